"""Operator 5: benchmark decontamination through a distributed positional inverted index.

`build_index` stores, for each block of training documents, the sorted positions (postings) of every test term and a
directory of its documents. The test side is a table too: its windows are exploded by Spark, their terms joined with the
index's counts, and each window goes to the blocks that hold its corpus-wide rarest term. There `phrase_matches`
intersects the offset-adjusted postings of its terms from that term on; `proximity_matches` finds terms near each other.
No list of a term is ever whole in one task: postings are cut by block, so a term of every document costs each task its
block's share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, Words, arrow_rows, doc_key, materialise, small_side, span_hash, table, text_blocks

WINDOW = 13
#: Positions left free between two documents of a block, so that no phrase runs over.
GAP = WINDOW
#: Up to so many distinct test terms are sent to all tasks, to leave other terms out of the index; with more it holds them all.
MOST_TERMS = 1_000_000
WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # the contract's words, after lower-casing A-Z
SEPARATOR = np.ones(256, bool)
SEPARATOR[0x30:0x3A] = SEPARATOR[0x61:0x7B] = SEPARATOR[0x80:] = SEPARATOR[0x41:0x5B] = False
INDEX = pa.schema([("block", pa.int64()), ("term", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
MATCH = "block long, doc int, item string, start int, length int"


def term_hashes(text: str | None) -> np.ndarray:
    """The hashes of a text's words, equal to those of Words over the same bytes."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    spans = [m.span() for m in WORD_BYTES.finditer(raw.tobytes())]
    at = np.array(spans, np.int64).reshape(-1, 2)
    return span_hash(raw, at[:, 0], at[:, 1]).view(np.int64)


def build_index(docs: DataFrame, terms: np.ndarray | None) -> DataFrame:
    """Rows (block, term, n, postings) and, with n below 0, (block, 0, n, directory of documents). terms: those to keep, None for all."""
    sent = docs.sparkSession.sparkContext.broadcast(None if terms is None else np.unique(terms))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, block = sent.value, TaskContext.get().partitionId() << 32
        for batch, raw, offsets in text_blocks(batches):
            words = Words(raw, offsets, SEPARATOR, lower=True)
            term = words.hash.view(np.int64)
            position = (np.arange(len(term)) + GAP * words.doc).astype(np.int32)
            if keep is not None and len(term):
                known = keep[np.minimum(np.searchsorted(keep, term), len(keep) - 1)] == term if len(keep) else np.zeros(len(term), bool)
                term, position = term[known], position[known]
            order = np.argsort(term, kind="stable")
            term, position = term[order], position[order]
            cuts = np.flatnonzero(np.diff(term, prepend=term[:1] - 1)) if len(term) else np.zeros(0, np.int64)
            ends = np.append(cuts[1:], len(term))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            firsts = words.first[:-1] + GAP * np.arange(len(ids))
            directory = np.stack([ids, firsts, np.diff(words.first)]).astype(np.int64).tobytes()
            data = [position[a:b].tobytes() for a, b in zip(cuts, ends if len(cuts) else [], strict=False)]
            yield arrow_rows(INDEX, [block] * (len(data) + 1), [*term[cuts].tolist(), 0], [*(ends[: len(cuts)] - cuts).tolist(), -len(ids)], [*data, directory])
            block += 1

    return materialise(docs.select(doc_key().alias("doc_id"), "text").mapInArrow(index, "block long, term long, n long, data binary"))


def document_rows(index: DataFrame) -> DataFrame:
    """block, doc (number in its block), doc_id, n_words of each indexed document."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, data in zip(frame.block, frame.data, strict=True):
                ids, _, n = np.frombuffer(data, np.int64).reshape(3, -1)
                yield pd.DataFrame({"block": block, "doc": np.arange(len(ids), dtype=np.int32), "doc_id": ids, "n_words": n})

    return index.where("n < 0").select("block", "data").mapInPandas(rows, "block long, doc int, doc_id long, n_words long")


NO_MATCH = pd.DataFrame({"block": np.zeros(0, np.int64), "doc": np.zeros(0, np.int32), "item": np.zeros(0, object), "start": np.zeros(0, np.int32), "length": np.zeros(0, np.int32)})


class Postings:
    """The postings of one block: binary search in (term, position) pairs sorted together."""

    def __init__(self, frame: pd.DataFrame):
        own = frame[frame.n > 0].sort_values("term")
        self.terms = own.term.to_numpy(np.int64)
        lists = [np.frombuffer(x, np.int32) for x in own.data]
        self.count = np.array([len(x) for x in lists], np.int64)
        self.begin = np.append(0, np.cumsum(self.count))
        self.position = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
        self.pairs = (np.repeat(np.arange(len(lists)), self.count) << 33) + self.position
        self.firsts = np.frombuffer(frame.data[frame.n < 0].iloc[0], np.int64).reshape(3, -1)[1]

    def number(self, terms: np.ndarray) -> np.ndarray:
        """The block's number of each term, -1 if it has no postings here."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def has(self, number: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = (number << 33) + position
        at = np.minimum(np.searchsorted(self.pairs, want), max(len(self.pairs) - 1, 0))
        return (position >= 0) & (self.pairs[at] == want)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, position, "right") - 1


PHRASES = pa.schema([("item", pa.string()), ("terms", pa.list_(pa.int64()))])


def phrases_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """A saved table of phrase (number), item, terms: the distinct runs of size words of each item; one run if it has fewer; none without words."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in text_blocks(batches):
            words = Words(raw, offsets, SEPARATOR, lower=True)
            n = np.diff(words.first)
            runs = np.where(n > 0, np.maximum(1, n - size + 1), 0)
            doc = np.repeat(np.arange(len(n)), runs)
            start = words.first[doc] + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            term = words.hash.view(np.int64)
            yield arrow_rows(PHRASES, batch.column(0).take(pa.array(doc)), [term[a : a + min(size, n[d])] for a, d in zip(start, doc, strict=True)])

    runs = items.select("item", "text").mapInArrow(windows, "item string, terms array<long>").distinct()
    return materialise(runs.select(F.monotonically_increasing_id().alias("phrase"), "item", "terms"))


def possible_phrases(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """item, length, shifts, terms of the phrases that the corpus can hold, terms from the corpus-wide rarest on."""
    counts = materialise(index.where("n > 0").groupBy("term").agg(F.sum("n").alias("n")))
    each = phrases.select("phrase", "item", F.size("terms").alias("length"), F.posexplode("terms").alias("at", "term"))
    found = each.join(small_side(counts), "term").groupBy("phrase", "item", "length").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("by"))
    return found.where(F.size("by") == F.col("length")).select("item", "length", F.transform("by", lambda x: x["at"]).alias("shifts"), F.transform("by", lambda x: x["term"]).alias("terms"))


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """block, doc, item, start (word of the document), length of every exact occurrence of a phrase of at most GAP terms.

    phrases: of phrases_of. A phrase meets only the blocks that have its rarest term.
    """
    ordered = materialise(possible_phrases(index, phrases))
    lead = ordered.select("*", F.col("terms")[0].alias("lead"))
    asked = index.where("n > 0").select(F.col("block").alias("in_block"), F.col("term").alias("lead")).join(lead, "lead").select("in_block", "item", "length", "shifts", "terms")

    def intersect(lists: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(lists) or not len(wanted):
            return NO_MATCH
        block = Postings(lists)
        length = wanted.length.to_numpy(np.int64)
        most = int(length.max())
        pad = np.arange(most)[None] < length[:, None]  # a shorter phrase asks for its rarest term again
        terms, shift = (np.zeros((len(wanted), most), np.int64) for _ in range(2))
        for out, column in ((terms, wanted.terms), (shift, wanted.shifts)):
            out[pad] = np.concatenate(column.tolist())
            out[:] = np.where(pad, out, out[:, :1])
        number = block.number(terms)
        here = np.flatnonzero((number >= 0).all(axis=1))
        n = block.count[number[here, 0]]
        which = np.repeat(here, n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = block.position[block.begin[number[which, 0]] + inner] - shift[which, 0] if len(which) else np.zeros(0, np.int64)
        for j in range(1, most):  # each further list keeps the starts it has too
            if not len(which):
                break
            ok = block.has(number[which, j], start + shift[which, j])
            which, start = which[ok], start[ok]
        doc = block.document(start)
        first = block.firsts[doc] if len(which) else np.zeros(0, np.int64)
        return pd.DataFrame({"block": np.full(len(which), lists.block.iloc[0]), "doc": doc.astype(np.int32), "item": wanted["item"].to_numpy()[which], "start": (start - first).astype(np.int32), "length": length[which].astype(np.int32)})

    return index.groupBy("block").cogroup(asked.groupBy("in_block")).applyInPandas(intersect, MATCH)


def proximity_matches(index: DataFrame, queries: list[tuple[str, np.ndarray]], slop: int) -> DataFrame:
    """Occurrences (as in phrase_matches; start: of the rarest term) where all terms of a query lie within slop words of its rarest one in the same document."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        block, found = Postings(frame), []
        for item, terms in sent.value:
            number = block.number(terms)
            if len(terms) and (number >= 0).all():
                lists = sorted((block.position[block.begin[i] : block.begin[i + 1]] for i in number), key=len)
                at = lists[0]
                doc = block.document(at)
                for other in lists[1:]:
                    low = np.maximum(at - slop, block.firsts[doc])
                    k = np.searchsorted(other, low)
                    ok = k < len(other)
                    hit = other[np.minimum(k, len(other) - 1)]
                    ok &= (hit <= at + slop) & (block.document(hit) == doc)
                    at, doc = at[ok], doc[ok]
                found.append(pd.DataFrame({"block": frame.block.iloc[0], "doc": doc.astype(np.int32), "item": item, "start": (at - block.firsts[doc]).astype(np.int32), "length": np.full(len(at), len(terms), np.int32)}))
        return pd.concat(found) if found else NO_MATCH

    return index.groupBy("block").applyInPandas(near, MATCH)


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    Nulls: a null text has no words, a null doc_id is returned as null, a null item_id counts as the text 'null'.
    Repeated rows are judged each; repeated items count once; other columns are ignored. An empty benchmark contaminates
    nothing, an empty table gives no rows. Neither side passes through the driver, but for the distinct test terms if
    there are at most MOST_TERMS of them.
    """
    phrases = phrases_of(bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text"))
    terms = phrases.select(F.explode("terms").alias("term")).distinct().limit(MOST_TERMS + 1).toPandas().term.to_numpy(np.int64)
    index = build_index(docs, terms if len(terms) <= MOST_TERMS else None)
    found = phrase_matches(index, phrases)
    covered = F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(start, start + length - 1)"))))
    hits = found.groupBy("block", "doc").agg(F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    every = document_rows(index).join(hits, ["block", "doc"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    named = F.coalesce("items", F.array().cast("array<string>"))
    return every.select(
        F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH base AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (SELECT rn, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM base, sizes)),
hits AS (SELECT rn, item, n, i FROM places JOIN grams USING (n, g)),
counts AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rn),
names AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item FROM hits) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM base LEFT JOIN counts USING (rn) LEFT JOIN names USING (rn)
"""
