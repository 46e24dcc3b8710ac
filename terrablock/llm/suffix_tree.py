"""Operator 7: substring dedup over words with prefix-partitioned suffix trees.

Windows of 13 words are taken by their anchor, the content-chosen word string in them with the smallest hash: windows in a
row with one anchor make a stretch, and only stretches whose anchor repeats in another text take part. So suffixes are
dealt by a prefix that each of them has at its anchor, and the prefix has a variable length: where very many distinct
stretches share one of 5 words, these are cut anew by prefixes of 9, 12 and 13, until a group fits into a task. In each
group a suffix tree is built over the window suffixes of the stretches, its edges spans of their words; its topmost nodes
13 words deep or more are the repeats, and each knows the smallest document below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, Words, arrow_rows, minima, small_side, table, text_blocks
from .repeats import CUT, STRETCH, Stretches, buckets_for, distinct_texts, keyed, positions_of, real_id, repeated_anchors, repeated_stretches, same_text, with_positions

WINDOW = 13
#: Lengths of prefixes in words, and how many distinct stretches a prefix may have before it is lengthened.
ANCHORS = (5, 9, 12, WINDOW)
GROUP = 2_000
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


class Windows:
    """The windows of a block as word numbers: start and anchor of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int):
        self.words = Words(raw, offsets)
        self.short, _ = self.words.grams(length)
        at = minima(self.short, WINDOW - length + 1)
        doc = self.words.doc
        self.start = np.flatnonzero(doc[: len(at)] == doc[WINDOW - 1 : WINDOW - 1 + len(at)]) if len(at) else np.zeros(0, np.int64)
        self.anchor = at[self.start]

    def place(self, word: np.ndarray) -> np.ndarray:
        """Numbers of words inside their documents."""
        return word - self.words.first[self.words.doc[word]]

    def runs(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, number of windows, anchor's hash) of the stretches: runs of kept windows with one anchor."""
        start, anchor = self.start[keep], self.anchor[keep]
        if not len(start):
            return start, start, np.zeros(0, np.uint64)
        first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
        return start[first], np.diff(np.append(first, len(start))), self.short[anchor[first]]

    def texts(self, first: np.ndarray, windows: np.ndarray) -> list[bytes]:
        """The words of each stretch with one blank between them, whatever stands there in the text."""
        w = self.words
        size = w.end - w.start + 1
        to = np.cumsum(size) - size
        whole = np.append(w.raw, np.uint8(32))[np.repeat(w.start - to, size) + np.arange(size.sum())]
        whole[to + size - 1] = 32
        line = whole.tobytes()
        last = first + windows - 1 + WINDOW - 1
        return [line[a:b] for a, b in zip(to[first], to[last] + size[last] - 1, strict=True)]


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = Windows(raw, offsets, ANCHORS[0])
    at = np.unique(w.anchor)
    return w.words.doc[at], w.place(at), w.short[at] if len(at) else np.zeros(0, np.uint64)


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of windows whose anchor is among the row's positions."""
    for batch, raw, offsets in text_blocks(batches):
        w = Windows(raw, offsets, ANCHORS[0])
        doc, pos = positions_of(batch)
        wanted = np.zeros(len(w.words.hash) + 1, bool)
        wanted[np.minimum(w.words.first[doc] + pos, len(w.words.hash))] = True
        first, n, h = w.runs(wanted[w.anchor])
        own = w.words.doc[first]
        ids, keys = (batch.column(i).to_numpy(zero_copy_only=False)[own] for i in (0, 1))
        yield arrow_rows(STRETCH, h.view(np.int64), w.texts(first, n), ids, keys, w.place(first).astype(np.int32), n.astype(np.int32))


def recut(length: int) -> Callable:
    """Stretches (h, cid, ctx, id, start) cut by prefixes of this length; at: the word where the part starts in the whole."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in text_blocks(batches, "ctx"):
            w = Windows(raw, offsets, length)
            first, n, h = w.runs(np.ones(len(w.start), bool))
            own, at = w.words.doc[first], w.place(first).astype(np.int32)
            up_h, up_cid, ids, start = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[own] for c in ("h", "cid", "id", "start"))
            yield arrow_rows(CUT, h.view(np.int64), w.texts(first, n), ids, start + at, n.astype(np.int32), up_h, up_cid, at)

    return cut


@dataclass(frozen=True)
class Tree:
    """A suffix tree over some suffixes of some contexts of words. Leaves stand in order: context and first word of each.

    Internal nodes: depth in words, the leaves below (first, last exclusive) and the edge above: context, first word and
    number of words. Of the root neither depth nor edge is more than 0.
    """

    who: np.ndarray
    at: np.ndarray
    depth: np.ndarray
    first: np.ndarray
    last: np.ndarray
    edge: np.ndarray


def suffix_tree(words: Words) -> Tree:
    """The tree of the suffixes with WINDOW words or more, each up to its context's end.

    Sorted suffixes and the words that neighbours share give the nodes: a node opens where the shared length rises and
    closes where it falls. Equal words have equal hashes, and that their bytes agree too is checked between neighbours.
    """
    n = np.diff(words.first)
    runs = np.maximum(n - WINDOW + 1, 0)
    who = np.repeat(np.arange(len(n)), runs)
    at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    symbol = np.append(np.unique(words.hash, return_inverse=True)[1] + 1, 0)  # 0 ends a suffix
    most = int(n.max(initial=0))
    steps = np.arange(most)
    place = words.first[who][:, None] + at[:, None] + steps
    table_ = symbol[np.where(at[:, None] + steps < n[who][:, None], place, len(symbol) - 1)]
    order = np.lexsort((who, *table_.T[::-1]))
    who, at, table_ = who[order], at[order], table_[order]
    differ = table_[1:] != table_[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    shared = np.minimum(shared, np.minimum(n[who[1:]] - at[1:], n[who[:-1]] - at[:-1]))
    line = words.raw.tobytes()
    begin = words.first[who] + at
    for k in np.flatnonzero(shared >= WINDOW):  # the bytes of the words that the two share
        a, b, s = begin[k], begin[k + 1], int(shared[k]) - 1
        if line[words.start[a] : words.end[a + s]] != line[words.start[b] : words.end[b + s]]:
            shared[k] = 0
    nodes: list[tuple[int, int, int, int]] = []  # depth, first leaf, last leaf, depth of the parent
    open_: list[tuple[int, int]] = [(0, 0)]
    for k, s in enumerate(np.append(shared, 0).tolist() if len(who) else []):
        left = k
        while open_[-1][0] > s:
            depth, left = open_.pop()
            nodes.append((depth, left, k + 1, max(s, open_[-1][0])))
        if open_[-1][0] < s:
            open_.append((s, left))
    nodes.append((0, 0, len(who), 0))
    depth, first, last, above = (np.array(x, np.int64) for x in zip(*nodes, strict=True))
    lead = np.minimum(first, max(len(who) - 1, 0))
    edge = np.stack([who[lead], at[lead] + above, depth - above], axis=1) if len(who) else np.zeros((1, 3), np.int64)
    return Tree(who, at, depth, first, last, edge)


def deep_nodes(tree: Tree) -> np.ndarray:
    """The numbers of the topmost nodes WINDOW words deep or more: their leaves are those that share a window."""
    return np.flatnonzero((tree.depth >= WINDOW) & (tree.depth - tree.edge[:, 2] < WINDOW))


def maximal_repeats(contexts: list[bytes]) -> list[tuple[bytes, int]]:
    """(words, places) of the strings of WINDOW words or more that stand at several places and can be lengthened on neither
    side without losing one of them, inside the contexts: nodes whose leaves have several words, or none, before them."""
    words = whole_words(contexts)
    tree = suffix_tree(words)
    lines = [x.split() for x in contexts]
    found = []
    for k in np.flatnonzero(tree.depth >= WINDOW):
        below = range(tree.first[k], tree.last[k])
        before = {lines[tree.who[i]][tree.at[i] - 1] if tree.at[i] else (tree.who[i],) for i in below}
        if len(before) > 1:
            i = tree.first[k]
            found.append((b" ".join(lines[tree.who[i]][tree.at[i] : tree.at[i] + tree.depth[k]]), len(below)))
    return found


def whole_words(contexts: list[bytes]) -> Words:
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    return Words(raw, np.append(0, np.cumsum([len(x) for x in contexts])), IS_SPACE)


def later_windows(contexts: list[bytes], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the context, offset in words) of the windows that also start in a context of a smaller document."""
    tree = suffix_tree(whole_words(contexts))
    deep = deep_nodes(tree)
    if not len(deep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = tree.last[deep] - tree.first[deep]
    leaf = np.repeat(tree.first[deep], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    doc = ids[tree.who[leaf]]
    low = np.repeat(np.minimum.reduceat(doc, np.cumsum(size) - size), size)
    late = leaf[doc > low]
    return tree.who[late], tree.at[late]


def dedup_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs.

    Each word covered by a window of WINDOW words that also starts in a document of a smaller doc_id goes; windows are
    judged on the input. Nulls: a null text has no words; a null doc_id orders after every other and is returned as null.
    Repeated rows (or different texts of one doc_id) do not remove each other's words; each comes out once, with the same result. Texts under WINDOW words keep all;
    an empty table gives no rows; other columns are ignored. A block, or a longer text alone, is held with some ten bytes
    for each of its bytes.
    """
    rows = keyed(docs)
    meta, texts = distinct_texts(rows)
    held = with_positions(texts, repeated_anchors(texts, anchors, buckets_for(meta), across=True))
    kind = Stretches(ANCHORS, GROUP, stretches, recut, later_windows, by_place=False)
    marks = repeated_stretches(held, kind).groupBy("id", "key").agg(F.flatten(F.collect_list("r")).alias("r"))
    marked = held.select("id", "key", "text").join(marks, ["id", "key"]).select("id", "key", "text", F.col("r.a").alias("pos"), F.col("r.b").alias("till"))
    cut_schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("removed", pa.int64()), ("sha", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in text_blocks(batches):
            words = Words(raw, offsets)
            doc, pos = positions_of(batch)
            _, till = positions_of(batch, "till")
            edge = np.zeros(len(words.hash) + WINDOW + 1, np.int64)
            np.add.at(edge, words.first[doc] + pos, 1)
            np.add.at(edge, words.first[doc] + till - 1 + WINDOW, -1)
            gone = np.cumsum(edge)[: len(words.hash)] > 0
            whole = raw.tobytes()
            removed, sha = [], []
            for d in range(batch.num_rows):
                own = range(words.first[d], words.first[d + 1])
                removed.append(int(gone[words.first[d] : words.first[d + 1]].sum()))
                sha.append(hashlib.sha256(b" ".join(whole[words.start[i] : words.end[i]] for i in own if not gone[i])).hexdigest())
            yield arrow_rows(cut_schema, batch.column(0), batch.column(1), removed, sha)

    plain_schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in text_blocks(batches):
            words = Words(raw, offsets)
            whole = raw.tobytes()
            sha = [hashlib.sha256(b" ".join(whole[offsets[d] : offsets[d + 1]].split())).hexdigest() for d in range(batch.num_rows)]
            yield arrow_rows(plain_schema, batch.column(0), batch.column(1), np.diff(words.first), sha)

    counts = rows.select("id", "key", "text").mapInArrow(plain, "id long, key long, n_words long, sha string")
    results = marked.mapInArrow(cut, "id long, key long, removed long, sha string").select(F.col("id").alias("_id"), F.col("key").alias("_key"), "removed", F.col("sha").alias("cut_sha"))
    firsts = meta.where("id > first_id").select(F.col("id").alias("_copy_id"), F.col("key").alias("_copy")).distinct()
    joined = counts.join(small_side(firsts), same_text("_copy_id", "_copy"), "left").join(results, same_text("_id", "_key"), "left")
    copy = F.col("_copy").isNotNull() & (F.col("n_words") >= WINDOW)  # an earlier document has the same text
    return joined.select(
        real_id(F.col("id")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH base AS (SELECT row_number() OVER () AS rn, coalesce(doc_id, 9223372036854775807) AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT rn, id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT rn, id, w, unnest(range(1, len(w) - 11)) AS i FROM base)),
low AS (SELECT g, min(id) AS m FROM wins GROUP BY g),
gone AS (SELECT DISTINCT rn, unnest(range(i, i + 13)) AS p FROM wins JOIN low USING (g) WHERE m < id),
words AS (SELECT rn, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM base),
kept AS (SELECT rn, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS n FROM words ANTI JOIN gone USING (rn, p) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM base LEFT JOIN kept USING (rn)
"""
