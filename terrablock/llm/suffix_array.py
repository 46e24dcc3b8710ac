"""Operator 9: substring dedup over bytes with two-stage suffix sorting.

Windows of 100 bytes are taken by their anchor (see repeats): windows in a row with one anchor make a stretch, and only
stretches whose anchor repeats take part. Equal stretches are combined first. The distinct stretches of each anchor meet
in one task, are set one after another and suffix-sorted in two stages: suffixes smaller than their successors directly,
the rest induced by bucket scans. Neighbours with a common prefix of 100 bytes or more are the repeats. Stretches of an
anchor with very many are cut anew by longer anchors, until so few share one that they can be sorted together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE, SpanHash, arrow_rows, minima, span_hash, table, text_blocks
from .repeats import CUT, STRETCH, Stretches, buckets_for, distinct_texts, keyed, positions_of, real_id, repeated_anchors, repeated_stretches, same_text, with_positions

WINDOW = 100
#: Lengths of anchors. The stretches of an anchor with over GROUP distinct ones are cut by the next length; windows that
#: share an anchor of WINDOW bytes are equal, so the last length leaves one distinct stretch.
ANCHORS = (24, 60, 88, WINDOW)
GROUP = 2_000
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


class Windows:
    """The windows of a block: start and anchor (position of the leftmost smallest hash) of each, PIECE bytes at a time."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int):
        n = max(len(raw) - WINDOW + 1, 0)
        best = np.zeros(n, np.int64)
        for a in range(0, n, PIECE):
            b = min(n, a + PIECE)
            part = raw[a : b + WINDOW - 1]
            at = np.arange(len(part) - length + 1)
            best[a:b] = minima(SpanHash(part)(at, at + length), WINDOW - length + 1) + a
        long = np.flatnonzero(np.diff(offsets) >= WINDOW)
        edge = np.zeros(n + 1, np.int8)
        edge[offsets[long]] += 1
        edge[offsets[long + 1] - WINDOW + 1] -= 1
        self.start = np.flatnonzero(np.cumsum(edge[:n], dtype=np.int8))
        self.anchor = best[self.start]
        self.raw, self.offsets, self.length = raw, offsets, length

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def hash(self, at: np.ndarray) -> np.ndarray:
        """Of the anchors at these rising positions."""
        return span_hash(self.raw, at, at + self.length)

    def runs(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end in bytes, anchor's hash) of the stretches: runs of kept windows with one anchor."""
        start, anchor = self.start[keep], self.anchor[keep]
        if not len(start):
            return start, start, np.zeros(0, np.uint64)
        first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
        last = np.append(first[1:], len(start)) - 1
        return start[first], start[last] + WINDOW, self.hash(anchor[first])


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = Windows(raw, offsets, ANCHORS[0])
    at = np.unique(w.anchor)
    doc = w.owner(at)
    return doc, at - offsets[doc], w.hash(at)


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of windows whose anchor is among the row's positions."""
    for batch, raw, offsets in text_blocks(batches):
        w = Windows(raw, offsets, ANCHORS[0])
        doc, pos = positions_of(batch)
        wanted = np.zeros(len(raw) + 1, bool)
        wanted[np.minimum(offsets[doc] + pos, len(raw))] = True
        a, b, h = w.runs(wanted[w.anchor])
        own = w.owner(a)
        ids, keys = (batch.column(i).to_numpy(zero_copy_only=False)[own] for i in (0, 1))
        yield arrow_rows(STRETCH, h.view(np.int64), [raw[i:j].tobytes() for i, j in zip(a, b, strict=True)], ids, keys, (a - offsets[own]).astype(np.int32), (b - a - WINDOW + 1).astype(np.int32))


def recut(length: int) -> Callable:
    """Stretches (h, cid, ctx, id, start) cut by anchors of this length; at: where the part starts in the whole."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in text_blocks(batches, "ctx"):
            w = Windows(raw, offsets, length)
            a, b, h = w.runs(np.ones(len(w.start), bool))
            own = w.owner(a)
            at = (a - offsets[own]).astype(np.int32)
            up_h, up_cid, ids, start = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[own] for c in ("h", "cid", "id", "start"))
            yield arrow_rows(CUT, h.view(np.int64), [raw[i:j].tobytes() for i, j in zip(a, b, strict=True)], ids, start + at, (b - a - WINDOW + 1).astype(np.int32), up_h, up_cid, at)

    return cut


def two_stage(text: np.ndarray) -> np.ndarray:
    """Suffixes of text (uint8) in the order of their first WINDOW symbols at least."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    end = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # last place of each run of one symbol
    rises = np.append(text[end[:-1]] < text[end[:-1] + 1], False)
    small = np.repeat(rises, np.diff(end, prepend=-1))  # suffixes smaller than their successors
    direct = np.flatnonzero(small)
    padded = np.append(text, np.zeros(WINDOW + 4, np.uint8))
    heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 4)[direct])
    direct = direct[np.argsort(heads.view(f"S{WINDOW + 4}").ravel(), kind="stable")]
    cut = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []

    def induce(placed: np.ndarray, c: int) -> np.ndarray:
        """Sends the larger predecessors of placed to their buckets; those of the same bucket are returned."""
        before = placed - 1
        before = before[before >= 0]
        before = before[~small[before]]
        symbol = text[before]
        same = before[symbol == c]
        before, symbol = before[symbol != c], symbol[symbol != c]
        by = np.argsort(symbol, kind="stable")
        before, symbol = before[by], symbol[by]
        edge = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])) if len(symbol) else np.zeros(0, np.int64)
        for part, s in zip(np.split(before, edge[1:]) if len(edge) else [], symbol[edge], strict=True):
            waiting[s].append(part)
        return same

    for c in range(256):
        current = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(current):
            out.append(current)
            current = induce(current, c)
        own = direct[cut[c] : cut[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    return np.concatenate(out)


def later_windows(contexts: list[bytes], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the context, offset) of the windows that also stand at a smaller (id, position) in another context."""
    size = np.array([len(x) for x in contexts], np.int64)
    begin = np.append(0, np.cumsum(size + 1))
    text = np.minimum(np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8), 254) + np.uint8(1)
    text[begin[1:] - 1] = 0  # 0 parts the contexts; UTF-8 has no bytes over 0xF7
    order = two_stage(text)
    owner = np.repeat(np.arange(len(contexts)), size + 1)
    offset = order - begin[owner[order]]
    full = offset <= size[owner[order]] - WINDOW
    order, offset = order[full], offset[full]
    padded = np.append(text, np.zeros(WINDOW + 4, np.uint8))
    heads = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    common = np.zeros(len(order), np.int64)  # of each suffix with the one before
    for a in range(1, len(order), 1 << 17):
        b = min(len(order), a + (1 << 17))
        same = heads[order[a:b]] == heads[order[a - 1 : b - 1]]
        common[a:b] = np.where(same.all(axis=1), WINDOW, same.argmin(axis=1))
    group = np.cumsum(common < WINDOW)
    who = owner[order]
    place = starts[who] + offset
    by = np.lexsort((place, ids[who], group))
    lead = np.flatnonzero(np.append(True, group[by][1:] != group[by][:-1])) if len(by) else np.zeros(0, np.int64)
    first = np.repeat(by[lead], np.diff(np.append(lead, len(by))))
    late = (ids[who[by]] > ids[who[first]]) | (place[by] > place[first])
    return who[by][late], offset[by][late]


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    Each byte covered by a string of WINDOW bytes that also starts earlier (in a smaller doc_id, or before in the same
    document) goes; strings are judged on the input and never cross documents. Nulls: a null text has no bytes; a null
    doc_id orders after every other and is returned as null. Repeated rows do not remove each other's bytes and each come
    out once, with the same result; different texts of one doc_id are compared by position. Texts under WINDOW bytes keep all; an empty table gives no rows; other
    columns are ignored. A long text is hashed piece by piece; about ten bytes for each of its bytes are held beside it.
    """
    rows = keyed(docs)
    meta, texts = distinct_texts(rows)
    held = with_positions(texts, repeated_anchors(texts, anchors, buckets_for(meta), across=False))
    kind = Stretches(ANCHORS, GROUP, stretches, recut, later_windows, by_place=True)
    marks = repeated_stretches(held, kind).groupBy("id", "key").agg(F.flatten(F.collect_list("r")).alias("r"))
    marked = held.select("id", "key", "text").join(marks, ["id", "key"]).select("id", "key", "text", F.col("r.a").alias("pos"), F.col("r.b").alias("till"))
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("removed", pa.int64()), ("spans", pa.int64()), ("sha", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in text_blocks(batches):
            doc, a = positions_of(batch, "pos")
            _, b = positions_of(batch, "till")
            edge = np.zeros(len(raw) + WINDOW + 1, np.int32)
            np.add.at(edge, offsets[doc] + a, 1)
            np.add.at(edge, offsets[doc] + b - 1 + WINDOW, -1)
            gone = np.cumsum(edge[: len(raw)], dtype=np.int32) > 0
            removed, spans, sha = [], [], []
            for d in range(batch.num_rows):
                own, text = gone[offsets[d] : offsets[d + 1]], raw[offsets[d] : offsets[d + 1]]
                removed.append(int(own.sum()))
                spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
                sha.append(hashlib.sha256(text[~own].tobytes()).hexdigest())
            yield arrow_rows(schema, batch.column(0), batch.column(1), removed, spans, sha)

    results = marked.mapInArrow(cut, "id long, key long, removed long, spans long, sha string").withColumnsRenamed({"id": "_id", "key": "_key"})
    joined = meta.join(results, same_text("_id", "_key"), "left")
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_bytes") >= WINDOW)  # an earlier document has the same text
    zero = F.lit(0).cast("long")
    return joined.select(
        real_id(F.col("id")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("sha", F.lower(F.hex("sig")))).alias("kept_sha256"),
    )


def op9_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"))


#: In hexadecimal, two digits a byte: a string of 100 bytes is 200 digits that start at an odd place.
OP9_SQL = """
WITH base AS (SELECT row_number() OVER () AS rn, coalesce(doc_id, 9223372036854775807) AS id, doc_id, lower(hex(encode(coalesce(text, '')))) AS x, coalesce(octet_length(encode(text)), 0) AS n FROM documents),
wins AS (SELECT rn, id, i, md5(x[2 * i - 1:2 * i + 198]) AS g FROM (SELECT rn, id, x, unnest(range(1, n - 98)) AS i FROM base)),
low AS (SELECT g, min(struct_pack(id := id, i := i)) AS m FROM wins GROUP BY g),
late AS (SELECT rn, i FROM wins JOIN low USING (g) WHERE m < struct_pack(id := id, i := i)),
edge AS (SELECT rn, i, i - coalesce(lag(i) OVER (PARTITION BY rn ORDER BY i), -100) > 100 AS opens FROM late),
runs AS (SELECT rn, min(i) AS a, max(i) + 100 AS b FROM (SELECT rn, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY rn ORDER BY i) AS r FROM edge) GROUP BY rn, r),
cut AS (SELECT rn, sum(b - a) AS removed, count(*) AS spans, list(struct_pack(a := a, b := b) ORDER BY a) AS l FROM runs GROUP BY rn),
keep AS (SELECT rn, list_zip(list_concat([1], list_transform(l, lambda s: s.b)), list_concat(list_transform(l, lambda s: s.a), [n + 1])) AS k FROM cut JOIN base USING (rn))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN k IS NULL THEN sha256(unhex(x)) ELSE sha256(unhex(array_to_string(list_transform(k, lambda s: x[2 * s[1] - 1:2 * s[2] - 2]), ''))) END AS kept_sha256
FROM base LEFT JOIN cut USING (rn) LEFT JOIN keep USING (rn)
"""
