"""Which texts may repeat: distinct texts, and anchors (content-chosen positions) whose hash occurs again in the corpus.

Every window of the wanted length contains exactly one anchor that is its own (the leftmost smallest hash of the short
strings inside), so equal windows have equal anchors, and a window whose anchor is unique is unique. Anchors are a small
part of all positions. Each task packs them into one binary row per bucket of hashes and block of text, and reports
those that repeat inside its block itself, sending on two of them: a hash that every document has costs its bucket two
entries per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, arrow_rows, doc_key, join_by_key, materialise, small_side, text_blocks

#: Anchors are combined over this much text before they are sent; a bucket holds the anchors of about this much text.
COMBINE, BUCKET = 16 << 20, 32 << 20
LEAST_BUCKETS = 256


def keyed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """id (null: NO_ID), text (null: empty), n_bytes, key: a hash of both and the seed. id and key name the text of a row;
    repeated rows share them."""
    rows = docs.select(doc_key().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("key", F.xxhash64("id", "text", F.lit(seed)))


def same_text(id_col: str, key_col: str) -> Column:
    return (F.col("id") == F.col(id_col)) & (F.col("key") == F.col(key_col))


def distinct_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(meta, texts) of keyed rows. meta: id, key, n_bytes, sig, first_id (smallest id with the same text), one row each;
    texts: the keyed rows that have the first id of their text. Only hashes are shuffled, unless the copies are many."""
    sums = rows.select("id", "key", "n_bytes", F.unhex(F.sha2("text", 256)).alias("sig"))
    named = materialise(sums)
    first = materialise(named.groupBy("sig").agg(F.min("id").alias("first_id"), F.count("*").alias("n")))
    meta = materialise(join_by_key(named, first, ["sig"]).select("id", "key", "n_bytes", "sig", "first_id"))
    copies = meta.where("id > first_id").select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct()
    return meta, rows.join(small_side(copies), same_text("_id", "_key"), "left_anti")


def buckets_for(rows: DataFrame) -> int:
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    return max(LEAST_BUCKETS, int(total // BUCKET))


def repeated(h: np.ndarray, key: np.ndarray, pos: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (h, key, pos) without doubles; whether each one's hash repeats (across: in another text); the first row of each hash."""
    order = np.lexsort((pos, key, h))
    h, key, pos = h[order], key[order], pos[order]
    if len(h):
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
        h, key, pos = h[fresh], key[fresh], pos[fresh]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(h)))
    many = key[start] != key[start + count - 1] if across else count > 1
    return h, key, pos, np.repeat(many, count), start


ROWS = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("hit", pa.bool_()), ("data", pa.binary())])
ROWS_SQL = "bucket int, n int, hit boolean, data binary"
FOUND = "key long, pos array<int>"


def by_key(key: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return pd.DataFrame({"key": key[start], "pos": pd.Series(np.split(pos.astype(np.int32), start[1:]) if len(start) else [], dtype=object)})


def repeated_anchors(texts: DataFrame, anchors: Callable, n_buckets: int, across: bool) -> DataFrame:
    """key, positions of the anchors of each text whose hash repeats elsewhere.

    texts: key, text. anchors(raw, offsets) gives (document number, position in it, hash) arrays of a block.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def combined() -> Iterator[pa.RecordBatch]:
            h, key, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            h, key, pos, many, start = repeated(h, key, pos, across)
            keep = ~many
            keep[start] = True
            last = np.append(start[1:], len(h)) - 1 if len(start) else start
            keep[last] = True  # of a repeated hash the first and the last, which differ
            for hit, pick in ((False, keep), (True, many)):
                a, k, p = h[pick], key[pick], pos[pick]
                bucket = ((k if hit else a).view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                a, k, p, bucket = a[order], k[order], p[order], bucket[order]
                cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
                some = np.flatnonzero(np.diff(cut))
                data = [(b"" if hit else a[cut[b] : cut[b + 1]].tobytes()) + k[cut[b] : cut[b + 1]].tobytes() + p[cut[b] : cut[b + 1]].astype(np.int32).tobytes() for b in some]
                yield arrow_rows(ROWS, some, np.diff(cut)[some], np.full(len(some), hit), data)

        for batch, raw, offsets in text_blocks(batches):
            doc, pos, h = anchors(raw, offsets)
            held.append((h, batch.column(0).to_numpy(zero_copy_only=False)[doc], pos.astype(np.int64)))
            size += len(raw)
            if size >= COMBINE:
                yield from combined()
                held, size = [], 0
        if held:
            yield from combined()

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        h, key, pos = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        hit_key, hit_pos = [], []
        for n, hit, data in zip(frame.n, frame.hit, frame.data, strict=True):
            at = 0 if hit else 8 * n
            k, p = np.frombuffer(data, np.int64, n, at), np.frombuffer(data, np.int32, n, at + 8 * n)
            if hit:
                hit_key.append(k)
                hit_pos.append(p)
            else:
                h.append(np.frombuffer(data, np.uint64, n))
                key.append(k)
                pos.append(p)
        _, key, pos, many, _ = repeated(np.concatenate(h), np.concatenate(key), np.concatenate(pos), across)
        return by_key(np.concatenate([key[many], *hit_key]), np.concatenate([pos[many], *hit_pos]))

    sent = texts.select("key", "text").mapInArrow(send, ROWS_SQL)
    return sent.groupBy("bucket").applyInPandas(gather, FOUND)


def with_positions(texts: DataFrame, found: DataFrame) -> DataFrame:
    """id, key, text, pos of the texts that have positions in found, one row for all repeated rows of a text: only these texts are shuffled and kept."""
    lists = materialise(found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pos")))).alias("pos")))
    some = small_side(lists.select("key"), 1_000_000)
    held = materialise(texts.join(some, "key", "left_semi").select("id", "key", "text").join(lists, "key").select("id", "key", "text", "pos"))
    both = ["id", "key"]
    again = materialise(held.groupBy(*both).agg(F.count("*").alias("n")).where("n > 1").select(*both))
    if again.isEmpty():
        return held
    again = small_side(again)
    return materialise(held.join(again, both, "left_anti").unionByName(held.join(again, both, "left_semi").dropDuplicates(both)))


def real_id(column):
    return F.nullif(column, F.lit(NO_ID))


def positions_of(batch: pa.RecordBatch, name: str = "pos") -> tuple[np.ndarray, np.ndarray]:
    """(document number in the batch slice, position) of its lists of positions."""
    lists = batch.column(batch.schema.get_field_index(name))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), flat.astype(np.int64)



# ---------------------------------------------------------------- stretches of windows with one anchor

#: Bytes of stretches solved together in one task.
TEXT = 1 << 20
STRETCH = pa.schema([("h", pa.int64()), ("ctx", pa.binary()), ("id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])
STRETCH_SQL = "h long, ctx binary, id long, key long, start int, windows int"
CUT = pa.schema([("h", pa.int64()), ("ctx", pa.binary()), ("id", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("up_h", pa.int64()), ("up_cid", pa.int64()), ("at", pa.int32())])
CUT_SQL = "h long, ctx binary, id long, start int, windows int, up_h long, up_cid long, at int"
LATE = pa.schema([("h", pa.int64()), ("cid", pa.int64()), ("off", pa.list_(pa.int32()))])


@dataclass(frozen=True)
class Stretches:
    """How an operator cuts and solves stretches: lengths of anchors, most distinct stretches of one anchor that are solved
    together, the functions for Arrow batches that cut texts and stretches, the function that finds the later windows of
    some contexts (numbers and offsets), and whether a place in the same document counts as earlier."""

    anchors: tuple[int, ...]
    group: int
    cut: Callable
    recut: Callable
    later: Callable
    by_place: bool


def sorted_groups(later: Callable) -> Callable:
    """For rows (h, cid, ctx, id, start) sorted by h: the later windows of whole groups of h, about TEXT bytes at a time."""

    def solve(frame: pd.DataFrame) -> pa.RecordBatch:
        frame = frame[frame.groupby("h")["cid"].transform("size") > 1].reset_index(drop=True)  # one stretch repeats nothing of itself
        if not len(frame):
            return arrow_rows(LATE, [], [], [])
        who, offset = later(frame.ctx.tolist(), frame.id.to_numpy(), frame.start.to_numpy().astype(np.int64))
        by = np.lexsort((offset, who))
        who, offset = who[by], offset[by].astype(np.int32)
        lead = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
        return arrow_rows(LATE, frame.h.to_numpy()[who[lead]], frame.cid.to_numpy()[who[lead]], [x for x in np.split(offset, lead[1:])] if len(lead) else [])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            frame = batch.to_pandas()
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            while len(held) > 1:
                total = held.ctx.str.len().cumsum().to_numpy()
                if total[-1] < TEXT:
                    break
                h = held.h.to_numpy()
                ends = np.flatnonzero(h[1:] != h[:-1]) + 1  # whole groups end here
                if not len(ends):
                    break
                k = min(int(np.searchsorted(total[ends - 1], TEXT)), len(ends) - 1)
                yield solve(held.iloc[: ends[k]])
                held = held.iloc[ends[k] :].reset_index(drop=True)
        if held is not None and len(held):
            yield solve(held)

    return groups


def first_places(found: DataFrame) -> DataFrame:
    """A saved table of the distinct stretches: h, cid, ctx, n (how many), id and start of the first of them."""
    first = found.groupBy("h", "cid", "ctx").agg(F.min(F.struct("id", "start")).alias("f"), F.count("*").alias("n"))
    return materialise(first.select("h", "cid", "ctx", "n", F.col("f.id").alias("id"), F.col("f.start").alias("start")))


def late_ranges(found: DataFrame, first: DataFrame, late: DataFrame, by_place: bool) -> DataFrame:
    """found with r, ranges (a, b exclusive) of its windows that also start earlier: all of a stretch that has an equal before it."""
    known = first.select("h", "cid", "n", F.col("id").alias("f_id"), F.col("start").alias("f_start")).join(late, ["h", "cid"], "left")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b")))
    part = F.transform("off", lambda x: F.struct(x.alias("a"), (x + 1).alias("b")))
    lead = (F.col("id") == F.col("f_id")) & ((F.col("start") == F.col("f_start")) if by_place else F.lit(True))
    return join_by_key(found, materialise(known), ["h", "cid"]).withColumn("r", F.when(lead, part).otherwise(whole)).where("r IS NOT NULL").drop("off")


def late_windows(first: DataFrame, kind: Stretches, level: int = 0) -> DataFrame:
    """h, cid, off: the offsets of the windows of each distinct stretch that also start earlier in another of its anchor."""
    per = materialise(first.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"))
    few = first.join(small_side(per.where(F.col("m") <= kind.group).select("h"), 1_000_000), "h")
    late = few.select("h", "cid", "ctx", "id", "start").repartition("h").sortWithinPartitions("h").mapInArrow(sorted_groups(kind.later), "h long, cid long, off array<int>")
    many = per.where(F.col("m") > kind.group).select("h")
    if level + 1 == len(kind.anchors) or many.isEmpty():  # windows with an anchor of their whole length are equal
        return late
    crowded = first.join(small_side(many), "h", "left_semi").select("h", "cid", "ctx", "id", "start")
    parts = materialise(crowded.mapInArrow(kind.recut(kind.anchors[level + 1]), CUT_SQL).withColumn("cid", F.xxhash64("ctx")))
    firsts = first_places(parts)
    placed = late_ranges(parts.drop("ctx"), firsts, late_windows(firsts, kind, level + 1), kind.by_place)
    offsets = F.flatten(F.transform("r", lambda x: F.sequence(x["a"] + F.col("at"), x["b"] - 1 + F.col("at"))))
    moved = placed.select(F.col("up_h").alias("h"), F.col("up_cid").alias("cid"), offsets.alias("off"))
    return late.unionByName(moved.groupBy("h", "cid").agg(F.flatten(F.collect_list("off")).alias("off")))


def repeated_stretches(held: DataFrame, kind: Stretches) -> DataFrame:
    """id, key, r: ranges of window starts (a, b exclusive) that also start earlier. held: id, key, text, pos."""
    every = materialise(held.mapInArrow(kind.cut, STRETCH_SQL).withColumn("cid", F.xxhash64("ctx")))
    first = first_places(every)
    placed = late_ranges(every.drop("ctx"), first, late_windows(first, kind), kind.by_place)
    return placed.select("id", "key", F.transform("r", lambda x: F.struct((F.col("start") + x["a"]).alias("a"), (F.col("start") + x["b"]).alias("b"))).alias("r"))
