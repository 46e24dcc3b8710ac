"""Helpers shared by the training-data operators: shared storage, hot-key-safe ordering, block tokenising."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a null document id inside the operators: it orders after every real id.
NO_ID = (1 << 63) - 1
#: Words of the near-duplicate contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: At most so many keys count as hot and are joined by broadcast (see join_by_key).
MOST_HOT = 10_000

_written: list[list[str]] = []  # tables written inside the open scratch blocks, innermost last


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set and Spark runs locally."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame, options: dict | None = None) -> DataFrame:
    """Write df once to the shared folder, with further options of the writer, and read it back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """A saved table of doc, a struct of all columns of docs, and row, a number of each row's own: decisions by row hold
    for repeated rows and null ids too, and no column of docs can clash with an operator's own."""
    return materialise(docs.select(F.expr("struct(*)").alias("doc"), F.monotonically_increasing_id().alias("row")))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what materialise wrote inside it; yields the list of these tables' paths, from which one that lives on is taken."""
    _written.append([])
    try:
        yield _written[-1]
    finally:
        for path in _written.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast df if it has few rows (counted first, of narrow columns); else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def doc_key(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def join_by_key(rows: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with per, which has one row for each key and in n how many of rows have it; both are saved tables.

    No task gathers a hot key: those of over 1 in MOST_HOT rows (and over 100), fewer than MOST_HOT in number whatever
    the rows, are joined by broadcast, and all others by a shuffle.
    """
    most = max(100, (per.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    hot, cold = per.where(F.col("n") > most), per.where(F.col("n") <= most)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def running_total(rows: DataFrame, groups: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add the sum of value over all earlier rows of the group, in the order given. rows: a saved table.

    The rows are range-sorted by group, order and, last, a number of their own, so that a group, one id or equal rows
    that are a third of all are cut into ranges as even as any others. Sums by group and range give each range its
    offset; a window inside (group, range) gives the rest. Offsets: one row for each group and range that meet.
    """
    numbered = rows.withColumn("_number", F.monotonically_increasing_id())
    ranged = materialise(numbered.repartitionByRange(*groups, *order, "_number").withColumn("_range", F.spark_partition_id()))
    per = ranged.groupBy(*groups, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*(F.col(g).alias(f"_k_{g}") for g in [*groups, "_range"]), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*groups, "_range").orderBy(*order, "_number").rowsBetween(Window.unboundedPreceding, -1)
    here = ranged.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    same = [F.col(g).eqNullSafe(F.col(f"_k_{g}")) for g in [*groups, "_range"]]
    joined = here.join(small_side(offsets), same)
    return joined.withColumn(name, F.col("_offset") + F.col("_inner")).drop("_offset", "_inner", "_number", "_range", *(f"_k_{g}" for g in [*groups, "_range"]))


# ---------------------------------------------------------------- blocks of text inside Arrow tasks

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240601)
#: A random value for each byte and an odd base: the polynomial hash of words.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = _U(0xD1342543DE82EF95)
BASE_INV = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))
GRAM_MUL = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
BLOCK = 1 << 20
#: Bytes hashed at a time: memory doesn't grow with a block or a long text.
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_blocks(batches, column: str = "text", block: int = BLOCK):
    """Yield (record batch slice, bytes, offsets) of at most about block bytes; a longer text comes alone. Null text is empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if len(texts) == 0:
            continue
        texts = pyarrow.compute.fill_null(texts.cast(pa.large_binary()), b"")
        buffers, at = texts.buffers(), texts.offset
        offsets = np.frombuffer(buffers[1], np.int64)[at : at + len(texts) + 1]
        raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + block, "right")) - 1)
            yield batch.slice(first, last - first), raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last
        del texts, buffers, raw, offsets
        pa.default_memory_pool().release_unused()


class Words:
    """The words of a block: start, end (bytes), document number and 64-bit hash of each; first[d]: number of d's first word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE, lower: bool = False):
        n = len(raw)
        self.raw = LOWER[raw] if lower else raw
        inside = ~separator[raw]
        starts = inside.copy()
        if n:
            starts[1:] &= ~inside[:-1]
            edge = offsets[(offsets > 0) & (offsets < n)]
            starts[edge] = inside[edge]
            ends = inside.copy()
            ends[:-1] &= ~inside[1:]
            ends[edge - 1] = inside[edge - 1]
            self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    @cached_property
    def hash(self) -> np.ndarray:
        return span_hash(self.raw, self.start, self.end)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether these lie in one document."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = self.hash[: n - k + 1] * GRAM_MUL[0]
        for j in range(1, k):
            out += self.hash[j : n - k + 1 + j] * GRAM_MUL[j]
        return mix(out), self.doc[: n - k + 1] == self.doc[k - 1 :]


STRIDE = 1 << 15  # powers are kept for so many exponents, and for so many multiples of it as a stretch needs


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSE = (_power_table(int(x), STRIDE) for x in (BASE, BASE_INV))
_LEAP, _LEAP_INVERSE = (_power_table(pow(int(x), STRIDE, 1 << 64), 1 << 10) for x in (BASE, BASE_INV))


class SpanHash:
    """64-bit hashes of stretches of raw, from one prefix sum."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.leap = (_LEAP, _LEAP_INVERSE) if n < STRIDE * len(_LEAP) else tuple(_power_table(pow(int(x), STRIDE, 1 << 64), n // STRIDE + 2) for x in (BASE, BASE_INV))
        self.total = np.zeros(n + 1, np.uint64)
        for k, a in enumerate(range(0, n, STRIDE)):
            part = raw[a : a + STRIDE]
            self.total[a + 1 : a + 1 + len(part)] = self.total[a] + np.cumsum(BYTE_VALUE[part] * _POWER[: len(part)]) * self.leap[0][k]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = _INVERSE[start & (STRIDE - 1)] * self.leap[1][start >> 15]
        return mix((self.total[end] - self.total[start]) * inverse + (end - start).astype(np.uint64) * _MUL)


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches raw[start:end], with starts and ends both in rising order, PIECE bytes at a time."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        a = start[i]
        j = max(i + 1, int(np.searchsorted(start, a + PIECE)))
        out[i:j] = SpanHash(raw[a : end[j - 1]])(start[i:j] - a, end[i:j] - a)
        i = j
    return out


def minima(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest of x[i:i+w] for each i."""
    n = len(x)
    if n < w:
        return np.zeros(0, np.int64)
    best, at, have = x.copy(), np.arange(n), 1
    while have < w:
        step = min(have, w - have)
        a, b = best[: len(best) - step], best[step:]
        right = b < a
        at = np.where(right, at[step:], at[: len(at) - step])
        best = np.where(right, b, a)
        have += step
    return at


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def arrow_rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def distinct_per_doc(doc: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """How many distinct values each document has."""
    _, first = np.unique(mix(value + doc.astype(np.uint64) * _MUL), return_index=True)
    return np.bincount(doc[first], minlength=n_docs)


def summed(partials: DataFrame) -> np.ndarray:
    """Element-wise sum of the column v (array<double>), a partial sum from each task; its length is fixed."""
    rows = partials.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r.i] = r.x
    return out


def tree_summed(partials: DataFrame, length: int) -> np.ndarray:
    """Element-wise sum of the column v (bytes of length float64), a partial sum from each task, merged in a tree of tasks."""
    context = partials.sparkSession.sparkContext
    vectors = partials.rdd.map(lambda r: np.frombuffer(r.v, np.float64))
    return context.parallelize([np.zeros(length)], 1).union(vectors).treeReduce(np.add)


def fold_of(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n
