"""Operator 13: importance resampling towards a target distribution, in two Arrow passes.

The features of a text are its runs of consecutive words, hashed into buckets. The first pass counts buckets: each task
keeps one vector, np.bincount of its features, and a tree of tasks adds the vectors up, for the corpus and the target.
A bucket's gain is the logarithm of its two smoothed shares' ratio. The second pass gathers the broadcast gains and sums
them by document with bincount weights. Gumbel noise from a hash of the id makes the highest scores a draw without
replacement, with chances in proportion to the exponential of the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, Words, arrow_rows, materialise, running_total, table, text_blocks, tree_summed
from .decontaminate import SEPARATOR
from .sharding import nibbles

#: Words over this many bytes are hashed one by one.
LONG_WORD = 48


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = value >> np.uint32(1) ^ np.uint32(0xEDB88320) * (value & np.uint32(1))
    return value


CRC = _crc_table()


def crc_onward(state: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes raw[start:end] of each: all words together, byte by byte, the longest first."""
    size = end - start
    out = state.copy()
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = zlib.crc32(raw[start[i] : end[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    short = np.where(size > LONG_WORD, 0, size).astype(np.uint8)
    order = np.argsort(LONG_WORD - short, kind="stable")
    register, at = out[order], start[order]
    longer = len(short) - np.cumsum(np.bincount(short, minlength=LONG_WORD + 1))  # how many words go on beyond each length
    for j, k in enumerate(longer.tolist()):
        if not k:
            break
        now = register[:k]
        register[:k] = CRC[(now ^ raw[at[:k] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out[order] = register
    return out


@dataclass(frozen=True)
class Features:
    """Runs of 1 to most words, in buckets."""

    most: int = 1
    buckets: int = 10_000

    def of(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document number, bucket) of each feature of a block, and the number of words of each document."""
        words = Words(raw, offsets, SEPARATOR, lower=True)
        n = len(words.start)
        state = np.full(n, 0xFFFFFFFF, np.uint32)
        docs, found = [], []
        for k in range(min(self.most, n)):
            live = n - k  # runs of k + 1 words that begin at each of the first words
            state = state[:live]
            if k:
                state = CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
            state = crc_onward(state, words.raw, words.start[k:], words.end[k:])
            inside = words.doc[:live] == words.doc[k:]
            docs.append(words.doc[:live][inside])
            found.append((state[inside] ^ np.uint32(0xFFFFFFFF)) % np.uint32(self.buckets))
        none = np.zeros(0, np.int64)
        return np.concatenate(docs or [none]), np.concatenate(found or [none]).astype(np.int64), np.diff(words.first)


def bucket_counts(texts: DataFrame, features: Features) -> np.ndarray:
    """How often each bucket occurs in all rows of texts (column text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(features.buckets, np.int64)
        for _, raw, offsets in text_blocks(batches):
            total += np.bincount(features.of(raw, offsets)[1], minlength=features.buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["v"])

    return tree_summed(texts.select("text").mapInArrow(count, "v binary"), features.buckets)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths of a natural logarithm, whole and rounded down."""
    s, t = corpus, target
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))))


def weighted(docs: DataFrame, target: DataFrame, features: Features) -> DataFrame:
    """doc_id, n_features, n_words, weight for each row of docs."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, features), bucket_counts(target, features)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("n_words", pa.int64()), ("weight", pa.int64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in text_blocks(batches):
            doc, bucket, n_words = features.of(raw, offsets)
            total = np.bincount(doc, gain.value[bucket], batch.num_rows)
            yield arrow_rows(schema, batch.column(0), np.bincount(doc, minlength=batch.num_rows), n_words, total.astype(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")


def resampled(docs: DataFrame, target: DataFrame, features: Features = Features(), percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs; rank: 1, 2, 3... of the rows drawn, else null.

    Of the N rows with least_words words or more, percent * N / 100 (rounded down) are drawn by the highest scores, ties
    by the smaller doc_id. Nulls: a null text has no words, in docs and in target; a null doc_id is returned as null, is
    hashed as an empty text and comes after every other in ties. Repeated rows are each counted and ranked, in any order
    among themselves. An empty target or table smooths to even shares; an empty docs gives no rows; other columns are
    ignored. Weights are whole numbers, exact in doubles up to 2^53. Every vector has features.buckets numbers, whatever
    the tables; ranks come from range-sorted running totals, and only the number of rows reaches the driver.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    rows = materialise(weighted(docs, target, features).withColumn("score", F.col("weight") + noise))
    able = rows.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = able.withColumn("_low", -F.col("score")).withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID)))
    ranked = running_total(order, [], ["_low", "_id"], F.lit(1).cast("long"), "_before").withColumn("rank", F.when(F.col("_before") < drawn, F.col("_before") + 1))
    columns = ["doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    return ranked.select(*columns).unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB has no crc32: that of each distinct word is folded half byte by half byte.
OP13_SQL = rf"""
WITH base AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
goal AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
counts AS (SELECT rn, x, count(*) AS k FROM (SELECT rn, unnest(w) AS x FROM base) GROUP BY rn, x),
goals AS (SELECT x, count(*) AS k FROM goal GROUP BY x),
spelt AS (SELECT x, hex(encode(x)) AS hx FROM (SELECT x FROM counts UNION SELECT x FROM goals)),
hashed AS (SELECT x, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(hx)), lambda i:
    CAST(strpos('0123456789ABCDEF', hx[i + 2 - 2 * (i % 2)]) - 1 AS BIGINT))),
    lambda c, v: xor(CAST(list_extract({nibbles()}, (xor(c, v) & 15) + 1) AS BIGINT), c >> 4)), CAST(4294967295 AS BIGINT)) % 10000 AS bucket FROM spelt),
corpus AS (SELECT bucket, sum(k) AS s FROM counts JOIN hashed USING (x) GROUP BY bucket),
target AS (SELECT bucket, sum(k) AS t FROM goals JOIN hashed USING (x) GROUP BY bucket),
sums AS (SELECT CAST(coalesce((SELECT sum(s) FROM corpus), 0) AS DOUBLE) AS s_all, CAST(coalesce((SELECT sum(t) FROM target), 0) AS DOUBLE) AS t_all),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((coalesce(s, 0) + 1) * (t_all + 10000)))) AS BIGINT) AS g FROM corpus FULL JOIN target USING (bucket), sums),
weights AS (SELECT rn, CAST(sum(k * g) AS BIGINT) AS weight FROM counts JOIN hashed USING (x) JOIN gain USING (bucket) GROUP BY rn),
drawn AS (SELECT rn, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    CAST(concat('0x', substr(sha256(concat('2024:', CAST(doc_id AS VARCHAR))), 1, 8)) AS BIGINT) AS h FROM base LEFT JOIN weights USING (rn)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM drawn),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked
"""
