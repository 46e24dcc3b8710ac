"""Operator 1: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, numbered, running_total, table


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard with the largest weight / -ln(u), u from md5(key:shard); a null key counts as the text 'null'.

    A shard's draw depends on the key and its own number alone, so one more shard only takes rows into itself.
    """
    name = F.coalesce(key.cast("string"), F.lit("null"))

    def draw(s: int, weight: float) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{s}"))), 1, 13), 16, 10).cast("double") + 1) / float((1 << 52) + 2)
        return F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(-s).alias("shard"))

    return (-F.array_max(F.array(*(draw(s, w) for s, w in enumerate(weights))))["shard"]).cast("int")


def with_slots(rows: DataFrame, shard: str, key: Column, order: list[str]) -> DataFrame:
    """Number the rows of each shard from 0 without gaps; no task holds a whole shard, or all rows of one key."""
    name = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":slot")))
    return running_total(materialise(rows.withColumn("_hash", name)), [shard], ["_hash", *order], F.lit(1), "slot").drop("_hash")


def shard_documents(docs: DataFrame, n_shards: int = 16, weights: list[float] | None = None, carry: list[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    Nulls: a null doc_id is a key of its own; a null text has size 1 and the checksum of the empty text. Repeated
    rows share a shard and get slots of their own; an empty table gives none. Of other columns, only carry's are kept.
    """
    weights = weights or [1.0] * n_shards
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), weights[:n_shards]).alias("shard"),
        shard_of(F.col("doc_id"), [*weights[:n_shards], 1.0]).alias("grown_shard"),
        *carry,
    )
    out = with_slots(rows, "shard", F.col("doc_id"), ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard", *carry)


def sharded_rows(docs: DataFrame, n_shards: int = 16, weights: list[float] | None = None) -> DataFrame:
    """The columns of shard_documents for each row of docs, then the other columns of docs; one whose name is taken gets _in behind it."""
    rows = numbered(docs)
    placed = shard_documents(rows.select("doc.doc_id", "doc.text", "row"), n_shards, weights, carry=["row"])
    names = [c for c in placed.columns if c != "row"]
    taken = {c.lower() for c in names}
    rest = []
    for c in docs.columns:
        if c.lower() != "doc_id":
            name = c
            while name.lower() in taken:
                name += "_in"
            taken.add(name.lower())
            rest.append(F.col("doc").getField(c).alias(name))
    return placed.join(rows, "row").select(*names, *rest)


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def nibbles() -> list[int]:
    """Remainders of the 16 half bytes under CRC-32's polynomial."""
    out = []
    for v in range(16):
        for _ in range(4):
            v = v >> 1 ^ 0xEDB88320 * (v & 1)
        out.append(v)
    return out


#: DuckDB has no crc32: each text's checksum is folded half byte by half byte.
OP1_SQL = f"""
WITH raw AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, hex(encode(coalesce(text, ''))) AS hx, string_split(hx, '') AS digits FROM documents),
sums AS (
  SELECT doc_id, key, CAST(len(hx) // 2 + 1 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(hx)), lambda i:
             CAST(strpos('0123456789ABCDEF', list_extract(digits, i + 2 - 2 * (i % 2))) - 1 AS BIGINT))),
             lambda c, x: xor(CAST(list_extract({nibbles()}, (xor(c, x) & 15) + 1) AS BIGINT), c >> 4)), CAST(4294967295 AS BIGINT)) AS text_crc32
  FROM raw),
draws AS (
  SELECT key, max_by(s, substr(md5(concat(key, ':', s)), 1, 13)) FILTER (WHERE s < 16) AS shard, max_by(s, substr(md5(concat(key, ':', s)), 1, 13)) AS grown
  FROM (SELECT DISTINCT key FROM raw), (SELECT CAST(range AS INTEGER) AS s FROM range(17)) GROUP BY key)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(concat(key, ':slot')), doc_id, size, text_crc32) - 1 AS slot, grown AS grown_shard
FROM sums JOIN draws USING (key)
"""
