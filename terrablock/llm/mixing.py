"""Operator 8: mix sources to target weights, cut at each source's exact word budget. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, numbered, running_total, small_side, table

#: The contract's weights by the sources' order, and its repeat limit.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target: share the whole size by weight, none above most times its own size.

    The excess of full sources goes to the others by weight until none is above, so a source gets
    min(limit, level * weight). Sources by limit / weight: the level is that of the first source it leaves room in.
    One row per source throughout; documents never meet here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))
    found = levels.withColumn("found", F.min(fits).over(whole)["level"])
    return found.select("source", "source_size", F.least("cap", F.coalesce(F.col("found") * F.col("weight"), F.col("cap"))).alias("target"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, carry: list[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many of each row's words the mix takes.

    Rows of a source stand in the order of md5(doc_id); whole epochs take every row, and the rest of the source's
    budget takes rows from the front, the last one in part. Nulls: a null text has size 0, a null source is a source
    of its own, a null doc_id hashes as the text 'null'. Repeated rows count separately. Rows of size 0 are taken 0.
    """
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":mix")))
    rows = materialise(docs.select("doc_id", "source", words.alias("size"), key.alias("_hash"), *carry))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    placed = running_total(rows, ["source"], ["_hash", "doc_id", "size"], F.col("size"), "_before")
    goal = small_side(goal.withColumnRenamed("source", "_source"))
    joined = placed.join(goal, F.col("source").eqNullSafe(F.col("_source")))
    budget = F.floor("target")
    epochs = F.coalesce(F.floor(F.try_divide(budget, F.col("source_size"))), F.lit(0))
    left = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), left - F.col("_before")))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


def mixed_rows(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them, the last one of a source whole; rows not
    taken go. Each row is decided on its own, repeated rows and rows of one id or of none too."""
    rows = numbered(docs)
    decided = mix_documents(rows.select("doc.doc_id", "doc.source", "doc.text", "row"), weights, most, carry=["row"])
    times = decided.select("row", F.coalesce(F.ceil(F.try_divide("taken", "size")), F.lit(0)).alias("times")).where("times > 0")
    joined = rows.join(small_side(materialise(times)), "row")
    return joined.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("doc.*")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':mix')) AS h
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, CAST(3 * sum(size) AS DOUBLE) AS cap,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM base GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM sizes),
goal AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         least(cap, coalesce((SELECT arg_min(lv, cap / weight) FROM levels WHERE lv * weight <= cap) * weight, cap)) AS target
  FROM levels),
placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM base)
SELECT doc_id, size, source_size, target,
       CAST(coalesce(floor(floor(target) / nullif(source_size, 0)), 0) * size
         + least(size, greatest(0, floor(target) - coalesce(floor(floor(target) / nullif(source_size, 0)), 0) * source_size - before)) AS BIGINT) AS taken
FROM placed JOIN goal ON placed.source IS NOT DISTINCT FROM goal.source
"""
