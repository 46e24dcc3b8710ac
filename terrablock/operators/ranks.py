"""Ranks inside keys of any size: rows are range-sorted, so no task holds a key, and a value that a third of all rows have
is cut into ranges like any others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrablock.functions.storage import saved

#: Values that over 1 in HOT rows have are joined back by broadcast: there are fewer than HOT of them, whatever the rows.
HOT = 10_000


def ranked(rows: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """rows with o_<value>, the rank from 1 with ties in the order of tie, and r_<value>, the mean rank of equal values.

    tie is different for every row of a key. Nulls in value are ranked before all others, as one value.
    """
    order = [value, tie]
    ranged = saved(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    per = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each key and range that meet
    offsets = per.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    placed = saved(ranged.withColumn("_place", place).join(offsets, [*keys, "_range"]).withColumn(f"o_{value}", F.col("_offset") + F.col("_place")).drop("_range", "_place", "_offset"))
    mean = F.min(f"o_{value}") + (F.count("*") - 1) / 2
    ties = saved(placed.groupBy(*keys, F.col(value).alias("_v")).agg(mean.alias(f"r_{value}"), F.count("*").alias("_n")))
    most = max(1, (ties.agg(F.sum("_n")).first()[0] or 0) // HOT)
    same = lambda t: [*(placed[k].eqNullSafe(t[k]) for k in keys), placed[value].eqNullSafe(t["_v"])]
    hot, cold = (ties.where(F.col("_n") > most), ties.where(F.col("_n") <= most))
    pick = [*(placed[c] for c in placed.columns)]
    often = placed.join(F.broadcast(hot), same(hot)).select(*pick, hot[f"r_{value}"])
    rest = placed.join(F.broadcast(hot), same(hot), "left_anti")
    return often.unionByName(rest.join(cold.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_v", f"r_{value}"), [*(rest[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys), rest[value].eqNullSafe(F.col("_v"))]).drop("_v", *(f"_k_{k}" for k in keys)))


def spearman_tied(rows: DataFrame, keys: list[str], x: str, y: str, tie: str) -> DataFrame:
    """keys, n, rho (ties by mean rank), rho_broken (ties in the order of tie); null where a side doesn't vary."""
    some = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, tie, x, y)
    both = ranked(some, keys, x, tie).join(ranked(some, keys, y, tie).drop(x, y), [*keys, tie])
    r = lambda p: F.try_divide(F.covar_pop(f"{p}_{x}", f"{p}_{y}"), F.stddev_pop(f"{p}_{x}") * F.stddev_pop(f"{p}_{y}"))
    return both.groupBy(*keys).agg(F.count("*").alias("n"), r("r").alias("rho"), r("o").alias("rho_broken"))
