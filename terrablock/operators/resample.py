"""Resampling by a counter: every random number is a hash of (seed, replicate, draw), so replicates are rows of a join, their
sums are one aggregation, and any engine that has the hash gives the same numbers.

The rows resampled are a campaign's draws, or the blocks of a draw: some hundreds for each key. Replicates are dealt over
the tasks; what a task holds doesn't grow with the nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrablock.functions.md5 import Numbers
from terrablock.functions.quantiles import normal_cdf, normal_quantile, sorted_quantile
from terrablock.functions.storage import saved
from terrablock.operators.errors import order_statistics

REPLICATES, WILD_REPLICATES = 4_000, 999
#: Signs taken from one hash of 32 hexadecimal digits.
SIGNS = 32
#: Digits to which a replicate is compared with the estimate.
TIE_DIGITS = 9


def uniform_word(*parts, at: int = 0) -> Column:
    """A whole number below 2^32 from eight digits of md5 of the parts, joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))), 1 + 8 * at, 8), 16, 10).cast("long")


def replicates(rows: DataFrame, n: int) -> DataFrame:
    """Each row with every replicate from 0, dealt by replicates. rows: a small saved table."""
    return rows.sparkSession.range(n).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(rows))


def resampled_sums(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], seed: int, n: int = REPLICATES) -> DataFrame:
    """keys, replicate and the sums of values over as many draws as the key has, taken with replacement.

    A key's rows are numbered in the given order; slot k of a replicate takes row floor(u m), with m the key's rows and
    u = uniform_word(seed, replicate, keys, k) / 2^32. A row for each key and draw: bounded by the campaign.
    """
    own = Window.partitionBy(*keys)
    place = (F.row_number().over(own.orderBy(*order)) - 1).alias("_i")
    numbered = saved(rows.select(*keys, *(v.cast("double").alias(k) for k, v in values.items()), place, F.count("*").over(own).alias("_m")))
    word = uniform_word(seed, F.col("replicate"), *map(F.col, keys), F.col("_i"))
    slots = replicates(numbered.select(*keys, "_i", "_m"), n).select(*keys, "replicate", F.shiftright(word * F.col("_m"), 32).cast("int").alias("_i"))
    return slots.join(F.broadcast(numbered.drop("_m")), [*keys, "_i"]).groupBy(*keys, "replicate").agg(*(F.sum(k).alias(k) for k in values))


def wild_bootstrap(sums: DataFrame, t_table: DataFrame, seed: int = 20260929, n: int = WILD_REPLICATES) -> DataFrame:
    """cell, seed, pred, pop, k, err, v, low, high (percentile), t_low, t_high: Rademacher signs on the residuals of a draw's blocks.

    sums: cell, seed, pred, pop, block_id, s, m; t_table: k, t. A block's sign is the same for all predictors and
    populations of a draw, whose residuals stand beside one another, so a replicate costs a row for each block. A single
    block has no interval.
    """
    draw, whole = ["cell", "seed"], ["cell", "seed", "pred", "pop"]
    own = Window.partitionBy(*whole)
    err = (F.sum("s").over(own) / F.sum("m").over(own)).alias("err")
    parts = saved(sums.select(*whole, "block_id", "s", "m", err, F.sum("m").over(own).alias("m_all")))
    kinds = [tuple(r) for r in parts.select("pred", "pop").distinct().orderBy("pred", "pop").collect()]  # predictors x populations
    flat = lambda p, q: F.sum(F.when((F.col("pred") == p) & (F.col("pop") == q), (F.col("s") - F.col("err") * F.col("m")) / F.col("m_all")))
    wide = saved(parts.groupBy(*draw, "block_id").agg(*(flat(p, q).alias(f"d{i}") for i, (p, q) in enumerate(kinds))))
    words = replicates(wide, -(-n // SIGNS)).withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in ("replicate", *draw, "block_id")))))
    signs = words.select(*draw, *(f"d{i}" for i in range(len(kinds))), "replicate", F.posexplode(F.split("_h", "")).alias("_at", "_c")).where((F.col("_at") < SIGNS) & (F.col("replicate") * SIGNS + F.col("_at") < n))
    sign = F.when(F.col("_c") >= "8", 1.0).otherwise(-1.0)
    moved = signs.groupBy(*draw, "replicate", "_at").agg(*(F.sum(sign * F.col(f"d{i}")).alias(f"d{i}") for i in range(len(kinds))))
    long = F.inline(F.array(*(F.struct(F.lit(p).alias("pred"), F.lit(q).alias("pop"), F.col(f"d{i}").alias("d")) for i, (p, q) in enumerate(kinds))))
    spread = moved.select(*draw, long).where("d IS NOT NULL").groupBy(*whole).agg(F.var_samp("d").alias("v"), F.array_sort(F.collect_list("d")).alias("d"))
    at = parts.groupBy(*whole, "err").agg(F.count("*").alias("k")).join(spread, whole).join(t_table, "k", "left")
    half = F.col("t") * F.sqrt("v")
    edge = lambda p: F.when(F.col("k") > 1, F.col("err") + sorted_quantile(F.col("d"), F.lit(p)))
    return at.select(*whole, "k", "err", F.when(F.col("k") > 1, F.col("v")).alias("v"), edge(0.025).alias("low"), edge(0.975).alias("high"), (F.col("err") - half).alias("t_low"), (F.col("err") + half).alias("t_high"))


def with_interval(boots: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, se, low, high of the replicates' values (nulls left out)."""
    per = boots.select(*keys, value.alias("v")).where("v IS NOT NULL").groupBy(*keys).agg(F.stddev_samp("v").alias("se"), F.array_sort(F.collect_list("v")).alias("_v"))
    return per.select(*keys, "se", *(sorted_quantile(F.col("_v"), F.lit(p)).alias(name) for p, name in ((0.025, "low"), (0.975, "high"))))


def ratio_bootstrap(draws: DataFrame, keys: list[str], order: list[str], top: str, base: str, seed: int = 20260930, n: int = REPLICATES) -> DataFrame:
    """keys, n, ratio, se, low, high: SD(top)/SD(base) over paired draws, resampled in pairs; keys whose base doesn't vary are left out."""
    some = draws.where(F.col(top).isNotNull() & F.col(base).isNotNull())
    whole = some.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.stddev_samp(top), F.stddev_samp(base)).alias("ratio"), F.avg(top).alias("_x0"), F.avg(base).alias("_y0")).where("n > 1 AND ratio IS NOT NULL")
    centred = some.join(whole.select(*keys, "_x0", "_y0"), keys).withColumns({"_x": F.col(top) - F.col("_x0"), "_y": F.col(base) - F.col("_y0")})
    x, y = F.col("_x"), F.col("_y")
    sums = resampled_sums(centred, keys, order, {"m": F.lit(1), "x": x, "xx": x * x, "y": y, "yy": y * y}, seed, n)
    square = lambda a: F.greatest(F.round(F.col(a + a) - F.col(a) * F.col(a) / F.col("m"), TIE_DIGITS), F.lit(0.0))
    return whole.drop("_x0", "_y0").join(with_interval(sums, keys, F.sqrt(F.try_divide(square("x"), square("y")))), keys)


def rmse_ratio(draws: DataFrame, keys: list[str], order: list[str], top: str, base: str, centre: str, seed: int = 20260933, n: int = REPLICATES) -> DataFrame:
    """keys, n, ratio, se, low, high: root mean square error of top against that of base, both about centre, over paired draws."""
    some = draws.where(F.col(top).isNotNull() & F.col(base).isNotNull()).withColumns({"_x": (F.col(top) - F.col(centre)) ** 2, "_y": (F.col(base) - F.col(centre)) ** 2})
    whole = some.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.try_divide(F.sum("_x"), F.sum("_y"))).alias("ratio"))
    sums = resampled_sums(some, keys, order, {"x": F.col("_x"), "y": F.col("_y")}, seed, n)
    return whole.join(with_interval(sums, keys, F.sqrt(F.try_divide(F.col("x"), F.col("y")))), keys)


def ratio_of_sums(rows: DataFrame, keys: list[str], order: list[str], top: str, base: str, seed: int = 20260931, n: int = REPLICATES) -> DataFrame:
    """keys, n, ratio, se of sum(top) / sum(base) over draws; a replicate without base counts 0."""
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.sum(top), F.sum(base)).alias("ratio"))
    sums = resampled_sums(rows, keys, order, {"x": F.col(top), "y": F.col(base)}, seed, n)
    per = sums.groupBy(*keys).agg(F.stddev_samp(F.coalesce(F.try_divide("x", "y"), F.lit(0.0))).alias("se"))
    return whole.join(per, keys)


def mean_intervals(rows: DataFrame, keys: list[str], order: list[str], value: str, seed: int = 20260932, n: int = REPLICATES) -> DataFrame:
    """keys, n, mean, low, high (percentile) and bca_low, bca_high (bias-corrected, accelerated) of the mean over draws.

    The bias is the normal quantile of the share of replicates below the mean, ties by half; the acceleration comes from
    the jackknife, whose deviations are those of the values over n - 1.
    """
    rows = rows.select(*keys, *order, value)
    first = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    d = (F.col(value) - F.col("mean")) / F.greatest(F.col("n") - 1, F.lit(1))
    cube = rows.join(first, keys).groupBy(*keys, "n", "mean").agg(F.sum(d * d).alias("_d2"), F.sum(d * d * d).alias("_d3"))
    boots = resampled_sums(rows, keys, order, {"x": F.col(value)}, seed, n).join(first, keys).select(*keys, "mean", (F.col("x") / F.col("n")).alias("b"))
    apart = F.round(F.col("b") - F.col("mean"), TIE_DIGITS)
    per = boots.groupBy(*keys).agg(F.array_sort(F.collect_list("b")).alias("_b"), F.avg(F.when(apart < 0, 1.0).when(apart == 0, 0.5).otherwise(0.0)).alias("_p"))
    both = cube.join(per, keys).withColumn("_z", normal_quantile(F.least(F.greatest(F.col("_p"), F.lit(1e-9)), F.lit(1 - 1e-9)))).withColumn("_a", F.coalesce(F.try_divide(F.col("_d3"), 6 * F.pow("_d2", F.lit(1.5))), F.lit(0.0)))

    def end(p: float) -> Column:
        z = F.col("_z") + normal_quantile(F.lit(p))
        return sorted_quantile(F.col("_b"), normal_cdf(F.col("_z") + z / (1 - F.col("_a") * z)))

    return both.select(*keys, "n", "mean", *(sorted_quantile(F.col("_b"), F.lit(p)).alias(c) for p, c in ((0.025, "low"), (0.975, "high"))), *(F.when(F.col("n") > 1, end(p)).otherwise(F.col("mean")).alias(c) for p, c in ((0.025, "bca_low"), (0.975, "bca_high"))))


#: Steps of the hash's range at which the loss is looked at, and how many standard errors of its share the median may lie off.
STEPS, ERRORS = 4_096, 6.0
#: Numbers whose values a task makes at a time.
GATHERED = 40_000
TALLY = pa.schema([("case", pa.int32()), ("below", pa.int64()), ("total", pa.int64()), ("word", pa.list_(pa.int64())), ("w", pa.list_(pa.float64()))])


def simulated_medians(numbers: DataFrame, n: int, cases: DataFrame, share: float, level: float, power: float, spread: float, loss) -> DataFrame:
    """case, total, median of a population drawn anew for each case: as many values as there are numbers (column i, 0 to n - 1).

    The first share of them are sentinels: level + loss(d), d even between the case's d_min and d_max; the others are
    normal about power. cases: case, seed, d_min, d_max, a bounded set. Each value is a hash of (seed, case, i), made once:
    the law of the values tells between which edges a median lies, so values below are counted and only those between are
    ordered, a few times the root of n. Cases whose median lies outside after all, and losses that fall with d, are
    ordered through a histogram. No task holds a case's values.
    """
    value = level + loss(F.col("d_min") + (F.col("d_max") - F.col("d_min")) * ((F.col("word") + 0.5) / 2.0**32))
    edges = median_edges(cases, n, value, share, power, spread)
    first = round(share * n)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in gathered(batches):
            sentinel, other, out = Numbers(i[i < first]), Numbers(i[i >= first]), []
            for case, seed, low_word, high_word, low, high in edges:
                prefix = f"{seed}|{case}|".encode()
                word, (a, b) = sentinel.hashed(prefix, second=False)[0], other.hashed(prefix)
                w = power + spread * np.sqrt(-2 * np.log((a + 0.5) / 2.0**32)) * np.cos(b / 2.0**32 * (2 * 3.141592653589793))
                below = np.count_nonzero(word < low_word) + np.count_nonzero(w < low)
                out.append((case, below, len(i), word[(word >= low_word) & (word <= high_word)], w[(w >= low) & (w <= high)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TALLY.types, strict=True)], schema=TALLY)

    tasks = 4 * numbers.sparkSession.sparkContext.defaultParallelism
    tallied = saved(numbers.select(F.col("i").cast("long")).repartition(tasks).mapInArrow(tally, "case int, below long, total long, word array<long>, w array<double>"))
    sums = tallied.groupBy("case").agg(F.sum("below").alias("below"), F.sum("total").alias("total"))
    sentinels = tallied.select("case", F.explode("word").alias("word")).join(F.broadcast(cases), "case").select("case", value.alias("w"))
    between = sentinels.unionByName(tallied.select("case", F.explode("w").alias("w"))).withColumn("k", F.row_number().over(Window.partitionBy("case").orderBy("w")) - 1)
    at = lambda half: F.max(F.when(F.col("k") + F.col("below") == F.floor(half), F.col("w")))
    found = between.join(F.broadcast(sums), "case").groupBy("case", "total").agg(at((F.col("total") - 1) / 2).alias("low"), at(F.col("total") / 2).alias("high"))
    span = numbers.sparkSession.createDataFrame([(e[0], e[4], e[5]) for e in edges], "case int, _low double, _high double")
    sure = saved(found.join(F.broadcast(span), "case").where("low >= _low AND high <= _high").select("case", "total", ((F.col("low") + F.col("high")) / 2).alias("median")))
    rest = saved(cases.join(sure, "case", "left_anti"))
    return sure if rest.isEmpty() else sure.unionByName(ordered_medians(numbers, n, rest, share, level, power, spread, loss))


def gathered(batches: Iterator[pa.RecordBatch], least: int = GATHERED) -> Iterator[np.ndarray]:
    """The first column of the batches, in arrays of at least so many numbers but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy())
        n += len(held[-1])
        if n >= least:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def median_edges(cases: DataFrame, n: int, value: Column, share: float, power: float, spread: float) -> list[tuple]:
    """case, seed, low_word, high_word, low, high of each case: sentinels of hashes below low_word are at most low, those above
    high_word at least high, and the median lies between low and high but for one case in a billion. value: a sentinel's, of
    word, d_min and d_max; where it falls as word rises, there are no edges and everything lies between."""
    spans = cases.select("d_min", "d_max").distinct()
    steps = cases.sparkSession.range(STEPS + 1).select((F.col("id") * (2**32 // STEPS)).alias("word"))
    laws: dict = {}
    for r in spans.crossJoin(steps).select("d_min", "d_max", "word", value.alias("w")).orderBy("word").collect():
        laws.setdefault((r.d_min, r.d_max), []).append((r.word, r.w))
    off, edges = ERRORS * 0.5 / math.sqrt(max(n, 1)) + 2 / max(n, 1), {}
    for key, law in laws.items():
        rising = all(a[1] is not None and b[1] is not None and a[1] <= b[1] for a, b in zip(law[:-1], law[1:], strict=True))
        upto = [share * word / 2**32 + (1 - share) * (1 + math.erf((w - power) / (spread * math.sqrt(2)))) / 2 for word, w in law] if rising else []
        under, over = ([x for x, p in zip(law, upto, strict=False) if hit(p)] for hit in (lambda p: p <= 0.5 - off, lambda p: p >= 0.5 + off))  # noqa: B023
        low, high = under[-1] if under else (0, -math.inf), over[0] if over else (2**32, math.inf)
        edges[key] = (low[0], high[0], low[1], high[1])
    return [(r.case, r.seed, *edges[r.d_min, r.d_max]) for r in cases.select("case", "seed", "d_min", "d_max").collect()]


def ordered_medians(numbers: DataFrame, n: int, cases: DataFrame, share: float, level: float, power: float, spread: float, loss) -> DataFrame:
    """As simulated_medians, from a histogram of all values, which are made twice."""
    both = numbers.crossJoin(F.broadcast(cases))
    digits = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in ("seed", "case", "i"))))
    word = lambda k: F.conv(F.substring("_h", 1 + 8 * k, 8), 16, 10).cast("double")
    u, v = (word(0) + 0.5) / 2.0**32, word(1) / 2.0**32
    normal = F.sqrt(-2 * F.log(u)) * F.cos(v * (2 * 3.141592653589793))
    d = F.col("d_min") + (F.col("d_max") - F.col("d_min")) * u
    value = F.when(F.col("i") < F.lit(round(share * n)), level + loss(d)).otherwise(power + spread * normal)
    rows = both.withColumn("_h", digits).select("case", value.alias("w"))
    found = order_statistics(rows, ["case"], F.col("w"), {"low": F.floor((F.col("total") - 1) / 2), "high": F.floor(F.col("total") / 2)})
    return found.select("case", "total", ((F.col("low") + F.col("high")) / 2).alias("median"))
