"""Queries by resampling: bootstraps over blocks and draws, and the coincidence experiment, all by counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrablock.functions import propagation as prop
from terrablock.functions.quantiles import t_quantile
from terrablock.functions.storage import saved
from terrablock.operators import errors, resample
from terrablock.plans.catalog import QUERIES, Study, free_space, query, rounded
from terrablock.plans.reports import level_draws, level_error, weighted_draws
from terrablock.sources import nodes as src

#: The coincidence experiment: seeds, distance intervals (km), share of sentinels, power and spread of the others, tolerance in dB.
SEEDS, INTERVALS, SHARE, POWER, SPREAD, TOLERANCE = 200, ((1.0, 140.0), (0.5, 150.0), (1.0, 120.0), (1.0, 160.0), (5.0, 140.0)), 0.8, 43.0, 10.0, 0.001


def t_table(s: Study):
    """k, t: the 0.975 quantile by k - 1 degrees of freedom; a row for each k up to the largest number of blocks."""
    most = s.blocks.groupBy("cell").count().agg(F.max("count")).first()[0] or 2
    return s.spark.createDataFrame([(k, round(t_quantile(0.975, k - 1), 6)) for k in range(2, most + 2)], "k long, t double")


@query
def wild_bootstrap(spark, sf_dir):
    s = Study(spark, sf_dir)
    return rounded(resample.wild_bootstrap(saved(s.sums()).where("s IS NOT NULL"), t_table(s)))


def _wide(s: Study):
    return saved(s.per_draw().where("pop = 'all'").groupBy("cell", "seed").pivot("pred", ["constant", "fspl_a"]).agg(F.max("mae")))


@query
def ratio_bootstrap(spark, sf_dir):
    """SD over draws of the fixed constant's error against that of free space."""
    return rounded(resample.ratio_bootstrap(_wide(Study(spark, sf_dir)), ["cell"], ["seed"], "constant", "fspl_a"))


@query
def rmse_ratio(spark, sf_dir):
    """Error of two estimates of the level's mean error, about its true value: the draw's weighted by 1/p, and its plain mean."""
    s = Study(spark, sf_dir)
    weighted = weighted_draws(s, saved(s.split.inclusion().where("p > 0"))).select("cell", "seed", F.try_divide("t", "w").alias("weighted"))
    plain = level_draws(s).where("pop = 'all'").select("cell", "seed", F.col("mae").alias("plain"))
    per = weighted.join(plain, ["cell", "seed"])
    true = s.nodes.groupBy("cell").agg(F.avg(level_error()).alias("theta"))
    return rounded(resample.rmse_ratio(saved(per.join(true, "cell")), ["cell"], ["seed"], "weighted", "plain", "theta"), 5)


@query
def class_bootstrap(spark, sf_dir):
    """Bootstrap error, over draws, of the test retention of each cell."""
    share = QUERIES["retention"](spark, sf_dir).where("role = 'test'").select("cell", "seed", F.col("n_after").cast("double").alias("x"), F.col("n_before").cast("double").alias("y"))
    return rounded(resample.ratio_of_sums(saved(share), ["cell"], ["seed"], "x", "y"))


@query
def mean_interval(spark, sf_dir):
    """Percentile and bias-corrected accelerated intervals of the mean error over draws, by cell."""
    per = saved(level_draws(Study(spark, sf_dir)).where("pop = 'all' AND mae IS NOT NULL"))
    return rounded(resample.mean_intervals(per, ["cell"], ["seed"], "mae"))


@query
def coincidence_rate(spark, sf_dir):
    """How often the median offset of a population as large as the table, of random distances and levels, comes within
    0.001 dB of the table's own: 200 seeds, five distance intervals. edge: where the sentinels alone would put it."""
    n = saved(src.nodes(spark, sf_dir).select("node_id", (F.col("rssi") + free_space()).alias("w")))
    own = errors.order_statistics(n, [], F.col("w"), {"low": F.floor((F.col("total") - 1) / 2), "high": F.floor(F.col("total") / 2)}).select(((F.col("low") + F.col("high")) / 2).alias("own"))
    cases = [(s * len(INTERVALS) + k, s, a, b) for s in range(SEEDS) for k, (a, b) in enumerate(INTERVALS)]
    cases = spark.createDataFrame(cases, "case int, seed int, d_min double, d_max double")
    loss = lambda d: prop.fspl(d * 1000, F.lit(src.BAND_MHZ))
    found = resample.simulated_medians(n.select(F.col("node_id").alias("i")), n.count(), cases, SHARE, prop.SENTINEL_RSSI, POWER, SPREAD, loss)
    edge = prop.SENTINEL_RSSI + loss(F.col("d_min") + (F.col("d_max") - F.col("d_min")) / (2 * SHARE))
    out = found.join(cases, "case").crossJoin(F.broadcast(own))  # one row
    return rounded(out.select("seed", "d_min", "d_max", F.col("total").alias("n"), "median", edge.alias("edge"), (F.abs(F.col("median") - F.col("own")) <= TOLERANCE).alias("hit")))
