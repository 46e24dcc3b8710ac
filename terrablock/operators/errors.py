"""Medians, errors and their summaries over draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrablock.functions.storage import saved

POPULATIONS = ("valid", "sentinel", "all")


def in_population(name: str) -> Column:
    return {"valid": F.col("valid"), "sentinel": ~F.col("valid"), "all": F.lit(True)}[name]


def middle_bins(hist: DataFrame, keys: list[str], ranks: dict[str, Column]) -> DataFrame:
    """Of each key the bins that hold the wanted ranks: keys, bin, before (values in lower bins), total.

    hist: keys, bin, n; ranks: expressions of total, from 0. A key has as many rows as bins, however many its values.
    """
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = hist.select(*keys, "bin", "n", before.alias("before"), F.sum("n").over(own).alias("total"))
    inside = lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("n"))
    hit = inside(next(iter(ranks.values())))
    for rank in ranks.values():
        hit = hit | inside(rank)
    return placed.where(hit).select(*keys, "bin", "before", "total")


def ranked(values: DataFrame, keys: list[str], ranks: dict[str, Column]) -> DataFrame:
    """keys, total and the values at the wanted ranks. values: keys, bin, before, total, v, n: all values of those bins with their counts."""
    upto = F.sum("n").over(Window.partitionBy(*keys, "bin").orderBy("v")) + F.col("before")
    placed = values.withColumn("upto", upto)
    return placed.groupBy(*keys).agg(F.first("total").alias("total"), *(F.min(F.when(F.col("upto") > rank, F.col("v"))).alias(name) for name, rank in ranks.items()))


def order_statistics(rows: DataFrame, keys: list[str], value: Column, ranks: dict[str, Column], width: float = 0.25) -> DataFrame:
    """keys, total and the exact order statistics of value at ranks (expressions of total, from 0; rows without a value don't count).

    A histogram of bins finds where the ranks lie and only values of those bins are ordered, so neither a task nor a
    buffer holds a key's values. The rows are read twice, two columns of them.
    """
    v = rows.select(*keys, value.cast("double").alias("v")).where("v IS NOT NULL").withColumn("bin", F.floor(F.col("v") / width))
    bins = middle_bins(v.groupBy(*keys, "bin").agg(F.count("*").alias("n")), keys, ranks)
    if not keys:
        return ranked(v.join(F.broadcast(bins), "bin").groupBy("bin", "before", "total", "v").agg(F.count("*").alias("n")), keys, ranks)  # at most a bin for each rank
    return ranked(v.join(bins, [*keys, "bin"]).groupBy(*keys, "bin", "before", "total", "v").agg(F.count("*").alias("n")), keys, ranks)


def draw_medians(nodes: DataFrame, roles: DataFrame, values: dict[str, Column], role: str = "train", width: float = 0.25) -> DataFrame:
    """cell, seed and the exact median of each value over the nodes of a role, in every draw; nodes: a saved table.

    Bins are counted by block once, whatever the draws. Of each draw they find the bins of the middle ranks, and only
    the nodes whose values lie in a wanted bin are read again, by block and value: no node is copied for a draw, and
    neither nodes nor all values of a draw meet in one task.
    """
    ranks = {"low": F.floor((F.col("total") - 1) / 2), "high": F.floor(F.col("total") / 2)}
    own = roles.where(F.col("role") == role).select("cell", "seed", "block_id")
    each = F.inline(F.array(*(F.struct(F.lit(name).alias("name"), x.cast("double").alias("v")) for name, x in values.items())))
    long = nodes.select("cell", "block_id", each).where("v IS NOT NULL").withColumn("bin", F.floor(F.col("v") / width))
    keys = ["cell", "seed", "name"]
    hist = long.groupBy("cell", "block_id", "name", "bin").agg(F.count("*").alias("n")).join(own, ["cell", "block_id"]).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    bins = saved(middle_bins(hist, keys, ranks))
    wanted = bins.select("cell", "name", "bin").distinct()
    freq = long.join(wanted, ["cell", "name", "bin"]).groupBy("cell", "block_id", "name", "bin", "v").agg(F.count("*").alias("n"))
    found = freq.join(own, ["cell", "block_id"]).join(bins, [*keys, "bin"]).groupBy(*keys, "bin", "before", "total", "v").agg(F.sum("n").alias("n"))
    medians = ranked(found, keys, ranks)
    return medians.groupBy("cell", "seed").agg(*(F.max(F.when(F.col("name") == name, (F.col("low") + F.col("high")) / 2)).alias(name) for name in values))


def draw_median(nodes: DataFrame, roles: DataFrame, value: Column, name: str, role: str = "train") -> DataFrame:
    """cell, seed, name: the exact median of one value over the nodes of a role, in every draw."""
    return draw_medians(nodes, roles, {name: value}, role)


def safe_corr(x: str, y: str) -> Column:
    """Pearson's correlation, null where one side doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def error_measures(rows: DataFrame, keys: list[str], error: Column) -> DataFrame:
    """keys, n, mae, rmse, bias, p90 of the absolute error (between order statistics), over rows with an error."""
    e = rows.select(*keys, error.alias("e")).where("e IS NOT NULL")
    at = 0.9 * (F.col("total") - 1)
    edges = order_statistics(e, keys, F.abs("e"), {"low": F.floor(at), "high": F.ceil(at)})
    p90 = edges.select(*keys, (F.col("low") + (at - F.floor(at)) * (F.col("high") - F.col("low"))).alias("p90"))
    return e.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias")).join(p90, keys)


def population_mae(rows: DataFrame, keys: list[str], errors: dict[str, Column]) -> DataFrame:
    """keys, pred, pop, n, mae: mean absolute errors by predictor and population in one pass; an empty population has null."""
    cells = [(p, q) for p in errors for q in POPULATIONS]
    sums = rows.groupBy(*keys).agg(*(F.avg(F.when(in_population(q), F.abs(errors[p]))).alias(f"{p}|{q}") for p, q in cells), *(F.count_if(in_population(q)).alias(f"n|{q}") for q in POPULATIONS))
    long = F.array(*(F.struct(F.lit(p).alias("pred"), F.lit(q).alias("pop"), F.col(f"n|{q}").alias("n"), F.col(f"{p}|{q}").alias("mae")) for p, q in cells))
    return sums.select(*keys, F.inline(long))


def block_sums(rows: DataFrame, keys: list[str], errors: dict[str, Column]) -> DataFrame:
    """keys, block_id, pred, pop, s (sum of absolute errors), m (nodes): what all design estimators need; empty ones are left out."""
    cells = [(p, q) for p in errors for q in POPULATIONS]
    sums = rows.groupBy(*keys, "block_id").agg(*(F.sum(F.when(in_population(q), F.abs(errors[p]))).alias(f"{p}|{q}") for p, q in cells), *(F.count_if(in_population(q)).alias(f"n|{q}") for q in POPULATIONS))
    long = F.array(*(F.struct(F.lit(p).alias("pred"), F.lit(q).alias("pop"), F.col(f"{p}|{q}").alias("s"), F.col(f"n|{q}").alias("m")) for p, q in cells))
    return sums.select(*keys, "block_id", F.inline(long)).where("m > 0")


def drift(per_draw: DataFrame) -> DataFrame:
    """cell, pred, pop, n_draws, mean, sd (ddof 1), weighted_sd (reliability weights n), low, high of the draws' mae.

    Draws with an empty population have no mae and don't count; a single draw has sd 0 and no weighted_sd.
    """
    some = per_draw.where("mae IS NOT NULL")
    keys = ["cell", "pred", "pop"]
    mean = F.sum(F.col("mae") * F.col("n")) / F.sum("n")
    centred = some.join(some.groupBy(*keys).agg(mean.alias("_m")), keys)
    w, d = F.col("n").cast("double"), F.col("mae") - F.col("_m")
    weighted = F.sqrt(F.try_divide(F.sum(w * d * d), F.sum(w) - F.try_divide(F.sum(w * w), F.sum(w))))
    return centred.groupBy(*keys).agg(
        F.count("*").alias("n_draws"), F.avg("mae").alias("mean"), F.coalesce(F.stddev_samp("mae"), F.lit(0.0)).alias("sd"), F.when(F.count("*") > 1, weighted).alias("weighted_sd"), F.min("mae").alias("low"), F.max("mae").alias("high")
    )


def drift_summary(drifts: DataFrame) -> DataFrame:
    """pred, pop: mean of the cells' draw SDs, SD of the cells' means, their ratio."""
    return drifts.groupBy("pred", "pop").agg(F.count("*").alias("n_cells"), F.avg("sd").alias("mean_sd"), F.stddev_samp("mean").alias("sd_of_means"), F.try_divide(F.avg("sd"), F.stddev_samp("mean")).alias("ratio"))


def inversions(per_draw: DataFrame, a: str, b: str) -> DataFrame:
    """cell (and ALL), pop: draws in which both predictors have a mae, and in how many a's is larger than b's."""
    wide = per_draw.groupBy("cell", "seed", "pop").agg(F.max(F.when(F.col("pred") == a, F.col("mae"))).alias("a"), F.max(F.when(F.col("pred") == b, F.col("mae"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    rolled = wide.withColumn("hit", (F.col("a") > F.col("b")).cast("long")).groupingSets([["cell", "pop"], ["pop"]], "cell", "pop").agg(F.count("*").alias("n_draws"), F.sum("hit").alias("n_inverted"))
    return rolled.select(F.coalesce("cell", F.lit("ALL")).alias("cell"), "pop", "n_draws", "n_inverted")


def rank_edges(rows: DataFrame, keys: list[str], value: Column, q: float) -> DataFrame:
    """keys, low, high: the order statistics at floor and ceil of (n-1) q."""
    at = (F.col("total") - 1) * q
    return order_statistics(rows, keys, value, {"low": F.floor(at), "high": F.ceil(at)}).drop("total")


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name, n, low, high, share_nonzero, constant of each column, in one pass."""
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns)))
    return rows.select(each).groupBy("name").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg((F.col("v") != 0).cast("double")).alias("share_nonzero"), (F.min("v") == F.max("v")).alias("constant"))


def diagnostics(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """Error families of a prediction by coverage, land cover and distance ring, in one wide pass, as (metric, value) rows."""
    e = F.col(pred) - F.col(truth)
    parts = {
        "all": F.lit(True), "valid": F.col("valid"), "sentinel": ~F.col("valid"), "covered": F.col("covered"), "uncovered": ~F.col("covered"),
        "vegetated": F.col("ndvi") > 0.5, "bare": F.col("ndvi") < 0.2, "near": F.col("dist_m") < 5000, "middle": (F.col("dist_m") >= 5000) & (F.col("dist_m") < 15000), "far": F.col("dist_m") >= 15000,
    }
    shapes = {"mae": lambda p: F.avg(F.when(p, F.abs(e))), "rmse": lambda p: F.sqrt(F.avg(F.when(p, e * e))), "bias": lambda p: F.avg(F.when(p, e)), "n": lambda p: F.count_if(p).cast("double")}
    wide = rows.agg(*(f(p).alias(f"{name}_{part}") for name, f in shapes.items() for part, p in parts.items()), F.corr(truth, pred).alias("pearson"), F.avg((F.col("covered") == (F.col(pred) > -85)).cast("double")).alias("coverage_accuracy"))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns))))


def quantiles(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """keys and the quantiles of value at the shares, by name, between their order statistics; all from one histogram."""
    at = {name: q * (F.col("total") - 1) for name, q in shares.items()}
    ranks = {f"{name}_{e}": f(x) for name, x in at.items() for e, f in (("low", F.floor), ("high", F.ceil))}
    edges = order_statistics(rows, keys, value, ranks)
    return edges.select(*keys, *((F.col(f"{n}_low") + (x - F.floor(x)) * (F.col(f"{n}_high") - F.col(f"{n}_low"))).alias(n) for n, x in at.items()))


def prediction_shape(rows: DataFrame, truth: str, pred: str, loss: Column, free: Column) -> DataFrame:
    """(metric, value): spread, percentiles and fidelity of a prediction, its physical consistency, the coverage at levels,
    90th percentiles of the error by distance ring, and correlations of the error with distance and terrain.

    loss: the predicted path loss, free: that of free space. The spread and correlations take one pass, the percentiles of
    predictions and those of rings one histogram each.
    """
    e = F.abs(F.col(pred) - F.col(truth))
    percent = lambda level: 100 * F.avg((F.col(pred) > level).cast("double"))
    wide = rows.agg(
        F.stddev_samp(pred).alias("std_pred"), F.stddev_samp(truth).alias("std_truth"), F.try_divide(F.stddev_samp(pred), F.stddev_samp(truth)).alias("fidelity"),
        F.avg((loss >= free).cast("double")).alias("fspl_compliance"), F.avg(F.col(pred).between(-140, -30).cast("double")).alias("range_ok"), F.corr(F.col(pred), -F.col("dist_m")).alias("distance_gradient"),
        *(percent(-x).alias(f"coverage_at_{x}dbm") for x in (85, 95, 105)), (percent(-85) - percent(-95)).alias("coverage_spread"),
        *(F.corr(F.col(c), e).alias(f"corr_{c}_error") for c in ("dist_m", "elevation", "slope", "ndvi")),
    )
    pairs = lambda df, names: df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))))
    shares = {f"pred_p{q}": q / 100 for q in (10, 25, 75, 90)}
    ring = F.when(F.col("dist_m") < 5000, "near").when(F.col("dist_m") < 15000, "middle").otherwise("far")
    rings = quantiles(rows.select(ring.alias("ring"), e.alias("e")), ["ring"], F.col("e"), {"p90": 0.9}).select(F.concat(F.lit("p90_"), "ring").alias("metric"), F.col("p90").alias("value"))
    return pairs(wide, wide.columns).unionByName(pairs(quantiles(rows, [], F.col(pred), shares), shares)).unionByName(rings)


def short_pearson(x: str, y: str) -> Column:
    """Correlation of population covariance over sample deviations: corr (n-1)/n within ±1, 0 below five rows."""
    n = F.count("*")
    return F.when(n < 5, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(F.corr(x, y), F.lit(0.0)) * (n - 1) / n)))


def spearman(rows: DataFrame, keys: list[str], x: str, y: str, tie: str) -> DataFrame:
    """keys, rho: rank correlation with ties ranked in the order of tie. A key's rows meet in one task: keys of many
    draws are meant, not keys with all nodes."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c, tie))
    return rows.select(*keys, rank(x).alias("rx"), rank(y).alias("ry")).groupBy(*keys).agg(F.corr("rx", "ry").alias("rho"))


def central_window(rows: DataFrame, most: int) -> DataFrame:
    """The rows of each cell inside the largest square about its median place with at most so many nodes.

    The square is bounded by the (most + 1)-th distance from the middle (the larger of dx and dy), which a histogram finds;
    a cell of no more rows keeps all.
    """
    middle = None
    for c in ("x_km", "y_km"):
        half = order_statistics(rows, ["cell"], F.col(c), {"a": F.floor((F.col("total") - 1) / 2), "b": F.floor(F.col("total") / 2)})
        half = half.select("cell", ((F.col("a") + F.col("b")) / 2).alias(f"m_{c}"))
        middle = half if middle is None else middle.join(half, "cell")
    placed = saved(rows.join(saved(middle), "cell").withColumn("_d", F.greatest(F.abs(F.col("x_km") - F.col("m_x_km")), F.abs(F.col("y_km") - F.col("m_y_km")))))
    edge = order_statistics(placed, ["cell"], F.col("_d"), {"edge": F.lit(most)}).select("cell", "edge")
    return placed.join(edge, "cell", "left").where("edge IS NULL OR _d < edge").select(*rows.columns)


def bias_summary(draws: DataFrame, domain: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_draws, theta, bias, mc_se, rmse, low, high (bias -+ 2 mc_se), distinct (from 0). draws: keys, mae; domain: keys, theta."""
    some = draws.where("mae IS NOT NULL").join(domain, keys)
    d = F.col("mae") - F.col("theta")
    out = some.groupBy(*keys, "theta").agg(F.count("*").alias("n_draws"), F.avg(d).alias("bias"), (F.stddev_samp("mae") / F.sqrt(F.count("*"))).alias("mc_se"), F.sqrt(F.avg(d * d)).alias("rmse"))
    low, high = F.col("bias") - 2 * F.col("mc_se"), F.col("bias") + 2 * F.col("mc_se")
    return out.select("*", low.alias("low"), high.alias("high"), ((low > 0) | (high < 0)).alias("distinct"))
