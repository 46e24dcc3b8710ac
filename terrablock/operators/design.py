"""Design-based estimators over block sums and inclusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrablock.functions.quantiles import f_quantile, log_gamma

DRAW = ["cell", "seed", "pred", "pop"]


def cluster_variance(sums: DataFrame, n_blocks: DataFrame | None) -> DataFrame:
    """cell, seed, pred, pop, k, m, err, v of each draw: the one-draw cluster variance of a ratio of block sums.

    n_blocks (cell, n_blocks) gives the finite-population factor 1 - k/N; None leaves it out. v is null below two blocks.
    """
    total = sums.groupBy(*DRAW).agg(F.count("*").alias("k"), F.sum("m").alias("m_all"), (F.sum("s") / F.sum("m")).alias("err"))
    residual = sums.join(total, DRAW).withColumn("r", F.col("s") - F.col("err") * F.col("m"))
    squares = residual.groupBy(*DRAW, "k", "m_all", "err").agg(F.sum(F.col("r") * F.col("r")).alias("ss"))
    k = F.col("k").cast("double")
    factor = F.lit(1.0)
    if n_blocks is not None:
        squares, factor = squares.join(n_blocks, "cell"), 1 - k / F.col("n_blocks")
    v = F.when(k > 1, factor * k / (k - 1) * F.col("ss") / (F.col("m_all").cast("double") * F.col("m_all")))
    return squares.select(*DRAW, "k", F.col("m_all").alias("m"), "err", v.alias("v"))


def variance_summary(draws: DataFrame) -> DataFrame:
    """cell, pred, pop: draws, defined variances, variance between draws, mean v, q = mean v / variance, coverage of err ± 2 sqrt(v)."""
    keys = ["cell", "pred", "pop"]
    centre = draws.groupBy(*keys).agg(F.avg("err").alias("mean_err"), F.var_samp("err").alias("var_err"))
    joined = draws.join(centre, keys)
    covered = F.when(F.col("v").isNotNull(), (F.abs(F.col("err") - F.col("mean_err")) <= 2 * F.sqrt("v")).cast("double"))
    out = joined.groupBy(*keys, "mean_err", "var_err").agg(F.count("*").alias("n_draws"), F.count("v").alias("n_defined"), F.avg("v").alias("mean_v"), F.avg(covered).alias("coverage"))
    return out.withColumn("q", F.when(F.col("var_err") > 0, F.col("mean_v") / F.col("var_err")))


def jackknife_variance(sums: DataFrame) -> DataFrame:
    """cell, seed, pred, pop, k, v: jackknife over a draw's blocks, from its sums less each block's own."""
    w = Window.partitionBy(*DRAW)
    out = (F.sum("s").over(w) - F.col("s")) / F.nullif(F.sum("m").over(w) - F.col("m"), F.lit(0))
    left = sums.select(*DRAW, out.alias("o"))
    k = F.count("*").cast("double")
    return left.groupBy(*DRAW).agg(F.count("*").alias("k"), F.when(k > 1, (k - 1) * F.var_pop("o")).alias("v"))


def role_counts(roles: DataFrame) -> DataFrame:
    """cell, n_blocks, k_train, k_test of any one draw (all draws have the same)."""
    one = roles.groupBy("cell", "seed").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("role") == "train").alias("k_train"), F.count_if(F.col("role") == "test").alias("k_test"))
    return one.groupBy("cell").agg(*(F.min(c).alias(c) for c in ("n_blocks", "k_train", "k_test")))


def inclusion(nodes: DataFrame, roles: DataFrame, left: DataFrame) -> DataFrame:
    """cell, node_id, block_id, n_block (draws with the block in test), n_kept (draws that keep the node), p, p_given.

    Draws with the block in test are counted by block; only what the buffer keeps is counted by node.
    """
    draws = roles.groupBy("cell").agg(F.count_distinct("seed").alias("n_draws"))
    tested = roles.groupBy("cell", "block_id").agg(F.count_if(F.col("role") == "test").alias("n_block"))
    kept = left.where("role = 'test'").groupBy("cell", "node_id").agg(F.count("*").alias("n_kept"))
    rows = nodes.join(tested.join(draws, "cell"), ["cell", "block_id"]).join(kept, ["cell", "node_id"], "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0).cast("long")))
    return rows.select(*nodes.columns, "n_block", "n_kept", (F.col("n_kept") / F.col("n_draws")).alias("p"), F.try_divide(F.col("n_kept"), F.col("n_block")).alias("p_given"))


def hajek(rows: DataFrame, keys: list[str], value: str, p: str = "p") -> DataFrame:
    """keys, n, estimate: sum(value/p) / sum(1/p) over rows of positive p."""
    some = rows.where(F.col(p) > 0)
    return some.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col(value) / F.col(p)), F.sum(1 / F.col(p))).alias("estimate"))


def estimands(per_draw: DataFrame, included: DataFrame, error: str) -> DataFrame:
    """cell: (a) mean error of the domain, (b) mean of the draws' errors, (c) ratio of expectations sum(p e)/sum(p), the
    ratio term -cov(err, m)/mean(m) with ddof 0, and the residual b - c - ratio term, which is 0 but for rounding.

    per_draw: cell, seed, n, mae; included: cell, p and the error column.
    """
    domain = included.groupBy("cell").agg(F.avg(error).alias("a"), F.try_divide(F.sum(F.col("p") * F.col(error)), F.sum("p")).alias("c"))
    draws = per_draw.where("n > 0").groupBy("cell").agg(F.count("*").alias("n_draws"), F.avg("mae").alias("b"), (-F.try_divide(F.covar_pop("mae", "n"), F.avg("n"))).alias("ratio_term"))
    return domain.join(draws, "cell").withColumn("residual", F.col("b") - F.col("c") - F.col("ratio_term"))


def design_effect(per_draw: DataFrame, domain: DataFrame) -> DataFrame:
    """cell: draws, mean, sd, cv, simple-random variance (mean over draws), deff and effective size. domain: cell, n_u, s2."""
    some = per_draw.where("mae IS NOT NULL AND n > 0").join(domain, "cell")
    srs = (1 - F.col("n") / F.col("n_u")) * F.col("s2") / F.col("n")
    out = some.groupBy("cell").agg(F.count("*").alias("n_draws"), F.avg("mae").alias("mean"), F.stddev_samp("mae").alias("sd"), F.avg(srs).alias("srs_variance"), F.avg("n").alias("mean_n"))
    out = out.withColumn("cv", F.try_divide(F.col("sd"), F.col("mean"))).withColumn("deff", F.try_divide(F.col("sd") * F.col("sd"), F.col("srs_variance")))
    return out.withColumn("n_effective", F.try_divide(F.col("mean_n"), F.col("deff")))


def extreme_ratio(groups: DataFrame, keys: list[str], highest: bool = True) -> DataFrame:
    """keys, theta: the largest (or smallest) sum(p e n)/sum(p n) with lo <= p <= hi. groups: keys, e, lo, hi, n.

    Sorted by e the best p is hi on one side of a cut and lo on the other, so prefix sums over the distinct (e, lo, hi)
    give every cut's value, and the extreme is the best of them.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("e").desc() if highest else F.col("e").asc(), "lo", "hi")
    whole = Window.partitionBy(*keys)
    lo, hi = F.col("lo") * F.col("n"), F.col("hi") * F.col("n")
    upto, all_ = w.rowsBetween(Window.unboundedPreceding, 0), whole
    top = F.sum(hi * F.col("e")).over(upto) + F.sum(lo * F.col("e")).over(all_) - F.sum(lo * F.col("e")).over(upto)
    base = F.sum(hi).over(upto) + F.sum(lo).over(all_) - F.sum(lo).over(upto)
    cuts = groups.select(*keys, F.try_divide(top, base).alias("theta"), F.try_divide(F.sum(lo * F.col("e")).over(all_), F.sum(lo).over(all_)).alias("none"))
    pick = F.max(F.greatest("theta", "none")) if highest else F.min(F.least("theta", "none"))
    return cuts.groupBy(*keys).agg(pick.alias("theta"))


def one_way(rows: DataFrame, keys: list[str], factor: str, value: str) -> DataFrame:
    """keys, n, groups, ms_between, ms_within, n0, s2_within, s2_between, icc of a one-way layout, balanced or not."""
    per = rows.groupBy(*keys, factor).agg(F.count(value).alias("k"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("k > 0")
    grand = per.groupBy(*keys).agg((F.sum(F.col("m") * F.col("k")) / F.sum("k")).alias("g"))
    per = per.join(grand, keys) if keys else per.crossJoin(F.broadcast(grand))
    n, a = F.sum("k"), F.count("*")
    d = F.col("m") - F.col("g")
    sums = per.groupBy(*keys).agg(n.alias("n"), a.alias("groups"), F.sum(F.col("k") * d * d).alias("ssb"), F.sum(F.col("k") * F.col("v")).alias("ssw"), F.sum(F.col("k") * F.col("k")).alias("k2"))
    between, within = F.try_divide(F.col("ssb"), F.col("groups") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("groups"))
    n0 = F.try_divide(F.col("n") - F.col("k2") / F.col("n"), F.col("groups") - 1)
    out = sums.select(*keys, "n", "groups", between.alias("ms_between"), within.alias("ms_within"), n0.alias("n0"))
    out = out.withColumn("s2_between", F.greatest(F.lit(0.0), F.try_divide(F.col("ms_between") - F.col("ms_within"), F.col("n0"))))
    return out.withColumn("icc", F.try_divide(F.col("s2_between"), F.col("s2_between") + F.col("ms_within")))


def component_intervals(layout: DataFrame, keys: list[str]) -> DataFrame:
    """keys, d1, d2, f, f_low, f_high (quantiles), theta, theta_low, theta_high, icc_low, icc_high. layout: rows of one_way.

    theta is the ratio of the components between and within; F is (1 + n0 theta) times Fisher's F of d1 = groups - 1 and
    d2 = n - groups, so its 95 % bounds are (F / quantile - 1) / n0, cut off at 0. Without a spread within, or with a
    single group or none left over, there is no interval.
    """
    some = layout.where("groups > 1 AND n > groups AND ms_within > 0").withColumns({"d1": F.col("groups") - 1, "d2": F.col("n") - F.col("groups"), "f": F.col("ms_between") / F.col("ms_within")})
    some = some.withColumns({"f_low": f_quantile(0.025, F.col("d1"), F.col("d2")), "f_high": f_quantile(0.975, F.col("d1"), F.col("d2"))})
    theta = lambda q: F.greatest(F.lit(0.0), (F.col("f") / q - 1) / F.col("n0"))
    out = some.select(*keys, "d1", "d2", "f", "f_low", "f_high", theta(F.lit(1.0)).alias("theta"), theta(F.col("f_high")).alias("theta_low"), theta(F.col("f_low")).alias("theta_high"))
    return out.withColumns({f"icc_{e}": F.col(f"theta_{e}") / (1 + F.col(f"theta_{e}")) for e in ("low", "high")})


def cochran_c(rows: DataFrame, factor: str, value: str) -> DataFrame:
    return rows.groupBy(factor).agg(F.var_samp(value).alias("v")).agg(F.try_divide(F.max("v"), F.sum("v")).alias("c"))


def leave_one_out_sd(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, sd, v: the SD of value and its jackknife variance, from sums less each row's own."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    centred = rows.select(*keys, (F.col(value) - F.avg(value).over(w)).alias("d"))
    n, d = F.count("*").over(w), F.col("d")
    rest = F.sum(d * d).over(w) - d * d - d * d / (n - 1)  # the centred sum is 0, so the others' sum is -d
    out = centred.select(*keys, d, F.when(n > 2, F.sqrt(F.greatest(rest, F.lit(0.0)) / (n - 2))).alias("o"))
    k = F.count("*").cast("double")
    return out.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_samp("d").alias("sd"), ((k - 1) * F.var_pop("o")).alias("v"))


def pooled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, mean, variance of the union of groups given by n, mean, variance (ddof 1)."""
    n = F.col("n").cast("double")
    mean = rows.groupBy(*keys).agg((F.sum(n * F.col("mean")) / F.sum(n)).alias("_g"))
    d = F.col("mean") - F.col("_g")
    joined = rows.join(mean, keys) if keys else rows.crossJoin(F.broadcast(mean))
    return joined.groupBy(*keys, "_g").agg(F.sum("n").alias("n"), (F.sum((n - 1) * F.col("variance") + n * d * d) / (F.sum(n) - 1)).alias("variance")).withColumnRenamed("_g", "mean")


def reading_summary(draws: DataFrame, variant: str) -> DataFrame:
    """cell, pred, pop, variant, reading, and how v stands to the variance between draws under two readings of which draws
    count for it: A all with an error, B those with a defined v. draws: of cluster_variance; undefined v: one block."""
    keys = ["cell", "pred", "pop"]
    defined = F.col("v").isNotNull()
    err = lambda reading: F.col("err") if reading == "A" else F.when(defined, F.col("err"))
    found = None
    for reading in "AB":
        centre = draws.groupBy(*keys).agg(F.avg(err(reading)).alias("mean_err"), F.var_samp(err(reading)).alias("var_err"))
        inside = F.when(defined, (F.abs(F.col("err") - F.col("mean_err")) <= 2 * F.sqrt("v")).cast("long"))
        sums = draws.join(centre, keys).groupBy(*keys, "mean_err", "var_err").agg(
            F.count("*").alias("n_err"), F.count("v").alias("n_v"), F.count_if(F.col("k") == 1).alias("n_one_block"), F.min("k").alias("k_min"), F.max("k").alias("k_max"),
            F.avg("v").alias("mean_v"), F.avg(F.sqrt("v")).alias("mean_root_v"), F.sum(inside).alias("n_covered"), F.avg(inside).alias("coverage"),
        )
        one = sums.withColumn("q", F.when(F.col("var_err") > 0, F.col("mean_v") / F.col("var_err"))).select(*keys, F.lit(variant).alias("variant"), F.lit(reading).alias("reading"), *sums.columns[3:], "q")
        found = one if found is None else found.unionByName(one)
    return found


def product_variance(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, v_z and its parts for z = x y: mean(y)^2 var(x), mean(x)^2 var(y) and the remainder."""
    z = F.col(x) * F.col(y)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.var_samp(z).alias("v_z"), (F.avg(y) * F.avg(y) * F.var_samp(x)).alias("by_x"), (F.avg(x) * F.avg(x) * F.var_samp(y)).alias("by_y"))
    return sums.withColumn("rest", F.col("v_z") - F.col("by_x") - F.col("by_y"))


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(X <= k) of n trials of chance p in (0, 1), however many: the term of k, or of k + 1, in logarithms, times a sum of
    falling ratios away from the mean; above the mean the upper tail is taken from 1."""
    log_term = lambda i: log_gamma(n + F.lit(1.0)) - log_gamma(i + F.lit(1.0)) - log_gamma(n - i + F.lit(1.0)) + i * F.log(p) + (n - i) * F.log(1 - p)

    def away(start: Column, steps: Column, ratio) -> Column:
        step = lambda acc, j: F.struct((acc["r"] * ratio(j)).alias("r"), (acc["s"] + acc["r"] * ratio(j)).alias("s"))
        sums = F.aggregate(F.sequence(F.lit(1), F.greatest(steps.cast("int"), F.lit(1))), F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("s")), step, lambda acc: acc["s"])
        return F.exp(log_term(start)) * F.when(steps < 1, 1.0).otherwise(sums)

    down = away(k, k, lambda j: (k - j + 1) / (n - k + j) * (1 - p) / p)
    up = away(k + 1, n - k - 1, lambda j: (n - k - j) / (k + 1 + j) * p / (1 - p))
    return F.when(k < 0, 0.0).when(k >= n, 1.0).when(k <= n * p, down).otherwise(1 - up)
