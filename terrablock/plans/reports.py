"""Further queries by name: distances and gates of a split, joint folds, classes of nodes, tables over draws, lattices."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrablock.functions import canonical
from terrablock.functions import geometry as geo
from terrablock.functions import propagation as prop
from terrablock.functions.storage import saved, shared_folder
from terrablock.operators import classes, design, errors, gates, graph, partition, proximity, ranks, retained
from terrablock.plans.catalog import B, DRAWS, FOLDS, G, MAX_GY, QUERIES, Study, _side, query, rounded, seeds
from terrablock.sources import nodes as src
from terrablock.sources import runner

#: The draw that stands for the reference split where one is looked at alone.
ONE = 1
LATTICE = (src.WIDTH_KM, src.HEIGHT_KM, G, B)


def level_error():
    """Error of the fixed level of the sentinel, which no draw changes."""
    return F.abs(F.col("rssi") - F.lit(prop.SENTINEL_RSSI))


def level_draws(s: Study) -> DataFrame:
    """cell, seed, pop, n, mae of the fixed level on the retained test nodes."""
    one, e = F.lit(1).cast("long"), level_error()
    sums = s.split.tally({"n_all": one, "s_all": e, "n_valid": F.when(F.col("valid"), one).otherwise(0), "s_valid": F.when(F.col("valid"), e)})
    long = F.array(*(F.struct(F.lit(p).alias("pop"), F.col(f"n_{p}").alias("n"), F.try_divide(f"s_{p}", f"n_{p}").alias("mae")) for p in ("valid", "all")))
    return sums.select("cell", "seed", F.inline(long))


# ---------------------------------------------------------------- distances, classes of nodes, folds


@query
def test_train_distance(spark, sf_dir):
    """Of one draw and cell the distances of test nodes, before the buffer, to the nearest training node."""
    n = saved(src.nodes(spark, sf_dir).select("cell", "node_id", "block_id", "x_km", "y_km"))
    roles = partition.block_roles(n.select("cell", "block_id").distinct(), seeds(spark).where(F.col("seed") == ONE))
    placed = saved(n.join(roles, ["cell", "block_id"]))
    d = saved(proximity.nearest_distance(placed.where("role = 'test'"), placed.where("role = 'train'"), ["cell"]))
    middle = errors.order_statistics(d, ["cell"], F.col("d_km"), {"a": F.floor((F.col("total") - 1) / 2), "b": F.floor(F.col("total") / 2)})
    ends = d.groupBy("cell").agg(F.count("d_km").alias("n"), F.min("d_km").alias("low"), F.max("d_km").alias("high"))
    return rounded(ends.join(middle, "cell").select("cell", "n", "low", ((F.col("a") + F.col("b")) / 2).alias("middle"), "high"))


@query
def distance_gate(spark, sf_dir):
    """Of one draw, cell and pair of roles: shared nodes, the least distance between retained nodes, and whether it reaches the buffer."""
    s = Study(spark, sf_dir, draws=[ONE])
    columns = ["cell", "node_id", "x_km", "y_km"]
    left = saved(s.left().select(*columns, "role"))
    train = s.nodes.join(s.roles.where("role = 'train'"), ["cell", "block_id"]).select(*columns)
    parts = {"train": train, "val": left.where("role = 'val'").select(*columns), "test": left.where("role = 'test'").select(*columns)}
    return rounded(gates.distance_gate(parts, B))


@query
def neighbour_class_profile(spark, sf_dir):
    """Mean inclusion given the block is in test by the number m of blocks near the node, with the closed bounds for the cell's own counts."""
    s = Study(spark, sf_dir)
    m = s.split.nodes.select("cell", "node_id", F.size(classes.near_set()).cast("long").alias("m"))
    rows = s.split.inclusion().where("p_given IS NOT NULL").join(m, ["cell", "node_id"])
    per = rows.groupBy("cell", "m").agg(F.count("*").alias("n"), F.avg("p_given").alias("p_given")).join(design.role_counts(s.roles), "cell")
    low = geo.falling_ratio(F.col("k_test") - 1, F.col("n_blocks") - 1, F.col("m"))
    high = geo.falling_ratio(F.col("n_blocks") - 1 - F.col("k_train"), F.col("n_blocks") - 1, F.col("m"))
    return rounded(per.select("cell", "m", "n", "p_given", low.alias("low"), high.alias("high")))


@query
def nearest_in_block(spark, sf_dir):
    """Of each node and other block closer than the buffer the nearest node there."""
    return proximity.nearest_in_blocks(src.lattice(spark, sf_dir), G, B).select("cell", "node_id", "near_block", "o_node")


@query
def node_classes(spark, sf_dir):
    """By cell and number m of near blocks: nodes, and those for which a neighbour's nearest node is near a block that the node itself isn't near."""
    n = saved(src.lattice(spark, sf_dir).select("cell", "node_id", "block_id", "x_km", "y_km"))
    near = saved(proximity.nearest_in_blocks(n, G, B))
    beyond = near.select("cell", F.col("node_id").alias("o_node"), F.col("near_block").alias("far_block"))
    own = near.select("cell", "node_id", F.col("near_block").alias("far_block"))
    hops = near.join(beyond, ["cell", "o_node"]).where("far_block <> block_id").join(own, ["cell", "node_id", "far_block"], "left_anti")
    fails = hops.select("cell", "node_id").distinct().withColumn("fails", F.lit(1))
    m = near.groupBy("cell", "node_id").agg(F.count("*").alias("m"))
    each = n.select("cell", "node_id").join(m, ["cell", "node_id"], "left").join(fails, ["cell", "node_id"], "left")
    return each.groupBy("cell", F.coalesce("m", F.lit(0)).alias("m")).agg(F.count("*").alias("n"), F.count("fails").alias("n_fails"))


@query
def class_counts(spark, sf_dir):
    """Nodes by cell, block and number of near blocks."""
    n = src.lattice(spark, sf_dir)
    m = proximity.near_blocks(n, G, B, MAX_GY).groupBy("cell", "node_id").agg(F.count("*").alias("m"))
    return n.join(m, ["cell", "node_id"], "left").groupBy("cell", "block_id", F.coalesce("m", F.lit(0)).alias("m")).agg(F.count("*").alias("n"))


@query
def kfold_joint(spark, sf_dir):
    """Error of all folds together, over the nodes that the trim between folds leaves, and without the trim, which no draw changes."""
    n = saved(src.nodes(spark, sf_dir).select("cell", "node_id", "block_id", "x_km", "y_km", level_error().alias("e")))
    folds = saved(partition.fold_roles(partition_blocks(n), seeds(spark), FOLDS))
    own = classes.classed(n, proximity.near_blocks(n, G, B, MAX_GY))
    sums = own.groupBy(*classes.KEY).agg(F.sum("e").alias("s"), F.count("*").alias("m"))
    lost = classes.fold_classes(own, folds).join(sums, classes.KEY).groupBy("cell", "seed").agg(F.sum("s").alias("s_lost"), F.sum("m").alias("m_lost"))
    whole = n.groupBy("cell").agg(F.sum("e").alias("s"), F.count("*").alias("n"))
    rows = folds.select("cell", "seed").distinct().join(whole, "cell").join(lost, ["cell", "seed"], "left").fillna(0, ["s_lost", "m_lost"])
    scored = F.col("n") - F.col("m_lost")
    return rounded(rows.select("cell", "seed", "n", scored.alias("n_scored"), (scored / F.col("n")).alias("fraction"), F.try_divide(F.col("s") - F.col("s_lost"), scored).alias("err"), (F.col("s") / F.col("n")).alias("err_whole")))


def partition_blocks(n: DataFrame) -> DataFrame:
    return n.select("cell", "block_id").distinct()


@query
def border_blocks(spark, sf_dir):
    """Test blocks over all draws, emptied or nearly so by the buffer, by whether the block lies on its cell's border."""
    s = Study(spark, sf_dir)
    gx, gy = geo.block_place(F.col("block_id"), MAX_GY)
    placed = s.blocks.select("cell", "block_id", "n_nodes", gx.alias("gx"), gy.alias("gy"))
    box = placed.groupBy("cell").agg(F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1"))
    edge = placed.join(box, "cell").withColumn("border", (F.col("gx") == F.col("x0")) | (F.col("gx") == F.col("x1")) | (F.col("gy") == F.col("y0")) | (F.col("gy") == F.col("y1")))
    kept = s.split.tally({"k": F.lit(1).cast("long")}, ("cell", "seed", "block_id"))
    every = s.roles.where("role = 'test'").join(edge, ["cell", "block_id"]).join(kept, ["cell", "seed", "block_id"], "left").withColumn("share", F.coalesce("k", F.lit(0)) / F.col("n_nodes"))
    return rounded(every.groupBy("cell", "border").agg(F.count("*").alias("n"), F.count_if(F.col("share") == 0).alias("n_empty"), F.count_if((F.col("share") > 0) & (F.col("share") < 0.1)).alias("n_thin"), F.avg("share").alias("share")))


@query
def anova_intervals(spark, sf_dir):
    """The ratio of a cell's components between and within blocks, and the intraclass correlation, with their 95 % bounds by F."""
    layout = design.one_way(src.nodes(spark, sf_dir).where("valid"), ["cell"], "block_id", "rssi")
    return rounded(design.component_intervals(saved(layout), ["cell"]), 5)


@query
def spearman_tied(spark, sf_dir):
    """Rank correlation of level and elevation over a cell's nodes, in steps of 0.1 dB and 0.01: by mean ranks of ties, and by their order."""
    n = src.nodes(spark, sf_dir).select("cell", "node_id", F.floor(F.col("rssi") * 10).alias("x"), F.floor(F.col("elevation") * 100).alias("y"))
    return rounded(ranks.spearman_tied(n, ["cell"], "x", "y", "node_id"))


@query
def central_window(spark, sf_dir):
    """The largest square window of each cell with at most 1,000 nodes."""
    return errors.central_window(src.lattice(spark, sf_dir).select("cell", "node_id", "x_km", "y_km"), 1000).select("cell", "node_id")


@query
def srs_sample(spark, sf_dir):
    """A simple random sample of 50 nodes in each cell and draw of five, and its mean error: smallest hashes of seed and node."""
    n = src.nodes(spark, sf_dir).select("cell", "node_id", level_error().alias("e"))
    draws = spark.range(1, 6).withColumnRenamed("id", "seed")
    key = F.md5(F.concat_ws("|", "seed", "node_id"))
    top = Window.partitionBy("cell", "seed").orderBy("h", "node_id")
    placed = n.crossJoin(F.broadcast(draws)).withColumn("h", key).withColumn("k", F.row_number().over(top)).where("k <= 50")  # five draws
    return rounded(placed.groupBy("cell", "seed").agg(F.count("*").alias("n"), F.avg("e").alias("mean")))


# ---------------------------------------------------------------- tables over draws


@query
def inversions_by_calibration(spark, sf_dir):
    """Draws in which the constant loses to free space, calibrated on all (a) or on valid (b) training nodes."""
    per = saved(Study(spark, sf_dir).per_draw())
    a, b = (errors.inversions(per, "constant", f"fspl_{c}").withColumn("calibration", F.lit(c)) for c in "ab")
    return a.unionByName(b)


@query
def bias_intervals(spark, sf_dir):
    """Bias of the fixed level's error over draws against the whole cell, its Monte Carlo error and RMSE, and whether it differs from zero."""
    s = Study(spark, sf_dir)
    domain = errors.population_mae(s.nodes, ["cell"], {"level": F.col("rssi") - F.lit(prop.SENTINEL_RSSI)}).select("cell", "pop", F.col("mae").alias("theta"))
    return rounded(errors.bias_summary(level_draws(s), domain, ["cell", "pop"]))


@query
def estimator_effects(spark, sf_dir):
    """Variance of the buffered and the unbuffered test error over draws against a simple random sample of the mean test size."""
    s = Study(spark, sf_dir)
    sums = saved(s.nodes.groupBy("cell", "block_id").agg(F.sum(level_error()).alias("s"), F.count("*").alias("m")))
    whole = sums.join(s.roles.where("role = 'test'"), ["cell", "block_id"]).groupBy("cell", "seed").agg((F.sum("s") / F.sum("m")).alias("mae"))
    held = level_draws(s).where("pop = 'all' AND mae IS NOT NULL")
    h = held.groupBy("cell").agg(F.var_samp("mae").alias("v_h"), F.avg("n").alias("n"))
    h0 = whole.groupBy("cell").agg(F.var_samp("mae").alias("v_h0"))
    s2 = s.nodes.groupBy("cell").agg(F.var_samp(level_error()).alias("s2"), F.count("*").alias("n_u"))
    v_a = (1 - F.col("n") / F.col("n_u")) * F.col("s2") / F.col("n")
    rows = h.join(h0, "cell").join(s2, "cell").select("cell", "v_h", "v_h0", v_a.alias("v_a"))
    return rounded(rows.select("*", F.try_divide("v_h", "v_a").alias("deff_h"), F.try_divide("v_h0", "v_a").alias("deff_h0")), 4)


@query
def variance_readings(spark, sf_dir):
    """Readings A and B of the one-draw variance, with and without the finite-population factor."""
    s = Study(spark, sf_dir)
    sums = saved(s.sums())
    n_blocks = s.blocks.groupBy("cell").agg(F.count("*").alias("n_blocks"))
    found = [design.reading_summary(saved(design.cluster_variance(sums, n)), v) for v, n in (("N", n_blocks), ("none", None))]
    return rounded(found[0].unionByName(found[1]), 4)


def weighted_draws(s: Study, included: DataFrame) -> DataFrame:
    """cell, seed, w, t of the retained test nodes: sums of 1/p and of the fixed level's error over p.

    p is a number of the class but for open nodes, so classes are summed once and open nodes come one by one. included:
    inclusion() where p > 0.
    """
    w = included.select("cell", "node_id", (1 / F.col("p")).alias("_w"))
    own = s.split.nodes.join(w, ["cell", "node_id"], "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    return s.split.tally({"w": F.col("_w"), "t": F.col("_w") * level_error()}, nodes=saved(own))


@query
def weighted_estimands(spark, sf_dir):
    """Each draw's Horvitz-Thompson weights 1/p: their mean sum against the cell's size, and the mean weighted error."""
    s = Study(spark, sf_dir)
    p = saved(s.split.inclusion().where("p > 0"))
    per = weighted_draws(s, p)
    draws = s.roles.groupBy("cell").agg(F.count_distinct("seed").alias("n_draws"))
    reach = p.groupBy("cell").agg(F.count("*").alias("n_reached"))
    size = s.nodes.groupBy("cell").agg(F.count("*").alias("n"))
    out = per.groupBy("cell").agg(F.sum("w").alias("w"), F.sum("t").alias("t")).join(draws, "cell").join(reach, "cell").join(size, "cell")
    return rounded(out.select("cell", "n", "n_reached", (F.col("w") / F.col("n_draws")).alias("mean_weight"), (F.col("t") / F.col("n_draws") / F.col("n")).alias("mean_error"), (F.col("t") / F.col("w")).alias("ratio")), 5)


@query
def ratio_bound(spark, sf_dir):
    """The ratio term -cov(err, M) / mean(M) of each cell and population, its bound sd sd / mean, and the correlation."""
    d = level_draws(Study(spark, sf_dir)).where("mae IS NOT NULL")
    n = F.col("n").cast("double")
    sums = d.groupBy("cell", "pop").agg(F.count("*").alias("n_draws"), (-F.covar_pop("mae", n) / F.avg(n)).alias("ratio_term"), (F.stddev_pop("mae") * F.stddev_pop(n) / F.avg(n)).alias("bound"), errors.safe_corr("mae", "n").alias("r"))
    return rounded(sums.withColumn("holds", F.abs("ratio_term") <= F.col("bound") + 1e-9))


@query
def product_variance(spark, sf_dir):
    """Variance over draws of the error sum per test block, Z = X Y with X the error and Y the scored nodes per block."""
    s = Study(spark, sf_dir)
    k = s.roles.where("role = 'test'").groupBy("cell", "seed").agg(F.count("*").alias("k"))
    rows = level_draws(s).where("pop = 'all' AND mae IS NOT NULL").join(k, ["cell", "seed"]).withColumn("y", F.col("n") / F.col("k"))
    return rounded(design.product_variance(rows, ["cell"], "mae", "y"), 3)


@query
def drift_ratio(spark, sf_dir):
    """SD over draws with the buffer against without it, by cell, predictor and population."""
    with_b, without = (errors.drift(Study(spark, sf_dir, b).per_draw()).select("cell", "pred", "pop", F.col("sd").alias(name), F.col("n_draws").alias(f"n_{name}")) for b, name in ((B, "sd_b"), (0.0, "sd_0")))
    return rounded(with_b.join(without, ["cell", "pred", "pop"]).withColumn("ratio", F.try_divide("sd_b", "sd_0")))


@query
def sign_changes(spark, sf_dir):
    """By cell and population: draws whose difference of the constant and free space has the other sign than its mean, and ties."""
    per = Study(spark, sf_dir).per_draw().where("mae IS NOT NULL")
    wide = per.groupBy("cell", "seed", "pop").agg(*(F.max(F.when(F.col("pred") == p, F.col("mae"))).alias(p) for p in ("constant", "fspl_a")))
    d = wide.select("cell", "pop", F.round(F.col("constant") - F.col("fspl_a"), 9).alias("d")).where("d IS NOT NULL")
    m = d.groupBy("cell", "pop").agg(F.count("*").alias("n_draws"), F.avg("d").alias("mean"))
    return rounded(d.join(m, ["cell", "pop"]).groupBy("cell", "pop", "n_draws", "mean").agg(F.count_if(F.sign("d") == -F.sign("mean")).alias("n_against"), F.count_if(F.col("d") == 0).alias("n_ties")))


@query
def valid_share_signs(spark, sf_dir):
    """By cell and role: draws whose valid share lies over, under or at that of training."""
    share = QUERIES["valid_fraction"](spark, sf_dir).where("role <> 'train'")
    d = F.col("over_train")
    return rounded(share.groupBy("cell", "role").agg(F.count_if(d > 0).alias("n_over"), F.count_if(d < 0).alias("n_under"), F.count_if(d == 0).alias("n_same"), F.avg(d).alias("mean")))


@query
def best_draw(spark, sf_dir):
    """The draw of least error of each cell, predictor and population, the first of ties."""
    per = Study(spark, sf_dir).per_draw().where("mae IS NOT NULL").withColumn("mae", F.round("mae", 6))
    return per.groupBy("cell", "pred", "pop").agg(F.min(F.struct("mae", "seed")).alias("m")).select("cell", "pred", "pop", "m.seed", "m.mae")


@query
def falling_steps(spark, sf_dir):
    """The series of a cell's errors in draw order: steps that fall, and those of them after the first that doesn't."""
    per = level_draws(Study(spark, sf_dir)).where("pop = 'all' AND mae IS NOT NULL").select("cell", "seed", F.round("mae", 6).alias("v"))
    order = Window.partitionBy("cell").orderBy("seed")
    steps = per.withColumn("fell", F.col("v") < F.lag("v").over(order)).where("fell IS NOT NULL")
    warm = steps.withColumn("warm", F.max((~F.col("fell")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return warm.groupBy("cell").agg(F.count("*").alias("n_steps"), F.count_if("fell").alias("n_fell"), F.count_if(F.col("fell") & (F.col("warm") == 1)).alias("n_fell_warm"))


@query
def retention_correlation(spark, sf_dir):
    """Correlation over draws of the test retention of each two cells."""
    share = QUERIES["retention"](spark, sf_dir).where("role = 'test'").select("seed", "cell", "share")
    share = saved(share)
    pairs = share.withColumnRenamed("cell", "a").withColumnRenamed("share", "x").join(share.withColumnRenamed("cell", "b").withColumnRenamed("share", "y"), "seed").where("a < b")
    return rounded(pairs.groupBy("a", "b").agg(F.count("*").alias("n"), errors.safe_corr("x", "y").alias("r")), 5)


@query
def campaign_table(spark, sf_dir):
    """Two predictors over the first five draws: median, SD, how far over a floor of 0.132 dB, sentinel parity and wins."""
    per = saved(Study(spark, sf_dir, draws=list(range(1, 6))).per_draw())
    wide = per.groupBy("cell", "seed", "pop").agg(*(F.max(F.when(F.col("pred") == p, F.col("mae"))).alias(p) for p in ("constant", "fspl_b")))
    wins = wide.where("pop = 'valid'").groupBy("cell").agg(F.count_if(F.col("fspl_b") < F.col("constant")).alias("n_wins"))
    parity = wide.where("pop = 'sentinel'").groupBy("cell").agg(F.count_if(F.abs(F.col("fspl_b") - F.col("constant")) <= 0.117).alias("n_parity"))
    rows = per.where("mae IS NOT NULL AND pop = 'valid' AND pred IN ('constant', 'fspl_b')").groupBy("cell", "pred").agg(F.count("*").alias("n"), F.median("mae").alias("middle"), F.stddev_samp("mae").alias("sd"))
    ratio = F.col("sd") / 0.132
    out = rows.select("*", ratio.alias("over_floor"), (ratio >= 3).alias("far_over"), (ratio < 2).alias("near_floor"))
    return rounded(out.join(wins, "cell", "left").join(parity, "cell", "left"))


@query
def plan_status(spark, sf_dir):
    """The plan (cell, predictor, draw) with its run status and errors: runs, failures, errors that agree with the block sums, and whether the batch is whole."""
    s = Study(spark, sf_dir)
    plan, status = planned(s)
    sums = s.sums().where("pop = 'all'").groupBy("cell", "seed", "pred").agg((F.sum("s") / F.sum("m")).alias("again"))
    per = s.per_draw().where("pop = 'all'").select("cell", "seed", "pred", "mae")
    keys = ["cell", "pred", "seed"]
    rows = plan.join(status, keys, "left").join(per, keys, "left").join(sums, keys, "left")
    same = F.abs(F.col("mae") - F.col("again")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("again"))
    out = rows.groupBy("cell", "pred").agg(F.count("*").alias("n_plan"), F.count_if(F.col("rc") == 0).alias("n_done"), F.count_if(F.col("rc") != 0).alias("n_failed"), F.count_if(F.col("rc").isNull()).alias("n_open"), F.count_if((F.col("rc") == 0) & same).alias("n_agree"))
    return out.withColumn("label", F.when(F.col("n_done") == F.col("n_plan"), "COMPLETE").otherwise("PARTIAL"))


def planned(s: Study) -> tuple[DataFrame, DataFrame]:
    """The plan, and a status table with failed runs (rc 1) and runs that aren't there, by a rule on the draw's number."""
    plan = s.roles.select("cell", "seed").distinct().withColumn("pred", F.explode(F.array(F.lit("constant"), F.lit("fspl_a"))))
    kind = F.col("seed") % 7 + F.when(F.col("pred") == "constant", 0).otherwise(1)
    return plan, plan.withColumn("rc", F.when(kind == 3, 1).otherwise(0)).where((kind != 5) | (F.col("cell") == "Q1"))


@query
def missing_of_plan(spark, sf_dir):
    """The runs of the plan that no finished run stands for."""
    plan, status = planned(Study(spark, sf_dir))
    return gates.missing_runs(plan, status.where("rc = 0"), ["cell", "pred", "seed"])


@query
def key_difference(spark, sf_dir):
    """Keys that only one of the plan and the status table has, with the side."""
    plan, status = planned(Study(spark, sf_dir))
    keys = ["cell", "pred", "seed"]
    ran = status.withColumn("seed", F.when(F.col("seed") == 60, 61).otherwise(F.col("seed")).cast("long")).select(*keys)
    left, right = plan.select(*keys).exceptAll(ran), ran.exceptAll(plan.select(*keys))
    return left.withColumn("side", F.lit("plan")).unionByName(right.withColumn("side", F.lit("status")))


@query
def trained_level(spark, sf_dir):
    """Error on valid test nodes, without a buffer, of the level that is the median of each draw's valid training nodes."""
    s = Study(spark, sf_dir, 0.0)
    level = saved(errors.draw_medians(s.nodes, s.roles, {"level": F.when(F.col("valid"), F.col("rssi"))}))
    test = s.nodes.where("valid").select("cell", "block_id", "rssi").join(s.roles.where("role = 'test'"), ["cell", "block_id"]).join(level, ["cell", "seed"])
    per = test.groupBy("cell", "seed").agg(F.avg(F.abs(F.col("rssi") - F.col("level"))).alias("mae"))
    return rounded(per.groupBy("cell").agg(F.count("*").alias("n_draws"), F.avg("mae").alias("mean"), F.stddev_samp("mae").alias("sd")))


@query
def draw_seed_ratio(spark, sf_dir):
    """SD of the valid test error over five draws against that over three trainings (their noise), by cell."""
    s = Study(spark, sf_dir, draws=list(range(1, 6)))
    trained = F.explode(F.array(*(F.struct(F.lit(k).alias("training"), (F.abs(F.pmod(F.col("node_id") * (7919 + k), F.lit(101)) - 50) / (5.0 + k % 3)).alias("e")) for k in (42, 43, 44))))
    rows = s.left().where("role = 'test' AND valid").select("cell", "seed", trained.alias("t")).groupBy("cell", "seed", "t.training").agg(F.avg("t.e").alias("mae"))
    rows = saved(rows)
    by_draw = rows.groupBy("cell", "training").agg(F.stddev_samp("mae").alias("sd")).groupBy("cell").agg(F.avg("sd").alias("sd_draws"))
    by_seed = rows.groupBy("cell", "seed").agg(F.stddev_samp("mae").alias("sd")).groupBy("cell").agg(F.count("*").alias("n_draws"), F.avg("sd").alias("sd_trainings"))
    return rounded(by_draw.join(by_seed, "cell").withColumn("ratio", F.try_divide("sd_draws", "sd_trainings")))


# ---------------------------------------------------------------- columns, channels, labels


@query
def standardised_distance(spark, sf_dir):
    """Distance to the antenna by the mean and SD (at least 1) of each cell's training nodes in one draw."""
    s = Study(spark, sf_dir, draws=[ONE])
    train = s.nodes.join(s.roles.where("role = 'train'"), ["cell", "block_id"]).groupBy("cell").agg(F.avg("dist_m").alias("m"), F.greatest(F.stddev_pop("dist_m"), F.lit(1.0)).alias("sd"))
    return rounded(s.nodes.join(train, "cell").select("node_id", ((F.col("dist_m") - F.col("m")) / F.col("sd")).alias("z")))


@query
def channel_outputs(spark, sf_dir):
    """Raw outputs (elevation, slope and ndvi stand for them) decoded by channel and clamped to the channel's limits."""
    raw = {"loss": F.col("elevation"), "vegetation": F.col("slope") * 4 - 1, "terrain": F.col("ndvi") * 2, "rssi": F.col("elevation") * -1, "coverage": F.col("ndvi")}
    values = {c: prop.decoded(x, c) for c, x in raw.items()}
    return rounded(src.lattice(spark, sf_dir).select("node_id", *(prop.clamped(v, c).alias(c) for c, v in values.items())))


@query
def channel_ranges(spark, sf_dir):
    """By channel of a prediction: share out of the channel's range, 99th percentile of the excess, and errors raw and clamped."""
    n = src.nodes(spark, sf_dir)
    pairs = {"loss": (F.col("pl"), 98 - F.col("pred_b")), "rssi": (F.col("rssi"), F.col("pred_b") - 40)}
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("channel"), t.alias("truth"), v.alias("v"), prop.clamped(v, c).alias("w")) for c, (t, v) in pairs.items())))
    rows = saved(n.select(each).withColumn("excess", F.abs(F.col("v") - F.col("w"))))
    at = 0.99 * (F.col("total") - 1)
    edges = errors.order_statistics(rows, ["channel"], F.col("excess"), {"low": F.floor(at), "high": F.ceil(at)})
    p99 = edges.select("channel", (F.col("low") + (at - F.floor(at)) * (F.col("high") - F.col("low"))).alias("p99"))
    sums = rows.groupBy("channel").agg(F.count("*").alias("n"), F.avg((F.col("excess") > 0).cast("double")).alias("share_out"), F.avg(F.abs(F.col("v") - F.col("truth"))).alias("mae_raw"), F.avg(F.abs(F.col("w") - F.col("truth"))).alias("mae_clamped"))
    return rounded(sums.join(p99, "channel"))


@query
def physics_penalties(spark, sf_dir):
    """Mean Huber loss, free-space hinge (a loss below free space) and vegetation penalty of a prediction, by cell."""
    loss = 98 - F.col("pred_b")
    hinge = F.greatest(prop.fspl(F.col("dist_m"), F.lit(src.BAND_MHZ)) - loss, F.lit(0.0))
    canopy = prop.huber(F.col("slope") * 20 - prop.canopy_loss(F.col("ndvi") * 30, F.lit(src.BAND_MHZ)), 3.0)
    n = src.nodes(spark, sf_dir).where("valid")
    return rounded(n.groupBy("cell").agg(F.avg(prop.huber(loss - F.col("pl"))).alias("huber"), F.avg(hinge).alias("hinge"), F.avg(canopy).alias("vegetation")), 5)


@query
def baseline_predictions(spark, sf_dir):
    """By model: mean level and share covered of its prediction for the nodes in reach of an antenna."""
    n = src.nodes(spark, sf_dir).where("valid").join(src.antennas(spark, sf_dir).select("site_id", "freq"), "site_id")
    found = None
    args = (F.col("dist_m"), F.col("freq"), F.lit(src.HEIGHT_M), F.lit(src.MOBILE_M), F.lit(src.POWER_DBM + src.GAIN_DBI))
    for model in prop.MODELS:
        p = prop.predict(model, *args)
        one = n.agg(F.lit(model).alias("model"), F.count("*").alias("n"), F.avg(p["rssi"]).alias("rssi"), F.avg(p["covered"].cast("double")).alias("covered"))
        found = one if found is None else found.unionByName(one)
    return rounded(found, 5)


@query
def haversine_distance(spark, sf_dir):
    """Great-circle distance of each node to the antenna that is nearest by it."""
    lon, lat = lambda x: -49.5 + x / 111, lambda y: -22.5 + y / 111
    sites = src.antennas(spark, sf_dir).select("site_id", lon(F.col("sx")).alias("slon"), lat(F.col("sy")).alias("slat"))
    n = src.lattice(spark, sf_dir).select("node_id", lon(F.col("x_km")).alias("lon"), lat(F.col("y_km")).alias("lat"))
    return proximity.nearest_on_sphere(n, sites, ["node_id"])


@query
def corner_projection(spark, sf_dir):
    """Nodes projected from the least longitude and latitude of their cell."""
    d = src.lattice(spark, sf_dir).select("cell", "node_id", (-49.5 + F.col("x_km") / 111).alias("lon"), (-22.5 + F.col("y_km") / 111).alias("lat"))
    low = d.groupBy("cell").agg(F.min("lon").alias("lon0"), F.min("lat").alias("lat0"))
    x, y = geo.project(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    return rounded(d.join(low, "cell").select("node_id", x.alias("x"), y.alias("y")))


@query
def run_labels(spark, sf_dir):
    """Labels of runs taken apart: block, model, quadrant, draw; and a city from a file name."""
    s = seeds(spark).crossJoin(F.broadcast(src.lattice(spark, sf_dir).select("cell").distinct()))  # four cells
    label = F.concat_ws("_", F.lit("g1"), F.when(F.col("seed") % 2 == 0, "gnn").otherwise("mlp"), "cell", F.concat(F.lit("s"), "seed"))
    part = F.split(label, "_")
    name = F.concat(F.lit("antenas_"), F.when(F.col("seed") % 3 == 0, "bauru").otherwise("lins"), F.lit("_2024.csv"))
    return s.select(label.alias("label"), part[0].alias("block"), part[1].alias("model"), part[2].alias("quadrant"), F.regexp_extract(part[3], r"s(\d+)", 1).cast("int").alias("draw"), F.regexp_extract(name, r"antenas_([a-z]+)_", 1).alias("city"))


@query
def operator_ids(spark, sf_dir):
    """Names of operators to their ids; unknown ones get the last."""
    k = F.col("n_nationkey")
    name = F.element_at(F.array(F.lit("claro"), F.lit(" TIM"), F.lit("Vivo"), F.lit("nextel"), F.lit("OUTROS")), (k % 5 + 1).cast("int"))
    return src.table(spark, sf_dir, "nation").select("n_nationkey", name.alias("name"), prop.operator_id(name).alias("id"))


@query
def mixture_rules(spark, sf_dir):
    """The error as a mixture of sentinel and valid parts, and the share of sentinels from which the fixed level wins; the floor of the link budget."""
    per = errors.population_mae(src.nodes(spark, sf_dir), ["cell"], {"a": F.col("rssi") + 100, "b": F.col("pred_b") - F.col("rssi")})
    get = lambda p, q: F.max(F.when((F.col("pred") == p) & (F.col("pop") == q), F.col("mae")))
    n = lambda q: F.max(F.when(F.col("pop") == q, F.col("n")))
    rows = per.groupBy("cell").agg((n("sentinel") / n("all")).alias("share"), get("a", "valid").alias("a"), get("b", "valid").alias("e"), get("b", "sentinel").alias("delta"), get("b", "all").alias("mae"))
    mixed = F.col("share") * F.col("delta") + (1 - F.col("share")) * F.col("e")
    threshold = F.try_divide(F.col("a") - F.col("e"), F.col("a") - F.col("e") + F.col("delta"))
    least = F.least(F.lit(200.0), F.lit(src.POWER_DBM + 150))
    floor = F.abs(least - prop.SENTINEL_LOSS) + F.abs(src.POWER_DBM - least - prop.SENTINEL_RSSI)
    return rounded(rows.select("cell", "share", "mae", mixed.alias("mixed"), threshold.alias("threshold"), ((1 - F.col("share")) * F.col("a") < mixed).alias("level_wins"), floor.alias("floor")))


@query
def r2_ceiling(spark, sf_dir):
    """By cell: the share of the level's variance that lies between blocks, the most that a predictor of block means explains."""
    n = src.nodes(spark, sf_dir).where("valid")
    blocks = n.groupBy("cell", "block_id").agg(F.count("*").alias("k"), F.avg("rssi").alias("m"), F.var_pop("rssi").alias("v"))
    within = blocks.groupBy("cell").agg((F.sum(F.col("k") * F.col("v")) / F.sum("k")).alias("within"))
    return rounded(n.groupBy("cell").agg(F.var_pop("rssi").alias("total")).join(within, "cell").select("cell", "total", "within", (1 - F.col("within") / F.col("total")).alias("ceiling")))


@query
def binomial_test(spark, sf_dir):
    """Exact lower tail and z-score of the draws in which a cell's largest test block held valid nodes, for a chance of one half."""
    s = Study(spark, sf_dir)
    hits = s.blocks.join(s.roles.where("role = 'test'"), ["cell", "block_id"]).groupBy("cell", "seed").agg((F.sum("n_valid") / F.sum("n_nodes") > 0.3).cast("long").alias("hit"))
    per = hits.groupBy("cell").agg(F.count("*").alias("n"), F.sum("hit").alias("k"))
    z = (F.col("k") / F.col("n") - 0.5) / F.sqrt(0.25 / F.col("n"))
    return rounded(per.select("cell", "n", "k", design.binomial_tail(F.col("n"), F.col("k"), F.lit(0.5)).alias("tail"), z.alias("z")))


# ---------------------------------------------------------------- lattices, graphs, data gates


@query
def retained_area(spark, sf_dir):
    """The retained-area experiment over the draws, on the lattice of blocks alone."""
    return rounded(retained.retained_area(spark, seeds(spark), *LATTICE))


@query
def cover_retention(spark, sf_dir):
    """Expected retention of test blocks from the counts of covering neighbours, by mean field and exactly."""
    return rounded(retained.cover_retention(spark, *LATTICE, 0.2, 20), 9)


@query
def grid_steps(spark, sf_dir):
    """The modal step of the lattice along rows, and the share of nodes with all eight neighbours."""
    n = saved(src.lattice(spark, sf_dir).select("node_id", "cell", "x_km", "y_km"))
    side = _side(spark, sf_dir)
    step = F.round(F.col("x_km") - F.lag("x_km").over(Window.partitionBy(F.floor(F.col("node_id") / side)).orderBy("node_id")), 6)
    modal = n.select(step.alias("step")).where("step IS NOT NULL").groupBy("step").agg(F.count("*").alias("k")).agg(F.max(F.struct("k", "step")).alias("m"))
    degree = graph.neighbour_edges(n, side).where("src <> dst").groupBy("src").agg(F.count("*").alias("d"))
    whole = n.agg(F.count("*").alias("n")).crossJoin(F.broadcast(degree.agg(F.count_if(F.col("d") == 8).alias("n_whole"))))
    return rounded(modal.crossJoin(F.broadcast(whole)).select(F.col("m.step").alias("step"), F.col("m.k").alias("n_step"), "n", "n_whole", (F.col("n_whole") / F.col("n")).alias("share")))


@query
def induced_report(spark, sf_dir):
    """Edges that stay, cross or go when the graph is cut to valid nodes, and links to antennas that stay, by cell."""
    n = saved(src.nodes(spark, sf_dir))
    return graph.cut_report(graph.neighbour_edges(n, _side(spark, sf_dir)), graph.antenna_links(n.select("cell", "node_id", "x_km", "y_km"), src.antennas(spark, sf_dir), 30.0, F.lit(0.0)), n)


@query
def relabelled_edges(spark, sf_dir):
    """The induced edges of valid nodes by dense numbers from 0 in the order of the nodes."""
    n = saved(src.nodes(spark, sf_dir).where("valid").select("node_id"))
    return graph.relabelled(graph.neighbour_edges(n, _side(spark, sf_dir)), n)


@query
def untrainable(spark, sf_dir):
    """Cells, draws and roles with no link to an antenna in reach: nothing can be trained there."""
    s = Study(spark, sf_dir)
    linked = s.nodes.groupBy("cell", "block_id").agg(F.count_if(F.col("dist_m") <= 1500).alias("n_links"))
    per = linked.join(s.roles, ["cell", "block_id"]).groupBy("cell", "seed", "role").agg(F.sum("n_links").alias("n_links"))
    return per.where("n_links < 40").withColumn("trainable", F.col("n_links") > 0)


@query
def data_gates(spark, sf_dir):
    """Assertions on the node table by cell: identity, constants, moments, missing numbers; and the design effect of a permuted target."""
    s = Study(spark, sf_dir)
    return rounded(gates.data_gates(s.nodes, s.roles), 4)


@query
def reconstruction(spark, sf_dir):
    """Test sizes declared by block counts against those rebuilt from nodes, with relative error and the tolerances it meets."""
    s = Study(spark, sf_dir)
    declared = s.blocks.join(s.roles.where("role = 'test'"), ["cell", "block_id"]).groupBy("cell", "seed").agg(F.sum("n_nodes").alias("declared"))
    rebuilt = s.split.tally({"rebuilt": F.lit(1).cast("long")})
    error = F.abs(F.coalesce("rebuilt", F.lit(0)) - F.col("declared")) / F.col("declared")
    return rounded(declared.join(rebuilt, ["cell", "seed"], "left").select("cell", "seed", "declared", F.coalesce("rebuilt", F.lit(0).cast("long")).alias("rebuilt"), error.alias("error"), (error <= 1e-3).alias("close"), (error <= 1e-4).alias("exact")))


@query
def digest_chain(spark, sf_dir):
    """Digests of the partitions under two ways to build them: equal, different or missing on one side."""
    s = Study(spark, sf_dir, draws=[1, 2])
    left = saved(s.left().select("cell", "seed", "role", "node_id"))
    own = gates.id_digest(left, ["cell", "seed", "role"], "node_id")
    other = gates.id_digest(left.where("NOT (cell = 'Q2' AND seed = 2 AND node_id % 2 = 0) AND NOT (cell = 'Q3' AND role = 'val')"), ["cell", "seed", "role"], "node_id")
    return gates.digest_chain(own, other, ["cell", "seed", "role"])


def cell_records(spark, sf_dir, b: float = B) -> DataFrame:
    """A nested record of each cell: counts, extents and its blocks in order of their numbers."""
    n = saved(src.nodes(spark, sf_dir).select("cell", "block_id", "valid", "x_km", "y_km"))
    blocks = n.groupBy("cell", "block_id").agg(F.count("*").alias("n_nodes"), F.count_if("valid").alias("n_valid"))
    listed = blocks.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("block_id", "n_nodes", "n_valid"))).alias("blocks"))  # a cell's blocks
    box = n.groupBy("cell").agg(F.struct(F.min("x_km").alias("x0"), F.max("x_km").alias("x1"), F.min("y_km").alias("y0"), F.max("y_km").alias("y1")).alias("extent"), F.count("*").alias("n"))
    return box.join(listed, "cell").select("cell", "n", "extent", "blocks", F.lit(b).alias("buffer"), F.lit("run of /home/someone/work").alias("note"))


@query
def record_digests(spark, sf_dir):
    """Canonical text of each cell's record, its length and digest; home folders in free text are masked."""
    rows = canonical.canonical_rows(cell_records(spark, sf_dir), masks={r"/home/[^/ ]+": "/home/<user>"}, digits=6)
    return rows.select("cell", F.length("text").alias("length"), "digest")


@query
def record_difference(spark, sf_dir):
    """Leaves in which the records of the cells differ from those of the valid blocks alone, with another buffer."""
    left = cell_records(spark, sf_dir).drop("note")
    right = left.withColumn("blocks", F.filter("blocks", lambda x: x["n_valid"] > 0)).withColumn("buffer", F.lit(0.0))
    return canonical.leaf_diff(left, right, ["cell"])


@query
def run_status(spark, sf_dir):
    """The blocks of each cell, computed by a batch that stops after one cell and goes on: status with digests, by cell."""
    n = saved(src.nodes(spark, sf_dir).select("cell", "block_id", "valid"))
    planned = n.select("cell").distinct()
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    compute = lambda cells: partition.blocks(n.join(F.broadcast(cells), "cell", "left_semi"))  # noqa: E731  (at most a batch of cells)
    runner.run_cells(spark, planned.orderBy("cell").limit(1), compute, path)
    return runner.run_cells(spark, planned, compute, path, batch=2)


@query
def merged_cells(spark, sf_dir):
    """The cells as one table with dense node numbers: each cell's own from 0, and an offset by the cells before it."""
    n = saved(src.lattice(spark, sf_dir).select("cell", "node_id"))
    sizes = n.groupBy("cell").agg(F.count("*").alias("n"))
    offset = sizes.select("cell", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # a row for each cell
    return graph.dense_numbers(n, ["cell"], "node_id", "number").join(offset, "cell").select("cell", "node_id", (F.col("number") + F.col("offset")).alias("merged"))
