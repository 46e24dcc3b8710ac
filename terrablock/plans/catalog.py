"""The queries by name: each takes (spark, sf_dir) and gives a DataFrame over the whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property, wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrablock.functions import geometry as geo
from terrablock.functions import propagation as prop
from terrablock.functions.quantiles import t_quantile
from terrablock.functions.storage import saved
from terrablock.operators import cells, classes, design, errors, gates, graph, partition, proximity
from terrablock.sources import nodes as src

G, B, MAX_GY = src.BLOCK_KM, 2.0, int(src.HEIGHT_KM // src.BLOCK_KM)
DRAWS, FOLDS = 60, 6
#: Draws of the queries that only count retained nodes.
MANY_DRAWS, SOME_DRAWS = 200, 100
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LEVELS = (-130.0, -120.0, -110.0, -100.0)


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def seeds(spark: SparkSession, n: int = DRAWS) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", "seed")


_shared: list[dict] = []  # the studies of the open sharing() blocks, innermost last


def kept(method: Callable) -> Callable:
    """Inside sharing() a study saves the method's table and gives it again."""

    @wraps(method)
    def once(self) -> DataFrame:
        if not _shared:
            return method(self)
        tables = self.__dict__.setdefault("tables", {})
        if method.__name__ not in tables:
            tables[method.__name__] = saved(method(self))
        return tables[method.__name__]

    return once


@contextmanager
def sharing() -> Iterator[None]:
    """Queries built inside it that ask for the same study share one."""
    _shared.append({})
    try:
        yield
    finally:
        _shared.pop()


class Study:
    """The parts that many queries share; each is saved where it is used more than once."""

    def __new__(cls, spark: SparkSession, sf_dir: str, b: float = B, draws: list[int] | int = DRAWS):
        if not _shared:
            return super().__new__(cls)
        return _shared[-1].setdefault((sf_dir, b, draws if isinstance(draws, int) else tuple(draws)), super().__new__(cls))

    def __init__(self, spark: SparkSession, sf_dir: str, b: float = B, draws: list[int] | int = DRAWS):
        """draws: the first so many, or a list of them."""
        if "spark" in self.__dict__:
            return
        self.spark, self.b = spark, b
        self.nodes = saved(src.nodes(spark, sf_dir))
        self.blocks = saved(partition.blocks(self.nodes))
        wanted = seeds(spark, draws) if isinstance(draws, int) else seeds(spark).where(F.col("seed").isin(draws))
        self.roles = saved(partition.block_roles(self.blocks, wanted))

    def near(self) -> DataFrame:
        return proximity.near_blocks(self.nodes, G, self.b, MAX_GY)

    @cached_property
    def split(self) -> classes.Split:
        return classes.Split(self.nodes, self.roles, self.near() if self.b > 0 else None, self.b)

    def left(self) -> DataFrame:
        return self.split.left() if self.b > 0 else partition.held_out(self.nodes, self.roles)

    @kept
    def fitted(self) -> DataFrame:
        """cell, seed, constant (median level of the training nodes), off_a and off_b (median of level + FSPL, all and valid)."""
        level = F.col("rssi") + free_space()
        return errors.draw_medians(self.nodes, self.roles, {"constant": F.col("rssi"), "off_a": level, "off_b": F.when(F.col("valid"), level)})

    def scored(self) -> DataFrame:
        """The retained test nodes with e_constant, e_fspl_a, e_fspl_b."""
        fit = saved(self.fitted())  # a row for each cell and draw
        test = self.left().where("role = 'test'").join(fit, ["cell", "seed"], "left")
        return test.withColumns({"e_constant": F.col("rssi") - F.col("constant"), "e_fspl_a": F.col("rssi") - (F.col("off_a") - free_space()), "e_fspl_b": F.col("rssi") - (F.col("off_b") - free_space())})

    @kept
    def per_draw(self) -> DataFrame:
        return errors.population_mae(self.scored(), ["cell", "seed"], error_columns())

    @kept
    def sums(self) -> DataFrame:
        return errors.block_sums(self.scored(), ["cell", "seed"], error_columns())


def error_columns() -> dict[str, Column]:
    return {p: F.col(f"e_{p}") for p in ("constant", "fspl_a", "fspl_b")}


def free_space() -> Column:
    return prop.fspl(F.col("dist_m"), F.lit(src.BAND_MHZ))


# ---------------------------------------------------------------- nodes, geometry, propagation


@query
def node_table(spark, sf_dir):
    return rounded(src.nodes(spark, sf_dir).select("node_id", "cell", "block_id", "x_km", "y_km", "site_id", "dist_m", "valid", "pl", "rssi", "covered", "pred_a", "pred_b"))


@query
def synthetic_grid(spark, sf_dir):
    return rounded(src.grid(spark, -49.6, -48.6, -22.8, -21.8, 60), 9)


@query
def project_xy(spark, sf_dir):
    degrees = src.lattice(spark, sf_dir).select("node_id", (-49.5 + F.col("x_km") / 111).alias("lon"), (-22.5 + F.col("y_km") / 111).alias("lat"))
    x, y = geo.project(F.col("lon"), F.col("lat"), -49.5, -22.5)
    return rounded(degrees.select("node_id", x.alias("x"), y.alias("y")))


@query
def cell_extents(spark, sf_dir):
    box = src.lattice(spark, sf_dir).select("cell", (-49.5 + F.col("x_km") / 111).alias("lon"), (-22.5 + F.col("y_km") / 111).alias("lat")).groupBy("cell")
    lows = box.agg(F.min("lon").alias("a"), F.max("lon").alias("b"), F.min("lat").alias("c"), F.max("lat").alias("d"))
    w, h = geo.extent_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return rounded(lows.select("cell", w.alias("width"), h.alias("height")))


@query
def block_ids(spark, sf_dir):
    gx, gy = geo.block_place(F.col("block_id"), MAX_GY)
    return rounded(src.lattice(spark, sf_dir).select("node_id", "block_id", gx.alias("gx"), gy.alias("gy"), geo.border_distance(F.col("x_km"), F.col("y_km"), G).alias("border_km")))


@query
def block_table(spark, sf_dir):
    return partition.blocks(src.nodes(spark, sf_dir))


@query
def block_neighbours(spark, sf_dir):
    """How many of the eight neighbouring blocks exist in the cell, sought by column and row, never by flat number."""
    gx, gy = geo.block_place(F.col("block_id"), MAX_GY)
    b = src.lattice(spark, sf_dir).select("cell", "block_id").distinct().select("cell", "block_id", gx.alias("gx"), gy.alias("gy"))
    shift = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = b.withColumn("dx", F.explode(shift)).withColumn("dy", F.explode(shift)).where("dx <> 0 OR dy <> 0")
    around = around.select("cell", "block_id", (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"))
    return around.join(b.select("cell", "gx", "gy", F.lit(1).alias("hit")), ["cell", "gx", "gy"], "left").groupBy("cell", "block_id").agg(F.count("hit").alias("n"))


@query
def propagation_models(spark, sf_dir):
    near = proximity.nearest_site(src.lattice(spark, sf_dir), src.antennas(spark, sf_dir)).join(F.broadcast(src.antennas(spark, sf_dir)), "site_id")  # 25 antennas
    models = {m: f(F.col("dist_m"), F.col("freq"), F.lit(src.HEIGHT_M), F.lit(src.MOBILE_M)) for m, f in prop.MODELS.items()}
    return rounded(near.select("node_id", *(c.alias(m) for m, c in models.items())), 5)


@query
def combined_loss(spark, sf_dir):
    near = proximity.nearest_site(src.lattice(spark, sf_dir), src.antennas(spark, sf_dir)).join(F.broadcast(src.antennas(spark, sf_dir)), "site_id")
    out = {e: prop.combined_loss(F.col("dist_m"), F.col("freq"), F.lit(src.HEIGHT_M), F.lit(src.MOBILE_M), F.col("ndvi"), F.col("slope"), e) for e in ("urban", "suburban", "rural")}
    return rounded(near.select("node_id", *(c.alias(e) for e, c in out.items())), 5)


@query
def enriched_targets(spark, sf_dir):
    n = src.nodes(spark, sf_dir)
    loss, level = prop.terrain_corrected(F.col("pl"), F.col("rssi"), F.col("slope") / 2, F.col("slope"))
    shadow = prop.shadow_margin(F.col("ndvi"), F.col("dist_m"), F.lit(src.BAND_MHZ))
    bend = prop.diffraction_loss(F.col("elevation") * 40, F.col("slope"), F.col("dist_m"), F.lit(src.BAND_MHZ))
    return rounded(n.select("node_id", loss.alias("loss"), level.alias("level"), shadow.alias("shadow"), bend.alias("diffraction"), prop.coverage_class(level).alias("class")), 5)


@query
def retention_laws(spark, sf_dir):
    """The mean-field law, in closed form and summed over the 256 states of the neighbours, for (g, b, q)."""
    cases = spark.createDataFrame([(g, b, k / 10) for g, b in ((10.0, 2.0), (5.0, 2.0), (10.0, 1.0)) for k in range(11)], "g double, b double, q double")
    bit = [(F.col("s").bitwiseAND(1 << i) / (1 << i)).cast("int") for i in range(8)]
    states = cases.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(255))))
    chance = math.prod(F.when(x == 1, 1 - F.col("q")).otherwise(F.col("q")) for x in bit)
    area = geo.trimmed_area(F.col("g"), F.col("g"), F.col("b"), dict(zip([*geo.SIDES, *geo.CORNERS], bit, strict=True)))
    summed = states.groupBy("g", "b", "q").agg(F.sum(chance * area / (F.col("g") * F.col("g"))).alias("enumerated"))
    return rounded(summed.select("g", "b", "q", geo.retention_law(F.col("g"), F.col("b"), F.col("q")).alias("law"), "enumerated"))


@query
def inclusion_law(spark, sf_dir):
    """Chance that a test node with m neighbouring blocks is kept: all m among the other test blocks, or none among training blocks."""
    counts = design.role_counts(partition.block_roles(partition.blocks(src.nodes(spark, sf_dir)), seeds(spark).where("seed = 1")))
    rows = counts.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(4))))
    low = geo.falling_ratio(F.col("k_test") - 1, F.col("n_blocks") - 1, F.col("m"))
    high = geo.falling_ratio(F.col("n_blocks") - 1 - F.col("k_train"), F.col("n_blocks") - 1, F.col("m"))
    return rounded(rows.select("cell", "n_blocks", "m", low.alias("low"), high.alias("high")), 9)


# ---------------------------------------------------------------- splits and joins


@query
def block_roles(spark, sf_dir):
    return partition.block_roles(partition.blocks(src.nodes(spark, sf_dir)), seeds(spark))


@query
def kfold_roles(spark, sf_dir):
    return partition.fold_roles(partition.blocks(src.nodes(spark, sf_dir)), seeds(spark), FOLDS)


@query
def nearest_antenna(spark, sf_dir):
    return rounded(proximity.nearest_site(src.lattice(spark, sf_dir), src.antennas(spark, sf_dir)).select("node_id", "site_id", "dist_m"))


def _level() -> Column:
    return src.POWER_DBM + src.GAIN_DBI - prop.fspl(F.col("dist_m"), F.col("freq"))


@query
def antenna_topk(spark, sf_dir):
    return rounded(graph.antenna_links(src.lattice(spark, sf_dir).select("cell", "node_id", "x_km", "y_km"), src.antennas(spark, sf_dir), 30.0, _level()).drop("cell"))


@query
def best_antenna(spark, sf_dir):
    return rounded(graph.best_antenna(src.lattice(spark, sf_dir).select("cell", "node_id", "x_km", "y_km"), src.antennas(spark, sf_dir), 30.0, _level()).drop("cell"))


@query
def near_blocks(spark, sf_dir):
    return proximity.near_blocks(src.lattice(spark, sf_dir), G, B, MAX_GY)


@query
def kfold_trim(spark, sf_dir):
    n = saved(src.nodes(spark, sf_dir))
    folds = saved(partition.fold_roles(partition.blocks(n), seeds(spark), FOLDS))
    return partition.fold_trimmed(n, proximity.near_blocks(n, G, B, MAX_GY), folds)


@query
def buffer_trim(spark, sf_dir):
    return Study(spark, sf_dir).left().select("cell", "seed", "node_id", "role")


@query
def retention(spark, sf_dir):
    return rounded(Study(spark, sf_dir, draws=MANY_DRAWS).split.retention())


@query
def effective_blocks(spark, sf_dir):
    """By draw: test blocks, those emptied, and those left with under a tenth of their nodes."""
    s = Study(spark, sf_dir)
    kept = s.split.tally({"n": F.lit(1).cast("long")}, ("cell", "seed", "block_id"))
    every = s.roles.where("role = 'test'").join(s.blocks, ["cell", "block_id"]).join(kept, ["cell", "seed", "block_id"], "left").withColumn("share", F.coalesce("n", F.lit(0)) / F.col("n_nodes"))
    return every.groupBy("cell", "seed").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("share") == 0).alias("n_empty"), F.count_if((F.col("share") > 0) & (F.col("share") < 0.1)).alias("n_thin"))


@query
def box_overlap(spark, sf_dir):
    return rounded(cells.box_overlap(cells.boxes(src.lattice(spark, sf_dir))))


@query
def coincident_nodes(spark, sf_dir):
    return cells.coincident(src.lattice(spark, sf_dir), 0)


@query
def cross_violations(spark, sf_dir):
    s = Study(spark, sf_dir)
    return cells.cross_violations(s.nodes, s.roles, B)


def _side(spark: SparkSession, sf_dir: str) -> int:
    return math.ceil(math.sqrt(max(src.table(spark, sf_dir, "orders").count(), 1)))


@query
def edge_report(spark, sf_dir):
    return rounded(graph.edge_report(graph.neighbour_edges(src.lattice(spark, sf_dir), _side(spark, sf_dir))))


@query
def induced_subgraph(spark, sf_dir):
    n = saved(src.nodes(spark, sf_dir))
    return graph.induced(graph.neighbour_edges(n, _side(spark, sf_dir)), n.where("valid"))


@query
def graph_mean_agg(spark, sf_dir):
    n = saved(src.nodes(spark, sf_dir))
    return rounded(graph.mean_neighbour(graph.neighbour_edges(n, _side(spark, sf_dir)), n, "rssi"))


# ---------------------------------------------------------------- errors and drift


@query
def calibration_offsets(spark, sf_dir):
    return rounded(Study(spark, sf_dir).fitted())


@query
def draw_errors(spark, sf_dir):
    return rounded(Study(spark, sf_dir).per_draw())


@query
def drift_constant(spark, sf_dir):
    return rounded(errors.drift(Study(spark, sf_dir).per_draw()))


@query
def drift_no_buffer(spark, sf_dir):
    return rounded(errors.drift(Study(spark, sf_dir, b=0.0).per_draw()))


@query
def drift_vs_cells(spark, sf_dir):
    return rounded(errors.drift_summary(errors.drift(Study(spark, sf_dir).per_draw())))


@query
def inversion_counts(spark, sf_dir):
    return errors.inversions(Study(spark, sf_dir).per_draw(), "constant", "fspl_a")


@query
def level_sensitivity(spark, sf_dir):
    """Mean absolute error of fixed levels on the valid held-out nodes; no buffer, so block sums come before the draws."""
    s = Study(spark, sf_dir)
    each = s.nodes.where("valid").select("cell", "block_id", "rssi", F.explode(F.array(*map(F.lit, LEVELS))).alias("level"))
    sums = each.groupBy("cell", "block_id", "level").agg(F.sum(F.abs(F.col("rssi") - F.col("level"))).alias("s"), F.count("*").alias("m"))
    draws = sums.join(s.roles.where("role = 'test'"), ["cell", "block_id"]).groupBy("cell", "seed", "level").agg((F.sum("s") / F.sum("m")).alias("mae"))
    return rounded(draws.groupBy("cell", "level").agg(F.count("*").alias("n_draws"), F.avg("mae").alias("mean"), F.stddev_samp("mae").alias("sd")))


@query
def prediction_errors(spark, sf_dir):
    n = src.nodes(spark, sf_dir)
    return rounded(errors.error_measures(n, ["cell", "valid"], F.col("pred_a") - F.col("rssi")))


@query
def prediction_contrast(spark, sf_dir):
    n = src.nodes(spark, sf_dir)
    d = F.abs(F.col("pred_a") - F.col("rssi")) - F.abs(F.col("pred_b") - F.col("rssi"))
    per = n.groupBy("cell", "block_id").agg(F.avg(d).alias("d"))
    return rounded(per.groupBy("cell").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.count_if(F.col("d") < 0).alias("n_a_wins"), F.avg(prop.huber(F.col("d"))).alias("huber")))


@query
def diagnostics(spark, sf_dir):
    n = saved(src.nodes(spark, sf_dir).select("rssi", "pred_b", "valid", "covered", "ndvi", "slope", "elevation", "dist_m"))
    shape = errors.prediction_shape(n, "rssi", "pred_b", src.POWER_DBM + src.GAIN_DBI - F.col("pred_b"), free_space())
    return rounded(errors.diagnostics(n, "rssi", "pred_b").unionByName(shape))


@query
def correlations(spark, sf_dir):
    n = src.nodes(spark, sf_dir).where("valid")
    return rounded(n.groupBy("cell").agg(F.corr("rssi", "elevation").alias("pearson"), errors.short_pearson("rssi", "elevation").alias("short_pearson")))


@query
def spearman(spark, sf_dir):
    per = src.nodes(spark, sf_dir).groupBy("cell", "block_id").agg(F.round(F.avg("rssi"), 6).alias("x"), F.round(F.avg("elevation"), 6).alias("y"))
    return rounded(errors.spearman(per, ["cell"], "x", "y", "block_id"))


@query
def median_band(spark, sf_dir):
    n = src.nodes(spark, sf_dir).where("valid")
    return rounded(errors.rank_edges(n, ["cell"], F.round("rssi", 6), 0.5))


@query
def feature_profile(spark, sf_dir):
    return rounded(errors.column_profile(src.lattice(spark, sf_dir), ["ndvi", "slope", "elevation", "x_km", "y_km"]))


@query
def cell_table(spark, sf_dir):
    n = src.nodes(spark, sf_dir)
    return rounded(n.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_sentinel"), F.count_distinct("block_id").alias("n_blocks"), F.count_distinct(F.when(F.col("valid"), F.col("block_id"))).alias("n_valid_blocks"), F.count_distinct(F.when(F.col("valid"), F.col("site_id"))).alias("n_sites"), F.avg("dist_m").alias("mean_dist")))


@query
def contingency(spark, sf_dir):
    far = F.col("dist_m") > 30_000
    v = F.col("valid")
    return src.nodes(spark, sf_dir).groupBy("cell").agg(F.count_if(v & far).alias("valid_far"), F.count_if(v & ~far).alias("valid_near"), F.count_if(~v & far).alias("sentinel_far"), F.count_if(~v & ~far).alias("sentinel_near"))


@query
def valid_fraction(spark, sf_dir):
    """Valid share by draw and role, and its difference from training: from block counts, without a node and draw pair."""
    s = Study(spark, sf_dir)
    per = s.blocks.join(s.roles, ["cell", "block_id"]).groupBy("cell", "seed", "role").agg(F.sum("n_nodes").alias("n"), (F.sum("n_valid") / F.sum("n_nodes")).alias("share"))
    train = F.max(F.when(F.col("role") == "train", F.col("share"))).over(Window.partitionBy("cell", "seed"))
    return rounded(per.select("cell", "seed", "role", "n", "share", (F.col("share") - train).alias("over_train")))


# ---------------------------------------------------------------- design-based estimators


@query
def block_sums(spark, sf_dir):
    return rounded(Study(spark, sf_dir).sums(), 5)


def _variances(s: Study) -> DataFrame:
    return design.cluster_variance(saved(s.sums()), s.blocks.groupBy("cell").agg(F.count("*").alias("n_blocks")))


@query
def cluster_variance(spark, sf_dir):
    return rounded(_variances(Study(spark, sf_dir)), 5)


@query
def variance_summary(spark, sf_dir):
    return rounded(design.variance_summary(saved(_variances(Study(spark, sf_dir)))), 4)


@query
def t_intervals(spark, sf_dir):
    """err ± t sqrt(v) of each draw, t by k - 1 degrees of freedom; the table of quantiles has a row for each k up to the number of blocks."""
    s = Study(spark, sf_dir)
    most = s.blocks.groupBy("cell").count().agg(F.max("count")).first()[0] or 2
    t = spark.createDataFrame([(k, round(t_quantile(0.975, k - 1), 6)) for k in range(2, most + 2)], "k long, t double")
    v = _variances(s).where("v IS NOT NULL").join(t, "k")
    return rounded(v.select("cell", "seed", "pred", "pop", "k", "t", (F.col("err") - F.col("t") * F.sqrt("v")).alias("low"), (F.col("err") + F.col("t") * F.sqrt("v")).alias("high")), 5)


@query
def jackknife_variance(spark, sf_dir):
    return rounded(design.jackknife_variance(Study(spark, sf_dir).sums()), 4)


@query
def inclusion_freq(spark, sf_dir):
    return rounded(Study(spark, sf_dir, draws=MANY_DRAWS).split.inclusion().select("cell", "node_id", "n_block", "n_kept", "p", "p_given"))


@query
def inclusion_profile(spark, sf_dir):
    """Mean inclusion given the block is in test, by distance to the border in steps of 0.25 km."""
    d = F.floor(geo.border_distance(F.col("x_km"), F.col("y_km"), G) / 0.25).cast("long")
    rows = Study(spark, sf_dir, draws=MANY_DRAWS).split.inclusion().where("p_given IS NOT NULL")
    return rounded(rows.groupBy("cell", d.alias("bin")).agg(F.count("*").alias("n"), F.avg("p_given").alias("p_given")))


@query
def hajek(spark, sf_dir):
    rows = Study(spark, sf_dir, draws=SOME_DRAWS).split.inclusion().withColumn("e", F.abs(F.col("rssi") - F.lit(prop.SENTINEL_RSSI)))
    return rounded(design.hajek(rows, ["cell", "valid"], "e"))


@query
def estimands(spark, sf_dir):
    s = Study(spark, sf_dir, draws=SOME_DRAWS)
    e = F.abs(F.col("rssi") - F.lit(prop.SENTINEL_RSSI))
    return rounded(design.estimands(_level_draws(s, e), s.split.inclusion().withColumn("e", e), "e"), 5)


def _level_draws(s: Study, e: Column) -> DataFrame:
    """cell, seed, n, mae of an error that no draw changes."""
    return s.split.tally({"n": F.lit(1).cast("long"), "s": e}).select("cell", "seed", "n", (F.col("s") / F.col("n")).alias("mae"))


@query
def design_effect(spark, sf_dir):
    s = Study(spark, sf_dir)
    e = F.abs(F.col("rssi") - F.lit(prop.SENTINEL_RSSI))
    per = _level_draws(s, e)
    domain = s.nodes.groupBy("cell").agg(F.count("*").alias("n_u"), F.var_samp(e).alias("s2"))
    return rounded(design.design_effect(per, domain), 4)


@query
def extreme_ratio(spark, sf_dir):
    """Largest and smallest mean error when each node's chance may lie anywhere between two bounds."""
    e = F.round(F.abs(F.col("rssi") - F.lit(prop.SENTINEL_RSSI)), 1)
    border = geo.border_distance(F.col("x_km"), F.col("y_km"), G) < B
    rows = src.nodes(spark, sf_dir).select("cell", e.alias("e"), F.when(border, 0.02).otherwise(0.15).alias("lo"), F.when(border, 0.087).otherwise(0.15).alias("hi")).groupBy("cell", "e", "lo", "hi").agg(F.count("*").alias("n"))
    rows = saved(rows)
    return rounded(design.extreme_ratio(rows, ["cell"]).withColumnRenamed("theta", "high").join(design.extreme_ratio(rows, ["cell"], False).withColumnRenamed("theta", "low"), "cell"))


@query
def anova_oneway(spark, sf_dir):
    return rounded(design.one_way(src.nodes(spark, sf_dir).where("valid"), ["cell"], "block_id", "rssi"), 5)


@query
def cochran_c(spark, sf_dir):
    return rounded(design.cochran_c(src.nodes(spark, sf_dir).where("valid"), "block_id", "rssi"))


@query
def jackknife_sd(spark, sf_dir):
    per = src.nodes(spark, sf_dir).groupBy("cell", "block_id").agg(F.avg("rssi").alias("m"))
    return rounded(design.leave_one_out_sd(per, ["cell"], "m"), 5)


@query
def pooled_moments(spark, sf_dir):
    per = src.nodes(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n"), F.avg("elevation").alias("mean"), F.var_samp("elevation").alias("variance"))
    return rounded(design.pooled(per, []))


# ---------------------------------------------------------------- gates


@query
def partition_gate(spark, sf_dir):
    s = Study(spark, sf_dir)
    return gates.partition_gate(saved(s.left()), s.nodes, s.roles, B)


@query
def table_diff(spark, sf_dir):
    """Drift with the buffer against drift without it: where they differ."""
    a, b = (saved(errors.drift(Study(spark, sf_dir, b).per_draw())) for b in (B, 0.0))
    return rounded(gates.table_diff(a, b, ["cell", "pred", "pop"], "mean", 1e-9))


@query
def missing_runs(spark, sf_dir):
    """The (cell, seed) of the plan that no retained valid test node stands for."""
    s = Study(spark, sf_dir)
    plan = s.roles.select("cell", "seed").distinct()
    return gates.missing_runs(plan, s.left().where("role = 'test' AND valid"), ["cell", "seed"])


@query
def id_digest(spark, sf_dir):
    return gates.id_digest(Study(spark, sf_dir).left(), ["cell", "seed", "role"], "node_id")


@query
def verdict_counts(spark, sf_dir):
    return gates.verdict(errors.drift(Study(spark, sf_dir).per_draw()).where("pop = 'valid' AND pred = 'constant'"), "sd", 0.1, 2)


@query
def seed_order(spark, sf_dir):
    """Of each draw the cells in the order of their valid test share, and whether it is the first draw's order."""
    s = Study(spark, sf_dir)
    share = s.blocks.join(s.roles.where("role = 'test'"), ["cell", "block_id"]).groupBy("seed", "cell").agg((F.sum("n_valid") / F.sum("n_nodes")).alias("v"))
    lists = share.groupBy("seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("v"), "cell"))), lambda x: x["cell"]), ",").alias("cells"))
    first = lists.where("seed = 1").select(F.col("cells").alias("first"))
    return lists.join(first, F.lit(True), "left").select("seed", "cells", (F.col("cells") == F.col("first")).alias("as_first"))
