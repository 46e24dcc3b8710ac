"""Held-out nodes by class. What the buffer does to a node in a draw depends on its block and the set of other blocks that
come closer than the buffer, and on nothing else, unless the node lies near a val or test block and near no training
block. So nodes are counted and summed by (cell, block, near set) once and a draw decides classes. What it leaves open
depends on which classes have a node near: these sets too are found once, and a draw decides them. Classes are as many as
a city's blocks have neighbourhoods, however many its nodes.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrablock.functions.storage import saved
from terrablock.operators.proximity import near_groups, patches_along

KEY = ["cell", "block_id", "near_key"]
#: Side of a block in km, for the density from which patches are laid.
BLOCK = 10.0


def around(near: DataFrame) -> DataFrame:
    """cell, node_id, block_id, near: the set of blocks (eight at most) near each node that has any. near: of near_blocks."""
    return near.groupBy("cell", "node_id", "block_id").agg(F.array_sort(F.collect_set("near_block")).alias("near"))


def classed(nodes: DataFrame, near: DataFrame | None) -> DataFrame:
    """A saved table of nodes with near_key, the near set's blocks joined by commas."""
    if near is None:
        return saved(nodes.withColumn("near_key", F.lit("")))
    keys = around(near).select("cell", "node_id", F.array_join("near", ",").alias("near_key"))
    return saved(nodes.join(keys, ["cell", "node_id"], "left").withColumn("near_key", F.coalesce("near_key", F.lit(""))))


def near_set() -> Column:
    return F.when(F.col("near_key") == "", F.array().cast("array<bigint>")).otherwise(F.split("near_key", ",").cast("array<bigint>"))


def fold_classes(nodes: DataFrame, folds: DataFrame) -> DataFrame:
    """KEY, seed of the classes of nodes (a table of classed) that lie closer than the buffer to a block of another fold."""
    sets = nodes.select(*KEY).distinct().where("near_key <> ''").withColumn("near", near_set())
    maps = folds.groupBy("cell", "seed").agg(F.map_from_entries(F.collect_list(F.struct("block_id", "fold"))).alias("folds"))
    own = F.element_at("folds", F.col("block_id"))
    return sets.join(maps, "cell").where(F.exists("near", lambda x: F.element_at("folds", x) != own)).select(*KEY, "seed")


class Split:
    """The held-out nodes of each draw that the buffer b leaves: val nodes not closer than b to a training node, then test
    nodes not closer than b to a training node or to a val node that is left. near: of near_blocks, None without a buffer."""

    def __init__(self, nodes: DataFrame, roles: DataFrame, near: DataFrame | None, b: float):
        self.columns, self.roles, self.b = nodes.columns, roles, b
        self.nodes = classed(nodes, near)

    @cached_property
    def decided(self) -> DataFrame:
        """KEY, seed, role, open of the classes that no training block drops. open: whose nodes have a block of the other
        held-out role near them, so that one by one they may drop a node or be dropped."""
        of = lambda r: F.collect_list(F.when(F.col("role") == r, F.col("block_id"))).alias(f"_{r}")
        lists = self.roles.groupBy("cell", "seed").agg(of("train"), of("val"), of("test"))
        own = self.roles.where("role <> 'train'")
        each = self.nodes.select(*KEY).distinct().join(own, ["cell", "block_id"]).join(lists, ["cell", "seed"]).withColumn("near", near_set())
        meets = lambda c: F.arrays_overlap("near", c)
        kept = each.where(~meets("_train"))
        return saved(kept.select(*KEY, "seed", "role", F.when(F.col("role") == "test", meets("_val")).otherwise(meets("_test")).alias("open")))

    @cached_property
    def survivors(self) -> DataFrame:
        """cell, seed, node_id of the test nodes of open classes that no val node drops.

        A draw keeps val classes whole, so a node of an open test class is dropped by the classes near it. Sets of near
        classes are found once, whatever the draws; a draw decides sets, and only nodes of sets that stay are given.
        """
        if self.b <= 0:
            return self.decided.where("open").select("cell", "seed", F.lit(0).cast("long").alias("node_id"))
        open_ = self.decided.where("open").select(*KEY, "seed", "role")
        kinds = saved(open_.select(*KEY).distinct().withColumn("kind", F.monotonically_increasing_id()))
        edge = saved(self.nodes.select(*KEY, "node_id", "x_km", "y_km").join(kinds, KEY))
        near = near_groups(edge, "kind", self.b, patches_along(self.nodes, BLOCK, self.b))
        sets = near.groupBy("cell", "node_id").agg(F.array_sort(F.collect_set("near")).alias("near"))
        placed = saved(edge.select("cell", "node_id", "kind").join(sets, ["cell", "node_id"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<bigint>"))))
        told = open_.join(kinds, KEY)
        val = told.where("role = 'val'").groupBy("cell", "seed").agg(F.collect_list("kind").alias("_val"))
        tried = placed.select("kind", "near").distinct().join(told.where("role = 'test'").select("cell", "seed", "kind"), "kind").join(val, ["cell", "seed"], "left")
        stay = tried.where(~F.coalesce(F.arrays_overlap("near", "_val"), F.lit(False))).select("kind", "near", "seed")
        return saved(placed.join(stay, ["kind", "near"]).select("cell", "seed", "node_id"))

    def whole(self, role: str | None = None) -> DataFrame:
        """The classes that a draw keeps whole: KEY, seed, role."""
        kept = self.decided.where("NOT open OR role <> 'test'")
        return (kept if role is None else kept.where(F.col("role") == role)).drop("open")

    def left(self) -> DataFrame:
        """All retained nodes of all draws: the nodes' columns, seed, role."""
        columns = [*self.columns, "seed", "role"]
        tried = self.nodes.join(self.survivors, ["cell", "node_id"]).withColumn("role", F.lit("test"))
        return self.nodes.join(self.whole(), KEY).select(*columns).unionByName(tried.select(*columns))

    def tally(self, values: dict[str, Column], by: tuple[str, ...] = ("cell", "seed"), role: str = "test", nodes: DataFrame | None = None) -> DataFrame:
        """by (of cell, seed, block_id, node columns that a class shares) and the sums of values over the retained nodes of
        a role: sums by class, and open nodes one by one. nodes: the classed nodes with further columns."""
        nodes = self.nodes if nodes is None else nodes
        per = nodes.groupBy(*KEY).agg(*(F.sum(v).alias(k) for k, v in values.items()))
        rows = self.whole(role).join(per, KEY).select(*by, *values)
        if role == "test":
            each = nodes.select("cell", "block_id", "node_id", *(v.alias(k) for k, v in values.items()))
            rows = rows.unionByName(each.join(self.survivors, ["cell", "node_id"]).select(*by, *values))
        return rows.groupBy(*by).agg(*(F.sum(k).alias(k) for k in values))

    def retention(self) -> DataFrame:
        """cell, seed, role, n_before, n_after, share of the held-out roles."""
        held = self.roles.where("role <> 'train'")
        before = self.nodes.groupBy("cell", "block_id").agg(F.count("*").alias("n")).join(held, ["cell", "block_id"]).groupBy("cell", "seed", "role").agg(F.sum("n").alias("n_before"))
        one = {"n_after": F.lit(1).cast("long")}
        after = self.tally(one).withColumn("role", F.lit("test")).unionByName(self.tally(one, role="val").withColumn("role", F.lit("val")))
        n_after = F.coalesce("n_after", F.lit(0).cast("long"))
        return before.join(after, ["cell", "seed", "role"], "left").select("cell", "seed", "role", "n_before", n_after.alias("n_after"), F.try_divide(n_after, F.col("n_before")).alias("share"))

    def inclusion(self) -> DataFrame:
        """The nodes' columns, n_block (draws with the block in test), n_kept (draws that keep the node), p, p_given.

        Draws that keep a class whole are counted by class; only open nodes have counts of their own.
        """
        draws = self.roles.groupBy("cell").agg(F.count_distinct("seed").alias("_n_draws"))
        tested = self.roles.groupBy("cell", "block_id").agg(F.count_if(F.col("role") == "test").alias("n_block")).join(draws, "cell")
        whole = self.whole("test").groupBy(*KEY).agg(F.count("*").alias("_whole"))
        own = self.survivors.groupBy("cell", "node_id").agg(F.count("*").alias("_own"))
        zero = F.lit(0).cast("long")
        rows = self.nodes.join(tested, ["cell", "block_id"]).join(whole, KEY, "left").join(own, ["cell", "node_id"], "left").withColumn("n_kept", F.coalesce("_whole", zero) + F.coalesce("_own", zero))
        p, given = F.col("n_kept") / F.col("_n_draws"), F.try_divide(F.col("n_kept"), F.col("n_block"))
        return rows.select(*self.columns, "n_block", "n_kept", p.alias("p"), given.alias("p_given"))
