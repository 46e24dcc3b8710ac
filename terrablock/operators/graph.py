"""Edges between nodes and antennas, and between neighbouring nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrablock.functions.storage import saved
from terrablock.operators.proximity import sites_in_reach

MOST_LINKS = 5


def antenna_links(nodes: DataFrame, sites: DataFrame, reach_km: float, level: Column, most: int = MOST_LINKS, least_level: float = -150.0) -> DataFrame:
    """cell, node_id, site_id, place, dist_m, level: for each node its strongest antennas in reach (ties: smaller site_id)."""
    pairs = sites_in_reach(nodes, sites, reach_km).withColumn("level", level).where(F.col("level") > least_level)
    order = Window.partitionBy("cell", "node_id").orderBy(F.col("level").desc(), "site_id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("cell", "node_id", "site_id", "place", "dist_m", "level")


def best_antenna(nodes: DataFrame, sites: DataFrame, reach_km: float, level: Column) -> DataFrame:
    """cell, node_id, site_id, level of the strongest antenna in reach: one aggregation, no sort."""
    pairs = sites_in_reach(nodes, sites, reach_km).withColumn("level", level)
    return pairs.groupBy("cell", "node_id").agg(F.max(F.struct("level", (-F.col("site_id")).alias("s"))).alias("b")).select("cell", "node_id", (-F.col("b.s")).alias("site_id"), F.col("b.level").alias("level"))


def neighbour_edges(rows: DataFrame, side: int) -> DataFrame:
    """src, dst: each node of a side x side lattice to itself and its eight neighbours, if they exist."""
    shift = F.array(F.lit(-1), F.lit(0), F.lit(1))
    c, r = F.col("node_id") % side, F.floor(F.col("node_id") / side)
    near = rows.select(F.col("node_id").alias("src"), c.alias("c"), r.alias("r")).withColumn("dx", F.explode(shift)).withColumn("dy", F.explode(shift))
    near = near.where((F.col("c") + F.col("dx")).between(0, side - 1) & (F.col("r") + F.col("dy") >= 0))
    edges = near.select("src", ((F.col("r") + F.col("dy")) * side + F.col("c") + F.col("dx")).alias("dst"))
    return edges.join(rows.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst")


def edge_report(edges: DataFrame) -> DataFrame:
    """n_edges, n_loops, n_double, n_one_way, max_degree, mean_degree of a directed edge table."""
    counted = edges.groupBy("src", "dst").agg(F.count("*").alias("k"))
    both = counted.join(counted.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_anti").agg(F.count("*").alias("n_one_way"))
    sums = counted.agg(F.sum("k").alias("n_edges"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("k")).otherwise(0)).alias("n_loops"), F.sum(F.col("k") - 1).alias("n_double"))
    degree = edges.groupBy("src").agg(F.count("*").alias("d")).agg(F.max("d").alias("max_degree"), F.avg("d").alias("mean_degree"))
    return sums.crossJoin(F.broadcast(both)).crossJoin(F.broadcast(degree))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """src, dst of the edges with both ends among members (node_id)."""
    ends = members.select("node_id")
    return edges.join(ends.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ends.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst")


def mean_neighbour(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """node_id, mean: the mean of value over each node's out-neighbours, itself left out."""
    joined = edges.where("src <> dst").join(nodes.select(F.col("node_id").alias("dst"), value), "dst")
    return joined.groupBy(F.col("src").alias("node_id")).agg(F.avg(value).alias("mean"))


def cut_report(edges: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """cell, n_kept, n_crossing (one end valid), n_removed (no end) of the edges by the cell of their source, and links to
    antennas (cell, node_id) of valid nodes and of others."""
    ends = nodes.select("cell", "node_id", "valid")
    both = edges.join(ends.withColumnRenamed("node_id", "src"), "src").join(ends.select(F.col("node_id").alias("dst"), F.col("valid").alias("to")), "dst")
    cut = both.groupBy("cell").agg(F.count_if(F.col("valid") & F.col("to")).alias("n_kept"), F.count_if(F.col("valid") != F.col("to")).alias("n_crossing"), F.count_if(~F.col("valid") & ~F.col("to")).alias("n_removed"))
    held = links.join(ends, ["cell", "node_id"]).groupBy("cell").agg(F.count_if("valid").alias("links_kept"), F.count_if(~F.col("valid")).alias("links_removed"))
    return cut.join(held, "cell", "left")


def dense_numbers(rows: DataFrame, keys: list[str], id_col: str, name: str) -> DataFrame:
    """keys, id_col, name: numbers from 0 without gaps in the order of id_col, by key. rows: a saved table.

    Range-sorted first; counts of the ranges give each its offset, so no task numbers a whole key.
    """
    ranged = saved(rows.select(*keys, id_col).repartitionByRange(*keys, id_col).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(id_col)) - 1
    return ranged.withColumn("_place", place).join(sizes.select(*keys, "_range", before.alias("_before")), [*keys, "_range"]).select(*keys, id_col, (F.col("_place") + F.col("_before")).cast("long").alias(name))


def relabelled(edges: DataFrame, members: DataFrame) -> DataFrame:
    """src, dst of the edges among members (node_id), by dense numbers from 0 in the order of node_id."""
    number = saved(dense_numbers(members, [], "node_id", "number"))
    ends = edges.join(number.select(F.col("node_id").alias("src"), F.col("number").alias("a")), "src").join(number.select(F.col("node_id").alias("dst"), F.col("number").alias("b")), "dst")
    return ends.select(F.col("a").alias("src"), F.col("b").alias("dst"))
