"""Relations between cells: bounding boxes, coincident nodes, buffer violations across cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrablock.functions.storage import saved
from terrablock.operators import tiles


def boxes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("cell").agg(F.min("x_km").alias("x0"), F.max("x_km").alias("x1"), F.min("y_km").alias("y0"), F.max("y_km").alias("y1"))


def box_overlap(boxes: DataFrame) -> DataFrame:
    """a, b, area, over_smaller, over_union of each pair of cells' boxes; one row for each pair of cells, of which there are few."""
    other = boxes.select(*(F.col(c).alias(f"o_{c}") for c in boxes.columns))
    side = lambda k: F.greatest(F.lit(0.0), F.least(f"{k}1", f"o_{k}1") - F.greatest(f"{k}0", f"o_{k}0"))
    area = side("x") * side("y")
    own, theirs = ((F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0")) for p in ("", "o_"))
    pairs = boxes.join(F.broadcast(other), F.col("cell") < F.col("o_cell"))  # a row for each cell
    return pairs.select(F.col("cell").alias("a"), F.col("o_cell").alias("b"), area.alias("area"), F.try_divide(area, F.least(own, theirs)).alias("over_smaller"), F.try_divide(area, own + theirs - area).alias("over_union"))


def coincident(nodes: DataFrame, digits: int) -> DataFrame:
    """n_places, n_shared: places (coordinates rounded to so many digits) and those with nodes of several cells."""
    places = nodes.groupBy(F.round("x_km", digits).alias("x"), F.round("y_km", digits).alias("y")).agg((F.min("cell") != F.max("cell")).alias("shared"))
    return places.agg(F.count("*").alias("n_places"), F.count_if("shared").alias("n_shared"))


def foreign_blocks(nodes: DataFrame, b: float) -> DataFrame:
    """cell, block_id, foreign (a set of (cell, block) of other cells), n: how many nodes have nodes of just those blocks closer than b.

    Only nodes within b of another cell's box can take part; they are sought with a join on the boxes first. No draw takes part.
    """
    limits = boxes(nodes).select(F.col("cell").alias("o_cell"), "x0", "x1", "y0", "y1")
    near = (F.col("x_km") > F.col("x0") - b) & (F.col("x_km") < F.col("x1") + b) & (F.col("y_km") > F.col("y0") - b) & (F.col("y_km") < F.col("y1") + b)
    kinds = saved(nodes.select("cell", "block_id").distinct().withColumn("target", F.monotonically_increasing_id()))  # a row for each block
    edge = nodes.join(F.broadcast(limits), (F.col("cell") != F.col("o_cell")) & near, "left_semi").join(kinds, ["cell", "block_id"])  # a row for each cell
    rows = saved(edge.select("node_id", "block_id", "target", F.col("cell").alias("own"), F.col("x_km").alias("x"), F.col("y_km").alias("y")))
    others = rows.select("target", F.col("node_id").alias("o_id"), F.col("own").alias("o_own"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    close = tiles.nearest_targets(rows.drop("target"), others, [], b)
    sets = close.groupBy("own", "node_id", "block_id").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    sets = saved(sets.groupBy(F.col("own").alias("cell"), "block_id", "targets").agg(F.count("*").alias("n")).withColumn("set", F.monotonically_increasing_id()))
    named = kinds.select("target", F.struct(F.col("cell").alias("o_cell"), F.col("block_id").alias("o_block")).alias("o"))
    foreign = sets.select("set", F.explode("targets").alias("target")).join(named, "target").groupBy("set").agg(F.array_sort(F.collect_set("o")).alias("foreign"))
    return sets.join(foreign, "set").select("cell", "block_id", "foreign", "n")


def cross_violations(nodes: DataFrame, roles: DataFrame, b: float) -> DataFrame:
    """seed, n_violations: test nodes of any cell that lie closer than b to a training node of another cell.

    A draw decides sets of foreign blocks, whatever the nodes that have them.
    """
    sets = saved(foreign_blocks(nodes, b).withColumn("set", F.monotonically_increasing_id()))
    tested = sets.join(roles.where("role = 'test'").drop("role"), ["cell", "block_id"]).select("set", "n", "seed", F.explode("foreign").alias("o"))
    train = roles.where("role = 'train'").select("seed", F.col("cell").alias("_cell"), F.col("block_id").alias("_block"))
    hit = tested.join(train.withColumnRenamed("seed", "_seed"), (F.col("seed") == F.col("_seed")) & (F.col("o.o_cell") == F.col("_cell")) & (F.col("o.o_block") == F.col("_block")))
    hits = hit.select("seed", "set", "n").distinct().groupBy("seed").agg(F.sum("n").alias("k"))
    return roles.select("seed").distinct().join(hits, "seed", "left").select("seed", F.coalesce("k", F.lit(0).cast("long")).alias("n_violations"))
