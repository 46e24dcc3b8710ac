"""Retained area of a lattice of blocks, without nodes: by random roles, and by counts of covering neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrablock.functions.geometry import CORNERS, SIDES, falling_ratio, trimmed_area
from terrablock.operators.partition import block_roles

#: Where each neighbour lies.
STEPS = {"left": (-1, 0), "right": (1, 0), "bottom": (0, -1), "top": (0, 1)}
STEPS |= {(x, y): (STEPS[x][0], STEPS[y][1]) for x, y in CORNERS}
#: Variants of the experiment: real widths of the last column and row, only val blocks with area left trim, neighbours over the edge.
VARIANTS = {"A": (False, False, False), "A2": (False, True, False), "B": (True, False, False), "C": (True, True, False), "T": (False, True, True)}


def block_lattice(spark: SparkSession, width: float, height: float, g: float) -> DataFrame:
    """i, j, w, h, nx, ny: the blocks that cover a rectangle; the last column and row may be thinner."""
    nx, ny = (math.ceil(round(size / g, 9)) for size in (width, height))
    at = spark.range(nx * ny).select(F.floor(F.col("id") / ny).alias("i"), (F.col("id") % ny).alias("j"))
    thin = lambda c, n, size: F.when(F.col(c) == n - 1, size - g * (n - 1)).otherwise(g)
    return at.select("i", "j", thin("i", nx, width).alias("w"), thin("j", ny, height).alias("h"), F.lit(nx).alias("nx"), F.lit(ny).alias("ny"))


def neighbours(blocks: DataFrame, torus: bool) -> DataFrame:
    """i, j, place (name of a side or corner), ni, nj of the neighbours that exist; on a torus all do."""
    each = F.explode(F.array(*(F.struct(F.lit("|".join(k) if isinstance(k, tuple) else k).alias("place"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in STEPS.items())))
    rows = blocks.select("i", "j", "nx", "ny", each.alias("s")).select("i", "j", "nx", "ny", "s.place", (F.col("i") + F.col("s.dx")).alias("ni"), (F.col("j") + F.col("s.dy")).alias("nj"))
    if torus:
        return rows.select("i", "j", "place", F.pmod("ni", F.col("nx").cast("long")).alias("ni"), F.pmod("nj", F.col("ny").cast("long")).alias("nj"))
    return rows.where("ni >= 0 AND nj >= 0 AND ni < nx AND nj < ny").select("i", "j", "place", "ni", "nj")


def left_area(blocks: DataFrame, near: DataFrame, trimming: DataFrame, b: float) -> DataFrame:
    """seed, i, j, area left of blocks (seed, i, j, w, h), where trimming (seed, i, j) are the blocks that trim."""
    hit = blocks.select("seed", "i", "j").join(near, ["i", "j"]).join(trimming.select("seed", F.col("i").alias("ni"), F.col("j").alias("nj")), ["seed", "ni", "nj"])
    names = [*SIDES, *("|".join(c) for c in CORNERS)]
    flags = hit.groupBy("seed", "i", "j").agg(*(F.max((F.col("place") == n).cast("int")).alias(n) for n in names))
    trims = {k: F.coalesce(F.col(f"`{n}`"), F.lit(0)) for k, n in zip([*SIDES, *CORNERS], names, strict=True)}
    return blocks.join(flags, ["seed", "i", "j"], "left").select("seed", "i", "j", trimmed_area(F.col("w"), F.col("h"), F.lit(b), trims).alias("area"))


def retained_area(spark: SparkSession, seeds: DataFrame, width: float, height: float, g: float, b: float) -> DataFrame:
    """variant, role, n_draws, mean, sd (ddof 0), p5, p95 of the share of the role's area that the buffer leaves, by random roles."""
    lattice = block_lattice(spark, width, height, g)
    ny = math.ceil(round(height / g, 9))
    roles = block_roles(lattice.select(F.lit("all").alias("cell"), (F.col("i") * ny + F.col("j")).alias("block_id")), seeds)
    roles = roles.select("seed", F.floor(F.col("block_id") / ny).alias("i"), (F.col("block_id") % ny).alias("j"), "role")
    found = None
    for variant, (real, kept_only, torus) in VARIANTS.items():
        sized = lattice if real else lattice.withColumns({"w": F.lit(g), "h": F.lit(g)})
        near, placed = neighbours(lattice, torus), roles.join(sized, ["i", "j"])
        train, val = placed.where("role = 'train'"), placed.where("role = 'val'")
        left = left_area(val, near, train, b)
        trimming = train.select("seed", "i", "j").unionByName((left.where("area > 1e-9") if kept_only else val).select("seed", "i", "j"))
        both = left.withColumn("role", F.lit("val")).unionByName(left_area(placed.where("role = 'test'"), near, trimming, b).withColumn("role", F.lit("test")))
        share = both.join(sized, ["i", "j"]).groupBy("seed", "role").agg((F.sum("area") / F.sum(F.col("w") * F.col("h"))).alias("share"))
        one = share.groupBy("role").agg(F.count("*").alias("n_draws"), F.avg("share").alias("mean"), F.stddev_pop("share").alias("sd"), F.percentile("share", 0.05).alias("p5"), F.percentile("share", 0.95).alias("p95")).withColumn("variant", F.lit(variant))
        found = one if found is None else found.unionByName(one)
    return found


def cover_retention(spark: SparkSession, width: float, height: float, g: float, b: float, step: float, spared: int) -> DataFrame:
    """n_blocks, mean_field, exact: expected share left when a place is kept if none of the k neighbours within b trims.

    Places are pixels of a raster; a neighbour covers a pixel nearer than b to it. spared: blocks that don't trim, the
    block itself among them; k of them are spared with chance (spared / n)^k, or exactly by falling factorials.
    """
    blocks = block_lattice(spark, width, height, g)
    n = blocks.count()
    px, py = (F.floor(F.col(c) / step + 1e-9).cast("int") for c in ("w", "h"))
    middle = lambda c: (F.col(c) + 0.5) * step
    pixels = blocks.withColumn("px", F.explode(F.sequence(F.lit(0), px - 1))).withColumn("py", F.explode(F.sequence(F.lit(0), py - 1)))
    away = {"left": middle("px"), "right": F.col("w") - middle("px"), "bottom": middle("py"), "top": F.col("h") - middle("py")}

    def exists(name) -> Column:
        dx, dy = STEPS[name]
        return (F.col("i") + dx).between(0, F.col("nx") - 1) & (F.col("j") + dy).between(0, F.col("ny") - 1)

    covered = [exists(s) & (away[s] < b) for s in SIDES] + [exists((x, y)) & (away[x] * away[x] + away[y] * away[y] < b * b) for x, y in CORNERS]
    k = sum((c.cast("int") for c in covered), F.lit(0))
    counts = pixels.groupBy(k.alias("k")).agg(F.count("*").alias("n"))
    exact = falling_ratio(F.lit(spared - 1), F.lit(n - 1), F.col("k"))
    return counts.agg(F.lit(n).alias("n_blocks"), (F.sum(F.col("n") * F.pow(F.lit(spared / n), F.col("k"))) / F.sum("n")).alias("mean_field"), (F.sum(F.col("n") * exact) / F.sum("n")).alias("exact"))
