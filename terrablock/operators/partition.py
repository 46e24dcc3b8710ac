"""Seeded block splits, folds and the buffer that trims held-out nodes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrablock.operators import classes

TRAIN, VAL = 0.70, 0.15


def blocks(nodes: DataFrame) -> DataFrame:
    """cell, block_id, n_nodes, n_valid: one row for each block, the size of a city map however many nodes there are."""
    return nodes.groupBy("cell", "block_id").agg(F.count("*").alias("n_nodes"), F.count_if("valid").alias("n_valid"))


def shuffled(blocks: DataFrame, seeds: DataFrame) -> DataFrame:
    """cell, seed, block_id, place (from 0), n: the blocks of each cell in the order of md5(seed|block)."""
    each = blocks.select("cell", "block_id").crossJoin(F.broadcast(seeds))
    order = Window.partitionBy("cell", "seed").orderBy(F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("block_id").cast("string"))), "block_id")
    return each.select("cell", "seed", "block_id", (F.row_number().over(order) - 1).alias("place"), F.count("*").over(Window.partitionBy("cell", "seed")).alias("n"))


def with_roles(placed: DataFrame) -> DataFrame:
    """The first 70 % of places train, the next 15 % val, the rest test; few blocks keep one of each."""
    train, val = F.greatest(F.lit(1), F.bround(F.col("n") * TRAIN).cast("int")), F.greatest(F.lit(1), F.bround(F.col("n") * VAL).cast("int"))
    short = train + val >= F.col("n")
    train, val = F.when(short, F.greatest(F.lit(1), F.col("n") - 2)).otherwise(train), F.when(short, F.lit(1)).otherwise(val)
    role = F.when(F.col("place") < train, "train").when(F.col("place") < train + val, "val").otherwise("test")
    return placed.select("cell", "seed", "block_id", role.alias("role"))


def block_roles(blocks: DataFrame, seeds: DataFrame) -> DataFrame:
    """cell, seed, block_id, role; seeds: one column seed. As many rows as blocks times draws, whatever the nodes."""
    return with_roles(shuffled(blocks, seeds))


def mt_roles(spark: SparkSession, blocks: DataFrame, seeds: list[int]) -> DataFrame:
    """As block_roles, by NumPy's Mersenne Twister shuffle of each cell's sorted block numbers (a few hundred a cell)."""
    own: dict[str, list[int]] = {}
    for r in blocks.select("cell", "block_id").distinct().orderBy("cell", "block_id").collect():
        own.setdefault(r.cell, []).append(r.block_id)
    rows = []
    for cell, ids in own.items():
        for seed in seeds:
            order = np.array(ids)
            np.random.RandomState(seed).shuffle(order)
            rows += [(cell, int(seed), int(x), i, len(ids)) for i, x in enumerate(order)]
    return with_roles(spark.createDataFrame(rows, "cell string, seed long, block_id long, place int, n long"))


def seed_list(spec: str, reference: int = 42) -> list[int]:
    """'' gives the reference seed, 'aleatorios:N:S' N draws below a million from generator S, else a comma-parted list."""
    if not spec:
        return [reference]
    if spec.startswith("aleatorios:"):
        n, s = map(int, spec.split(":")[1:])
        return [int(x) for x in np.random.RandomState(s).randint(0, 10**6, n)]
    return [int(x) for x in spec.split(",")]


def fold_roles(blocks: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """cell, seed, block_id, fold: k folds of equal size by place, the last takes the remainder."""
    size = F.greatest(F.lit(1), F.floor(F.col("n") / k))
    return shuffled(blocks, seeds).select("cell", "seed", "block_id", F.least(F.floor(F.col("place") / size), F.lit(k - 1)).cast("int").alias("fold"))


def fold_trimmed(nodes: DataFrame, near: DataFrame, folds: DataFrame) -> DataFrame:
    """cell, seed, node_id of the nodes that lie closer than the buffer to a block of another fold. near: of near_blocks.

    A draw decides classes of nodes; only what it trims is given node by node.
    """
    own = classes.classed(nodes.select("cell", "node_id", "block_id"), near)
    return classes.fold_classes(own, folds).join(own, classes.KEY).select("cell", "seed", "node_id")


def held_out(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """The val and test nodes of each draw: nodes with seed and role. Training nodes are never copied for a draw."""
    return nodes.join(roles.where("role <> 'train'"), ["cell", "block_id"])


def retained(nodes: DataFrame, roles: DataFrame, near: DataFrame, b: float) -> DataFrame:
    """The held-out nodes of each draw that the buffer leaves (see classes.Split), with seed and role."""
    return classes.Split(nodes, roles, near, b).left()
