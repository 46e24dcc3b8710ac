"""Splits, trims and medians against brute force over random nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrablock.functions.quantiles import t_quantile
from terrablock.operators import design, errors, partition, proximity

G, MAX_GY = 4.0, 9


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    xy = np.vstack([rng.uniform(0, 20, (600, 2)), rng.normal(10, 0.2, (200, 2))])  # a dense knot over a corner of blocks
    block = (np.floor(xy[:, 0] / G) * (MAX_GY + 1) + np.floor(xy[:, 1] / G)).astype(int)
    return xy, block, np.round(rng.normal(size=len(xy)), 1)


@pytest.fixture(scope="module")
def nodes(spark, points):
    xy, block, v = points
    rows = [("A", i, int(block[i]), float(xy[i, 0]), float(xy[i, 1]), bool(i % 3), float(v[i])) for i in range(len(xy))]
    return spark.createDataFrame(rows, "cell string, node_id long, block_id long, x_km double, y_km double, valid boolean, v double").cache()


@pytest.fixture(scope="module")
def roles(spark, nodes):
    return partition.block_roles(partition.blocks(nodes), spark.range(1, 4).withColumnRenamed("id", "seed")).cache()


@pytest.mark.parametrize("b", [0.5, 1.5])
def test_near_blocks(nodes, points, b):
    xy, block, _ = points
    d = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    want = {(i, int(block[j])) for i, j in zip(*np.nonzero(d < b * b), strict=True) if block[i] != block[j]}
    got = [(r.node_id, r.near_block) for r in proximity.near_blocks(nodes, G, b, MAX_GY).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("b", [0.5, 1.5])
def test_retained(nodes, roles, points, b):
    xy, block, _ = points
    d = ((xy[:, None] - xy[None]) ** 2).sum(-1) < b * b
    want = set()
    for seed in (1, 2, 3):
        by = {r.block_id: r.role for r in roles.where(F.col("seed") == seed).collect()}
        role = np.array([by[x] for x in block])
        train = role == "train"
        val = (role == "val") & ~d[:, train].any(axis=1)
        test = (role == "test") & ~d[:, train | val].any(axis=1)
        want |= {(seed, int(i), "val") for i in np.flatnonzero(val)} | {(seed, int(i), "test") for i in np.flatnonzero(test)}
    left = partition.retained(nodes, roles, proximity.near_blocks(nodes, G, b, MAX_GY), b)
    assert {(r.seed, r.node_id, r.role) for r in left.collect()} == want


def test_draw_median(nodes, roles, points):
    _, block, v = points
    got = {r.seed: r.m for r in errors.draw_median(nodes, roles, F.col("v"), "m").collect()}
    for seed in (1, 2, 3):
        train = {r.block_id for r in roles.where((F.col("seed") == seed) & (F.col("role") == "train")).collect()}
        assert got[seed] == pytest.approx(np.median(v[[x in train for x in block]]))


def test_nearest_by_bins(spark, nodes, points):
    xy, _, _ = points
    rng = np.random.default_rng(5)
    at = rng.uniform(-10, 60, (40, 2))
    sites = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "site_id long, sx double, sy double")
    want = np.sqrt(((xy[:, None] - at[None]) ** 2).sum(-1)).argmin(axis=1)
    for most in (100, 1):  # as one array, and through bins that widen
        got = {r.node_id: r.site_id for r in proximity.nearest_site(nodes, sites, most, 1.0).collect()}
        assert [got[i] for i in range(len(xy))] == want.tolist()


def test_extreme_ratio(spark):
    rng = np.random.default_rng(1)
    e, lo, w, n = rng.uniform(0, 5, 30), rng.uniform(0.1, 0.5, 30), rng.uniform(0, 0.5, 30), rng.integers(1, 4, 30)
    rows = spark.createDataFrame([("x", float(a), float(b), float(b + c), int(k)) for a, b, c, k in zip(e, lo, w, n, strict=True)], "k string, e double, lo double, hi double, n long")
    order = np.argsort(-e)
    best = max((np.where(np.isin(np.arange(30), order[:c]), lo + w, lo) * n * e).sum() / (np.where(np.isin(np.arange(30), order[:c]), lo + w, lo) * n).sum() for c in range(31))
    assert design.extreme_ratio(rows, ["k"]).first().theta == pytest.approx(best)


def test_seed_list_and_twister_roles(spark, nodes):
    assert partition.seed_list("") == [42] and partition.seed_list("3,4") == [3, 4]
    assert partition.seed_list("aleatorios:3:20260926") == list(np.random.RandomState(20260926).randint(0, 10**6, 3))
    counts = partition.mt_roles(spark, partition.blocks(nodes), [42]).groupBy("role").count().collect()
    assert {r.role: r["count"] for r in counts} == {"train": 18, "val": 4, "test": 3}  # 25 blocks: 17.5 rounds to 18, 3.75 to 4


@pytest.mark.parametrize("df,want", [(1, 12.706205), (2, 4.302653), (5, 2.570582), (30, 2.042272)])
def test_t_quantile(df, want):
    assert t_quantile(0.975, df) == pytest.approx(want, abs=1e-5)
