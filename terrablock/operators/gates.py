"""Validation gates: each gives rows that say what holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrablock.functions.storage import saved
from terrablock.operators.proximity import closer_than, tile_others, tile_rows
from terrablock.operators.tiles import least_distance


def partition_gate(left: DataFrame, nodes: DataFrame, roles: DataFrame, b: float) -> DataFrame:
    """cell, seed, n_double (nodes with two roles), n_close (retained test nodes closer than b to a retained val node)."""
    double = left.groupBy("cell", "seed", "node_id").agg(F.count("*").alias("k")).groupBy("cell", "seed").agg(F.count_if(F.col("k") > 1).alias("n_double"))
    cols = ["cell", "seed", "node_id", "x_km", "y_km"]
    close = closer_than(left.where("role = 'test'").select(*cols), left.where("role = 'val'").select(*cols), ["cell", "seed"], b).groupBy("cell", "seed").agg(F.count("*").alias("n_close"))
    return double.join(close, ["cell", "seed"], "left").select("cell", "seed", "n_double", F.coalesce("n_close", F.lit(0).cast("long")).alias("n_close"))


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """keys, left, right of the rows that only one table has or whose values differ by more than the relative tolerance."""
    a, b = left.select(*keys, F.col(value).alias("left"), F.lit(True).alias("_a")), right.select(*keys, F.col(value).alias("right"), F.lit(True).alias("_b"))
    joined = a.join(b, keys, "full_outer")
    same = F.abs(F.col("left") - F.col("right")) <= tolerance * F.greatest(F.lit(1.0), F.abs("left"))
    return joined.where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.coalesce(same, F.col("left").isNull() & F.col("right").isNull())).select(*keys, "left", "right")


def missing_runs(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return plan.join(done.select(*keys).distinct(), keys, "left_anti").select(*keys)


def id_digest(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """keys, n, digest: an order-free digest of a set of ids (sum of hashes), for sets too large to gather."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 12), 16, 10).cast("long").cast("decimal(38,0)")).cast("string").alias("digest"))


def verdict(rows: DataFrame, value: str, threshold: float, least: int) -> DataFrame:
    """n, n_over, verdict: 'reinforces' if value reaches the threshold in at least so many rows, else 'delimits'."""
    over = F.count_if(F.col(value) >= threshold)
    return rows.agg(F.count(value).alias("n"), over.alias("n_over"), F.when(over >= least, "reinforces").otherwise("delimits").alias("verdict"))


def distance_gate(parts: dict[str, DataFrame], b: float) -> DataFrame:
    """cell, pair, n_shared, least_km, ok of each two parts (cell, node_id, x_km, y_km): no shared node, none closer than b."""
    found, names, key = None, list(parts), ["cell"]
    near, far = ({k: saved(f(p, key)) for k, p in parts.items()} for f in (tile_rows, tile_others))
    for i, one in enumerate(names):
        for other in names[i + 1 :]:
            least = least_distance(near[other], far[one], key).select("cell", F.sqrt("d2").alias("least_km"))
            d = near[other].select("cell").distinct().join(least, "cell", "left")
            shared = parts[one].select("cell", "node_id").intersect(parts[other].select("cell", "node_id")).groupBy("cell").agg(F.count("*").alias("n_shared"))
            n_shared = F.coalesce("n_shared", F.lit(0).cast("long"))
            rows = d.join(shared, "cell", "left").select("cell", F.lit(f"{one}-{other}").alias("pair"), n_shared.alias("n_shared"), "least_km", ((n_shared == 0) & (F.coalesce("least_km", F.lit(b)) >= b)).alias("ok"))
            found = rows if found is None else found.unionByName(rows)
    return found


def digest_chain(own: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state (equal, different, missing, extra) of the digests that two sides give."""
    a = own.select(*keys, F.col("digest").alias("_a"))
    joined = a.join(other.select(*keys, F.col("digest").alias("_b")), keys, "full_outer")
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") == F.col("_b"), "equal").otherwise("different")
    return joined.select(*keys, state.alias("state"))


def data_gates(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """cell, gate, value, ok: double ids, the sentinel's constants, mean and SD of elevation, missing numbers, and the
    design effect over draws of a target dealt anew by hash, which must lie between 0.5 and 2."""
    sentinel = ~F.col("valid")
    wide = nodes.groupBy("cell").agg(
        (F.count("*") - F.count_distinct("node_id")).cast("double").alias("double_ids"),
        F.count_if(sentinel & ((F.col("pl") != 300) | (F.col("rssi") != -110))).cast("double").alias("odd_sentinels"),
        F.avg("elevation").alias("mean"), F.stddev_samp("elevation").alias("sd"),
        F.count_if(F.col("rssi").isNull() | F.isnan("rssi") | F.col("pl").isNull() | F.isnan("pl")).cast("double").alias("missing"),
    )
    dealt = nodes.select("cell", "block_id", (F.conv(F.substring(F.md5(F.concat(F.lit("target|"), F.col("node_id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)).alias("t"))
    sums = saved(dealt.groupBy("cell", "block_id").agg(F.sum("t").alias("s"), F.count("*").alias("m")))
    domain = dealt.groupBy("cell").agg(F.var_samp("t").alias("s2"), F.count("*").alias("n_u"))
    draws = sums.join(roles.where("role = 'test'"), ["cell", "block_id"]).groupBy("cell", "seed").agg((F.sum("s") / F.sum("m")).alias("mae"), F.sum("m").alias("n"))
    srs = (1 - F.col("n") / F.col("n_u")) * F.col("s2") / F.col("n")
    effect = draws.join(domain, "cell").groupBy("cell").agg((F.var_samp("mae") / F.avg(srs)).alias("permuted_effect"))
    rows = wide.join(effect, "cell")
    limits = {"double_ids": (0, 0), "odd_sentinels": (0, 0), "mean": (-1, 1), "sd": (0.1, 2), "missing": (0, 0), "permuted_effect": (0.5, 2)}
    each = F.array(*(F.struct(F.lit(g).alias("gate"), F.col(g).alias("value"), F.col(g).between(*limits[g]).alias("ok")) for g in limits))
    return rows.select("cell", F.inline(each))


def record_diff(left: DataFrame, right: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """path, left, right of the leaves (path, value) that only one record has, or that differ: numbers by more than the tolerance, others at all."""
    a, b = left.select("path", F.col("value").alias("left"), F.lit(True).alias("_a")), right.select("path", F.col("value").alias("right"), F.lit(True).alias("_b"))
    near = F.abs(F.col("left").try_cast("double") - F.col("right").try_cast("double")) <= tolerance
    same = F.col("left").eqNullSafe(F.col("right")) | F.coalesce(near, F.lit(False))
    return a.join(b, "path", "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull() | ~same).select("path", "left", "right")
