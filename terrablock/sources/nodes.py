"""Node tables: a lattice of nodes over the orders table, antennas over the nation table, and generated grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrablock.functions import geometry as geo
from terrablock.functions import propagation as prop
from terrablock.operators.proximity import nearest_site

WIDTH_KM, HEIGHT_KM = 103.4, 111.0
#: Side of a block, of a quadrant's inner border, and the reach of an antenna of this fixture.
BLOCK_KM, CELL_KM, REACH_M = 10.0, 50.0, 6000.0
POWER_DBM, GAIN_DBI, HEIGHT_M, MOBILE_M, BAND_MHZ = 43.0, 12.0, 30.0, 1.5, 900.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many tasks as there are cores, where a small input would give fewer; a large one is left as it is read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def grid(spark: SparkSession, lon_min: float, lon_max: float, lat_min: float, lat_max: float, side: int) -> DataFrame:
    """node_id, row, col, lon, lat of a side x side grid, row by row from the northern edge."""
    step = max(side - 1, 1)
    at = spark.range(side * side).select(F.col("id").alias("node_id"), F.floor(F.col("id") / side).alias("row"), (F.col("id") % side).alias("col"))
    return at.select("*", (lon_min + F.col("col") * (lon_max - lon_min) / step).alias("lon"), (lat_max - F.col("row") * (lat_max - lat_min) / step).alias("lat"))


def antennas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, sx, sy (km), freq (MHz): one antenna for each nation, on a 5 x 5 lattice."""
    k = F.col("n_nationkey").cast("long")
    freq = F.element_at(F.array(F.lit(700.0), F.lit(900.0), F.lit(1900.0)), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(k.alias("site_id"), (8.0 + 22.0 * (k % 5)).alias("sx"), (12.0 + 20.0 * F.floor(k / 5)).alias("sy"), freq.alias("freq"))


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as nodes on a square lattice, by cell (quadrant), block, and with terrain features."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    side = math.ceil(math.sqrt(max(orders.count(), 1)))
    step, i = max(side - 1, 1), F.col("o_orderkey")
    x, y = (i % side).cast("double") * WIDTH_KM / step, F.floor(i / side).cast("double") * HEIGHT_KM / step
    placed = orders.select(
        i.alias("node_id"),
        x.alias("x_km"),
        y.alias("y_km"),
        ((F.col("o_custkey") % 200) / 100.0 - 1).alias("ndvi"),
        ((F.col("o_custkey") % 50) / 100.0).alias("slope"),
        ((F.col("o_totalprice") - 250000) / 150000).alias("elevation"),
        ((F.col("o_totalprice") / 500000 - 0.5) * 20).alias("_shift"),
    )
    max_gy = int(HEIGHT_KM // BLOCK_KM)
    cell = F.concat(F.lit("Q"), (1 + (F.col("x_km") >= CELL_KM).cast("int") + 2 * (F.col("y_km") >= CELL_KM).cast("int")).cast("string"))
    return placed.select("*", cell.alias("cell"), geo.block_number(F.col("x_km"), F.col("y_km"), BLOCK_KM, max_gy).alias("block_id"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lattice with dist_m (to the nearest antenna), valid, pl, rssi, covered and the two predictions pred_a and pred_b."""
    near = nearest_site(lattice(spark, sf_dir), antennas(spark, sf_dir))
    valid = F.col("dist_m") <= REACH_M
    loss = prop.fspl(F.col("dist_m"), F.lit(BAND_MHZ)) + F.col("_shift")
    full = near.select("*", valid.alias("valid"), F.when(valid, loss).otherwise(prop.SENTINEL_LOSS).alias("pl"))
    full = full.withColumn("rssi", F.when(F.col("valid"), POWER_DBM + GAIN_DBI - F.col("pl")).otherwise(prop.SENTINEL_RSSI)).drop("_shift")
    noise = lambda k, d: ((F.col("node_id") * k) % 101 - 50) / d
    return full.select("*", (F.col("rssi") > -85).alias("covered"), (F.col("rssi") + noise(7919, 25.0)).alias("pred_a"), (F.col("rssi") + noise(104729, 10.0)).alias("pred_b"))
