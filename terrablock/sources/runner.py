"""A batch over cells that can be killed and goes on: planned less finished cells are computed, each published with its digest.

Two tables lie below the run's folder: data, by cell, and status, a row for each finished cell. A cell's data is replaced
as a whole when it is written, and it counts as finished only by its status row, which is written last; a run that dies
between the two computes the cell again. Both tables are in the folder that driver and executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrablock.functions.canonical import canonical
from terrablock.sources.readers import write_cells

STATUS = "cell string, n long, digest string"


def content(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """cell, n, digest of each planned cell's rows: a sum of hashes of their canonical texts, whatever their order."""
    text = canonical(F.struct(*rows.columns), rows.schema)
    word = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long").cast("decimal(38,0)")
    per = rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum(word).cast("string").alias("digest"))
    return planned.select("cell").distinct().join(per, "cell", "left").select("cell", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("digest", F.lit("0")).alias("digest"))


def finished(spark: SparkSession, path: str) -> DataFrame:
    """cell, n, digest of the finished cells; none where nothing was run."""
    try:
        return spark.read.schema(STATUS).parquet(f"{path}/status")
    except AnalysisException:
        return spark.createDataFrame([], STATUS)


def written(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{path}/data")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def run_cells(spark: SparkSession, planned: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, batch: int = 4) -> DataFrame:
    """Compute the planned cells that aren't finished, batch by batch, and return their status. planned: column cell.

    compute gets a table of some cells and returns rows of them, with a column cell and the same schema every time. A job
    for each batch: cells are a bounded list of places, and only their names reach the driver.
    """
    still = planned.select("cell").distinct().join(finished(spark, path).select("cell"), "cell", "left_anti")
    names = [r.cell for r in still.orderBy("cell").collect()]
    for k in range(0, len(names), batch):
        some = spark.createDataFrame([(c,) for c in names[k : k + batch]], "cell string")
        rows = compute(some)
        write_cells(rows, f"{path}/data")
        back = written(spark, path, rows.schema).join(F.broadcast(some), "cell", "left_semi")  # at most batch cells
        write_cells(content(back, some).select("n", "digest", "cell"), f"{path}/status")
    return finished(spark, path)


def audit(spark: SparkSession, planned: DataFrame, path: str, schema) -> DataFrame:
    """cell, n, state of each planned cell: 'finished', 'open', or 'changed' where the data no longer has the digest it was published with."""
    status = finished(spark, path).withColumnRenamed("n", "n_then").withColumnRenamed("digest", "then")
    now = content(written(spark, path, schema), planned)
    state = F.when(F.col("then").isNull(), "open").when((F.col("then") == F.col("digest")) & (F.col("n") == F.col("n_then")), "finished").otherwise("changed")
    return now.join(status, "cell", "left").select("cell", F.when(F.col("then").isNotNull(), F.col("n")).alias("n"), state.alias("state"))


def completeness(planned: DataFrame, status: DataFrame) -> DataFrame:
    """n_planned, n_finished, n_rows, label: COMPLETE if every planned cell is finished, else PARTIAL."""
    rows = planned.select("cell").distinct().join(status, "cell", "left")
    out = rows.agg(F.count("*").alias("n_planned"), F.count("digest").alias("n_finished"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return out.withColumn("label", F.when(F.col("n_finished") == F.col("n_planned"), "COMPLETE").otherwise("PARTIAL"))
