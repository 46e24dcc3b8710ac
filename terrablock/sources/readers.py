"""Scans of registries, records and manifests, and sinks for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

REGISTRY = "site_id string, lat string, lon string, height_m string, freq_mhz string, power_w string, operator string"


def antenna_registry(spark: SparkSession, path: str) -> DataFrame:
    """A CSV registry of antennas: numbers that can't be read are 0; power in dBm, environment by frequency; rows without a place go."""
    from terrablock.functions.propagation import environment_of, watts_to_dbm

    raw = spark.read.csv(path, header=True, schema=REGISTRY)
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c)
    clean = raw.select("site_id", number("lat"), number("lon"), number("height_m"), number("freq_mhz"), number("power_w"), "operator").where("lat <> 0 OR lon <> 0").dropDuplicates()
    height = F.when(F.col("height_m") > 0, F.col("height_m")).otherwise(30.0)
    return clean.withColumns({"height_m": height, "power_dbm": watts_to_dbm(F.col("power_w")), "environment": environment_of(F.col("freq_mhz"))})


def records(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON records, one or more files of one document each."""
    return spark.read.json(path, multiLine=True)


def _leaves(value: Column, kind: DataType, path: Column) -> Column:
    """Array of (path, value) of everything below a value, by its type: fields by name, items by number."""
    if isinstance(kind, StructType):
        parts = [_leaves(value.getField(f.name), f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        return F.concat(*parts) if parts else F.array().cast("array<struct<path:string,value:string>>")
    if isinstance(kind, ArrayType):
        items = F.transform(value, lambda x, i: _leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(items), F.array().cast("array<struct<path:string,value:string>>"))
    return F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))


def flattened(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, value: a row for every leaf of nested rows, whatever their schema; missing leaves are null."""
    fields = [f for f in rows.schema.fields if f.name not in keys]
    return rows.select(*keys, F.inline(F.concat(*(_leaves(F.col(f.name), f.dataType, F.lit(f.name)) for f in fields))))


def record_leaves(spark: SparkSession, path: str) -> DataFrame:
    """file, path, value of nested JSON records."""
    return flattened(records(spark, path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)), ["file"])


def write_record(rows: DataFrame, path: str, provenance: dict[str, str], inputs: DataFrame | None = None) -> None:
    """One nested JSON record of a summary (some dozens of rows) with its provenance and the digests of its inputs (of digests)."""
    whole = rows.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("rows"), *(F.first(F.lit(v)).alias(k) for k, v in provenance.items()))
    if inputs is not None:
        whole = whole.crossJoin(inputs.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("inputs")))
    whole.coalesce(1).write.mode("overwrite").json(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A published CSV table, numbers with thousands' commas read as numbers."""
    raw = spark.read.csv(path, header=True)
    wanted = spark.createDataFrame([], schema).dtypes
    return raw.select(*(F.regexp_replace(c, ",", "").cast(t).alias(c) if t in ("double", "long", "int", "bigint") else F.col(c).cast(t) for c, t in wanted))


def manifest(spark: SparkSession, path: str, group: str | None = None) -> DataFrame:
    """JSON lines, of one group if given."""
    rows = spark.read.json(path)
    return rows if group is None else rows.where(F.col("grupo") == group)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_cells(rows: DataFrame, path: str) -> None:
    """Rows by cell, replacing only the cells that rows has: a batch can stop and go on."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(path)


def open_cells(spark: SparkSession, planned: DataFrame, path: str) -> DataFrame:
    """The planned cells that the table at path doesn't have yet."""
    return planned.join(spark.read.parquet(path).select("cell").distinct(), "cell", "left_anti")


def write_table(rows: DataFrame, path: str, digits: int = 3) -> None:
    """A published table: doubles as text with so many digits, CSV with a header."""
    rows.select(*(F.format_number(c, digits).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes)).write.mode("overwrite").csv(path, header=True)
