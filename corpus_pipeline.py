"""A corpus pipeline of five stages: quality, near duplicates, decontamination, mixing, sharding.

Every stage decides row by row, so repeated rows, rows of one doc_id and rows without any are each judged, and hands on
all columns of documents, whatever their names. Null and empty texts: the classifier judges them, nothing links or
contaminates them, and the mix, whose unit is the word, takes none of them. Empty tables give empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrablock.llm.common import doc_key, materialise, numbered, scratch, small_side, table
from terrablock.llm.decontaminate import decontaminate
from terrablock.llm.mixing import mixed_rows
from terrablock.llm.ngram_join import Link, linked_components
from terrablock.llm.quality import keep_good
from terrablock.llm.sharding import sharded_rows

#: Near duplicates of the pipeline: shingles of five words, Jaccard 0.80.
NEAR = Link(5, 80, 100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id stays (null last; of several rows of it, one)."""
    rows = numbered(docs)
    linked = linked_components(rows.select(F.col("row").alias("doc_id"), "doc.text"), NEAR).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select("row", doc_key("doc.doc_id").alias("id"))
    groups = linked.join(ids, "row").groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("n"))
    alone = materialise(groups.select(F.col("first.row").alias("row")))
    return rows.join(small_side(alone), "row", "left_semi").select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows contaminated by the benchmark go."""
    rows = numbered(docs)
    judged = decontaminate(rows.select(F.col("row").alias("doc_id"), "doc.text"), table(spark, sf_dir, "benchmark"))
    gone = materialise(judged.where("contaminated").select(F.col("doc_id").alias("row")))
    return rows.join(small_side(gone), "row", "left_anti").select("doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows appear as often as the mix of sources takes them."""
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and slot, and keeps its text and other columns."""
    return sharded_rows(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: The classifier's fit can't be said in SQL; tests hold the other stages against each operator's SQL and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each written to the shared folder and read again; what a stage wrote for itself is deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark) as own:
            docs = materialise(stage(spark, docs, sf_dir))
            own.pop()
    return docs
