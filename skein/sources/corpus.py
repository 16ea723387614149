"""Reading and writing corpora and link graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A corpus (doc_id or url, text) from any of Spark's file formats, or a table's name with fmt 'table'."""
    return spark.read.table(path) if fmt == "table" else spark.read.format(fmt).options(**options).load(path)


def write_corpus(content: DataFrame, edges: DataFrame, path: str) -> None:
    """What a crawl hands on: contents and references side by side, as Parquet."""
    content.write.mode("overwrite").parquet(f"{path}/contents")
    edges.write.mode("overwrite").parquet(f"{path}/references")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/references")


def crawl_counters(content: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: pages with content, links, and hosts' pages linked from."""
    pages = content.agg(F.count("*").alias("contents"))
    return pages.crossJoin(F.broadcast(edges.agg(F.count("*").alias("links"), F.countDistinct("src").alias("sources"))))


def enough(content: DataFrame, stop_size: int = 3000) -> bool:
    """Whether a crawl has more pages than it was to stop at; reads at most that many."""
    return content.limit(stop_size + 1).count() > stop_size
