"""What the operators share: table reading, intermediate tables, labelled samples."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and \t \n \v \f \r.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}/{name}"


#: Of small rows, as many as one file should have at least.
FILE_ROWS = 1_000_000

#: Lists that paths of new tables are noted in, the innermost last.
_NOTED: list[list[str]] = []


def stage_table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and lost executors cost nothing.

    `rows`, if it is known, is a bound of the number of (small) rows, which are then written to files of a million
    at least, rather than to as many files as there are partitions.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    path = stage_path(spark, name)
    df.write.parquet(path)
    for noted in _NOTED[-1:]:
        noted.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of tables that nothing reads any more, on whatever file system they are."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_tables(*tables: DataFrame) -> None:
    """Deletes what stage_table() wrote for these, once all that is computed from them is written itself."""
    for t in tables:
        remove(t.sparkSession, t.staged_at)


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Within, the paths of new tables are noted in `paths`."""
    _NOTED.append(paths)
    try:
        yield
    finally:
        _NOTED.pop()


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, modulus: int, held: int) -> list:
    """At most `rows` training rows (text, label), chosen by a hash of the id, half of them of each label where there are enough.

    Rows whose crc32(doc_id) mod `modulus` is `held`, null ids and null labels are left out.
    The bound applies to fitting alone; scoring covers every row.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(id_crc(F.col("doc_id")) % modulus != held)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_y"))
        .withColumn("_h", F.xxhash64("doc_id"))
    )
    picked = [known.where(F.col("_y") == y).orderBy("_h", "doc_id").limit(rows // 2) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    # The ids are at most `rows` longs, so their size is bounded by the parameter.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).join(F.broadcast(ids), "doc_id")
    found = texts.groupBy("doc_id").agg(F.first("_y").alias("_y"), F.max("_t").alias("_t"), F.first("_h").alias("_h")).collect()
    return [(r["_t"], r["_y"]) for r in sorted(found, key=lambda r: (r["_h"], r["doc_id"]))]
