"""Shared pieces: words, bound columns, stored intermediate tables, document keys."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words: blank, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="inkveil-")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this process only where none is set on a single machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or f"file://{_own_folder()}").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts the lineage, so later steps
    neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Shuffle files of what is stored go when the driver collects what refers to them; else they would wait for memory
    # to run short there, and take the executors' disks until then.
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table of ``stored`` that nothing will read again."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if path.startswith(shared_root(spark)) or path.removeprefix("file://").startswith(shared_root(spark).removeprefix("file://")):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though it is used several times."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def text_key(text: Column) -> Column:
    """With ``doc_id``, names a document: rows equal in both count as one document and share its result."""
    return F.xxhash64(text)


def keyed(docs: DataFrame) -> DataFrame:
    """``_row``, the whole input row, and its document's name in ``_id`` and ``_key``: no other column can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_key"))


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, _key) is not in ``bad``; a null doc_id is a name as well."""
    gone = bad.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k")).distinct()
    rows = keyed(docs)
    return unpacked(rows.join(gone, rows["_id"].eqNullSafe(gone["_d"]) & (rows["_key"] == gone["_k"]), "left_anti"), docs.columns)


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The input columns back out of ``_row``, some with new values."""
    return df.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in columns])
