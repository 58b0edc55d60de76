"""Reading documents and writing redacted copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.dialect import collapse_ws, strip_ws
from inkveil.operators.sequence import ordered_concat

ROWS_PER_TASK = 25_000  # records of about 200 characters


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Deal a table out evenly, before work bound by the processor: no task gets more than about ``rows_per_task`` rows,
    and every core has one.

    Only for frames that are plain scans: their rows are counted from the files' footers. How many splits a scan has
    says nothing, as all rows of a split may stand in one row group. The condition always holds; as it depends on the
    task, no later filter moves below the exchange, where it would run in the few tasks that read.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))
    return df.repartition(tasks).where(F.spark_partition_id() >= 0)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one row each: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def has_pdf_name(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(".pdf"))


def has_pdf_signature(content: Column) -> Column:
    """The first five bytes are ``%PDF-``."""
    return F.substring(content, 1, 5) == F.encode(F.lit("%PDF-"), "utf-8")


def read_pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that are PDFs by name and by signature: path, modificationTime, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(has_pdf_name(F.col("path")) & has_pdf_signature(F.col("content")))


def assemble_pages(items: DataFrame) -> DataFrame:
    """Page text from its ordered items: joined by blanks, white space collapsed."""
    joined = ordered_concat(items, ["doc_id", "page_no"], "item_no", "str", " ")
    return joined.select("doc_id", "page_no", collapse_ws(F.col("text")).alias("text"))


def assemble_documents(pages: DataFrame) -> DataFrame:
    """Document text from its pages, a blank line between them, with the page count: one row per document."""
    joined = ordered_concat(pages, ["doc_id"], "page_no", "text", "\n\n")
    return joined.select("doc_id", F.lit(0).cast("long").alias("part_no"), strip_ws(F.col("text")).alias("text"), F.col("n_parts").alias("page_count"))


def count_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))


# What a missing metadata entry reads as.
METADATA_DEFAULTS = {
    "title": "Unknown", "author": "Unknown", "subject": "", "creator": "", "producer": "", "creation_date": "",
}

SCRUBBED = {
    "producer": "inkveil", "creator": "inkveil", "title": "Redacted Document", "author": "Anonymous",
    "subject": "Redacted Content", "keywords": "redacted",
}


def metadata_defaults(meta: DataFrame) -> DataFrame:
    """Fill missing metadata; empty counts as missing."""
    out = meta
    for name, default in METADATA_DEFAULTS.items():
        if name in meta.columns:
            out = out.withColumn(name, F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default)))
    return out


def scrub_metadata(meta: DataFrame, keep: Sequence[str] = ("doc_id",), constants: dict[str, str] | None = None) -> DataFrame:
    """Replace all metadata by constants; only the key columns survive."""
    values = SCRUBBED if constants is None else constants
    return meta.select(*keep, *[F.lit(v).alias(k) for k, v in values.items()])


def output_path(folder: str, run_date: str) -> str:
    """Dated output folder; ``run_date`` is yyyy-MM-dd."""
    return f"{folder.rstrip('/')}/redacted_{run_date}"


def resolved(spark: SparkSession, path: str) -> str:
    """The path with scheme and host, so that two spellings of one place are equal."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def write_copy(redacted: DataFrame, source: str | DataFrame, target: str) -> None:
    """Write redacted pages as a new table. The original is never overwritten, nor is an earlier copy.

    ``source`` is the original's path, or a frame that reads it: the copy may lie neither over nor among its files.
    """
    spark = redacted.sparkSession
    own = resolved(spark, target)
    files = [source] if isinstance(source, str) else source.inputFiles()
    for file in {resolved(spark, f) for f in files}:
        folder = file if isinstance(source, str) else file.rsplit("/", 1)[0]
        if file == own or file.startswith(f"{own}/") or own == folder:
            raise ValueError("the redacted copy must not replace its source")
    redacted.write.mode("errorifexists").parquet(target)
