"""Scanning and redacting a stream of documents.

Detection and masking look at one document at a time and keep no state, so the batch functions take a
streaming frame unchanged; there are no watermarks to set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkveil.operators.scan import scan_pattern_arrays
from inkveil.plans.redaction import redact_documents
from inkveil.session import shared_folder


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string", max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def redact_stream(docs: DataFrame, presets: Sequence[str] = (), custom: Sequence[str] = ()) -> DataFrame:
    """Pattern scan and redaction of each arriving document."""
    found = scan_pattern_arrays(docs.select("doc_id", "text"), presets, custom)
    return redact_documents(found.withColumnRenamed("findings", "targets")).select(
        "doc_id", F.col("redacted").alias("text"), "n_targets", "n_redactions"
    )


def write_stream(redacted: DataFrame, target: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append to a table, exactly once; ends when the present input is used up.

    Without a path of its own the progress is kept below the cluster's shared checkpoint folder.
    """
    checkpoint = checkpoint or shared_folder(redacted.sparkSession, "redact_stream")
    return (
        redacted.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
