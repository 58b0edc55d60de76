"""Session statistics in event time: what was found first, when, and how much by then.

A finding is a row (ts, doc_id, text, source). Of findings of a document that are equal but for case and spacing only the
earliest counts. A stream keeps each one as state until the watermark has passed it by ``delay``: whatever the order in
which equal findings arrive, the earliest is written, once, and repetitions up to ``delay`` after it are recognised. A
row that arrives behind the watermark is dropped. The windows of the table that the stream writes are those of
:func:`batch_stats`, as long as repetitions and late rows stay within the delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkveil.functions.text import norm_key
from inkveil.session import shared_folder

DELAY_S = 2 * 3600
WIDTH = "1 hour"


def _keyed(findings: DataFrame) -> DataFrame:
    return findings.select(F.col("ts").cast("timestamp").alias("ts"), "doc_id", norm_key(F.col("text")).alias("key"), "source")


def first_findings(findings: DataFrame) -> DataFrame:
    """ts, doc_id, key, source of the earliest of equal findings; of equally early ones the smallest source."""
    earliest = F.min(F.struct("ts", "source")).alias("f")
    return _keyed(findings).groupBy("doc_id", "key").agg(earliest).select("f.ts", "doc_id", "key", "f.source")


def stream_first_findings(findings: DataFrame, delay_s: int = DELAY_S) -> DataFrame:
    """The same on a stream."""
    rows = _keyed(findings).withWatermark("ts", f"{delay_s} seconds")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "key", "source")}

    def keep(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ts, source = state.get
            state.remove()
            yield pd.DataFrame({"ts": [ts], "doc_id": [group[0]], "key": [group[1]], "source": [source]})
            return
        found = [state.get] if state.exists else []
        for batch in batches:
            found += [(t, None if pd.isna(s) else s) for t, s in zip(batch["ts"], batch["source"])]
        first = min(found, key=lambda f: (f[0], f[1] is not None, f[1] or ""))
        state.update(first)
        state.setTimeoutTimestamp(int(pd.Timestamp(first[0]).timestamp() * 1000) + delay_s * 1000)

    return rows.groupBy("doc_id", "key").applyInPandasWithState(
        keep,
        f"ts timestamp, doc_id {kinds['doc_id']}, key string, source {kinds['source']}",
        f"ts timestamp, source {kinds['source']}",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def write_first_findings(first: DataFrame, target: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append to a table, exactly once; ends when the present input is used up."""
    return (
        first.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint or shared_folder(first.sparkSession, "first_findings"))
        .trigger(availableNow=True)
        .start()
    )


def window_stats(first: DataFrame, width: str = WIDTH) -> DataFrame:
    """begins, source, n_found, n_total: first findings per window and source, and of the source up to its end."""
    counted = first.groupBy(F.window("ts", width).alias("_w"), "source").agg(F.count(F.lit(1)).alias("n_found"))
    upto = Window.partitionBy("source").orderBy("begins").rowsBetween(Window.unboundedPreceding, 0)
    return counted.select(F.col("_w.start").alias("begins"), "source", "n_found").withColumn("n_total", F.sum("n_found").over(upto))


def batch_stats(findings: DataFrame, width: str = WIDTH) -> DataFrame:
    return window_stats(first_findings(findings), width)
