"""From entities to a redacted copy with its audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.dialect import collapse_ws, fold, is_blank
from inkveil.functions.spans import blackout, merge_spans
from inkveil.functions.text import audit_hash, let
from inkveil.operators.entities import target_set
from inkveil.operators.mask import all_spans, redact_pages
from inkveil.sources.audit import append_audit, redaction_audit
from inkveil.sources.files import write_copy


def redact_documents(docs: DataFrame) -> DataFrame:
    """Redact single-text documents from (doc_id, text, targets): a narrow map, nothing is shuffled."""
    targets = F.transform(
        F.filter(F.array_distinct("targets"), lambda t: ~is_blank(t)), collapse_ws
    )
    found = let(fold(F.col("text")), lambda low: all_spans(low, F.transform("targets", fold)))
    spans = docs.select("doc_id", "text", targets.alias("targets")).withColumn("_spans", found)
    return spans.select(
        "doc_id",
        "text",
        F.size("targets").cast("bigint").alias("n_targets"),
        F.size("_spans").cast("bigint").alias("n_redactions"),
        blackout(F.col("text"), merge_spans(F.col("_spans"))).alias("redacted"),
    )


def redact_to(pages: DataFrame, detected: DataFrame, manual: DataFrame, source: str, target: str) -> None:
    """Redact the pages of a collection and store the copy next to, never over, its source."""
    write_copy(redact_pages(pages, target_set(detected, manual)), source, target)


def redact_documents_to(docs: DataFrame, source: str, target: str, audit: str) -> bool:
    """Store redacted documents, then their audit records, read back from what was stored."""
    done = redact_documents(docs)
    stored = done.select(
        "doc_id", F.col("redacted").alias("text"), "n_targets", "n_redactions", audit_hash(F.col("text")).alias("doc_hash")
    )
    write_copy(stored, source, target)
    back = docs.sparkSession.read.parquet(target)
    return append_audit(redaction_audit(back), audit)
