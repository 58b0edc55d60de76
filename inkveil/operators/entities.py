"""Operators over findings and entity tables.

Findings carry ``family, seq, pos``, which order them inside a document: model output before rules,
rules before the pattern scan, and text order within a rule. "First" always means lowest in that order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.dialect import WS, strip_ws
from inkveil.functions.text import confidence_band, confidence_percent, is_common_word, norm_key, source_label
from inkveil.operators.sequence import keep_first, number_rows

ORDER = ("family", "seq", "pos")
FIELDS = (*ORDER, "text", "score", "type", "source")
PER_LIST_PAGE = 17


def is_trivial(text: Column) -> Column:
    """At most one character, or only digits and spaces."""
    t = strip_ws(text)
    return (F.length(t) <= 1) | t.rlike(rf"^[\d{WS}]+\z")


def drop_trivial(findings: DataFrame) -> DataFrame:
    """Cleanup of the fast scan."""
    return findings.where(~is_trivial(F.col("text")))


def keep_first_text(findings: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    return keep_first(findings, keys, strip_ws(F.col("text")), ORDER, FIELDS)


def keep_first_normalized(
    findings: DataFrame, keys: Sequence[str] = ("doc_id",), order: Sequence[str] = ORDER, columns: Sequence[str] = FIELDS
) -> DataFrame:
    """Drop texts of at most two characters; of those equal but for case and spacing keep the first."""
    long_enough = findings.where(F.length(strip_ws(F.col("text"))) > 2)
    return keep_first(long_enough, keys, norm_key(F.col("text")), order, columns)


def drop_common_words(names: DataFrame, column: str = "text") -> DataFrame:
    """Name filter: more than three characters and not a common word."""
    return names.where((F.length(column) > 3) & ~is_common_word(F.col(column)))


def count_by_source(entities: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    intel = F.col("source") == "intel"
    return entities.groupBy(*keys).agg(
        F.count_if(~F.coalesce(intel, F.lit(False))).alias("n_ai"),
        F.count_if(intel).alias("n_intel"),
        F.count(F.lit(1)).alias("n_total"),
    )


def session_stats(documents: DataFrame, entities: DataFrame, redacted: DataFrame) -> DataFrame:
    """One row: documents scanned, entities listed (detected and manual), redaction targets applied."""
    scanned = documents.agg(F.count(F.lit(1)).alias("scanned"))
    found = entities.agg(F.count(F.lit(1)).alias("entities"))
    done = redacted.agg(F.count(F.lit(1)).alias("redacted"))
    named = [
        scanned.select(F.lit("scanned").alias("k"), F.col("scanned").alias("v")),
        found.select(F.lit("entities").alias("k"), F.col("entities").alias("v")),
        done.select(F.lit("redacted").alias("k"), F.col("redacted").alias("v")),
    ]
    rows = named[0].unionByName(named[1]).unionByName(named[2])
    return rows.agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("scanned", "entities", "redacted")])


def search(entities: DataFrame, query: str) -> DataFrame:
    """Case-insensitive literal search in the entity text; a blank query keeps everything."""
    if not query.strip():
        return entities
    return entities.where(F.contains(F.lower("text"), F.lit(query.lower())))


def with_confidence(entities: DataFrame) -> DataFrame:
    score = F.col("score")
    return (
        entities.withColumn("band", confidence_band(score))
        .withColumn("percent", confidence_percent(score))
        .withColumn("label", source_label(F.col("source")))
    )


def paginate(
    entities: DataFrame, keys: Sequence[str] = ("doc_id",), per_page: int = PER_LIST_PAGE, order: Sequence[str] = ("ord",)
) -> DataFrame:
    """List pages by falling score, equal ones in ``order``: adds n, page, total and the label "start-end of total"."""
    score = F.coalesce("score", F.lit(0.0))
    numbered = number_rows(entities, keys, [score.desc(), *[F.col(c) for c in order]], number="n", total="total")
    first = (F.col("page") - 1) * per_page + 1
    last = F.least(F.col("page") * per_page, F.col("total"))
    return numbered.withColumn("page", F.ceil(F.col("n") / per_page).cast("bigint")).withColumn(
        "label", F.concat(first.cast("string"), F.lit("-"), last.cast("string"), F.lit(" of "), F.col("total").cast("string"))
    )


def page_slice(pages: DataFrame, page: int) -> DataFrame:
    return pages.where(F.col("page") == page)


# --- manual entities --------------------------------------------------------------------------------


def with_manual(
    detected: DataFrame, manual: DataFrame, keys: Sequence[str] = ("doc_id",), order: Sequence[str] = ("page_no", "seq", "pos")
) -> DataFrame:
    """The list a reviewer sees: detected entities in their order, then the manual ones in theirs (``seq``), which are
    certain. ``part`` (0 or 1) and the order columns give an entity's place."""
    kinds = {c: detected.schema[c].dataType for c in order}
    place = [(F.col("seq") if c == "seq" else F.lit(None)).cast(kinds[c]).alias(c) for c in order]
    fields = ("text", "score", "type", "source")
    certain = [F.lit(1.0).alias("score"), F.lit("manual").alias("type"), F.lit("manual").alias("source")]
    return detected.select(*keys, F.lit(0).alias("part"), *order, *fields).unionByName(
        manual.select(*keys, F.lit(1).alias("part"), *place, "text", *certain)
    )


def add_manual(existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Append manual texts; a text already in the list is ignored. Every call adds a later batch of each document."""
    batched = "batch" in existing.columns
    old = existing.select(*keys, (F.col("batch") if batched else F.lit(0)).alias("batch"), "seq", "text")
    if batched:
        last = existing.groupBy(*keys).agg((F.max("batch") + 1).alias("batch"))
        more = new.select(*keys, "seq", "text").join(last, list(keys), "left").withColumn("batch", F.coalesce("batch", F.lit(1)))
    else:
        more = new.select(*keys, F.lit(1).alias("batch"), "seq", "text")
    both = old.unionByName(more.select(*keys, "batch", "seq", "text"))
    return keep_first(both, keys, F.col("text"), ("batch", "seq"), ("batch", "seq", "text"))


def undo_manual(manual: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Remove the entity added last in each document: the last of the last batch, where there are batches."""
    place = [c for c in ("batch", "seq") if c in manual.columns]
    last = manual.groupBy(*keys).agg(F.max(F.struct(*place)).alias("_last")).select(*keys, "_last.*")
    return manual.join(last, [*keys, *place], "left_anti")


def remove(entities: DataFrame, removed: DataFrame, keys: Sequence[str] = ("doc_id", "ord")) -> DataFrame:
    """Remove by position, not by text: an equal text elsewhere stays."""
    return entities.join(removed.select(*keys).distinct(), list(keys), "left_anti")


def target_set(detected: DataFrame, manual: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Distinct texts to redact, by exact text."""
    return detected.select(*keys, "text").unionByName(manual.select(*keys, "text")).distinct()


def requested_presets(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requested preset ids that exist. The catalogue is the fixed eight-row table, hence the broadcast."""
    return requests.join(F.broadcast(catalog), "preset_id")


# --- report -----------------------------------------------------------------------------------------

FIRST_REPORT_PAGE = 26
LATER_REPORT_PAGE = 32


def report_page(n: Column) -> Column:
    later = 2 + F.floor((n - FIRST_REPORT_PAGE - 1) / LATER_REPORT_PAGE)
    return F.when(n <= FIRST_REPORT_PAGE, 1).otherwise(later).cast("bigint")


def report_lines(entities: DataFrame, keys: Sequence[str] = ("doc_id",), order: Sequence[str] = ("ord",)) -> DataFrame:
    """Numbered report lines with their page: 26 on the first, 32 on the following ones."""
    numbered = number_rows(entities, keys, [F.col(c) for c in order], number="line_no")
    line = F.concat(F.col("line_no").cast("string"), F.lit(". "), F.col("text"))
    return numbered.select(*keys, report_page(F.col("line_no")).alias("report_page"), "line_no", line.alias("line"))


def report_header(documents: DataFrame, run_date: str, name: str = "doc_id", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """What stands above the first line of each document's report, as lines numbered below 1."""
    lines = (F.lit("Redaction report"), F.lit(f"Generated: {run_date}"), F.concat(F.lit("Document: "), F.col(name).cast("string")), F.lit("Sensitive items:"))
    rows = F.array(*[F.struct(F.lit(i + 1 - len(lines)).cast("bigint").alias("line_no"), x.alias("line")) for i, x in enumerate(lines)])
    return documents.select(*keys, F.lit(1).cast("bigint").alias("report_page"), F.inline(rows))
