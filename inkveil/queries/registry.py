"""The named queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.catalog import rules as R
from inkveil.catalog.dictionaries import ALL_PRESETS, PRESETS
from inkveil.functions import text as T
from inkveil.functions.dialect import collapse_ws
from inkveil.operators import entities as E
from inkveil.operators import mask as M
from inkveil.operators import scan as S
from inkveil.operators.chunks import chunk_texts, stitch_replies, stitch_tokens
from inkveil.operators.ner import merge_tokens, tag_chunks
from inkveil.operators.review import review_log as replay
from inkveil.operators.rule_table import rejected_rules, scan_rule_table
from inkveil.plans import job as J
from inkveil.plans import scan as P
from inkveil.plans.redaction import redact_documents
from inkveil.queries import inputs as I
from inkveil.session import scratch, stored
from inkveil.sources import audit as A
from inkveil.sources import files as SF
from inkveil.sources.settings import parse_list, preset_catalog
from inkveil.streaming.stats import batch_stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PAGE_KEYS = ("doc_id", "page_no")

RULE_FAMILIES = {
    "scan_common": R.COMMON_RULES,
    "scan_names": R.NAME_RULES,
    "scan_bank": R.BANK_RULES,
    "scan_medical": R.MEDICAL_RULES,
    "scan_legal": R.LEGAL_RULES,
    "scan_employment": R.EMPLOYMENT_RULES,
    "scan_identity": R.IDENTITY_RULES,
    "scan_financial": R.FINANCIAL_RULES,
    "scan_insurance": R.INSURANCE_RULES,
    "scan_fast_rules": R.FAST_RULES + R.FAST_NAME_RULES,
    "scan_legacy_rules": R.LEGACY_RULES,
}
EVERY_RULE = tuple(r for family in RULE_FAMILIES.values() for r in family) + R.DEEP_RULES
COMBINED_PRESETS = ("bank-statement", "tax-form", "identity")


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = fn(spark, sf)
        wide = [
            F.col(f.name).cast("bigint").alias(f.name) if f.dataType.typeName() in ("integer", "short", "byte") else F.col(f.name)
            for f in df.schema.fields
        ]
        return df.select(*wide)

    # a query may share its name with the function it shows
    QUERIES[fn.__name__.removesuffix("_query")] = run
    return run


def _family(name: str) -> None:
    def fn(spark: SparkSession, sf: str) -> DataFrame:
        return S.scan_rules(I.all_docs(spark, sf), RULE_FAMILIES[name])

    fn.__name__ = name
    query(fn)


for _name in RULE_FAMILIES:
    _family(_name)


# --- scans ------------------------------------------------------------------------------------------


@query
def rule_histogram(spark, sf):
    return S.count_rules(I.all_docs(spark, sf), EVERY_RULE)


@query
def rules_cross(spark, sf):
    return scan_rule_table(I.all_docs(spark, sf), I.rule_table(spark, sf))


@query
def rules_led(spark, sf):
    """The same when the table is too long for a projection."""
    return scan_rule_table(I.all_docs(spark, sf), I.rule_table(spark, sf), planned=1)


@query
def rules_rejected(spark, sf):
    return rejected_rules(I.rule_table(spark, sf)).select("rule", "pattern")


@query
def scan_urls(spark, sf):
    pages = I.table(spark, sf, "pages").select("page_id", "url")
    return S.scan_rules(pages, [r for r in EVERY_RULE if r.rule_id in ("C16", "C17", "A09")], ("page_id",), "url")


@query
def scan_deep_rules(spark, sf):
    return S.scan_deep_rules(I.all_docs(spark, sf))


@query
def scan_intel(spark, sf):
    return S.scan_pattern(I.all_docs(spark, sf), ALL_PRESETS, I.CUSTOM_KEYWORDS)


@query
def keyword_windows(spark, sf):
    found = S.scan_keyword_windows(I.all_docs(spark, sf), ALL_PRESETS)
    return found.select("doc_id", "preset", "keyword", "pos", "window")


@query
def keyword_values(spark, sf):
    found = S.scan_keyword_windows(I.all_docs(spark, sf), ALL_PRESETS)
    return found.where(F.col("value").isNotNull()).select("doc_id", "preset", "keyword", "pos", "value")


@query
def keyword_join(spark, sf):
    words = sorted({k for p in PRESETS.values() for k in p.keywords})
    return S.join_keywords(I.all_docs(spark, sf), words)


@query
def custom_keywords(spark, sf):
    docs = S.with_gates(I.all_docs(spark, sf))
    found = docs.withColumn("findings", S.custom_hits(I.CUSTOM_KEYWORDS))
    return S.explode_findings(found, ["doc_id"])


@query
def ner_merge(spark, sf):
    return merge_tokens(I.tokens(I.all_pages(spark, sf)), PAGE_KEYS)


@query
def scan_fast(spark, sf):
    pages = I.all_pages(spark, sf)
    return P.scan_fast(pages, I.tokens(pages), PAGE_KEYS)


@query
def parse_llm_reply(spark, sf):
    rows = I.replies(I.all_pages(spark, sf)).where(F.col("reply").isNotNull())
    items = F.when(~T.reply_says_nothing(F.col("reply")), T.parse_reply(F.col("reply")))
    found = rows.withColumn("findings", items)
    return S.explode_findings(found, PAGE_KEYS)


@query
def llm_prompt(spark, sf):
    docs = I.documents(spark, sf).select("doc_id", T.extraction_prompt(F.col("text")).alias("prompt"))
    return docs.select("doc_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


@query
def llm_prompt_chunks(spark, sf):
    """Every character of a text is asked about."""
    chunks = chunk_texts(I.documents(spark, sf), 3000, 300)
    asked = chunks.select("doc_id", "chunk_no", "start", T.extraction_prompt(F.col("text")).alias("prompt"))
    return asked.select("doc_id", "chunk_no", "start", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


@query
def ner_chunks(spark, sf):
    """Entities of whole texts, tagged in chunks."""
    chunks = chunk_texts(I.documents(spark, sf), 2000, 400)
    return merge_tokens(stitch_tokens(tag_chunks(chunks, I.tag_words), chunks, 2000, 400))


@query
def llm_reply_chunks(spark, sf):
    """Items of whole texts, from replies to chunks."""
    chunks = chunk_texts(I.documents(spark, sf), 1000, 100)
    return stitch_replies(chunks.withColumn("reply", F.expr(I.REPLY_TEXT.replace("page_no", "chunk_no"))))


@query
def ner_merge_legacy(spark, sf):
    """The threshold of the superseded first version."""
    return merge_tokens(I.tokens(I.all_pages(spark, sf)), PAGE_KEYS, min_score=0.85)


@query
def scan_deep(spark, sf):
    pages = I.all_pages(spark, sf)
    return P.scan_deep(I.replies(pages), I.tokens(pages), PAGE_KEYS)


@query
def scan_combined(spark, sf):
    pages = I.all_pages(spark, sf)
    return P.scan(pages, "fast", COMBINED_PRESETS, I.CUSTOM_KEYWORDS, I.tokens(pages), keys=PAGE_KEYS)


@query
def scan_combined_deep(spark, sf):
    pages = I.all_pages(spark, sf)
    return P.scan(I.replies(pages), "deep", tokens=I.tokens(pages), doc_type="insurance", keys=PAGE_KEYS)


@query
def scan_offline(spark, sf):
    return P.scan(I.all_docs(spark, sf), "offline", COMBINED_PRESETS)


@query
def preset_catalog_query(spark, sf):
    used = S.count_keywords(I.all_docs(spark, sf), ALL_PRESETS)
    return (
        preset_catalog(spark)
        .join(used, F.col("preset") == F.col("preset_id"), "left")
        .select("preset_id", "name", "description", "n_rules", "n_keywords", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))
    )


@query
def preset_lookup(spark, sf):
    ids = ["tax-form", "education", *ALL_PRESETS]
    wanted = F.get(F.array(*[F.lit(i) for i in ids]), (F.col("event_id") % len(ids)).cast("int"))
    requests = I.table(spark, sf, "events").select("event_id", wanted.alias("preset_id"))
    return E.requested_presets(requests, preset_catalog(spark)).select("event_id", "preset_id", "name")


# --- entities ---------------------------------------------------------------------------------------


@query
def dedup_normalized(spark, sf):
    cols = (*I.PLACE, "text", "score", "type", "source")
    return E.keep_first_normalized(I.page_entities(I.all_pages(spark, sf)), ("doc_id",), I.PLACE, cols)


@query
def stopword_filter(spark, sf):
    words = I.page_items(spark, sf).select("doc_id", "page_no", "item_no", F.col("str").alias("text"))
    return E.drop_common_words(words).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"))


@query
def counts_by_source(spark, sf):
    pages = I.all_pages(spark, sf)
    found = P.scan(pages, "fast", ("legal-document",), (), I.tokens(pages), keys=PAGE_KEYS)
    return E.count_by_source(found, ("doc_id",))


@query
def session_stats(spark, sf):
    pages = I.all_pages(spark, sf)
    listed = stored(I.entity_list(pages), "entities")
    return E.session_stats(I.documents(spark, sf), listed, listed.select("doc_id", "text").distinct())


@query
def running_stats(spark, sf):
    """First findings per day of event time; a user's events of one type are equal findings."""
    found = I.table(spark, sf, "events").select(
        "ts", F.col("user_id").alias("doc_id"), F.col("event_type").alias("text"), F.col("event_type").alias("source")
    )
    return batch_stats(found, "1 day").withColumn("begins", F.unix_micros("begins"))


@query
def confidence_band(spark, sf):
    scored = I.tokens(I.all_pages(spark, sf)).select(
        "doc_id",
        "page_no",
        "idx",
        F.when(F.col("score") >= 0.04, F.col("score")).alias("score"),
        F.when(F.col("idx") % 3 == 0, "bert").when(F.col("idx") % 3 == 1, "regex").otherwise("intel").alias("source"),
    )
    return E.with_confidence(scored)


@query
def target_set(spark, sf):
    pages = I.all_pages(spark, sf)
    return E.target_set(I.page_entities(pages), I.manual_entities(pages))


@query
def add_manual(spark, sf):
    pages = I.all_pages(spark, sf)
    first = I.manual_entities(pages)
    more = pages.select("doc_id", F.col("page_no").alias("seq"), F.element_at(F.split("text", " "), 1).alias("text"))
    return E.add_manual(first, more)


@query
def undo_manual(spark, sf):
    return E.undo_manual(I.manual_entities(I.all_pages(spark, sf)))


@query
def remove_entities(spark, sf):
    found = stored(I.page_entities(I.all_pages(spark, sf)), "entities")
    return E.remove(found, found.where(F.col("pos") % 5 == 0), ("doc_id", *I.PLACE))


@query
def review_log(spark, sf):
    return replay(I.review_events(I.all_pages(spark, sf)))


@query
def entity_search(spark, sf):
    return E.search(I.page_entities(I.all_pages(spark, sf)), "EXAMPLE.com")


@query
def paginate_entities(spark, sf):
    return E.paginate(I.entity_list(I.all_pages(spark, sf)), order=("part", *I.PLACE))


@query
def entity_page(spark, sf):
    return E.page_slice(E.paginate(I.entity_list(I.all_pages(spark, sf)), order=("part", *I.PLACE)), 2)


@query
def report_lines(spark, sf):
    return E.report_lines(I.entity_list(I.all_pages(spark, sf)), order=("part", *I.PLACE))


# --- masking ----------------------------------------------------------------------------------------


def _with_targets(docs: DataFrame) -> DataFrame:
    """Single-text documents with their fast-rule matches and one manual target."""
    auto = F.array_distinct(S.concat_arrays([S.rule_matches(r) for r in R.FAST_RULES + R.FAST_NAME_RULES]))
    gated = S.with_gates(docs, rules=R.FAST_RULES + R.FAST_NAME_RULES).withColumn("auto", auto).withColumn("manual", F.array(I.longest_word(F.col("text"))))
    return S.drop_gates(gated)


def _targets(pages: DataFrame) -> DataFrame:
    """Stored, as in the job: the search reads them more than once, the rules run once."""
    return stored(E.target_set(I.page_entities(pages), I.manual_entities(pages)), "targets")


@query
def mask_preview(spark, sf):
    docs = _with_targets(I.all_docs(spark, sf))
    return docs.select("doc_id", M.mask_preview(F.col("text"), F.concat("auto", "manual")).alias("masked"))


@query
def preview_truncate(spark, sf):
    docs = _with_targets(I.all_docs(spark, sf))
    masked = M.mask_preview(F.col("text"), F.concat("auto", "manual"))
    return docs.select("doc_id", T.preview(F.col("text"), masked).alias("shown"))


@query
def highlight_text(spark, sf):
    docs = _with_targets(I.all_docs(spark, sf))
    return docs.select("doc_id", M.highlight(F.col("text"), F.col("auto"), F.col("manual")).alias("html"))


@query
def redact_documents_query(spark, sf):
    docs = _with_targets(I.all_docs(spark, sf))
    return redact_documents(docs.select("doc_id", "text", F.concat("auto", "manual").alias("targets"))).drop("text")


@query
def match_spans(spark, sf):
    pages = I.all_pages(spark, sf)
    return M.page_spans(pages, _targets(pages))


@query
def merge_spans(spark, sf):
    pages = I.all_pages(spark, sf)
    return M.merged_page_spans(pages, _targets(pages))


@query
def redact_pages(spark, sf):
    pages = I.all_pages(spark, sf)
    return M.redact_pages(pages, _targets(pages))


@query
def redaction_count(spark, sf):
    pages = I.all_pages(spark, sf)
    return M.count_redactions(pages, _targets(pages))


@query
def verify_redaction(spark, sf):
    pages = I.all_pages(spark, sf)
    targets = _targets(pages)
    return M.verify_pages(stored(M.redact_pages(pages, targets), "redacted"), targets)


@query
def highlight_items(spark, sf):
    pages = I.all_pages(spark, sf)
    flags = M.highlight_items(I.page_items(spark, sf), I.page_entities(pages), I.manual_entities(pages))
    return flags.select("doc_id", "page_no", "item_no", "str", "is_manual", "is_detected")


@query
def highlight_priority(spark, sf):
    pages = I.all_pages(spark, sf)
    flags = M.highlight_items(I.page_items(spark, sf), I.page_entities(pages), I.manual_entities(pages))
    return flags.where(F.col("label").isNotNull()).groupBy("doc_id", "page_no", "label").agg(F.count(F.lit(1)).alias("n_items"))


# --- the job ------------------------------------------------------------------------------------------


@query
def job_entities(spark, sf):
    pages = I.all_pages(spark, sf)
    found = J.document_entities(pages, "fast", COMBINED_PRESETS, I.CUSTOM_KEYWORDS, I.tokens(pages))
    return found.select("doc_id", "ord.*", "text", "score", "type", "source")


@query
def job_audit(spark, sf):
    """The audit log of a whole job."""
    pages = I.all_pages(spark, sf)
    out = J.run(pages, scratch(spark, "job"), "2024-05-01", manual=I.manual_entities(pages))
    return spark.read.parquet(out.audit).drop("ts")


# --- sources, audit, small functions ------------------------------------------------------------------


@query
def assemble_pages(spark, sf):
    items = I.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.posexplode(F.split("text", " ")).alias("item_no", "str")
    )
    return SF.assemble_pages(items)


@query
def assemble_document(spark, sf):
    return SF.assemble_documents(
        I.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    )


@query
def page_count(spark, sf):
    return SF.count_pages(I.all_pages(spark, sf))


def _metadata(spark, sf):
    value = lambda c: F.when(F.col("doc_id") % 3 == 0, F.col(c)).when(F.col("doc_id") % 3 == 1, F.lit(""))
    return I.table(spark, sf, "documents").select(
        "doc_id",
        value("source").alias("title"),
        value("lang").alias("author"),
        value("lang").alias("subject"),
        value("source").alias("creator"),
        value("source").alias("producer"),
        value("lang").alias("creation_date"),
    )


@query
def metadata_defaults(spark, sf):
    return SF.metadata_defaults(_metadata(spark, sf))


@query
def metadata_scrub(spark, sf):
    return SF.scrub_metadata(_metadata(spark, sf))


@query
def parse_targets(spark, sf):
    docs = I.documents(spark, sf).select("doc_id", T.parse_targets(F.col("text")).alias("findings"))
    return S.explode_findings(docs, ["doc_id"])


@query
def join_targets(spark, sf):
    docs = _with_targets(I.records(spark, sf))
    wire = T.join_targets(F.col("auto"))
    return docs.select("doc_id", wire.alias("words"), F.size(T.parse_targets(wire)).alias("n_parsed"), F.size("auto").alias("n_targets"))


@query
def pdf_signature(spark, sf):
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("%PDF-"), F.col("text"))).otherwise(F.col("text"))
    ending = F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, ".pdf").otherwise(".txt")
    files = I.documents(spark, sf).select(
        "doc_id", F.concat(F.lit("in/"), F.col("doc_id").cast("string"), ending).alias("path"), F.encode(head, "utf-8").alias("content")
    )
    return files.where(SF.has_pdf_name(F.col("path")) & SF.has_pdf_signature(F.col("content"))).select(
        "doc_id", "path", F.length("content").alias("n_bytes")
    )


@query
def settings_json(spark, sf):
    stored = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["'), F.col("event_type"), F.lit('","identity"]'))).when(
        F.col("event_id") % 3 == 0, F.concat(F.lit('["'), F.col("event_type"))
    )
    return I.table(spark, sf, "events").select("event_id", F.array_join(parse_list(stored), "|").alias("presets"))


@query
def audit_json(spark, sf):
    action = F.when(F.col("event_id") % 2 == 0, "SCAN_COMPLETED").otherwise("REDACTION_APPLIED")
    k = F.get_json_object("props", "$.k").cast("bigint")
    doc = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.lit("DOCUMENT_LOADED").alias("action"),
                    F.concat(F.lit("sha256:"), F.md5(F.col("event_id").cast("string"))).alias("fileHash"),
                    F.col("user_id").alias("pageCount"),
                    F.lit(None).cast("bigint").alias("entitiesFound"),
                ),
                F.struct(
                    action.alias("action"),
                    F.lit(None).cast("string").alias("fileHash"),
                    F.lit(None).cast("bigint").alias("pageCount"),
                    k.alias("entitiesFound"),
                ),
            ).alias("audit_log")
        )
    )
    logs = I.table(spark, sf, "events").select("event_id", doc.alias("doc"))
    return A.parse_audit_log(logs).select("event_id", "action", "fileHash", "pageCount", "entitiesFound")


@query
def audit_redaction(spark, sf):
    docs = _with_targets(I.all_docs(spark, sf))
    done = redact_documents(docs.select("doc_id", "text", F.col("auto").alias("targets")))
    return A.redaction_audit(done.withColumn("doc_hash", T.audit_hash(F.col("text"))))


@query
def audit_lines(spark, sf):
    """Audit records as log lines."""
    n = F.get_json_object("props", "$.k").cast("bigint")
    records = I.table(spark, sf, "events").select(
        "event_id",
        "ts",
        F.when(F.col("event_id") % 2 == 0, "REDACTION_START").otherwise("REDACTION_COMPLETE").alias("action"),
        T.audit_hash(F.col("event_type")).alias("doc_hash"),
        F.when(F.col("event_id") % 2 == 0, n).alias("n_entities"),
        F.when(F.col("event_id") % 2 == 1, n).alias("n_redactions"),
    )
    return records.select("event_id", A.audit_text().alias("line"))


@query
def doc_hash(spark, sf):
    return I.documents(spark, sf).select(
        "doc_id", T.audit_hash(F.col("text")).alias("audit_hash"), T.name_hash(F.col("text")).alias("name_hash")
    )


@query
def text_forms(spark, sf):
    t = F.col("text")
    return I.documents(spark, sf).select(
        "doc_id",
        collapse_ws(t).alias("collapsed"),
        T.norm_key(t).alias("norm_key"),
        T.escape_html(t).alias("html"),
        T.ellipsis(t, 25).alias("short_label"),
    )


# --- flagship ---------------------------------------------------------------------------------------


@query
def flagship(spark, sf):
    """E-mail and IP findings per source after the normalised dedup."""
    docs = I.table(spark, sf, "documents").select("doc_id", "source", "text")
    hits = S.scan_rules(docs, [r for r in R.COMMON_RULES if r.rule_id in ("C01", "C09")], ("doc_id", "source"))
    named = hits.select("doc_id", "source", "rule", "pos", F.col("match").alias("text"))
    unique = E.keep_first_normalized(named, ("doc_id", "source"), ("rule", "pos"), ("rule", "pos", "text"))
    return unique.groupBy("source", "rule").agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_distinct("doc_id").alias("n_docs")
    )
