"""Inputs the given tables lack, derived from them.

``documents`` is prose with few digits. Orders are therefore also rendered as short business records, so
that every rule family meets text it applies to. The rendering is one SQL expression that Spark and an
ANSI engine read alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.catalog.rules import Rule
from inkveil.functions.dialect import collapse_ws, escape_literal
from inkveil.functions.text import let
from inkveil.operators.entities import drop_trivial, with_manual
from inkveil.operators.scan import fast_rule_findings
from inkveil.sources.files import spread

_YEAR = "cast(1950 + o_orderkey % 70 as string)"
_MONTH = "lpad(cast(1 + o_orderkey % 12 as string), 2, '0')"
_DAY = "lpad(cast(1 + o_orderkey % 28 as string), 2, '0')"
_ISO = f"{_YEAR} || '-' || {_MONTH} || '-' || {_DAY}"
_US = f"{_MONTH} || '/' || {_DAY} || '/' || {_YEAR}"
_C8 = "lpad(cast(o_custkey as string), 8, '0')"
_K4 = "lpad(cast(o_orderkey % 10000 as string), 4, '0')"
_K7 = "lpad(cast(o_orderkey * 7919 % 10000000 as string), 7, '0')"
_K9 = "lpad(cast(o_orderkey * 104729 % 1000000000 as string), 9, '0')"
_WHOLE = "cast(floor(o_totalprice) as bigint)"
_AMOUNT = (
    f"(case when {_WHOLE} >= 1000 then cast(cast(floor({_WHOLE} / 1000) as bigint) as string) || ',' || "
    f"lpad(cast({_WHOLE} % 1000 as string), 3, '0') else cast({_WHOLE} as string) end"
    " || '.' || lpad(cast(o_orderkey % 100 as string), 2, '0'))"
)
_NAME = (
    "case o_custkey % 5 when 0 then 'Jane Doe' when 1 then 'John Smith' when 2 then 'Maria Garcia Lopez' "
    "when 3 then 'Élodie Martin' else 'Anna Schäfer' end"
)

RECORD_TEXT = f"""case o_orderkey % 8
 when 0 then 'Account: ' || {_C8} || '12, sort code 12-34-' || {_DAY} || '. IBAN GB29NWBK' || {_K9} || '12345, SWIFT CHASUS33XXX. REF: TX' || {_C8} || '; balance: $' || {_AMOUNT} || ' CR. Check #: ' || {_K4} || ', wire FW' || {_K9} || '. Card 4111-1111-1111-' || {_K4} || '. Routing 021000021'
 when 1 then 'Patient: ' || {_NAME} || ', MRN: A' || {_C8} || '. DOB: ' || {_US} || '. NPI: 1' || {_K9} || '. ICD J45.' || {_DAY} || '; CPT: 99213; RX: ' || {_K9} || '. Phone (555) 123-' || {_K4} || '. Member ABC12-DE-' || {_K4}
 when 2 then 'Case No. 12-CV-' || {_K9} || '. Docket # ' || {_C8} || '. Bar No. ' || {_K4} || '. Hearing ' || {_US} || ' at 42 Wood Lane Court. Plaintiff: ' || {_NAME} || ' v. Smith, John A.'
 when 3 then 'Employee ID: EMP' || {_K4} || '9. Salary: $' || {_AMOUNT} || ' per year. EIN: 12-' || {_K7} || '. RATING: 4.5/5. Hire date: ' || {_US} || '. Emergency contact Mary Jones. Name: ' || {_NAME}
 when 4 then 'Passport: AB' || {_K7} || '. SSN 123-45-' || {_K4} || '. Identity: NI' || {_K7} || '. DL: A' || {_K7} || '. Address: 12 High Wood Street, London SW1A 1AA or M5V 3A8, zip 90210-' || {_K4} || '. VISA ' || {_K9} || '. From: Dr. ' || {_NAME}
 when 5 then 'Tax form 1099-INT and W-2; gross income = ' || {_AMOUNT} || ' USD. EIN 12 ' || {_K7} || '. SSN: 123 45 ' || {_K4} || '. acct# ' || {_K9} || '. Dividend £' || {_AMOUNT} || ' and €1.234,56'
 when 6 then 'Policy AB-' || {_K9} || ', Claim ' || {_K4} || ', GRP-12345, member ' || {_C8} || '. Premium: $' || {_AMOUNT} || '. Effective date: ' || {_ISO} || '. Signed: ' || {_NAME} || ', January 5, ' || {_YEAR}
 else 'Mail user' || {_C8} || '@mail.example.com or see http://www.example.com/p?q=' || {_K4} || ' host 10.0.' || cast(o_orderkey % 256 as string) || '.7, 2001:0db8:85a3:0000:0000:8a2e:0370:' || {_K4} || ', MAC 00:1A:2B:3C:4D:5E, wallet 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa, VIN 1HGBH41JXMN' || lpad(cast(o_orderkey % 1000000 as string), 6, '0') || ', plate AB 12 c, call +1-555-123-' || {_K4} || ' é' || {_K9}
end"""

REPLY_TEXT = """case page_no % 5 when 3 then 'NONE' when 4 then null
 else '- ' || replace(text, '. ', chr(10) || '1. ') end"""

# Rules a caller might bring along; boundaries are tested both ways unless told otherwise.
CALLER_RULES = (
    Rule("U1", r"\b[0-9a-f]{40}\b", soft="LR"),
    Rule("U2", r"\bLicen[cs]ed?\s+under\b", ignore_case=True, soft="LR"),
    Rule("U3", r"\bVersion\s+(\d+(?:\.\d+)?)", ignore_case=True, group=1, soft="LR"),
)
PLACE = ("page_no", "seq", "pos")
CUSTOM_KEYWORDS = ("wood", "Élodie", "  ", "a+b")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), 2_000)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf).select((-1 - F.col("o_orderkey")).alias("doc_id"), F.expr(RECORD_TEXT).alias("text"))


def all_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and business records as single-text documents."""
    return documents(spark, sf).unionByName(records(spark, sf))


def rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """Rules as a caller's table might hold them: two words of each benchmark item, and some that do not compile."""
    words = F.split("text", " ")
    quoted = lambda i: escape_literal(F.get(words, F.lit(i)))
    pattern = F.concat(quoted(2), F.lit(r"\s+"), quoted(3))
    items = table(spark, sf, "benchmark").where(F.size(words) > 3)
    good = items.select(F.concat(F.lit("W"), F.col("item_id").cast("string")).alias("rule"), pattern.alias("pattern"), (F.col("item_id") % 2 == 0).alias("ignore_case"))
    bad = table(spark, sf, "region").select(
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("rule"), F.concat(F.lit("("), F.col("r_name")).alias("pattern"), F.lit(True).alias("ignore_case")
    )
    fixed = spark.createDataFrame([(r.rule_id, r.pattern, r.ignore_case, r.group) for r in CALLER_RULES], "rule string, pattern string, ignore_case boolean, group_no int")
    return fixed.unionByName(good.unionByName(bad).withColumn("group_no", F.lit(0)))


def all_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with their turns as pages, and customers with their records as pages."""
    talk = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text")).select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), collapse_ws(F.col("text")).alias("text")
    )
    forms = orders(spark, sf).select(
        (-1 - F.col("o_custkey")).alias("doc_id"),
        F.col("o_orderkey").alias("page_no"),
        F.expr(RECORD_TEXT).alias("text"),
    )
    return talk.unionByName(forms)


def page_items(spark: SparkSession, sf: str) -> DataFrame:
    return all_pages(spark, sf).select(
        "doc_id", "page_no", F.posexplode(F.split("text", " ")).alias("item_no", "str")
    )


def longest_word(text: Column) -> Column:
    keyed = F.transform(
        F.split(collapse_ws(text), " "),
        lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")),
    )
    return F.array_min(keyed)["w"]


def manual_entities(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", F.col("page_no").alias("seq"), longest_word(F.col("text")).alias("text"))


def page_entities(pages: DataFrame) -> DataFrame:
    """An entity table of multi-page documents: doc_id, page_no, seq, pos, text, score, type, source."""
    found = drop_trivial(fast_rule_findings(pages, ("doc_id", "page_no")))
    return found.select("doc_id", *PLACE, "text", "score", "type", "source")


def entity_list(pages: DataFrame) -> DataFrame:
    """The same with the manual entities, and ``part`` before their place."""
    return with_manual(page_entities(pages), manual_entities(pages))


def review_events(pages: DataFrame) -> DataFrame:
    """What a reviewer might do page by page: mostly add its longest or its first word, now and then something else."""
    k = F.col("page_no") % 7
    action = F.when(k == 3, "undo").when(k == 5, "remove").when(F.col("page_no") % 11 == 10, "clear").otherwise("add")
    text = F.when(k % 2 == 0, longest_word(F.col("text"))).otherwise(F.element_at(F.split("text", " "), 1))
    return pages.select("doc_id", F.col("page_no").alias("seq"), action.alias("action"), text.alias("text"))


def tokens(pages: DataFrame) -> DataFrame:
    """Token predictions as a tagger would give them, from the capital letters of the words."""
    cap = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    words = let(
        F.split("text", " "),
        lambda ws: F.transform(
            ws,
            lambda w, i: F.struct(
                i.alias("i"),
                w.alias("w"),
                cap(F.substring(w, 1, 1)).alias("cap"),
                F.coalesce(cap(F.substring(F.get(ws, i - 1), 1, 1)), F.lit(False)).alias("after_cap"),
            ),
        ),
    )
    rows = pages.select("doc_id", "page_no", F.inline(words))
    kind = F.when(F.length("w") % 4 == 0, "LOC").otherwise("PER")
    head = (
        F.when(F.col("cap") & ~F.col("after_cap"), F.concat(F.lit("B-"), kind))
        .when(F.col("cap"), F.concat(F.lit("I-"), kind))
        .otherwise("O")
    )
    tail = F.when(F.col("cap"), F.concat(F.lit("I-"), kind)).otherwise("O")
    long_word = F.length("w") >= 8
    pieces = F.array(
        F.struct(
            (F.col("i") * 2).alias("idx"),
            head.alias("entity"),
            F.when(long_word, F.substring("w", 1, 4)).otherwise(F.col("w")).alias("word"),
        ),
        F.struct(
            (F.col("i") * 2 + 1).alias("idx"),
            tail.alias("entity"),
            F.when(long_word, F.concat(F.lit("##"), F.substring(F.col("w"), F.lit(5), F.length("w")))).alias("word"),
        ),
    )
    score = (F.length("w") * 37 % 100).cast("double") / 100
    return (
        rows.select("doc_id", "page_no", score.alias("score"), F.inline(pieces))
        .where(F.col("word").isNotNull())
        .select("doc_id", "page_no", "idx", "entity", "word", "score")
    )


def tag_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A tagger for :func:`tag_documents`: words with a capital letter, one behind the other, are names."""
    capital = lambda w: w[:1].upper() == w[:1] and w[:1].lower() != w[:1]
    for chunks in batches:
        rows = []
        for doc_id, chunk_no, text in zip(chunks["doc_id"], chunks["chunk_no"], chunks["text"]):
            at, after = 0, False
            for w in text.split(" "):
                if capital(w):
                    kind = "LOC" if len(w) % 4 == 0 else "PER"
                    rows.append((doc_id, chunk_no, at, ("I-" if after else "B-") + kind, w, len(w) * 37 % 100 / 100))
                after = capital(w)
                at += len(w) + 1
        yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "at", "entity", "word", "score"])


def replies(pages: DataFrame) -> DataFrame:
    return pages.withColumn("reply", F.expr(REPLY_TEXT))
