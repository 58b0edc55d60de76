"""Scalar and array column functions. All are built-in expressions; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.catalog.dictionaries import COMMON_WORDS
from inkveil.functions.dialect import WS, collapse_ws, strip_ws

BLOCK = "█"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside a lambda body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def norm_key(text: Column) -> Column:
    """Key under which two spellings of an entity count as one."""
    return F.lower(collapse_ws(text))


def is_common_word(text: Column) -> Column:
    return F.lower(strip_ws(text)).isin(*COMMON_WORDS)


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def ellipsis(text: Column, limit: int) -> Column:
    """The first ``limit`` characters, with dots when something was cut off."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def preview(original: Column, shown: Column, limit: int = 5000) -> Column:
    """Cut ``shown`` for display; the dots depend on the length of the original text."""
    dots = F.when(F.length(original) > limit, F.lit("...")).otherwise(F.lit(""))
    return F.concat(F.substring(shown, 1, limit), dots)


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.7, "medium").otherwise("low")


def confidence_percent(score: Column) -> Column:
    """Whole percent, halves up; NULL where there is no score to show."""
    return F.when(score != 0, F.floor(score * 100 + 0.5)).cast("bigint")


def source_label(source: Column) -> Column:
    return (
        F.when(source == "bert", "model")
        .when(source == "regex", "rule")
        .when(source == "heuristic", "heuristic")
        .when(source == "manual", "manual")
        .otherwise("other")
    )


def audit_hash(content: Column) -> Column:
    """Short content hash for audit records: the first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def name_hash(content: Column) -> Column:
    """Short content hash for file names: the first 8 hex digits of MD5."""
    return F.substring(F.md5(content), 1, 8)


def parse_targets(words: Column) -> Column:
    """Comma-separated target list to an array, blanks dropped."""
    return F.filter(F.transform(F.split(words, ","), strip_ws), lambda w: w != "")


def join_targets(targets: Column) -> Column:
    """Target array to the comma-separated form. Lossy: a target holding a comma comes back as two."""
    return F.array_join(targets, ",")


def longest_first(texts: Column) -> Column:
    """Longest text first; equal lengths keep their order."""
    keyed = F.transform(texts, lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda s: s["t"])


PROMPT_HEAD = """Task: list every piece of personal or sensitive information found in the text.

Look for:
1. people's names, in full or in part
2. phone and fax numbers, e-mail addresses
3. street addresses, towns, regions, postal codes, countries
4. identity, passport, licence, employee, patient and account numbers
5. card, bank and routing numbers, amounts of money with their context
6. dates tied to a person, such as birth, hiring or appointments
7. diagnoses, medicines, conditions and treatments
8. anything else that identifies somebody

Rules:
- copy each item exactly as written
- partial items count
- one item per line
- give bare values without labels or comments
- answer NONE if there is nothing

Text:
"""
PROMPT_TAIL = "\n\nItems:"


def extraction_prompt(text: Column, limit: int = 3000) -> Column:
    """Question put to an external language model about the head of a text."""
    return F.concat(F.lit(PROMPT_HEAD), F.substring(text, 1, limit), F.lit(PROMPT_TAIL))


def parse_reply(reply: Column) -> Column:
    """Items named in a model's free-text reply, as an array."""
    items = F.transform(F.split(strip_ws(reply), "[\n,]"), strip_ws)
    items = F.transform(items, lambda s: F.regexp_replace(s, rf"^[-•*\d.)\]]+[{WS}]*", ""))
    items = F.transform(items, lambda s: F.regexp_replace(s, r"""^["']|["']\z""", ""))
    return F.filter(
        items,
        lambda s: (F.length(s) > 1)
        & (s != "NONE")
        & ~F.contains(F.lower(s), F.lit("none found"))
        & ~F.startswith(F.lower(s), F.lit("no "))
        & ~s.rlike(rf"(?i)^[a-z{WS}]+:\z"),
    )


def reply_says_nothing(reply: Column) -> Column:
    low = F.lower(reply)
    return (
        (strip_ws(reply) == "NONE")
        | F.contains(low, F.lit("no pii"))
        | F.contains(low, F.lit("no sensitive"))
    )
