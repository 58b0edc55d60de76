"""Rules and keywords searched a batch of texts at once: the same matches as one by one, and nothing searched twice."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkveil.catalog.dictionaries import COMMON_WORDS
from inkveil.catalog.rules import Rule
from inkveil.functions.dialect import WS, collapse_ws, java_regex, re2_search, strip_ws
from inkveil.operators import rule_table
from inkveil.operators import scan as S
from inkveil.operators.candidates import grams_held
from inkveil.operators.rule_table import scan_rule_table
from inkveil.plans.job import document_entities
from inkveil.queries.registry import EVERY_RULE


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def rules_of(*patterns):
    return [Rule(f"T{i}", p, ignore_case=i % 2 == 1, soft="LR") for i, p in enumerate(patterns)]


PATTERNS = (r"\bab\b", r"\bk+\s*s", r"[^a-c\s]+", r"a.c", r"(?:a|bc){1,2}?", r"x?[A-f]{2}", r"x|y\b", r"[\w.-]+@\d", r"\.\s+é", r"[\^&-]", "É")


def test_re2_reads_as_java(spark):
    rng = random.Random(3)
    parts = ["a", "b", "c", "K", "s", "S", " ", " ", "\n", "\r", " ", "é", "É", "K", "ſ", "@1", ".", "^", "&", "-", "F", "x", "y", "﷐", "\x01", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(400)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = rules_of(*PATTERNS, *PATTERNS[::-1])
    assert all(re2_search(r.pattern, r.ignore_case) for r in rules)
    got = {}
    for r in S.scan_rules(docs, rules).orderBy("doc_id", "rule", "pos").collect():
        got.setdefault((r.doc_id, r.rule), []).append(r.match)
    one_by_one = docs.select("doc_id", *[F.regexp_extract_all("text", F.lit(java_regex(r.pattern, r.ignore_case)), F.lit(0)).alias(r.rule_id) for r in rules])
    want = {(row.doc_id, r.rule_id): row[r.rule_id] for row in one_by_one.collect() for r in rules if row[r.rule_id]}
    wrong = {k: (got.get(k), want.get(k)) for k in {*got, *want} if got.get(k) != want.get(k)}
    assert not wrong, [(texts[k[0]], rules[int(k[1][1:])].pattern, v) for k, v in list(wrong.items())[:5]]
    counts = {r.rule: (r.n_matches, r.n_docs) for r in S.count_rules(docs, rules).collect()}
    assert counts == {r.rule_id: (sum(len(v) for k, v in want.items() if k[1] == r.rule_id), sum(k[1] == r.rule_id for k in want)) for r in rules if any(k[1] == r.rule_id for k in want)}


@pytest.mark.parametrize("pattern", ["a*", r"\b(?:x)?", "a(?=b)", "x*+", "[a[b]]", "[a&&b]", "a$", "^a", r"\Sx", r"(a)\1", "x{1001}", r"[a-\d]", "(?i)a"])
def test_other_syntax_is_left_to_java(spark, pattern):
    assert re2_search(pattern) is None


def test_rules_of_a_table_are_searched_in_batches(spark):
    """No expression of its own for each rule and text; those that RE2 reads otherwise keep theirs."""
    docs = spark.createDataFrame([(1, "Ab ab abc"), (2, "b"), (3, None)], "doc_id long, text string")
    rules = spark.createDataFrame([("R", r"\bab\b", True, 0), ("S", "a(b)", False, 1)], "rule string, pattern string, ignore_case boolean, group_no int")
    both = rules.union(spark.createDataFrame([("L", "b(?=c)", False, 0)], rules.schema))
    got = scan_rule_table(docs, rules)
    assert "regexp_extract_all" not in plan(got) and plan(scan_rule_table(docs, both)).count("regexp_extract_all") == 1
    want = [(1, "R", 1, "Ab"), (1, "R", 2, "ab"), (1, "S", 1, "b"), (1, "S", 2, "b")]
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, scan_rule_table(docs, both).collect())) == [(1, "L", 1, "b"), *want]


def test_counts_of_rules_are_searched_in_batches(spark):
    docs = spark.createDataFrame([(1, "12345 a@b.cd"), (2, "54321")], "doc_id long, text string")
    counts = S.count_rules(docs, EVERY_RULE)
    assert "regexp_extract_all" not in plan(counts)
    assert {r.rule: (r.n_matches, r.n_docs) for r in counts.collect() if r.rule in ("M08", "C13", "A01")} == {"M08": (2, 2), "C13": (2, 2), "A01": (1, 1)}


def test_keywords_are_walked_in_batches(spark):
    """One walk over a batch of texts, values included: no expression searches for them text by text."""
    docs = spark.createDataFrame([(1, "Account: 12345678, ok"), (2, "routing number = x1\ny"), (3, None)], "doc_id long, text string")
    found = S.scan_keyword_windows(docs, ["bank-statement"])
    assert "regexp_extract" not in plan(found)
    assert [r.value for r in found.where("keyword = 'routing number'").collect()] == [None]
    assert "regexp_extract" not in plan(S.scan_pattern(docs, ["bank-statement"]))


def test_values_behind_keywords(spark):
    """As by the pattern that says what a value is, of whatever text stands behind the keyword."""
    rng = random.Random(8)
    parts = ["tax", "ax", "TAX id", ": ", "=", " ", "\n", ",", ";", "é", " ", "　", "x", "12", "\U0001f600", "word and more words, "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.v for r in docs.select("i", S.keyword_values(["tax", "tax id", "ax"]).alias("v")).collect()}
    space = "".join(c for c in map(chr, range(0x10000)) if re.match(r"[\t-\r    -     　﻿]", c))
    plain = re.compile(rf"[^:=\n]*[:=]?[{space}]*([^\n,;]{{2,50}})")
    for i, text in enumerate(texts):
        low, want = "".join(c.lower() if c.isascii() else c for c in text), []
        for k in ("tax", "tax id", "ax"):
            for at in (p for p in range(len(text)) if low.startswith(k, p)):
                m = plain.match(text[at : at + 100])
                value = m[1].strip(space) if m else ""
                if len(value) > 2 and value.lower() != k and value.lower() not in COMMON_WORDS:
                    want.append(value)
        assert got[i] == want, text


def test_white_space_forms(spark):
    rng = random.Random(9)
    parts = [" ", "  ", "\t", "\n", " ", " ", "﻿", "a", "é", "b c", "\U0001f600", "\x1c", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(500)] + [None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = F.regexp_replace(t, rf"^[{WS}]+|(?<![{WS}])[{WS}]++\z", ""), F.trim(F.regexp_replace(t, f"[{WS}]+", " "))
    for r in frame.select(strip_ws(t).alias("a"), collapse_ws(t).alias("b"), plain[0].alias("c"), plain[1].alias("d")).collect():
        assert (r.a, r.b) == (r.c, r.d)


def test_findings_of_a_document_are_grouped_once(spark):
    """Not first by page and then by document: the rows would be shuffled twice."""
    pages = [(1, 1, "Mail JO@x.org and jo@x.org"), (1, 2, "jo@x.org 12345"), (2, 1, "12345"), (1, None, "JO@X.org")]
    frame = spark.createDataFrame(pages, "doc_id long, page_no long, text string")
    got = document_entities(frame, "fast", ["bank-statement"])
    assert plan(got).count("aggregate [") == 1
    rows = got.collect()
    assert {(r.doc_id, r.text.lower()) for r in rows} == {(1, "jo@x.org"), (1, "x.org"), (1, "12345"), (1, "345"), (2, "12345"), (2, "345")}
    assert len(rows) == 6 and [r.text for r in rows if "@" in r.text] == ["JO@X.org"]


def test_pieces_held_are_those_of_each_text(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcé\U0001f600 ") for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for wanted in (["abc", "éa ", "\U0001f600bb", "aaa"], []):
        got = docs.select("i", grams_held(wanted)(F.col("t")).alias("h")).collect()
        for r in got:
            t = texts[r.i]
            assert (r.h is None) if t is None else sorted(r.h) == [n for n, w in enumerate(wanted) if w in t]


def test_led_rules_are_looked_up_without_a_regex(spark, monkeypatch):
    """The pieces of a text are not cut out one by one, neither to count them nor to look them up."""
    seen = []
    plain = rule_table.stored
    monkeypatch.setattr(rule_table, "stored", lambda df, name: (seen.append(plan(df)), plain(df, name))[1])
    docs = spark.createDataFrame([(1, "abc ÉABC"), (2, "ab"), (None, None)], "doc_id long, text string")
    rules = spark.createDataFrame([("R", "abc", True, 0), ("S", "éabc", True, 0), ("T", "xyz", False, 0)], "rule string, pattern string, ignore_case boolean, group_no int")
    got = scan_rule_table(docs, rules, planned=1)
    assert len(seen) == 1 and "generate explode(_pieces" in seen[0] and seen[0].count("regexp_extract_all") == 1
    assert sorted(map(tuple, got.collect())) == [(1, "R", 1, "abc"), (1, "R", 2, "ABC")]
