"""Operators against worked examples and brute force."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkveil.functions import text as T
from inkveil.functions import spans as SP
from inkveil.functions.dialect import any_case, collapse_ws, fold, strip_ws
from inkveil.operators import entities as E
from inkveil.operators import mask as M
from inkveil.operators import review as R
from inkveil.operators import scan as S
from inkveil.operators.candidates import candidates
from inkveil.operators import chunks as C
from inkveil.operators import rule_table
from inkveil.operators.ner import merge_tokens, tag_chunks, tag_documents
from inkveil.operators.sequence import number_rows
from inkveil.plans import scan as P
from inkveil.plans.redaction import redact_documents
from inkveil.queries.inputs import tag_words


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


# --- tagger tokens ------------------------------------------------------------------------------------

TOKENS = "doc_id long, idx int, entity string, word string, score double"


def brute_merge(tokens):
    out, cur = [], None
    for _, _, entity, word, score in tokens:
        if score < 0.5 or entity == "O":
            continue
        kind, piece = entity.split("-", 1)[1], word.removeprefix("##")
        if entity.startswith("B-") or cur is None or cur[1] != kind:
            cur = [piece, kind, score]
            out.append(cur)
        else:
            cur[0] += piece if word.startswith("##") else " " + piece
            cur[2] = max(cur[2], score)
    return sorted(tuple(e) for e in out if len(e[0]) > 1)


def test_merge_example(spark):
    rows = [(1, 0, "B-PER", "Jo", 0.9), (1, 1, "I-PER", "##hn", 0.8), (1, 2, "O", "and", 0.9),
            (1, 3, "I-PER", "Lee", 0.95), (1, 4, "B-LOC", "Rome", 0.7)]
    got = merge_tokens(spark.createDataFrame(rows, TOKENS)).orderBy("seq").collect()
    assert [(r.text, r.type, r.score) for r in got] == [("John Lee", "PER", 0.95), ("Rome", "LOC", 0.7)]


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_merge_across_buckets(spark, bucket):
    rng = random.Random(bucket)
    rows = [(1, i, rng.choice(["B-PER", "I-PER", "I-PER", "I-LOC", "O"]), rng.choice(["Ab", "##cd", "E", "Fgh"]),
             rng.choice([0.3, 0.6, 0.9])) for i in range(200)]
    got = merge_tokens(spark.createDataFrame(rows, TOKENS).repartition(5), bucket=bucket).collect()
    assert sorted((r.text, r.type, r.score) for r in got) == brute_merge(rows)


def test_tagger_plug_in(spark):
    def tagger(batches):
        import pandas as pd

        for docs in batches:
            rows = [(d, i, "B-PER" if w[0].isupper() else "O", w, 0.9)
                    for d, t in zip(docs.doc_id, docs.text) for i, w in enumerate(t.split())]
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "entity", "word", "score"])

    docs = spark.createDataFrame([(1, "then Ann met Bo")], "doc_id long, text string")
    assert sorted(r.text for r in merge_tokens(tag_documents(docs, tagger)).collect()) == ["Ann", "Bo"]


# --- order-dependent helpers --------------------------------------------------------------------------


def test_number_rows_equals_plain_numbering(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.choice([0.5, 0.9, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ord long, score double").repartition(4)
    score = F.coalesce("score", F.lit(0.0))
    got = number_rows(df, ["k"], [score.desc(), F.col("ord")], "n", "total").collect()
    for k in "ab":
        want = sorted((r for r in rows if r[0] == k), key=lambda r: (-(r[2] or 0), r[1]))
        assert [r.ord for r in sorted((g for g in got if g.k == k), key=lambda g: g.n)] == [r[1] for r in want]
        assert {g.total for g in got if g.k == k} == {len(want)}


def test_dedup_normalized(spark):
    rows = [(1, 0, 0, i, t, 0.9, "x", "y") for i, t in enumerate(["L PINTO", "l  pinto", "Ab", "Zed"])]
    df = spark.createDataFrame(rows, "doc_id long, family int, seq long, pos long, text string, score double, type string, source string")
    once = E.keep_first_normalized(df)
    assert sorted(r.text for r in once.collect()) == ["L PINTO", "Zed"]
    assert E.keep_first_normalized(once).count() == 2
    assert sorted(r.text for r in E.keep_first_normalized(df.repartition(3)).collect()) == ["L PINTO", "Zed"]


def test_fast_cleanup(spark):
    rows = [(1, 0, 0, i, t, 0.9, "x", "y") for i, t in enumerate(["12345", "1", "a1", "a1 "])]
    df = spark.createDataFrame(rows, "doc_id long, family int, seq long, pos long, text string, score double, type string, source string")
    assert [r.text for r in E.keep_first_text(E.drop_trivial(df)).collect()] == ["a1"]


def test_list_and_report_pages(spark):
    df = spark.range(155).select(F.lit(1).alias("doc_id"), F.col("id").alias("ord"), F.lit("t").alias("text"), F.lit(0.9).alias("score"))
    pages = E.paginate(df)
    assert pages.agg(F.max("page")).first()[0] == 10
    assert E.page_slice(pages, 2).select("label").distinct().first()[0] == "18-34 of 155"
    lines = E.report_lines(df.where("ord < 60")).groupBy("report_page").count().orderBy("report_page").collect()
    assert [r["count"] for r in lines] == [26, 32, 2]


def test_manual_list(spark):
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, seq long, text string")
    new = spark.createDataFrame([(1, 0, "b"), (1, 1, "c")], "doc_id long, seq long, text string")
    assert sorted(r.text for r in E.add_manual(old, new).collect()) == ["a", "b", "c"]
    assert [r.text for r in E.undo_manual(old).collect()] == ["a"]


def test_search(spark):
    df = spark.createDataFrame([("Ann [x]",), ("bob",)], "text string")
    assert E.search(df, "[X]").count() == 1
    assert E.search(df, "  ").count() == 2


def test_confidence(spark):
    df = spark.createDataFrame([(0.95, "bert"), (0.85, "regex"), (0.5, "manual"), (None, "ai")], "score double, source string")
    assert [(r.band, r.percent, r.label) for r in E.with_confidence(df).collect()] == [
        ("high", 95, "model"), ("medium", 85, "rule"), ("low", 50, "manual"), ("low", None, "other")]


# --- keywords and replies -----------------------------------------------------------------------------


def values(spark, text, *keywords):
    docs = S.with_gates(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    return docs.select(S.keyword_values(keywords)).first()[0]


def test_keyword_values(spark):
    assert values(spark, "account name\nJohn Smith", "account name") == ["John Smith"]
    assert values(spark, "account name is John Smith, x", "account name") == []
    assert values(spark, "Patient: Ann Lee; x", "patient") == ["Ann Lee"]
    assert values(spark, "Balance = total", "balance") == []


def test_windows_overlap(spark):
    docs = S.with_gates(spark.createDataFrame([(1, "xANANAx")], "doc_id long, text string"))
    assert docs.select(S.keyword_hits(["ana"])).first()[0][0].windows == ["ANANAx", "ANAx"]
    long = S.with_gates(spark.createDataFrame([(1, "tax" + "é" * 300)], "doc_id long, text string"))
    assert [len(w) for w in long.select(S.keyword_hits(["tax"])).first()[0][0].windows] == [100]


def test_custom_keywords(spark):
    docs = S.with_gates(spark.createDataFrame([(1, "A+b a+B aab ÉLAN élan")], "doc_id long, text string"))
    assert docs.select(S.custom_hits(["a+b", " ", "élan"])).first()[0] == ["A+b", "a+B", "ÉLAN", "élan"]


def test_reply(spark):
    reply = F.lit("- John, 1. 42 Wood Ln\nNONE\nName:\n\"Q x\"\nno idea")
    assert one(spark, T.parse_reply(reply)) == ["John", "42 Wood Ln", "Q x"]
    assert one(spark, T.reply_says_nothing(F.lit(" NONE ")))
    assert one(spark, T.reply_says_nothing(F.lit("I see no PII here")))


# --- scans --------------------------------------------------------------------------------------------


def test_pattern_scan_order_and_subset(spark):
    docs = spark.createDataFrame([(1, "Mail a@b.io, REF: ABC123XYZ, account name: Ann Lee")], "doc_id long, text string")
    few = [r.text for r in S.scan_pattern(docs, ["bank-statement"]).orderBy("ord").collect()]
    every = [r.text for r in S.scan_pattern(docs, ["bank-statement", "medical-record", "nope"]).collect()]
    assert few[0] == "a@b.io" and "REF: ABC123XYZ" in few and "Ann Lee" in few
    assert set(few) <= set(every)
    assert S.scan_pattern(docs).count() == 0
    assert S.scan_pattern(docs, ["nope"]).count() > 0


def test_modes(spark):
    docs = spark.createDataFrame(
        [(1, "Signed: Ann Lee, ann@x.org", "Ann Lee\nBob"), (2, "a@b.com", None), (3, "  ", "x")], "doc_id long, text string, reply string")
    deep = P.scan(docs, "deep").collect()
    assert {(r.doc_id, r.text, r.source) for r in deep} == {
        (1, "Ann Lee", "ai"), (1, "Bob", "ai"), (1, "ann@x.org", "ai"), (2, "a@b.com", "regex")}
    offline = P.scan(docs, "offline", doc_type="bank-statement").collect()
    assert {r.source for r in offline} == {"intel"} and {r.doc_id for r in offline} == {1, 2}
    with pytest.raises(ValueError):
        P.scan(docs, "other")


# --- masks --------------------------------------------------------------------------------------------


def arr(*texts):
    return F.array(*[F.lit(t) for t in texts])


def test_preview_mask(spark):
    assert one(spark, M.mask_preview(F.lit("abcde AB"), arr("bcde", "ab"))) == "a████ ██"
    assert one(spark, M.mask_preview(F.lit("x" * 30), arr("x" * 30))) == "█" * 20


def test_spans_and_blackout(spark):
    assert [tuple(s) for s in one(spark, M.match_spans(F.lit("aXbxx"), F.lit("x")))] == [(2, 3), (4, 5), (5, 6)]
    spans = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in [(8, 9), (1, 4), (3, 6)]])
    assert [tuple(s) for s in one(spark, M.merge_spans(spans))] == [(1, 6), (8, 9)]
    assert one(spark, M.blackout(F.lit("abcdefghij"), M.merge_spans(spans))) == "█████fg█ij"


def brute_redact(text, targets):
    covered, n, low = set(), 0, text.lower()
    for t in targets:
        at = low.find(t.lower())
        while at >= 0:
            n += 1
            covered.update(range(at, at + len(t)))
            at = low.find(t.lower(), at + len(t))
    return "".join("█" if i in covered else c for i, c in enumerate(text)), n


@pytest.mark.parametrize("per_row", [1, 3, 1000])
def test_redact_pages_equals_brute_force(spark, monkeypatch, per_row):
    monkeypatch.setattr(M, "PAGES_PER_BUCKET", 2)
    monkeypatch.setattr(M.attach_targets, "__defaults__", (("target", "low"), "doc_id", "page_no", per_row))
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abÉé.") for _ in range(rng.randint(1, 4)))
    pages = [(d, p, " ".join(word() for _ in range(12))) for d in range(4) for p in range(5)]
    targets = {(d, word()) for d in range(3) for _ in range(6)} | {(0, "A  B"), (1, " ")}
    got = M.redact_pages(
        spark.createDataFrame(pages, "doc_id long, page_no long, text string"),
        spark.createDataFrame(sorted(targets), "doc_id long, text string"),
    )
    found = {(r.doc_id, r.page_no): (r.text, r.n_redactions) for r in got.collect()}
    for d, p, text in pages:
        mine = [" ".join(t.split()) for k, t in targets if k == d and t.strip()]
        assert found[d, p] == brute_redact(text, mine)
        assert len(found[d, p][0]) == len(text)
    leaks = M.verify_pages(got, spark.createDataFrame(sorted(targets), "doc_id long, text string"))
    assert leaks.agg(F.sum("n_leaks")).first()[0] == 0
    assert leaks.count() == len(pages)


def test_redaction_ignores_case_and_spacing(spark):
    pages = spark.createDataFrame([(1, 1, "Almeida almeida, L PINTO DOS")], "doc_id long, page_no long, text string")
    targets = spark.createDataFrame([(1, "ALMEIDA"), (1, "L  PINTO   DOS")], "doc_id long, text string")
    assert M.redact_pages(pages, targets).first().text == "███████ ███████, ███████████"


def test_highlight(spark):
    html = one(spark, M.highlight(F.lit("Ann <b> ann\nBo"), arr("ann"), arr("Bo", "<b>")))
    assert html == (
        '<mark class="text-highlight-auto">Ann</mark> <mark class="text-highlight-manual">&lt;b&gt;</mark> '
        '<mark class="text-highlight-auto">ann</mark><br><mark class="text-highlight-manual">Bo</mark>')


def test_item_flags(spark):
    items = spark.createDataFrame([(1, 1, i, s) for i, s in enumerate(["John", "Smithson", "ohn", "x", " "])],
                                  "doc_id long, page_no long, item_no int, str string")
    auto = spark.createDataFrame([(1, "john smith")], "doc_id long, text string")
    manual = spark.createDataFrame([(1, "X")], "doc_id long, text string")
    got = {r.item_no: r.label for r in M.highlight_items(items, auto, manual).collect()}
    # "x" lies in no detected entity; "Smithson" holds the word "smith"; "ohn" lies in the entity
    assert got == {0: "detected", 1: "detected", 2: "detected", 3: "manual", 4: None}


# --- text helpers -------------------------------------------------------------------------------------


def test_white_space(spark):
    assert one(spark, strip_ws(F.lit(" \t a b ﻿\n"))) == "a b"
    assert one(spark, collapse_ws(F.lit(" a  \n b "))) == "a b"
    assert one(spark, F.rlike(F.lit("x.y"), any_case(F.lit("X.Y"))))
    assert not one(spark, F.rlike(F.lit("xzy"), any_case(F.lit("x.y"))))


def test_target_list(spark):
    assert one(spark, T.parse_targets(F.lit(" a, ,b"))) == ["a", "b"]
    wire = T.join_targets(arr("$1,200.00", "Bob"))
    assert one(spark, T.parse_targets(wire)) == ["$1", "200.00", "Bob"]


def test_preview_cut(spark):
    assert one(spark, T.preview(F.lit("x" * 5001), F.lit("y" * 10))) == "y" * 10 + "..."
    assert one(spark, T.ellipsis(F.lit("abcdef"), 3)) == "abc..."


CASES = [("ΟΔΟΣΑ x", "ΟΔΟΣ", 1), ("ΟΔΟΣ", "οδος", 1), ("Straße", "STRAẞE", 1), ("İzmir ızmır", "izmir", 2), ("ſecret", "SECRET", 1), ("5 \u212a", "5 k", 1),
         ("straße 5", "strasse", 0), ("ﬁle", "file", 0), ("ǅ ǆ Ǆ", "ǆ", 3), ("\uffff\ufffe x", "X", 1), ("𐐀 𐐨", "𐐨", 2)]


def test_search_redaction_and_leak_check_agree_in_every_letter_case(spark):
    df = spark.createDataFrame([(i, t, x) for i, (t, x, _) in enumerate(CASES)], "i int, t string, x string")
    low, target = fold(F.col("t")), fold(F.col("x"))
    found = df.select("i", M.match_spans(F.col("t"), F.col("x")).alias("s"), M.readable(low, F.array(target)).alias("n")).orderBy("i").collect()
    assert [(len(r.s), r.n) for r in found] == [(n, n > 0) for _, _, n in CASES]
    pages = df.select(F.col("i").alias("doc_id"), F.lit(1).alias("page_no"), F.col("t").alias("text"))
    targets = df.select(F.col("i").alias("doc_id"), F.col("x").alias("text"))
    assert M.verify_pages(M.redact_pages(pages, targets), targets).agg(F.sum("n_leaks")).first()[0] == 0


def test_fold_is_one_code_point_for_one(spark):
    every = "".join(c for c in map(chr, range(1, 0x20000)) if not "\ud800" <= c <= "\udfff")
    got = spark.createDataFrame([(every,)], "t string").select(fold(F.col("t"))).first()[0]
    assert len(got) == len(every)
    for c, low in zip(every, got):
        if unicodedata.category(c) != "Cn":  # the engines may know different versions of the standard
            assert low == fold_plainly(c), hex(ord(c))


def fold_plainly(c):
    if c in "\uffff\ufffe":
        return "\ufdd0"
    upper = c.upper() if len(c.upper()) == 1 else c
    return "i" if upper == "İ" else upper.lower()


# --- spans --------------------------------------------------------------------------------------------


def array_of(values, kind="int"):
    return F.expr(f"cast(array({', '.join(map(str, values))}) as array<{kind}>)")


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 333])
def test_running_sums(spark, n):
    values = [random.Random(n).randint(0, 9) for _ in range(n)]
    assert one(spark, SP.running_sums(array_of(values))) == [sum(values[: i + 1]) for i in range(n)]


def test_merged_spans_and_text_put_together(spark):
    rng = random.Random(8)
    for size in (0, 1, 5, 200):
        spans = [(s, s + rng.randint(1, 12)) for s in (rng.randint(1, 2990) for _ in range(size))]
        text = "".join(rng.choice("ab é𝄞\n") for _ in range(3002))
        covered = {i for s, e in spans for i in range(s, e)} | {0}
        array = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in spans]) if spans else F.expr(SP.NO_SPANS)
        merged = one(spark, SP.merge_spans(array))
        # touching spans are merged as well
        assert [(m.s, m.e) for m in merged] == [
            (s, next(e for e in range(s, 4000) if e not in covered)) for s in sorted(covered - {0}) if s - 1 not in covered or s == 1 and s in covered]
        done = one(spark, SP.blackout(F.lit(text), SP.merge_spans(array)))
        assert done == "".join("█" if i + 1 in covered else c for i, c in enumerate(text))


def test_a_megabyte_with_a_hundred_thousand_hits(spark):
    text = "secret   é" * 100_000
    df = spark.createDataFrame([(1, text, ["SECRET", "nothing"])], "doc_id int, text string, targets array<string>")
    r = redact_documents(df).first()
    assert r.n_redactions == 100_000 and r.redacted == text.replace("secret", "█" * 6)


def highlight_plainly(text, auto, manual):
    """Longest target first, its hits from the left in what is still free."""
    kind = {}
    rest = text.lower()
    lows = {m.lower() for m in manual}
    for t in sorted([t.lower() for t in auto + manual], key=len, reverse=True):
        at = rest.find(t)
        while t and at >= 0:
            kind[at] = (at + len(t), "manual" if t in lows else "auto")
            rest = rest[:at] + "\0" * len(t) + rest[at + len(t) :]
            at = rest.find(t)
    out, at = [], 0
    esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    for s, (e, k) in sorted(kind.items()):
        out += [esc(text[at:s]), f'<mark class="text-highlight-{k}">', esc(text[s:e]), "</mark>"]
        at = e
    return ("".join(out) + esc(text[at:])).replace("\n", "<br>")


def test_highlight_takes_the_longest_first(spark):
    assert highlight_plainly("abcde", ["bcde"], ["abc"]) == 'a<mark class="text-highlight-auto">bcde</mark>'
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abB<&") for _ in range(rng.randint(1, n)))
    rows = [(i, word(40) + "\n" + word(9), [word(4) for _ in range(4)], [word(4) for _ in range(2)]) for i in range(200)]
    rows += [(200, "abcde", ["bcde"], ["abc"]), (201, "Ann ann", ["ann"], ["ANN"]), (202, "", ["a"], []), (203, "none", [], []), (204, "a a", ["", "a"], [""])]
    df = spark.createDataFrame(rows, "i int, t string, a array<string>, m array<string>")
    got = {r.i: r.h for r in df.select("i", M.highlight(F.col("t"), F.col("a"), F.col("m")).alias("h")).collect()}
    assert got == {i: highlight_plainly(t, a, m) for i, t, a, m in rows}


# --- candidates ---------------------------------------------------------------------------------------


def test_candidates_hold_every_containment(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé 𝄞") for _ in range(rng.randint(1, n)))
    texts = [(d, i, word(30)) for d in range(3) for i in range(60)]
    patterns = sorted({(d, word(5)) for d in range(4) for _ in range(40)})
    got = candidates(
        spark.createDataFrame(texts, "doc_id int, page_no int, low string"), spark.createDataFrame(patterns, "doc_id int, low string"),
        ("doc_id",), ("page_no",), ("low",)).collect()
    pairs = {(r.doc_id, r.page_no, r.low) for r in got}
    assert len(pairs) == len(got)
    held = {(d, i, p) for d, i, t in texts for k, p in patterns if k == d and p in t}
    assert held <= pairs and len(pairs) < 0.5 * sum(k == d for d, _, _ in texts for k, _ in patterns)


@pytest.mark.parametrize("per_row", [2, 1000])
def test_item_flags_either_way(spark, per_row):
    rng = random.Random(6)
    word = lambda n=4: "".join(rng.choice("abcA") for _ in range(rng.randint(1, n)))
    items = [(d, p, i, rng.choice([word(), word(), word() + " " + word(), " "])) for d in range(3) for p in range(3) for i in range(20)]
    auto = [(d, f"{word(6)} {word(6)}") for d in range(3) for _ in range(4)] + [(0, " ")]
    manual = [(d, word(6)) for d in range(2) for _ in range(3)]

    def touches(low, entities):
        return low != "" and any(low in t or any(w in low for w in t.split()) for t in entities)

    want = {}
    for d, p, i, s in items:
        low = s.strip().lower()
        want[d, p, i] = tuple(touches(low, [t.lower() for k, t in side if k == d and t.strip()]) for side in (manual, auto))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = M.highlight_items(spark.createDataFrame(items, "doc_id long, page_no long, item_no int, str string"), frame(auto), frame(manual), per_row)
    assert {(r.doc_id, r.page_no, r.item_no): (r.is_manual, r.is_detected) for r in got.collect()} == want


# --- the manual list ----------------------------------------------------------------------------------


def test_undo_takes_back_the_last_batch_first(spark):
    old = spark.createDataFrame([(1, i, t) for i, t in enumerate("abc")], "doc_id int, seq int, text string")
    new = lambda t: spark.createDataFrame([(1, 0, t), (2, 0, t)], "doc_id int, seq int, text string")
    texts = lambda df: sorted(r.text for r in df.where("doc_id = 1").collect())
    both = E.add_manual(E.add_manual(old, new("d")), new("e"))
    once = E.undo_manual(both)
    assert texts(both) == list("abcde") and texts(once) == list("abcd") and texts(E.undo_manual(once)) == list("abc")


def replay_plainly(events):
    live = []
    for action, text in events:
        if action == "add" and text and text.strip() and text not in live:
            live.append(text)
        elif action == "undo" and live:
            live.pop()
        elif action == "remove" and text in live:
            live.remove(text)
        elif action == "clear":
            live = []
    return live


def test_review_log_equals_a_stack(spark):
    rng = random.Random(9)
    logs = {d: [(rng.choice(["add"] * 6 + ["undo", "undo", "remove", "clear" if (d or 0) % 3 == 0 else "add", "look"]), rng.choice(["a", "b", "c", "d e", " ", None]))
                for _ in range(rng.randint(1, 60))] for d in [None, *range(40)]}
    rows = [(d, n * 10**7, a, t) for d, log in logs.items() for n, (a, t) in enumerate(log)]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "doc_id long, seq long, action string, text string")
    got = R.review_log(events).orderBy("doc_id", "n").collect()
    for d, log in logs.items():
        mine = [r for r in got if r.doc_id == d]
        assert [r.text for r in mine] == replay_plainly(log) and [r.n for r in mine] == list(range(1, len(mine) + 1))
        assert [r.seq for r in mine] == sorted(r.seq for r in mine) and all(log[r.seq // 10**7] == ("add", r.text) for r in mine)
    assert R.review_log(events.limit(0)).count() == 0


def test_manual_entities_are_listed_and_counted(spark):
    auto = spark.createDataFrame([(1, 1, 0, 1, "a", 0.9, "x", "regex"), (1, 1, 0, 2, "b", 1.0, "x", "bert")],
                                 "doc_id int, page_no long, seq int, pos int, text string, score double, type string, source string")
    both = E.with_manual(auto, spark.createDataFrame([(1, 5, "m"), (2, 1, "n")], "doc_id int, seq int, text string"))
    listed = E.paginate(both, order=("part", "page_no", "seq", "pos")).orderBy("doc_id", "n").collect()
    assert [(r.text, r.source, r.label) for r in listed] == [
        ("b", "bert", "1-3 of 3"), ("m", "manual", "1-3 of 3"), ("a", "regex", "1-3 of 3"), ("n", "manual", "1-1 of 1")]
    lines = E.report_lines(both, order=("part", "page_no", "seq", "pos")).where("doc_id = 1").orderBy("line_no").collect()
    assert [r.line for r in lines] == ["1. a", "2. b", "3. m"]


def test_one_large_document_is_numbered_in_many_tasks(spark):
    df = spark.range(200_000).select(F.lit(1).alias("doc_id"), F.struct((F.col("id") * 10**7).alias("page"), F.lit(2000).alias("pos")).alias("ord"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would be one task
    try:
        got = number_rows(df.repartition(7), ["doc_id"], [F.col("ord")], "n", "total")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.where("n <> ord.page / 10000000 + 1 or total <> 200000").count() == 0
    assert len(set(got.inputFiles())) == 8  # as many ranges as partitions, though there is one document


# --- rules as a table ---------------------------------------------------------------------------------

RULE_ROWS = "rule string, pattern string, ignore_case boolean, group_no int"


def test_required_text():
    cases = {r"\bLicen[cs]ed?\s+under\b": "Licen", r"abc?d": "ab", r"ab|cdef": "", r"(?:foo)bar": "bar", r"a+bc": "bc", r"x{2}yz": "yz",
             r"\d{4}": "", r"a\.b\$c": "a.b$c", r"[abc]def[^]x]g": "def", r"lo*ng": "ng", r"(a|b)cd(e)?fgh": "fgh", "": "", r"ab+c": "ab", r"a\d+bcd*": "bc"}
    assert {p: rule_table.required_text(p) for p in cases} == cases


@pytest.mark.parametrize("planned", [1, 2, 256])
def test_rule_table(spark, planned):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcA1.") for _ in range(rng.randint(1, n)))
    patterns = ["(" + word(4), "[" + word(2), "*a", r"a(b)c", r"\d\d+", r"a[bc]+A", r"cab?c", r"(?:ab|ca)1"] + [word(4).replace(".", r"\.") for _ in range(12)]
    rows = [(f"R{i}", p, i % 2 == 0, 0) for i, p in enumerate(patterns)] + [("G", "a(b)c", False, 1), ("H", "abc", True, 3), (None, "a", True, 0), ("N", None, True, 0), ("D", "ab", True, None)]
    rules = spark.createDataFrame(rows, RULE_ROWS)
    texts = [(i, j, word(60)) for i in range(20) for j in range(2)] + [(99, 0, None), (99, 1, "")]
    docs = spark.createDataFrame(texts, "doc_id long, page_no long, text string")
    got = rule_table.scan_rule_table(docs, rules, ("doc_id", "page_no"), planned=planned).collect()
    want, bad = set(), set()
    for name, pattern, ignore, group in rows:
        try:
            plain = re.compile(pattern, re.IGNORECASE if ignore else 0)
            if name is None or (group or 0) > plain.groups:
                raise re.error("no")
        except (re.error, TypeError):
            bad.add((name, pattern))
            continue
        want |= {(d, p, name, k + 1, m[group or 0]) for d, p, t in texts for k, m in enumerate(plain.finditer(t or ""))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {(r.rule, r.pattern) for r in rule_table.rejected_rules(rules).collect()} == bad
    assert rule_table.scan_rule_table(docs, rules.limit(0)).count() == 0


def test_rule_table_is_no_corpus(spark, monkeypatch):
    monkeypatch.setattr(rule_table, "MAX_BYTES", 10)
    with pytest.raises(ValueError):
        rule_table.checked_rules(spark.createDataFrame([("A", "x" * 11, False, 0)], RULE_ROWS))


# --- chunks -------------------------------------------------------------------------------------------


def test_chunks_cover_the_text(spark):
    texts = ["", None, "a", "é𝄞" * 5, "x" * 16, "abcdefgh" * 4 + "i", "y" * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for size, overlap in ((10, 4), (10, 5), (8, 0)):
        rows = C.chunk_texts(df, size, overlap).collect()
        for d, t in enumerate(texts):
            mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.chunk_no)
            t = t or ""
            assert [r.chunk_no for r in mine] == list(range(len(mine))) and {r.n_chunks for r in mine} == {len(mine)}
            assert all(r.text == t[r.start : r.start + size] and r.start == r.chunk_no * (size - overlap) for r in mine)
            assert mine[-1].start + len(mine[-1].text) == len(t) and (len(mine) == 1 or len(mine[-1].text) > overlap)
    with pytest.raises(ValueError):
        C.chunk_texts(df, 10, 6)


def test_entities_of_chunks_are_those_of_the_text(spark):
    rng = random.Random(10)
    word = lambda: rng.choice([str.upper, str.lower, str.title])("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(0, 300)))) for i in range(10)], "doc_id long, text string")
    entities = lambda size, overlap: sorted(tuple(r) for r in merge_tokens(
        C.stitch_tokens(tag_chunks(C.chunk_texts(docs, size, overlap), tag_words), C.chunk_texts(docs, size, overlap), size, overlap)).collect())
    assert entities(100, 50) == entities(10**6, 0) != []


def test_replies_of_chunks(spark):
    rows = [(1, 0, "Ann\nBob"), (1, 1, "Bob\nCy"), (1, 2, "NONE"), (1, 3, None), (2, 0, "no pii")]
    got = C.stitch_replies(spark.createDataFrame(rows, "doc_id int, chunk_no int, reply string")).orderBy("chunk_no", "pos").collect()
    assert [(r.doc_id, r.chunk_no, r.text) for r in got] == [(1, 0, "Ann"), (1, 0, "Bob"), (1, 1, "Cy")]
