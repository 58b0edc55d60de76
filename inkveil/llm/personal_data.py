"""Personal data and the terms that give it away.

E-mail addresses, IP addresses, card and phone numbers are found by patterns; they are the protected entities.
How much a term tells about an entity is estimated from the corpus: with counts of documents n(c), n(t), n(c,t)
(both anywhere in the text) and N, the pointwise mutual information PMI(c;t) = log n(c,t) N / (n(c) n(t)) is at most
the information IC(c) = log N / n(c) of the entity, and equal to it where the term never occurs without the entity.
A term whose PMI reaches GENERALISE of IC is generalised, from REMOVE of it removed, wherever it stands in the
documents that hold the entity. Two different texts must bear the evidence, so a copied document is none.

As n(c,t) is at most n(c), a term with n(t) > N^(1 - GENERALISE) n(c)^GENERALISE cannot reach the share, nor can a
term or an entity of one document have two texts: both are left out before terms meet entities, and nothing is lost.

DataFrame expressions only; texts are read twice (entities, document frequencies). Only texts that hold an entity
of several texts, their words, and partial counts are shuffled; a frequent term or entity is pre-aggregated.
Positions are code points.

Defined results: a null text is empty; entities are compared by kind and exact text; rows equal in doc_id and text
get equal spans and count in N and in every n alike; words inside an entity count as words of the text, but no term
is marked that overlaps an entity; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import keyed, let, stored, text_key, unpacked

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
GENERALISE, REMOVE = 0.8, 0.95
MIN_TEXTS = 2
# Runs are entered at their start (or where the last match ended) and never given back, so long runs stay linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_WORD = r"\p{L}{3,}+"
_BLOCK = 64


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches.

    The gaps between them come from a split. Running sums are taken over blocks, so no array is copied once per match.
    """
    def placed(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda v, i: F.length(F.get(gaps, i)) + F.length(v))

        def with_sums(s: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int"))
            add = lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + _sum(F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK)))))
            offsets = F.aggregate(blocks, F.array(F.lit(0)), add)

            def rows(o: Column) -> Column:
                def row(v: Column, i: Column) -> Column:
                    b = F.floor(i / _BLOCK).cast("int")
                    start = F.get(o, b) + _sum(F.slice(s, b * _BLOCK + 1, i - b * _BLOCK)) + F.length(F.get(gaps, i))
                    return F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"))

                return F.transform(found, row)

            return let(offsets, rows)

        return let(steps, with_sums)

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda g: placed(f, g))))


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        return F.when((F.length(digits) - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return _sum(F.transform(F.sequence(F.lit(1), F.length(digits)), value)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _entities(text: Column) -> Column:
    """Array of (start, kind, end, value): all entities."""
    def of(number: int, kind: str) -> Column:
        hint = text.contains(HINTS[kind]) if HINTS[kind] else text.rlike("[0-9]")
        good = F.filter(matches(F.when(hint, text).otherwise(""), PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(
            m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"), m["value"].alias("value"),
        ))

    return F.concat(*[of(i, k) for i, k in enumerate(KINDS)])


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))
    return F.array_distinct(F.transform(found, lambda v: F.lower(v)))


def _reach(n_entity: Column, total: float) -> Column:
    """No term of more documents reaches GENERALISE with an entity of ``n_entity``; a little more, for rounding."""
    return F.pow(F.lit(total), F.lit(1 - GENERALISE)) * F.pow(n_entity.cast("double"), F.lit(GENERALISE)) * (1 + 1e-9)


def _holders(found: DataFrame, total: float) -> DataFrame:
    """(_doc, _key, kind, value, n, n_entity): documents and those of their entities that several texts hold; n: its rows."""
    distinct = F.array_distinct(F.transform("e", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))))
    each = found.where("size(e) > 0").select("_doc", "_key", F.explode(distinct).alias("c"))
    each = each.groupBy("_doc", "_key", "c.kind", "c.value").agg(F.count(F.lit(1)).alias("n"))
    per_text = each.groupBy("kind", "value", "_key").agg(F.sum("n").alias("n"))
    entities = per_text.groupBy("kind", "value").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("texts"))
    return each.join(entities.where((F.col("texts") >= MIN_TEXTS) & (F.col("n_entity") < total)).drop("texts"), ["kind", "value"])


def _together(holders: DataFrame, held: DataFrame, docs: DataFrame, total: float) -> DataFrame:
    """(_doc, _key, kind, value, term, n, n_entity, n_term): documents that hold both, where the term may tell enough."""
    most = holders.agg(F.max("n_entity")).first()[0] or 0
    words = docs.select(F.explode_outer(_terms(F.col("text"))).alias("term")).where("term is not null")
    frequency = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    rare = frequency.where((F.col("n_term") >= MIN_TEXTS) & (F.col("n_term") <= _reach(F.lit(most), total)))
    terms = held.select("_doc", "_key", F.explode_outer(_terms(F.col("text"))).alias("term")).where("term is not null").join(rare, "term")
    return terms.join(holders, ["_doc", "_key"]).where(F.col("n_term") <= _reach(F.col("n_entity"), total))


def disclosing(together: DataFrame, total: float) -> DataFrame:
    """(kind, value, term, removed): terms that tell too much about an entity."""
    pair = ["kind", "value", "term"]
    per_text = together.groupBy(*pair, "n_entity", "n_term", "_key").agg(F.sum("n").alias("n"))
    pairs = per_text.groupBy(*pair, "n_entity", "n_term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("texts"))
    share = F.log(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term"))) / F.log(total / F.col("n_entity"))
    known = pairs.where(F.col("texts") >= MIN_TEXTS).withColumn("share", share)
    return known.where(F.col("share") >= GENERALISE).select(*pair, (F.col("share") >= REMOVE).alias("removed"))


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, _key, base (start, kind, end) and terms (start, kind, end, removed), both sorted; a row per distinct document."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))  # only beside _key, the text: equal texts get equal spans
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("_key"))
    with_text = let(_entities(F.col("text")), lambda e: F.struct(e.alias("e"), F.when(F.size(e) > 0, F.col("text")).alias("text")))
    found = stored(rows.select("doc_id", "_key", with_text.alias("f")).select("doc_id", "_key", "f.*"), "pii-entities")
    named = found.withColumn("_doc", doc)
    total = float(docs.count())
    holders = stored(_holders(named, total), "pii-holders")
    texts = named.where("text is not null").select("_doc", "_key", "text")
    held = texts.join(holders.select("_doc", "_key"), ["_doc", "_key"], "left_semi").dropDuplicates(["_doc", "_key"])
    together = stored(_together(holders, held, docs, total), "pii-terms")
    telling = stored(disclosing(together, total), "pii-disclosing")
    told = together.join(telling, ["kind", "value", "term"]).groupBy("_doc", "_key", "term").agg(F.max("removed").alias("removed"))
    told = stored(told, "pii-told")
    placed = texts.join(told.select("_doc", "_key"), ["_doc", "_key"], "left_semi").dropDuplicates(["_doc", "_key"])
    placed = placed.select("_doc", "_key", F.explode_outer(matches(F.col("text"), _WORD)).alias("m")).where("m is not null")
    hits = placed.select("_doc", "_key", F.lower("m.value").alias("term"), "m.start", "m.end").join(told, ["_doc", "_key", "term"])
    span = F.struct("start", F.lit(TERM).alias("kind"), "end", "removed")
    # A document's own findings: never more than its text holds.
    per_document = hits.groupBy(F.col("_doc").alias("_d"), F.col("_key").alias("_k")).agg(F.sort_array(F.collect_list(span)).alias("terms"))
    base = F.sort_array(F.transform("e", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    out = named.select("doc_id", "_doc", "_key", base.alias("base")).dropDuplicates(["doc_id", "_key"])
    same = (F.col("_doc") == F.col("_d")) & (F.col("_key") == F.col("_k"))
    clear = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    return out.join(per_document, same, "left").select("doc_id", "_key", "base", F.filter("terms", clear).alias("terms"))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def span_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts per kind, base_sha256, spans, n_term: one row per row of ``docs``."""
    plain = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int,removed:boolean>>")), lambda t: F.struct(
        t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))
    count = lambda number: F.size(F.filter("base", lambda b: b["kind"] == number)).cast("long")
    told = findings(docs).select(
        F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.sort_array(F.concat("base", plain))).alias("spans"),
        F.size(plain).cast("long").alias("n_term"),
    )
    rows = docs.select("doc_id", text_key(F.col("text")).alias("_key"))
    return rows.join(told, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))).drop("_d", "_k", "_key")


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with entities replaced by their kind, telling terms generalised to [TERM] or removed."""
    told = findings(docs).select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "base", "terms")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])
    cover = lambda s, removed: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(removed, "").otherwise(F.get(names, s["kind"])).alias("by"))
    terms = F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int,removed:boolean>>"))
    marks = F.concat(F.transform("base", lambda s: cover(s, F.lit(False))), F.transform(terms, lambda s: cover(s, s["removed"])))
    rows = keyed(docs).join(told, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    text = F.col("_row.text")

    def rebuilt(s: Column) -> Column:
        # The text as an array of characters, so that every piece is cut without walking from the start.
        def pieces(c: Column) -> Column:
            def piece(x: Column, i: Column) -> Column:
                done = F.coalesce(F.get(s, i - 1)["end"], F.lit(0))
                gap = F.array_join(F.slice(c, done + 1, F.greatest(x["start"] - done, F.lit(0))), "")
                return F.concat(gap, F.when(x["start"] >= done, x["by"]).otherwise(""))

            rest = F.array_join(F.slice(c, F.element_at(s, -1)["end"] + 1, F.size(c)), "")
            return F.concat(F.array_join(F.transform(s, piece), ""), rest)

        return let(F.split(text, ""), pieces)

    new = F.when(F.size(marks) > 0, let(_apart(marks), rebuilt)).otherwise(text)
    return unpacked(rows, docs.columns, text=new)


def _apart(marks: Column) -> Column:
    """Sorted marks without those inside an earlier one; a mark that sticks out begins where the one before ends.

    The highest end so far is kept by blocks, so marks nest to any depth and no array is copied once per mark.
    """
    def outer(o: Column) -> Column:
        block = lambda b, n: F.coalesce(F.array_max(F.transform(F.slice(o, b * _BLOCK + 1, n), lambda y: y["end"])), F.lit(0))
        blocks = F.sequence(F.lit(0), F.floor((F.size(o) - 1) / _BLOCK).cast("int"))
        add = lambda a, b: F.concat(a, F.array(F.greatest(F.element_at(a, -1), block(b, F.lit(_BLOCK)))))

        def kept(highest: Column) -> Column:
            def sticks_out(x: Column, i: Column) -> Column:
                b = F.floor(i / _BLOCK).cast("int")
                return x["end"] > F.greatest(F.get(highest, b), block(b, i - b * _BLOCK))

            return F.filter(o, sticks_out)

        return let(F.aggregate(blocks, F.array(F.lit(0)), add), kept)

    return let(F.sort_array(marks), outer)
