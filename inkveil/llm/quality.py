"""Quality rules: robust multivariate outliers among documents.

Per document, statistics are counted and turned into a vector of variance-stabilised shares. For every
language and source a minimum-covariance-determinant estimate is found: from medians and absolute
deviations, concentration steps repeatedly refit mean and covariance to the rows of smallest Mahalanobis
distance. Documents too far from their group's estimate are rejected.

Everything is DataFrame expressions. The texts are read once; the steps run over a stored table of a few
numbers per document. Each step is two aggregates with map-side partial results, so a language or source
holding most rows is no hot group; the estimates have one row per group.

Defined results: a null text has no words and fails the base rule; null languages and sources are groups of
their own; groups too small to estimate use their language's estimate, then that of all documents, and
when even those are too few only the base rule decides. An empty table gives an empty result. Rows equal
in doc_id and text get equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import let, stored, text_key, without, words

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SUBSET = 0.75  # share of a group's rows that carries its estimate
STEPS = 3
MIN_GROUP = 100  # rows below which a group is too small to estimate
MAX_DISTANCE = 28.0  # squared Mahalanobis distance; four normal dimensions exceed it once in 80,000 rows
VECTOR = ("x0", "x1", "x2", "x3")
# Spread per dimension that is always allowed for: the shares are zero in most documents, and without a
# floor the first repeated line would be infinitely far from the rest.
FLOORS = (0.05, 0.08, 0.12, 0.12)
_N = len(VECTOR)
_PAIRS = [(i, j) for i in range(_N) for j in range(i + 1)]
_LEVELS = ((True, True), (True, False), (False, False))  # by language and source, by language, all


def repeat_words(tokens: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text.

    Linear but for a sort, which only texts with a repeated window need.
    """
    windows = F.transform(F.sequence(F.lit(1), F.size(tokens) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(tokens, i, WINDOW)))
    return F.when(F.size(tokens) < WINDOW, F.lit(0)).otherwise(
        let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w)))
    )


def _covered(windows: Column) -> Column:
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def total(at: Column) -> Column:
        steps = F.transform(at, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - v, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, v: a + v)

    return let(let(ordered, repeated), total)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    text = F.coalesce("text", F.lit(""))
    tokens = words(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # One call binds the words for the two figures that need them.
    counted = let(
        tokens, lambda w: F.struct(F.size(w).alias("n"), let(F.transform(w, lambda x: F.xxhash64(x)), repeat_words).alias("r"))
    )
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return docs.select(
        "doc_id", "lang", "source", text_key(F.col("text")).alias("_key"), counted.alias("_w"), line_counts.alias("_l"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    ).select(
        "doc_id", "lang", "source", "_key", F.col("_w.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("_l.dup").cast("long").alias("n_dup_lines"), F.col("_w.r").cast("long").alias("n_repeat_words"),
        F.col("_l.n").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    """Word length on a log scale and square-rooted shares; constants damp the shares of short texts."""
    words_, lines_ = F.col("n_words") + 50.0, F.col("n_lines") + 5.0
    return [
        F.log((F.col("word_chars") + 250.0) / words_).alias("x0"),
        F.sqrt(F.col("n_symbols") / words_).alias("x1"),
        F.sqrt(F.col("n_dup_lines") / lines_).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / words_).alias("x3"),
    ]


def _consistency(share: float) -> float:
    """Factor that makes the covariance of the inner ``share`` of normal rows that of all (four dimensions)."""
    tail4 = lambda q: math.exp(-q / 2) * (1 + q / 2)
    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - tail4(mid) < share else (low, mid)
    return share / (1 - math.exp(-low / 2) * (1 + low / 2 + low * low / 8))


def _cholesky(covariance: dict[tuple[int, int], Column]) -> list[Column]:
    """Lower triangle of the root of a 4 x 4 covariance; floors on the diagonal keep it regular."""
    root: dict[tuple[int, int], Column] = {}
    for i, j in _PAIRS:
        rest = covariance[i, j] + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            rest = rest - root[i, k] * root[j, k]
        root[i, j] = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / root[j, j]
    return [root[i, j].alias(f"l{i}{j}") for i, j in _PAIRS]


def _distance() -> Column:
    """Squared Mahalanobis distance of x from m under the root l, by forward substitution."""
    solved: list[Column] = []
    for i in range(_N):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * solved[k]
        solved.append(rest / F.col(f"l{i}{i}"))
    return sum((s * s for s in solved[1:]), solved[0] * solved[0])


def _with_estimate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    e = estimates.withColumnsRenamed({"level": "_level", "lang": "_lang", "source": "_source", "n": "_n"})
    same = F.col("level").eqNullSafe(F.col("_level")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(e, same).drop("_level", "_lang", "_source", "_n")


def estimates(rows: DataFrame) -> DataFrame:
    """Mean ``m*`` and covariance root ``l*`` for each language and source, each language, and all rows."""
    levels = F.array(*[
        F.struct(F.lit(i).alias("level"), (F.col("lang") if by_lang else F.lit(None).cast("string")).alias("lang"),
                 (F.col("source") if by_source else F.lit(None).cast("string")).alias("source"))
        for i, (by_lang, by_source) in enumerate(_LEVELS)
    ])
    rows = rows.select(F.explode(levels).alias("_g"), *VECTOR).select("_g.*", *VECTOR)
    group = ["level", "lang", "source"]
    centre = stored(
        rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(VECTOR)])
        .where(F.col("n") >= MIN_GROUP),
        "quality-centre",
    )
    spread = _with_estimate(rows, centre).groupBy(*group).agg(
        *[F.max(f"m{i}").alias(f"m{i}") for i in range(_N)],
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i, x in enumerate(VECTOR)],
    )
    diagonal = {(i, j): (F.col(f"s{i}") * 1.4826) ** 2 if i == j else F.lit(0.0) for i, j in _PAIRS}
    now = stored(spread.select(*group, *[f"m{i}" for i in range(_N)], *_cholesky(diagonal)), "quality-spread")
    factor = _consistency(SUBSET)
    for _ in range(STEPS):
        far = _with_estimate(rows, now).select(*group, *VECTOR, _distance().alias("d"))
        cut = stored(far.groupBy(*group).agg(F.percentile_approx("d", SUBSET, 1000).alias("m_cut")), "quality-cut")
        inner = _with_estimate(far, cut).where("d <= m_cut")
        fit = inner.groupBy(*group).agg(
            *[F.avg(x).alias(f"m{i}") for i, x in enumerate(VECTOR)],
            *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i, j in _PAIRS],
        )
        covariance = {(i, j): F.col(f"c{i}{j}") * factor for i, j in _PAIRS}
        now = stored(fit.select(*group, *[f"m{i}" for i in range(_N)], *_cholesky(covariance)), "quality-step")
    return now


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``distance`` (null without an estimate) and ``kept``; one row per input row."""
    counts = stored(statistics(docs).select("*", base_failed().alias("base_failed"), *vector()), "quality-counts")
    found = estimates(counts.where("not base_failed"))
    judged = counts
    for i, (by_lang, by_source) in enumerate(_LEVELS):
        e = found.where(F.col("level") == i).withColumnsRenamed({"lang": "_lang", "source": "_source"})
        same = [F.col(a).eqNullSafe(F.col(f"_{a}")) for a, by in (("lang", by_lang), ("source", by_source)) if by]
        joined = judged.join(e, same, "left") if same else judged.join(F.broadcast(e), F.lit(True), "left")
        judged = joined.select(*judged.columns, F.when(F.col("level").isNotNull(), _distance()).alias(f"_d{i}"))
    distance = F.coalesce(*[f"_d{i}" for i in range(len(_LEVELS))])
    return judged.select(
        "doc_id", "_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= MAX_DISTANCE)).alias("kept"), distance.alias("distance"),
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with their columns."""
    return without(docs, judge(docs).where("not kept"))
