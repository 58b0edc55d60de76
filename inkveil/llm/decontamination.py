"""Benchmark decontamination with spaced seeds.

Fixed masks pick some of the words of every window and ignore the others, so two passages still meet where an
ignored word was replaced. The hashes of all windows of the benchmark are joined with those of all documents;
around every hit the words of document and item are laid over each other, and the best stretch is scored with
a gain for equal and a loss for different words.

DataFrame expressions only. The document side is narrow: the seeds of the benchmark are broadcast when a
count shows that they are few, and otherwise joined by a shuffle; both find the same. Only hits carry words
(a bounded stretch of them) further.

Defined results: null and wordless texts or items match nothing; an item with a null id counts like any other, and
items of equal ids and different texts are looked for one by one; items shorter than a mask are looked for as
a whole; repeated items and repeated rows give equal results; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import text_key, without, words

# 1: the word counts, 0: any word. Two masks of weight six that share few positions when shifted.
MASKS = ("11011011", "1101001101")
AROUND = 64  # words looked at on either side of a hit
GAIN, LOSS = 1, 2
MIN_SCORE = 10  # or, of items with fewer words, all but one replaced one; all of those shorter than a mask
BROADCAST_ROWS = 1_000_000  # seeds of 20 bytes

_SHORT = min(map(len, MASKS))
_LONG = max(map(len, MASKS))


def _hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def _seed(at: Column, hashes: Column, mask: str, number: int) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(hashes, at + k) for k, bit in enumerate(mask) if bit == "1"])


def _seeds(hashes: Column, masks: list[tuple[int, str]]) -> Column:
    """(at, seed) for every place and mask."""
    def of(mask: str, number: int) -> Column:
        last = F.size(hashes) - len(mask)
        places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("at"), _seed(i, hashes, mask, number).alias("seed")))

    return F.concat(*[of(m, n) for n, m in masks])


def benchmark_seeds(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[tuple[int, str]]]:
    """Items (item_id, item, ref), their seeds (ref, q, seed), and the masks in use.

    An item shorter than every mask is one seed of all its words; at most seven such lengths exist.
    """
    items = benchmark.select("item_id", _hashes(F.col("text")).alias("item")).where("size(item) > 0").distinct()
    # Names an item, null ids and ids of several texts too: structs of nulls are equal.
    items = items.withColumn("ref", F.struct("item_id", F.xxhash64("item").alias("h")))
    long = [(i, m) for i, m in enumerate(MASKS)]
    lengths = [r[0] for r in items.where(F.size("item") < _SHORT).select(F.size("item")).distinct().collect()]
    short = [(100 + n, "1" * n) for n in sorted(lengths)]
    of_long = items.where(F.size("item") >= _SHORT).select("ref", F.explode_outer(_seeds(F.col("item"), long)).alias("s"))
    seeds = of_long.select("ref", F.col("s.at").alias("q"), "s.seed")
    for number, mask in short:
        one = items.where(F.size("item") == len(mask)).select("ref", F.lit(0).alias("q"), _seed(F.lit(0), F.col("item"), mask, number).alias("seed"))
        seeds = seeds.union(one)
    return items, seeds.where("seed is not null"), long + short


def _score(window: Column, start: Column, item: Column, p: Column, q: Column) -> Column:
    """Best stretch on the diagonal of a hit: equal words gain, different ones lose, never below zero."""
    first = F.greatest(q - AROUND, F.lit(0), q - p)
    last = F.least(q + AROUND + _LONG, F.size(item), q - p + start + F.size(window)) - 1
    steps = F.transform(
        F.sequence(first, F.greatest(last, first)),
        lambda k: F.when(F.get(item, k) == F.get(window, p - q + k - start), F.lit(GAIN)).otherwise(F.lit(-LOSS)),
    )
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def add(a: Column, v: Column) -> Column:
        now = F.greatest(a["now"] + v, F.lit(0))
        return F.struct(now.alias("now"), F.greatest(a["best"], now).alias("best"))

    return F.aggregate(steps, zero, add)["best"]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, _key, item_id, item_words, score: every item that stands in a document."""
    items, seeds, masks = benchmark_seeds(benchmark)
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    hashed = docs.select("doc_id", text_key(F.col("text")).alias("_key"), _hashes(F.col("text")).alias("w"))
    placed = hashed.select("doc_id", "_key", "w", F.explode_outer(_seeds(F.col("w"), masks)).alias("s"))
    start = F.greatest(F.col("s.at") - AROUND, F.lit(0))
    hits = placed.join(seeds, F.col("s.seed") == F.col("seed")).select(
        "doc_id", "_key", "ref", "q", F.col("s.at").alias("p"), start.alias("start"),
        F.slice("w", start + 1, F.lit(2 * AROUND + _LONG)).alias("window"),
    )
    scored = hits.join(items, "ref").select(
        "doc_id", "_key", "item_id", F.size("item").cast("long").alias("item_words"),
        _score(F.col("window"), F.col("start"), F.col("item"), F.col("p"), F.col("q")).cast("long").alias("score"),
    )
    # One word of an item may be replaced, but of those too short for a mask.
    replaced = F.when(F.col("item_words") < _SHORT, F.col("item_words")).otherwise(F.col("item_words") - GAIN - LOSS)
    enough = scored.where(F.col("score") >= F.least(F.lit(MIN_SCORE), replaced))
    return enough.groupBy("doc_id", "_key", "item_id").agg(F.max("item_words").alias("item_words"), F.max("score").alias("score"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage."""
    return without(docs, overlaps(docs, benchmark))
