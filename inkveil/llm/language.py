"""Language identification by nearest centroids.

A text is a vector of hashed letter two- and three-grams, weighted by 1 + log count and inverse document
frequency and scaled to length one. Every language is described by several centroids, found by spherical k-means
on a bounded sample of its labelled texts; the text gets the language of the centroid of largest cosine. It is
rejected if it is farther from that centroid than nearly all of the centroid's own texts.

Document frequencies cover all training texts and are summed on Spark. The sample is at most about SAMPLE texts
a language, drawn by a hash of the text where the texts are read; centroids (languages x CLUSTERS x SIZE numbers) go to every task, which
reads whole texts in pieces.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected; so is every text when
there is nothing to learn from. A null doc_id counts as empty text in the fold rule. Rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 4096
CLUSTERS = 4
SAMPLE = 1000
LANGUAGES = 100_000
ROUNDS = 12
FOLDS = 5
OWN_SHARE = 0.002  # share of a centroid's own texts beyond its radius
PIECE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams; None without a letter."""
    if not text:
        return None
    total, some = np.zeros(SIZE), False
    for at in range(0, len(text), PIECE):
        raw = np.frombuffer(text[max(0, at - 2) : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        x = _letters()[raw].astype(np.uint64)
        some = some or bool((x != 32).any())
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
        x = np.concatenate([[np.uint64(32)], x[keep], [np.uint64(32)]])
        two = x[:-1] * np.uint64(0x110000) + x[1:]
        three = two[:-1] * np.uint64(0x110000) + x[2:]
        for g in (two, three):
            total += np.bincount(((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64), minlength=SIZE)
    return total if some else None


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return v / max(float(np.linalg.norm(v)), 1e-12)


def in_fold() -> Column:
    """Held out: the fold rule of doc_id."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, n = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for text in batch["text"]:
            g = grams(text)
            if g is not None:
                total += g > 0
                n += 1
    yield pd.DataFrame({"slot": np.arange(-1, SIZE), "n": np.concatenate([[n], total])})


def _clusters(idf: np.ndarray):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(d, g) for d, g in zip(group["draw"], map(grams, group["text"])) if g is not None]
        if not rows:
            return pd.DataFrame({"lang": [], "centroid": [], "radius": []})
        x = np.stack([weighted(g, idf) for _, g in sorted(rows, key=lambda r: r[0])])
        centres = x[np.linspace(0, len(x) - 1, min(CLUSTERS, len(x))).astype(int)]
        for _ in range(ROUNDS):
            nearest = (x @ centres.T).argmax(axis=1)
            sums = np.stack([x[nearest == k].sum(axis=0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        cosine = x @ centres.T
        nearest = cosine.argmax(axis=1)
        radius = [float(np.quantile(1 - cosine[nearest == k, k], 1 - OWN_SHARE)) if (nearest == k).any() else 0.0 for k in range(len(centres))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c.tolist() for c in centres], "radius": radius})

    return run


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language of each centroid, centroids, radii, idf) from text, lang."""
    rows = labelled.where("lang is not null and text is not null").select("text", "lang")
    counted = rows.mapInPandas(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = {r["slot"]: r["n"] for r in counted.collect()}  # SIZE + 1 rows
    n = found.get(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([found.get(i, 0) for i in range(SIZE)], float))) + 0.1
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    if sizes.count() <= LANGUAGES:  # so that no text is shuffled for it
        sizes = F.broadcast(sizes)
    # Drawn by the text, of which copies count once: no group of equal rows can enlarge a sample.
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    drawn = rows.join(sizes, "lang").where(draw < F.lit(SAMPLE * float(1 << 40)) / F.col("rows"))
    sample = drawn.groupBy("lang", draw.alias("draw")).agg(F.min("text").alias("text"))
    centres = sample.groupBy("lang").applyInPandas(_clusters(idf), "lang string, centroid array<double>, radius double")
    rows_ = sorted(centres.collect(), key=lambda r: (r["lang"], r["centroid"]))
    matrix = np.array([r["centroid"] for r in rows_]).reshape(len(rows_), SIZE)
    return [r["lang"] for r in rows_], matrix, np.array([r["radius"] for r in rows_]), idf


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, rejected; only ``text`` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, centres, radii, idf = shared.value
        for batch in batches:
            out = []
            for text in batch["text"]:
                g = grams(text)
                if g is None or not names:
                    out.append(("und", 0.0, True))
                    continue
                cosine = centres @ weighted(g, idf)
                k = int(cosine.argmax())
                out.append((names[k], float(np.clip(cosine[k], 0, 1)), bool(1 - cosine[k] > radii[k])))
            frame = pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])
            frame.insert(0, "doc_id", batch["doc_id"].array)
            yield frame

    # As text: pandas has no whole numbers beside nulls.
    named = docs.select(F.col("doc_id").cast("long").cast("string"), "text")
    return named.mapInPandas(run, "doc_id string, lang_pred string, score double, rejected boolean").withColumn("doc_id", F.col("doc_id").cast("long"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learned from the rows outside the fold, applied to all."""
    model = learn(docs.where(~in_fold()))
    return predicted(docs, model).select("doc_id", in_fold().alias("held_out"), "lang_pred", "score", "rejected")
