"""Removing repeated byte strings by longest-previous-factor values.

Every byte that a 100-byte string covers goes if the same string also starts earlier in the corpus. A position's
longest previous factor (LPF) says how far its suffix also starts earlier; in suffix order with ties by position
the previous smaller position of a later copy stands next to it. A suffix array of the whole corpus would pass
through one machine, so the suffixes that can match are brought together first, without losing one:

* Of any 69 consecutive 32-byte strings the one of smallest hash is an anchor. Every 100-byte string holds an
  anchor, at the same place in each of its copies.
* An anchor with its surroundings (the bytes that any 100-byte string around it can reach) that stands earlier
  with equal surroundings is repeated as a whole. This settles nearly all of a copied passage by one aggregate.
* The first occurrences of different surroundings of one anchor, at the edges of passages, are put in suffix
  order place by place, and LPF >= 100 marks what to remove. Anchors with very many different surroundings
  (a passage in a large share of all documents) are split into their 100-byte strings and settled by an
  aggregate over all tasks instead; the result is the same.

Defined results: null texts are empty; documents are in the order of doc_id (null lowest), then of a hash of the
text; rows equal in both are one document. Texts of any length; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import stored, text_key
from inkveil.llm.shingles import _BASE, _BYTE, _INVERSE, _powers, mixed

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # bytes before an anchor that a string around it can reach
IN_TASK = 20_000  # different surroundings of one anchor that one task orders
_LOWEST = -(1 << 63)
_PLACE = ["d", "k", "pos"]


class Bytes:
    """Hashes of any stretch of a text from prefix sums of a polynomial."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray) -> None:
        if len(Bytes.up) <= len(raw):
            n = 1 << (len(raw) + 1).bit_length()
            Bytes.up, Bytes.down = _powers(_BASE, n), _powers(_INVERSE, n)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * Bytes.up[: len(raw)], out=self.sums[1:])

    def hashes(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Bytes.down[: len(self.sums)][start])


def _sliding(values: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """``pick`` over each window of ``width`` values, from running picks of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, fill, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, hashes of the surroundings) of a text of at least LENGTH bytes."""
    sums, width = Bytes(raw), REACH + 1
    grams = sums.hashes(slice(0, len(raw) - GRAM + 1), slice(GRAM, len(raw) + 1))
    least = _sliding(grams, width, np.minimum, 2**64 - 1)
    # A string is an anchor if it is the least of some window: of the windows that hold it, the largest minimum.
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(_sliding(around, width, np.maximum, 0) == grams)
    left, right = np.minimum(at, REACH), np.minimum(len(raw) - at, LENGTH)
    context = mixed(sums.hashes(at - left, at + right) + (left * 1000 + right).astype(np.uint64), 3)
    return at, grams[at], context


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


ROWS = 100_000  # per batch that a task hands on


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts: list[tuple] = []
    held = 0

    def frame() -> pd.DataFrame:
        docs = np.repeat(np.arange(len(parts)), [len(x[2]) for x in parts])
        d, k, n = (np.array([x[i] for x in parts], np.int64)[docs] for i in (0, 1, 5))
        at, h, c = (np.concatenate([x[i] for x in parts]) for i in (2, 3, 4))
        left, right = np.minimum(at, REACH).astype(np.int8), np.minimum(n - at, LENGTH).astype(np.int8)
        return pd.DataFrame({"hash": h.view(np.int64), "context": c.view(np.int64), "d": d, "k": k, "pos": at, "left": left, "right": right})

    for batch in batches:
        for d, k, text in zip(batch["d"], batch["k"], batch["text"]):
            raw = _bytes(text)
            if len(raw) >= LENGTH:
                parts.append((d, k, *anchors(raw), len(raw)))
                held += len(parts[-1][2])
            if held >= ROWS:
                yield frame()
                parts, held = [], 0
    if parts:
        yield frame()


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The surroundings of listed anchors, the anchor always at the same place."""
    names = ["hash", "d", "k", "pos", "left", "right", "bytes"]
    rows: list[tuple] = []
    for batch in batches:
        for d, k, text, places in zip(batch["d"], batch["k"], batch["text"], batch["places"]):
            raw = _bytes(text).tobytes()
            for p in places:
                pos = p["pos"]
                part = raw[max(0, pos - REACH) : pos + LENGTH]
                left = min(pos, REACH)
                rows.append((p["hash"], d, k, pos, left, len(part) - left, (bytes(REACH - left) + part).ljust(REACH + LENGTH, b"\0")))
            if len(rows) >= ROWS // 10:
                yield pd.DataFrame(rows, columns=names)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names)


def repeated_starts(group: np.ndarray, left: np.ndarray, right: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Matrix (rows x REACH + 1): whether the string starting so many bytes before the anchor has LPF >= LENGTH.

    Rows are in the order of the corpus. Per offset the suffixes of each group are ordered by their first LENGTH
    bytes, ties by position; an equal predecessor is the previous smaller position.
    """
    found = np.zeros((len(data), REACH + 1), bool)
    names = group.astype(">u8").view(np.uint8).reshape(-1, 8)
    for offset in range(REACH + 1):
        rows = np.flatnonzero((left >= offset) & (right >= LENGTH - offset))
        if len(rows) < 2:
            continue
        suffix = np.concatenate([names[rows], data[rows, REACH - offset : REACH - offset + LENGTH]], axis=1)
        suffix = np.ascontiguousarray(suffix).view(f"S{8 + LENGTH}").ravel()
        order = np.argsort(suffix, kind="stable")
        same = suffix[order][1:] == suffix[order][:-1]
        found[rows[order[1:][same]], offset] = True
    return found


def _ranges(d: np.ndarray, k: np.ndarray, pos: np.ndarray, found: np.ndarray) -> pd.DataFrame:
    """Runs of marked offsets as byte ranges."""
    edges = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1] - 1
    return pd.DataFrame({"d": d[row], "k": k[row], "start": pos[row] - last, "end": pos[row] - first + LENGTH})


def _ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Settle whole groups, some thousand surroundings at a time; a task's rows come sorted by anchor and place."""
    held: list[pd.DataFrame] = []

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(b"".join(rows["bytes"]), np.uint8).reshape(len(rows), REACH + LENGTH)
        found = repeated_starts(rows["hash"].to_numpy(), rows["left"].to_numpy(), rows["right"].to_numpy(), data)
        return _ranges(rows["d"].to_numpy(), rows["k"].to_numpy(), rows["pos"].to_numpy(), found)

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= IN_TASK:
            rows = pd.concat(held)
            whole = (rows["hash"] != rows["hash"].iloc[-1]).to_numpy()
            if whole.any():
                yield settle(rows[whole])
            held = [rows[~whole]]
    if held and sum(map(len, held)):
        yield settle(pd.concat(held))


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The 100-byte strings around an anchor by two hashes, from prefix sums of all rows at once."""
    width = REACH + LENGTH
    up, down = _powers(_BASE, width + 1), _powers(_INVERSE, width + 1)
    offsets = np.arange(REACH + 1)
    at = REACH - offsets
    for batch in batches:
        for part in (batch.iloc[i : i + 2000] for i in range(0, len(batch), 2000)):
            raw = np.frombuffer(b"".join(part["bytes"]), np.uint8).reshape(-1, width)
            fits = (part["left"].to_numpy()[:, None] >= offsets) & (part["right"].to_numpy()[:, None] >= LENGTH - offsets)
            names = []
            for data in (raw, raw ^ np.uint8(0x5A)):
                sums = np.zeros((len(raw), width + 1), np.uint64)
                np.cumsum(_BYTE[data] * up[:width], axis=1, out=sums[:, 1:])
                names.append(mixed((sums[:, at + LENGTH] - sums[:, at]) * down[at])[fits].view(np.int64))
            row, offset = np.nonzero(fits)
            d, k, pos = (part[c].to_numpy()[row] for c in _PLACE)
            yield pd.DataFrame({"hash": names[0], "context": names[1], "d": d, "k": k, "pos": pos - offset})


def _after() -> Column:
    return F.struct(*_PLACE) > F.col("first")


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """d, k, start, end: byte ranges to remove, overlapping. ``texts``: d, k, text."""
    rows = texts.mapInPandas(_anchor_rows, "hash long, context long, d long, k long, pos long, left byte, right byte")
    often = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    shared = stored(rows.join(often, "hash"), "lpf-anchors")
    firsts = stored(shared.groupBy("hash", "context").agg(F.min(F.struct(*_PLACE)).alias("first")), "lpf-firsts")
    whole = [F.col("d"), F.col("k"), (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end")]
    reached = F.col("left") + F.col("right").cast("int") >= LENGTH
    done = shared.join(firsts, ["hash", "context"]).where(_after() & reached).select(*whole)

    sizes = firsts.groupBy("hash").count().where("count > 1")
    edges = stored(firsts.join(sizes, "hash").select("hash", "first.*", "count"), "lpf-edges")
    # A document's own anchors: fewer than its bytes.
    wanted = edges.groupBy("d", "k").agg(F.collect_list(F.struct("hash", "pos")).alias("places"))
    cut = texts.join(wanted, ["d", "k"]).mapInPandas(_cut, "hash long, d long, k long, pos long, left int, right int, bytes binary")
    cut = stored(cut.join(sizes, "hash").distinct(), "lpf-surroundings")
    few = cut.where(F.col("count") <= IN_TASK).repartition("hash").sortWithinPartitions("hash", *_PLACE)
    ordered = few.mapInPandas(_ordered, "d long, k long, start long, end long")
    crowded = cut.where(F.col("count") > IN_TASK).select("d", "k", "pos", "left", "right", "bytes").repartition("d", "pos")
    strings = stored(crowded.mapInPandas(_strings, "hash long, context long, d long, k long, pos long"), "lpf-strings")
    earliest = strings.groupBy("hash", "context").agg(F.min(F.struct(*_PLACE)).alias("first"))
    many = strings.join(earliest, ["hash", "context"]).where(_after()).select("d", "k", F.col("pos").alias("start"), (F.col("pos") + LENGTH).alias("end"))
    return done.union(ordered).union(many)


def merged(ranges: list) -> list[tuple[int, int]]:
    """Sorted ranges that neither overlap nor touch."""
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for d, text, ranges in zip(batch["doc_id"], batch["text"], batch["ranges"]):
            raw = _bytes(text).tobytes()
            gone = merged(ranges) if ranges is not None else []
            edges = [0, *(x for r in gone for x in r), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((d, len(raw), len(raw) - len(kept), len(gone), kept))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes); one row per row of ``docs``."""
    names = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("d"), text_key(F.col("text")).alias("k")]
    texts = docs.select(*names, "text").where(F.octet_length("text") >= LENGTH)
    ranges = stored(repeated_ranges(texts), "lpf-ranges")
    per_document = ranges.groupBy("d", "k").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    rows = docs.select(F.col("doc_id").cast("long"), "text", *names).join(per_document, ["d", "k"], "left")
    # The id as text: pandas has no whole numbers beside nulls.
    done = rows.select(F.col("doc_id").cast("string"), "text", "ranges").mapInPandas(_without, "doc_id string, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
