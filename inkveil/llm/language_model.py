"""Scoring texts with a bigram model that lives in a log-frequency Bloom filter.

A count c is kept as its level 1 + floor(log2 c): a word or word pair of level q is put into a Bloom filter q times,
together with the numbers 1 to q. Repeated probes with 1, 2, ... until the first miss give the level back, and the
middle of the level's range is the count. A miss is certain, a level too high has probability below 2^-HASHES. A pair
never counts more often than its words, whose levels bound its own. Probabilities are smoothed by a Dirichlet prior:
p(w | u) = (c(u, w) + PRIOR * p(w)) / (c(u) + PRIOR), and p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)), with levels' counts.

Words are named by 64-bit hashes of their bytes, pairs by a hash of both names. Training texts are read once; each task
counts blocks of tokens and sends (name, count) to the shard that the name's upper bits choose, where one task adds them
up and makes the shard's filter. The number of shards follows the bytes of training text, so that one task's share does
not grow; a frequent word costs a shard one row per counted block, not one per occurrence.

Filters grow with the corpus and are never sent out whole: shards are broadcast in blocks of at most BROADCAST_BYTES,
each to one pass over the texts, which notes the levels it finds (a byte per word and per pair) for the last pass to
turn into probabilities. One block needs no notes. Results do not depend on the block size. A cluster should set
``broadcast_bytes`` to what its executors can hold, for the number of passes is the filter's size over that.

Defined results: a null text is empty and has one token, its end. A null doc_id counts as empty text in the fold
rule (held out). Rows are scored one by one, so repeated rows repeat their result. Without training texts every count is
0; V + 1 then is 1. Exact counts hold but for two words of equal name (for 10^9 distinct words, one pair in 30 such
corpora). Columns beside doc_id and text are not read. Very long texts are hashed in pieces of PIECE bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import discard, stored

FOLDS = 10
PRIOR = 100.0
ADDED = 0.1
HASHES = 7
BITS = 10.1  # bits per entry: HASHES / ln 2
BROADCAST_BYTES = 128 << 20
SHARD_TEXT = 8 << 20  # bytes of training text per shard
PIECE = 1 << 20  # bytes hashed at once
BLOCK = 1 << 21  # tokens counted or probed at once

U = np.uint64
_RANDOM = np.random.default_rng(20)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACES = _RANDOM.integers(1, 1 << 63, 1 << 16, dtype=np.int64).astype(U) | U(1)
_END, _START, _PAIR, _LEVEL = (U(x) for x in _RANDOM.integers(1, 1 << 63, 4).tolist())


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _valued(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What a byte adds to its word's sum; the factors are odd, so one changed byte always shows."""
    return _BYTES[byte] * (_PLACES[place & 0xFFFF] + ((place >> 16).astype(U) << U(1)))


def _named(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of the words raw[starts:ends]; between words nothing is read."""
    lengths = ends - starts
    if lengths.max() > PIECE:  # summed in pieces
        long = np.flatnonzero(lengths > PIECE)
        cuts = [range(starts[k], ends[k], PIECE) for k in long]
        sums = [sum((_valued(raw[a : min(a + PIECE, ends[k])], np.arange(a, min(a + PIECE, ends[k])) - starts[k]).sum(keepdims=True) for a in c), np.zeros(1, U)) for k, c in zip(long, cuts)]
        out, short = np.zeros(len(starts), U), lengths <= PIECE
        out[long] = mixed(np.concatenate(sums) + lengths[long].astype(U))
        if short.any():
            out[short] = _named(raw, starts[short], ends[short])
        return out
    inside = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    value = _valued(raw[inside], inside - np.repeat(starts, lengths))
    return mixed(np.add.reduceat(value, np.cumsum(lengths) - lengths) + lengths.astype(U))


def tokens(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, first): the token names of all texts raw[edges[i]:edges[i + 1]], each text's words and its end,
    and where each text's tokens begin, with the total last."""
    names, begins, at, stop = [], [], int(edges[0]), int(edges[-1])
    text_starts = np.zeros(stop - at + 1, bool)
    text_starts[edges - at] = True
    base = at
    while at < stop:
        to = min(at + PIECE, stop)
        while to < stop:  # on to where no word runs on
            free = np.flatnonzero(_SPACE[raw[to : min(to + 4096, stop)]] | text_starts[to - base : min(to + 4096, stop) - base])
            if len(free):
                to += int(free[0])
                break
            to = min(to + 4096, stop)
        word = ~_SPACE[raw[at:to]]
        fresh = text_starts[at - base : to - base]
        starts = word.copy()
        starts[1:] &= ~word[:-1] | fresh[1:]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | fresh[1:]
        first = np.flatnonzero(starts) + at
        if len(first):
            names.append(_named(raw, first, np.flatnonzero(ends) + at + 1))
            begins.append(first)
        at = to
    where = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    found = np.concatenate(names) if names else np.zeros(0, U)
    before = np.searchsorted(where, edges)
    return np.insert(found, before[1:], _END), before + np.arange(len(edges))


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, names, first) for runs of rows of about PIECE * 4 bytes of text."""
    if not len(column):
        return
    column = column.fill_null("").cast(pa.large_string())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + 4 * PIECE, "right")) - 1)
        yield at, to, *tokens(raw, edges[at : to + 1])
        at = to


def contexts(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each, or the start."""
    out = np.roll(names, 1)
    out[first[:-1]] = _START
    return out


def pair_names(before: np.ndarray, names: np.ndarray) -> np.ndarray:
    return mixed(before * _PAIR + names)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1].astype(np.uint8)  # 1 + floor(log2 c), 0 of 0


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's range of counts; 0 for level 0."""
    q = levels.astype(float)
    return np.where(levels > 0, (2.0 ** (q - 1) + 2.0**q - 1) / 2, 0.0)


def shard_of(names: np.ndarray, shards: int) -> np.ndarray:
    """In the order of names: shard i holds an interval of them."""
    return ((names >> U(32)) * U(shards)) >> U(32)


# --- building ---------------------------------------------------------------------------------------


def _summed(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(names, kind="stable")
    names = names[order]
    at = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
    return names[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def _counted(shards: int):
    def block(words: list, pairs: list) -> Iterator[pa.RecordBatch]:
        for kind, parts in enumerate((words, pairs)):
            if parts:
                names, counts = np.unique(np.concatenate(parts), return_counts=True)
                where = shard_of(names, shards).astype(np.int32)
                yield pa.record_batch([pa.array(where), pa.array(np.full(len(names), kind, np.int8)), pa.array(names.view(np.int64)), pa.array(counts)], names=["shard", "kind", "name", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, size = [], [], 0
        for batch in batches:
            for _, _, names, first in _texts(batch.column(0)):
                words.append(names)
                pairs.append(pair_names(contexts(names, first), names))
                size += len(names)
                if size >= BLOCK:
                    yield from block(words, pairs)
                    words, pairs, size = [], [], 0
        yield from block(words, pairs)

    return run


_PARTIALS = "shard int, kind byte, name long, n long"
_SHARDS = "shard int, n_words long, n_tokens long, words binary, counts binary, n_bits long, bits binary"


def positions(names: np.ndarray, level: int, n_bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """The HASHES bit numbers of (name, level), one array after the other."""
    h = mixed(names + U(level * int(_LEVEL) & (1 << 64) - 1))
    step = mixed(h) | U(1)
    for _ in range(HASHES):
        yield ((h >> U(32)) * U(n_bits) if np.isscalar(n_bits) else (h >> U(32)) * n_bits) >> U(32)
        h = h + step


def _filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's words with their exact counts, and the filter of its words and pairs."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    all_ = pa.Table.from_batches(parts)
    col = lambda c: all_.column(c).to_numpy()
    shard, kind, names, n = col("shard"), col("kind"), col("name").view(U), col("n")
    for s in np.unique(shard).tolist():
        words, counts = _summed(names[(shard == s) & (kind == 0)], n[(shard == s) & (kind == 0)])
        pairs, pair_counts = _summed(names[(shard == s) & (kind == 1)], n[(shard == s) & (kind == 1)])
        entries, level = np.concatenate([words, pairs]), np.concatenate([levels_of(counts), levels_of(pair_counts)])
        n_bits = 64 * (1 + int(level.sum(dtype=np.int64) * BITS) // 64)
        bits = np.zeros(n_bits, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            for at in positions(entries[level >= q], q, n_bits):
                bits[at] = True
        columns = [[s], [len(words)], [int(counts.sum())], [words.tobytes()], [counts.astype("<i8").tobytes()], [n_bits], [np.packbits(bits, bitorder="little").tobytes()]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _SHARDS.split(", ")])


@dataclass(frozen=True)
class Model:
    """Where the shards are stored, and the sums over them."""

    shards: DataFrame
    n_shards: int
    n_texts: int
    n_tokens: int
    n_words: int


def learn(texts: DataFrame, shard_text: int = SHARD_TEXT) -> Model:
    """The model of all rows of ``texts`` (column text)."""
    texts = texts.select("text")
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n_shards = 1 + size["b"] // shard_text
    partials = texts.mapInArrow(_counted(n_shards), _PARTIALS)
    made = stored(partials.repartitionById(n_shards, F.col("shard")).mapInArrow(_filtered, _SHARDS), "lm-shards")
    sums = made.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("v")).first()
    return Model(made, n_shards, size["n"], sums["n"], sums["v"])


# --- scoring ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Block:
    """The shards from ``low`` to before ``high``, laid end to end."""

    low: int
    high: int
    words: np.ndarray
    counts: np.ndarray
    starts: np.ndarray  # per shard: first bit, a multiple of 64
    sizes: np.ndarray  # per shard: number of bits
    bits: np.ndarray  # bytes

    def holds(self, names: np.ndarray, shards: int) -> np.ndarray:
        s = shard_of(names, shards)
        return (s >= U(self.low)) & (s < U(self.high))

    def exact(self, names: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.words, names), len(self.words) - 1)
        return np.where(self.words[at] == names, self.counts[at], 0)

    def levels(self, names: np.ndarray, shards: int) -> np.ndarray:
        """Probe with 1, 2, ... until the first miss. All names must belong to the block."""
        out = np.zeros(len(names), np.uint8)
        place = shard_of(names, shards).astype(np.int64) - self.low
        live = np.flatnonzero(self.sizes[place] > 0)
        for q in range(1, 65):
            if not len(live):
                break
            start, size = self.starts[place[live]], self.sizes[place[live]].astype(U)
            names_left = names[live]
            keep = np.ones(len(live), bool)
            for at in positions(names_left, q, size):
                bit = at.astype(np.int64) + start
                keep &= (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
            live = live[keep]
            out[live] = q
        return out


def _block(rows: list, low: int, high: int) -> Block:
    rows = sorted(rows, key=lambda r: r["shard"])
    sizes = np.zeros(high - low, np.int64)
    for r in rows:
        sizes[r["shard"] - low] = r["n_bits"]
    joined = lambda c, kind: np.frombuffer(b"".join(bytes(r[c]) for r in rows), kind)
    return Block(low, high, joined("words", "<u8"), joined("counts", "<i8"), np.cumsum(sizes) - sizes, sizes, joined("bits", np.uint8))


def blocks(model: Model, broadcast_bytes: int) -> list[tuple[int, int]]:
    """Runs of shards of at most ``broadcast_bytes``, or of one shard."""
    size = (F.length("words") + F.length("counts") + F.length("bits")).alias("size")
    # Runs of shards are sized from sums over at most 4096 groups, whatever the number of shards.
    per = 1 + model.n_shards // 4096
    sums = model.shards.groupBy(F.floor(F.col("shard") / per).alias("g")).agg(F.sum(size).alias("size")).collect()
    sizes = {r["g"]: r["size"] for r in sums}
    out, low, total = [], 0, 0
    for g in range(-(-model.n_shards // per)):
        if total and total + sizes.get(g, 0) > broadcast_bytes:
            out.append((low, g * per))
            low, total = g * per, 0
        total += sizes.get(g, 0)
    return [*out, (low, model.n_shards)]


def _distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(names, return_inverse=True)


def _probed(names: np.ndarray, before: np.ndarray, block: Block, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exact count, level of the word, level of the pair) of each token; 0 where another block has it."""
    word, back = _distinct(names)
    here = block.holds(word, shards)
    exact, level = np.zeros(len(word), np.int64), np.zeros(len(word), np.uint8)
    exact[here], level[here] = block.exact(word[here]), block.levels(word[here], shards)
    pair, pair_back = _distinct(pair_names(before, names))
    here = block.holds(pair, shards)
    pair_level = np.zeros(len(pair), np.uint8)
    pair_level[here] = block.levels(pair[here], shards)
    return exact[back], level[back], pair_level[pair_back]


def _scores(model_sums: tuple[int, int, int], level: np.ndarray, pair_level: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 p of every token given the one before."""
    n_texts, n_tokens, n_words = model_sums
    word = count_of(level)
    before = np.roll(word, 1)
    before[first[:-1]] = n_texts
    single = (word + ADDED) / (n_tokens + ADDED * (n_words + 1))
    pair = np.minimum(count_of(pair_level), np.minimum(word, before))
    return np.log10((pair + PRIOR * single) / (before + PRIOR))


_STATE = "notes binary, known long, base double"


def _pass(shared: Broadcast, sums: tuple[int, int, int], shards: int, first_pass: bool, last_pass: bool):
    """Columns doc_id, held_out, text (and the notes of earlier passes) to notes, or in the last pass to scores."""

    def scored(batch: pa.RecordBatch, at: int, to: int, names: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        block: Block = shared.value
        before = contexts(names, first)
        n = len(names)
        exact, level, pair_level = np.zeros(n, np.int64), np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        for i in range(0, n, BLOCK):
            j = min(i + BLOCK, n)
            exact[i:j], level[i:j], pair_level[i:j] = _probed(names[i:j], before[i:j], block, shards)
        per_text = lambda x: np.add.reduceat(x, first[:-1])
        # A token belongs to one block: elsewhere it adds nothing.
        mine = block.holds(names, shards)
        base = per_text(np.where(mine, np.log10((exact + ADDED) / (sums[1] + ADDED * (sums[2] + 1))), 0.0))
        known = per_text((exact > 0).astype(np.int64))
        if not first_pass:
            old = np.frombuffer(b"".join(batch.column("notes").slice(at, to - at).to_pylist()), np.uint8).reshape(-1, 2)
            level, pair_level = np.maximum(level, old[:, 0]), np.maximum(pair_level, old[:, 1])
            base = base + batch.column("base").slice(at, to - at).to_numpy()
            known = known + batch.column("known").slice(at, to - at).to_numpy()
        if last_pass:
            score = per_text(_scores(sums, level, pair_level, first))
            return [pa.array(np.diff(first)), pa.array(known), pa.array(base), pa.array(score)]
        notes = np.stack([level, pair_level], 1).tobytes()
        return [pa.array([notes[2 * a : 2 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary()), pa.array(known), pa.array(base)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["doc_id", "held_out"] if last_pass else ["doc_id", "held_out", "text"]
        made = ["n_tokens", "known", "base", "score"] if last_pass else ["notes", "known", "base"]
        for batch in batches:
            for at, to, names, first in _texts(batch.column("text")):
                rows = [batch.column(c).slice(at, to - at) for c in kept]
                yield pa.record_batch([*rows, *scored(batch, at, to, names, first)], names=kept + made)

    return run


def score(docs: DataFrame, model: Model, held_out: Column, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    sums = (model.n_texts, model.n_tokens, model.n_words)
    runs = blocks(model, broadcast_bytes)
    own = rows.schema["doc_id"].dataType.simpleString()
    for k, (low, high) in enumerate(runs):
        first, last = k == 0, k == len(runs) - 1
        block = _block(model.shards.where(F.col("shard").between(low, high - 1)).collect(), low, high)
        shared = spark.sparkContext.broadcast(block)
        out = "n_tokens long, known long, base double, score double" if last else f"text string, {_STATE}"
        done = rows.mapInArrow(_pass(shared, sums, model.n_shards, first, last), f"doc_id {own}, held_out boolean, {out}")
        if not last:
            now = stored(done, "lm-notes")
            if not first:
                discard(rows)
            rows = now
            shared.unpersist()
    return done.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def score_held_out(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Learn from nine of ten folds of ``docs`` by crc32 of doc_id, and score all of it."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0
    return score(docs, learn(docs.where(~held)), held, broadcast_bytes)
