"""Packing documents into token sequences by hierarchical best fit.

Every document becomes token ids and an end token. Longer ones are cut into full pieces; what is left of each
is packed best-fit by its own partition, without a shuffle. Bins that are nearly full are final. Underfull
bins move on as items of their own: a tree of ever fewer tasks repeats the best fit on them, until one task
holds the rest or nothing more merges. A bin holds at most as many members as tokens, so rows stay bounded,
and a task of the tree gets a bounded number of bins, at whatever size.

Items are sorted before each fit, so a task that runs again after a lost executor makes the same bins, and
every round is stored before the next reads it. Ids come from the tokenizer, word by word: white space
separates words before any merge, so a word's ids do not depend on its neighbours, and a bounded table
keeps those of words already seen. Texts are first split at the vocabulary's added tokens (<|endoftext|>), as the
tokenizer does itself; each of them is a word of its own.

Defined results: null and empty texts are one end token; repeated rows are packed as often as they occur; a
null doc_id stays null; an empty table gives an empty result. Only (doc_id, text) are read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import stored

LENGTH = 2048
NEARLY_FULL = 2044
FAN_IN = 4
BINS_PER_TASK = 1_000_000
KNOWN_WORDS = 1_200_000
END = np.zeros(1, "<u4").tobytes()
# White space of Unicode, as the vocabulary's own pattern cuts it (fixed values).
_W = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(rf" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
# How the byte-level form cuts a word into pieces, and the letters it writes bytes with (fixed values). Latin letters
# only: their classes are the same in every version of Unicode.
_LATIN = re.compile(" ?[!-~\xa1-\u024f]+")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}

MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
BINS = f"total int, members array<{MEMBER}>"
_FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]


def _piece_encoder(form: dict) -> tiktoken.Encoding | None:
    """The same merges for single pieces, at half the time; None where the file asks for more than byte pairs by rank.

    A file merges listed pairs by the order of the list, this one pairs whose union is a token by the token's number.
    That is the same where numbers rise along the list: before a token's turn, what stands between its edges has
    been merged as in the token alone, so it is the listed pair.
    """
    cut, model = form["pre_tokenizer"] or {}, form["model"]
    if form["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut["add_prefix_space"]:
        return None
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    vocabulary = model["vocab"]
    ids = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    special = {a["id"] for a in form["added_tokens"]}
    plain = {t: i for t, i in vocabulary.items() if i not in special}
    if len(plain) != 256 + len(ids) or any(a >= b for a, b in zip(ids, ids[1:])):
        return None
    letters = {chr(c): b for b, c in _BYTE_LETTERS.items()} | {chr(b): b for b in _PRINTED}
    return tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks={bytes(letters[c] for c in t): i for t, i in plain.items()}, special_tokens={})


class Words:
    """Ids of whole texts as little-endian bytes, from a tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(a.lstrip or a.rstrip or a.single_word for a in added):
            raise ValueError("added tokens that depend on their neighbours")
        # The longest first, as the tokenizer takes them.
        self.spelled = {a.content for a in added}
        self.pieces: dict[str, bytes] = {}
        self.merged = _piece_encoder(json.loads(self.tokenizer.to_str()))
        self.added = re.compile("(" + "|".join(re.escape(a.content) for a in sorted(added, key=lambda a: -len(a.content))) + ")") if added else None

    def _cut(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return _CHUNK.findall(text)
        parts = self.added.split(text)  # every other one is an added token
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else _CHUNK.findall(part))]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of words; Latin ones piece by piece, as a piece often ends a word that is new only for its comma."""
        rest = [w for w in words if not (self.merged and _LATIN.fullmatch(w) and w not in self.spelled)]
        told = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))}
        pieces, merged = self.pieces, self.merged
        for w in words:
            if w not in told:
                parts = _PIECE.findall(w)
                for part in parts:
                    if part not in pieces:
                        pieces[part] = array("I", merged.encode_ordinary(part)).tobytes()
                told[w] = b"".join([pieces[part] for part in parts])
        return [told[w] for w in words]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
            self.pieces.clear()
        cut = [self._cut(t or "") for t in texts]
        known = self.known
        found = [list(map(known.get, words)) for words in cut]
        new = sorted({w for words, ids in zip(cut, found) if None in ids for w, b in zip(words, ids) if b is None})
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            known.update(zip(part, self._ids(part)))
        return [b"".join(ids if None not in ids else map(known.__getitem__, words)) for words, ids in zip(cut, found)]


@cache
def tokenizer_words(path: str) -> Words:
    """One per worker process: the next task finds the words of the last."""
    return Words(path)


def pieces(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(piece, start, tokens, crc32) of a document's ids; only the first piece may be shorter than ``length``."""
    n = len(ids) // 4
    first = n if n <= length else n % length or length
    edges = [0, *range(first, n + 1, length)]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, largest first into the fullest bin with room."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]  # by room
    rooms = 0  # bit r: some bin has room r
    count = 0
    for k, size in enumerate(sizes.tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b, count = length, count, count + 1
        bins[k], offsets[k] = b, length - room
        if room > size:
            open_bins[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets


def _batch(members: dict[str, np.ndarray | pa.Array], edges: np.ndarray) -> pa.RecordBatch:
    """A row per bin; ``edges``: where each bin's members begin, and the end."""
    arrays = [pa.array(members[n]).cast(t) if not isinstance(members[n], pa.Array) else members[n] for n, t in _FIELDS]
    flat = pa.StructArray.from_arrays(arrays, names=[n for n, _ in _FIELDS])
    sums = np.concatenate([[0], np.cumsum(np.asarray(members["length"]))])
    total = (sums[edges[1:]] - sums[edges[:-1]]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(total), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), flat)], ["total", "members"])


def _fitted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Merge the bins of ``batch`` by best fit, largest first; ties by the first member."""
    lists = batch.column("members")
    flat = lists.flatten()
    edges = np.concatenate([[0], np.cumsum(np.diff(np.asarray(lists.offsets)))])
    first = edges[:-1]
    columns = {n: flat.field(n) for n, _ in _FIELDS}
    doc = np.asarray(columns["doc_id"].fill_null(-1))
    sizes = np.asarray(batch.column("total")).astype(np.int64)
    start, crc = np.asarray(columns["start"]), np.asarray(columns["ids_crc32"])
    order = np.lexsort((crc[first], start[first], doc[first], -sizes))
    bins, offsets = best_fit(sizes[order])
    by_bin = np.argsort(bins, kind="stable")
    items = order[by_bin]
    counts = np.diff(edges)[items]
    take = np.repeat(first[items], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    moved = {n: c.take(pa.array(take)) for n, c in columns.items()}
    moved["offset"] = pa.array(np.asarray(moved["offset"]) + np.repeat(offsets[by_bin], counts))
    per_bin = np.bincount(bins[by_bin], weights=counts).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(per_bin)])
    for at in range(0, len(per_bin), 20_000):
        to = min(at + 20_000, len(per_bin))
        part = {n: c.slice(ends[at], ends[to] - ends[at]) for n, c in moved.items()}
        yield _batch(part, ends[at : to + 1] - ends[at])


def _singles(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    members = {n: pa.array(c, t) for (n, t), c in zip(_FIELDS, columns)}
    members["offset"] = pa.array(np.zeros(len(rows), np.int64))
    return _batch(members, np.arange(len(rows) + 1))


def _packed_locally(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer_words(path)
        rest: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                full = []
                for d, ids in zip(part.column("doc_id").to_pylist(), words.encode(part.column("text").to_pylist())):
                    for k, start, n, crc in pieces(ids + END):
                        (full if n == LENGTH else rest).append((d, k, start, n, crc))
                if full:
                    yield _singles(full)
        if rest:
            yield from _fitted(_singles(rest))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [b for b in batches if b.num_rows]
    if found:
        yield from _fitted(pa.Table.from_batches(found).combine_chunks().to_batches()[0])


def bins(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per sequence: ``total`` tokens and its ``members`` in place."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    now = stored(rows.mapInArrow(_packed_locally(tokenizer), BINS), "packing-local")
    final = now.where(F.col("total") >= NEARLY_FULL)
    rest = now.where(F.col("total") < NEARLY_FULL)
    tasks, count = rows.sparkSession.sparkContext.defaultParallelism * FAN_IN, rest.count()
    while count > 1:
        tasks = max(tasks // FAN_IN, -(-count // BINS_PER_TASK), 1)
        # Dealt by content, not in turn, so that a repeated task gets the same bins.
        dealt = rest.repartition(tasks, F.xxhash64(F.element_at("members", 1), F.lit(tasks)))
        now = stored(dealt.mapInArrow(_merged, BINS), "packing-round")
        final = final.union(now.where(F.col("total") >= NEARLY_FULL))
        rest = now.where(F.col("total") < NEARLY_FULL)
        before, count = count, now.count()
        if tasks == 1 or count > 0.999 * before:
            break
        count = rest.count()
    return final.union(rest)


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    numbered = bins(docs, tokenizer).select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    rows = numbered.select("sequence_id", F.explode("members").alias("m"))
    return rows.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def _document_ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer_words(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cut = [np.frombuffer(x + END, "<u4").astype(np.int32) for x in words.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([c.tolist() for c in cut], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str) -> DataFrame:
    """The training rows: sequence_id and its token ids, from ``pack``'s stored result. Needs distinct doc_ids.

    Only pieces are shuffled, and a sequence gathers at most 2048 tokens.
    """
    ids = docs.select("doc_id", "text").mapInArrow(_document_ids(tokenizer), "doc_id long, ids array<int>")
    cut = packed.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("part"))
    placed = cut.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    return placed.select("sequence_id", F.flatten("parts.part").alias("ids"))
