"""Prefix trie of conversations: what they share from their start on.

Every conversation is first rebuilt: the first ``h`` turns of a leading conversation, then its own from the ``h``-th on.
Turns are named by 128 bits of hash, and only names travel from there, never texts. Equal sequences become one row with
their number, smallest id and the digest of their ids. The distinct sequences are sorted into range shards. A shard
encodes its names by a dictionary of its own, in their order, and inserts its sequences into a ternary search tree: the
children of a node form a binary search tree, kept shallow by inserting the median of every run of sequences before its
halves. Nodes are made after their parents, so one pass backwards adds up members, leaves and savings, without
recursion.

A node's sequences are neighbours in the order, so only the prefixes of a shard's first and last sequence can reach into
other shards. These boundary nodes leave the shard as parts, named by a chained hash, and are merged by name: members are
added, and savings and leaves summed up the boundary tree by doubling the distance covered each round. All other nodes
are complete in their shard, but for the id of a boundary parent, which a salted join fills in.

Copies: however many conversations are equal, they reach their digest in blocks of BLOCK ids and the trie as one row. A
shared first turn spreads over shards like any other. One conversation is one row of names (20 bytes a turn, so at most
about 10^8 turns); its turns are numbered in blocks before.

Defined results: a null role or text is empty; turns are in the order of ``turn`` (null first), equal ones by role and
text, repeated rows are repeated turns. Rows without conv_id belong to no conversation and are left out. Remainders of
negative ids keep their sign. An empty table has no members and no nodes, not even the root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.chat import _numbered as numbered
from inkveil.llm.common import stored, words

GROUP = 20  # conversations that share a leading one
BLOCK = 4096  # ids
TURNS_PER_SHARD = 100_000
SALTS = 32
NO_ENDS = hashlib.sha256(b"").hexdigest()
SEQUENCE = "array<struct<a:bigint,b:bigint,w:bigint>>"


# --- sequences --------------------------------------------------------------------------------------


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from its leading one."""
    return F.crc32(conv_id.cast("string")) % 4


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, seq: the names and word counts of each rebuilt conversation's turns."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    name = [F.xxhash64(F.lit(seed), "role", "text").alias(c) for seed, c in ((1, "a"), (2, "b"))]
    named = stored(numbered(rows).select("conv_id", "place", *name, F.size(words(F.col("text"))).cast("long").alias("w")), "trie-turns")
    turn = F.struct("part", "place", "a", "b", "w").alias("turn")
    own = named.where(F.col("place") >= borrowed(F.col("conv_id"))).withColumn("part", F.lit(1)).select("conv_id", turn)
    lead = named.where((F.col("place") < 3) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "_lead")
    ids = named.select("conv_id").distinct()
    begun = ids.withColumn("_lead", F.col("conv_id") - F.col("conv_id") % GROUP).join(lead, "_lead")
    begun = begun.where(F.col("place") < borrowed(F.col("conv_id"))).withColumn("part", F.lit(0)).select("conv_id", turn)
    # A conversation may be left without turns; it is a member of the root all the same.
    all_ = own.unionByName(begun).unionByName(ids.select("conv_id", F.lit(None).cast(own.schema["turn"].dataType).alias("turn")))
    seq = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["w"].alias("w")))
    return all_.groupBy("conv_id").agg(seq.cast(SEQUENCE).alias("seq"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of equal sequences, one after the other, to one row each."""
    open_, digest, out = None, None, []

    def rows(found: list) -> pa.RecordBatch:
        seq, conv, n, sha = zip(*found)
        return pa.record_batch([pa.concat_arrays(list(seq)), pa.array(conv, pa.int64()), pa.array(n, pa.int64()), pa.array(sha)], names=["seq", "conv_id", "n", "sha"])

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "low", "n", "ids")))
        for i, (k1, k2, low, n, ids) in enumerate(keys):
            if open_ and open_[0] == (k1, k2):
                digest.update(b"," + ids.encode())
                open_[3] += n
                continue
            if open_:
                out.append((*open_[1:], digest.hexdigest()))
                if len(out) >= 1000:
                    yield rows(out)
                    out = []
            open_, digest = [(k1, k2), batch.column("seq").slice(i, 1), low, n], hashlib.sha256(ids.encode())
    if open_:
        out.append((*open_[1:], digest.hexdigest()))
    if out:
        yield rows(out)


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """seq, conv_id (smallest), n, sha (SHA-256 of the ids, ascending, comma-joined) of equal sequences."""
    keys = [F.xxhash64(F.lit(seed), F.transform("seq", lambda t: F.struct(t["a"], t["b"]))).alias(k) for seed, k in ((3, "k1"), (4, "k2"))]
    rows = sequences.select("conv_id", "seq", *keys, F.floor(F.col("conv_id") / BLOCK).alias("block"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = rows.groupBy("k1", "k2", "block").agg(F.any_value("seq").alias("seq"), F.min("conv_id").alias("low"), F.count(F.lit(1)).alias("n"), ids.alias("ids"))
    sorted_ = blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block")
    return sorted_.select("k1", "k2", "low", "n", "ids", "seq").mapInArrow(_digested, f"seq {SEQUENCE}, conv_id long, n long, sha string")


# --- one shard --------------------------------------------------------------------------------------


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every run before its halves."""
    runs = [(0, n)]
    while runs:
        low, high = runs.pop()
        if low < high:
            mid = (low + high) // 2
            yield mid
            runs += [(mid + 1, high), (low, mid)]


class Tree:
    """Ternary search tree of sequences of numbers. Node 0 is the root; a node is made after its parent."""

    def __init__(self) -> None:
        self.key, self.left, self.right, self.down, self.up, self.depth = [-1], [-1], [-1], [-1], [-1], [0]

    def _made(self, key: int, up: int) -> int:
        for column, value in ((self.key, key), (self.left, -1), (self.right, -1), (self.down, -1), (self.up, up), (self.depth, self.depth[up] + 1)):
            column.append(value)
        return len(self.key) - 1

    def insert(self, sequence: list[int]) -> int:
        """The node that the sequence ends at."""
        key, left, right, down = self.key, self.left, self.right, self.down
        at = 0
        for x in sequence:
            side, holder, here = down, at, down[at]
            while here >= 0 and key[here] != x:
                side, holder = (left, here) if x < key[here] else (right, here)
                here = side[here]
            if here < 0:
                here = side[holder] = self._made(x, at)
            at = here
        return at

    def path(self, sequence: list[int]) -> list[int]:
        """The nodes of a sequence that has been inserted, from the root."""
        out, at = [0], self.insert(sequence)
        ends = []
        while at:
            ends.append(at)
            at = self.up[at]
        return out + ends[::-1]


_NODES = (
    "name binary, parent_name binary, depth long, words long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, sha string"
)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard's sorted sequences: complete ones without a name, boundary nodes as parts with one."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    seqs = table.column("seq").chunk(0)
    flat = seqs.flatten()
    a, b, w = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "w"))
    names, codes = np.unique(np.stack([a, b], 1), axis=0, return_inverse=True) if len(a) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    codes = codes.ravel()
    word_count = np.zeros(len(names), np.int64)
    word_count[codes] = w
    edges = np.concatenate([[0], np.cumsum(np.diff(np.asarray(seqs.offsets)))]).tolist()
    conv, many, sha = (table.column(c).to_pylist() for c in ("conv_id", "n", "sha"))
    sequence = lambda i: codes[edges[i] : edges[i + 1]].tolist()

    tree, ends = Tree(), {}
    for i in medians(len(conv)):
        ends[tree.insert(sequence(i))] = i
    size = len(tree.key)
    boundary: dict[int, bytes] = {}
    for i in (0, len(conv) - 1):
        name = b""
        for node in tree.path(sequence(i)):
            name = hashlib.blake2b(name + (names[tree.key[node]].tobytes() if node else b"root"), digest_size=16).digest()
            boundary[node] = name

    members, low, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    for node in range(size - 1, -1, -1):
        if node in ends:
            i = ends[node]
            members[node] += many[i]
            low[node] = conv[i] if low[node] is None else min(low[node], conv[i])
        up = tree.up[node]
        if node not in boundary:
            saved[node] += (members[node] - 1) * int(word_count[tree.key[node]])
            leaves[node] += not children[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
        if node:
            members[up] += members[node]
            low[up] = low[node] if low[up] is None else min(low[up], low[node])

    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string()]
    titles = [x.split()[0] for x in _NODES.split(", ")]
    for at in range(0, size, 20_000):
        span = range(at, min(at + 20_000, size))
        ups = [tree.up[v] for v in span]
        columns = [
            [boundary.get(v) for v in span],
            [boundary.get(u) if u >= 0 else None for u in ups],
            [tree.depth[v] for v in span],
            [int(word_count[tree.key[v]]) if v else 0 for v in span],
            [low[v] for v in span],
            [low[u] if u >= 0 and u not in boundary else None for u in ups],
            [members[v] for v in span],
            [children[v] for v in span],
            [leaves[v] for v in span],
            [saved[v] for v in span],
            [sha[ends[v]] if v in ends else None for v in span],
        ]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=titles)


# --- merging ----------------------------------------------------------------------------------------


def _merged(parts: DataFrame) -> DataFrame:
    """Boundary nodes whole: name, parent_name, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens, sha."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.max(c).alias(c) for c in ("parent_name", "depth", "words", "sha")]
    nodes = parts.groupBy("name").agg(F.min("conv_id").alias("conv_id"), *sums, *same)
    below = nodes.where(F.col("parent_name").isNotNull()).groupBy(F.col("parent_name").alias("name")).agg(F.count(F.lit(1)).alias("_below"))
    n_children = F.col("n_children") + F.coalesce("_below", F.lit(0))
    nodes = nodes.join(below, "name", "left").withColumns(
        {
            "n_children": n_children,
            "n_leaves": F.col("n_leaves") + F.when(n_children == 0, 1).otherwise(0),
            "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"),
        }
    )
    return stored(nodes.drop("_below", "words"), "trie-boundary")


def _summed_up(nodes: DataFrame) -> DataFrame:
    """Leaves and savings of the boundary nodes below added to each, by doubling: after round k a node holds the sums
    over distances below 2^k, and ``_far`` is its ancestor at distance 2^k."""
    now = nodes.withColumn("_far", F.col("parent_name"))
    while not now.where(F.col("_far").isNotNull()).isEmpty():
        up = now.where(F.col("_far").isNotNull()).groupBy(F.col("_far").alias("name")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        jump = now.select(F.col("name").alias("_far"), F.col("_far").alias("_next"))
        more = now.join(up, "name", "left").join(jump, "_far", "left")
        now = stored(
            more.withColumns(
                {
                    "n_leaves": F.col("n_leaves") + F.coalesce("_l", F.lit(0)),
                    "saved_tokens": F.col("saved_tokens") + F.coalesce("_s", F.lit(0)),
                    "_far": F.col("_next"),
                }
            ).drop("_l", "_s", "_next"),
            "trie-sums",
        )
    return now.drop("_far")


def trie(turns: DataFrame, turns_per_shard: int = TURNS_PER_SHARD) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    seqs = stored(distinct_sequences(rebuilt(turns)), "trie-sequences")
    total = seqs.agg(F.coalesce(F.sum(F.size("seq")), F.lit(0)).alias("n")).first()["n"]
    shards = seqs.repartitionByRange(1 + total // turns_per_shard, "seq").sortWithinPartitions("seq")
    nodes = stored(shards.mapInArrow(_shard, _NODES), "trie-nodes")

    joint = stored(_summed_up(_merged(nodes.where(F.col("name").isNotNull()))), "trie-joint")
    above = joint.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("_above"))
    whole = nodes.where(F.col("name").isNull())
    pending = whole.where(F.col("parent_name").isNotNull()).withColumn("_salt", F.pmod("conv_id", F.lit(SALTS)).cast("int"))
    salted = above.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256")]
    return (
        whole.where(F.col("parent_name").isNull()).select(*columns)
        .union(pending.join(salted, ["parent_name", "_salt"]).withColumn("parent_conv_id", F.col("_above")).select(*columns))
        .union(joint.join(above, "parent_name", "left").withColumn("parent_conv_id", F.col("_above")).select(*columns))
    )
