"""Language model, whitening and prefix trie against brute force and on awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm import language_model as lm
from inkveil.llm import prefix_trie, whitening

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BIG = 1 << 60


# --- language model -----------------------------------------------------------------------------------


def split(text):
    return WORD.findall((text or "").translate(LOWER)) + [None]


def middle(count):
    q = count.bit_length()
    return (2 ** (q - 1) + 2**q - 1) / 2 if count else 0


def scored_plainly(rows):
    """doc_id to (n_tokens, n_known, N, base score, score with exact levels)."""
    held = {d: zlib.crc32((str(d) if d is not None else "").encode()) % 10 == 0 for d, _ in rows}
    train = [split(t) for d, t in rows if not held[d]]
    one = collections.Counter(w for t in train for w in t)
    two = collections.Counter(p for t in train for p in zip([0, *t], t))
    n, v = sum(one.values()), len(one)
    out = []
    for d, text in rows:
        t = split(text)
        score = 0.0
        for u, w in zip([0, *t], t):
            single = (middle(one[w]) + 0.1) / (n + 0.1 * (v + 1))
            before = len(train) if u == 0 else middle(one[u])
            score += math.log10((min(middle(two[u, w]), middle(one[w]), before) + lm.PRIOR * single) / (before + lm.PRIOR))
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out.append((d, held[d], len(t), sum(one[w] > 0 for w in t), n, base, score))
    return out


def assert_scores(df, rows):
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    want = sorted(scored_plainly(rows), key=repr)
    assert sorted(g[:5] for g in got if g[0] is not None) == sorted(w[:5] for w in want if w[0] is not None)
    base, score = collections.defaultdict(list), collections.defaultdict(list)
    for g in got:
        base[g[0]].append(g[5]), score[g[0]].append(g[6])
    for d in base:
        assert np.allclose(sorted(base[d]), sorted(w[5] for w in want if w[0] == d), rtol=1e-9)
        # a level too high is rare: a probe misses but for 1 in 2^HASHES
        assert np.allclose(sorted(score[d]), sorted(w[6] for w in want if w[0] == d), rtol=0.05)


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    df = lm.score_held_out(docs)
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert_scores(df, rows)
    unseen = [r for r in df.collect() if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_language_model_awkward(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two ONE"), (4, "one two ONE"), (None, "one two"), (None, "\x0b\x0c x"),
            (5, "x" * 3_000_000), (6, "ab cd " * 500_000), (7, "ÄÖ ß 𝄞 " * 40), (BIG + 1, "one two"), (BIG + 3, "no such word")]
    odd = spark.createDataFrame([(*r, 1, "mine") for r in rows], "doc_id long, text string, n_tokens int, score string").repartition(3)
    df = lm.score_held_out(odd)
    assert_scores(df, rows)
    assert {BIG + 1, BIG + 3} < {r["doc_id"] for r in df.collect()}
    assert lm.score_held_out(odd.limit(0)).count() == 0
    only = odd.where("doc_id is null")  # nothing to learn from
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in lm.score_held_out(only).collect())


def test_language_model_in_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm.learn(docs.where("doc_id % 10 <> 0"), shard_text=1 << 15)
    assert len(lm.blocks(model, 100_000)) > 3
    whole, blocks = ({r["doc_id"]: r for r in lm.score(docs, model, F.expr("doc_id % 10 = 0"), b).collect()} for b in (1 << 30, 100_000))
    for d, r in whole.items():
        assert r["n_known"] == blocks[d]["n_known"]
        assert math.isclose(r["score"], blocks[d]["score"]) and math.isclose(r["base_score"], blocks[d]["base_score"])


def test_words_are_named_alike_wherever_they_stand():
    text = ("ab  Cd\n" + "x" * (3 * lm.PIECE) + " ab " + "y " * lm.PIECE + "cd").encode()
    raw = np.frombuffer(text + b"ab", np.uint8)
    names, first = lm.tokens(raw, np.array([0, len(text), len(text), len(raw)]))
    assert first.tolist() == [0, lm.PIECE + 6, lm.PIECE + 7, lm.PIECE + 9]
    words = [*split(text.decode()), None, "ab", None]
    by_word = collections.defaultdict(set)
    for w, n in zip(words, names.tolist()):
        by_word[w].add(n)
    assert len(words) == len(names) and all(len(x) == 1 for x in by_word.values()) and len(by_word) == len(set.union(*by_word.values()))


def test_filter_never_misses():
    counts = np.random.default_rng(1).integers(1, 1000, 5000)
    names = lm.mixed(np.arange(5000, dtype=np.uint64))
    assert lm.levels_of(np.array([0, 1, 2, 3, 4, 7, 8])).tolist() == [0, 1, 2, 2, 3, 3, 4]
    import pyarrow as pa

    rows = pa.record_batch([pa.array(np.zeros(5000, np.int32)), pa.array(np.ones(5000, np.int8)), pa.array(names.view(np.int64)), pa.array(counts)], names=["shard", "kind", "name", "n"])
    (made,) = lm._filtered(iter([rows]))
    block = lm._block(made.to_pylist(), 0, 1)
    found = block.levels(names, 1)
    assert (found >= lm.levels_of(counts)).all() and (found > lm.levels_of(counts)).mean() < 0.02
    strangers = lm.mixed(np.arange(5000, 25000, dtype=np.uint64))
    assert (block.levels(strangers, 1) > 0).mean() < 0.02


# --- whitening ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,rank", [(1, 1), (2, 1), (5, 5), (8, 3), (33, 20), (64, 64)])
def test_eigen(n, rank):
    b = np.random.default_rng(n).normal(size=(n, rank)) * 10.0 ** -np.arange(rank).clip(0, 6)
    a = b @ b.T
    factor, order = whitening.pivoted_cholesky(a)
    assert factor.shape[1] <= rank and np.allclose(factor @ factor.T, a[np.ix_(order, order)])
    values, vectors = whitening.eigen(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][: len(values)], rtol=1e-6, atol=1e-12 * values[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-12 * values[0])


def test_small_eigenvalues_are_exact():
    graded = np.diag([1.0, 1e-6, 1e-12]) @ (np.eye(3) + 0.3) @ np.diag([1.0, 1e-6, 1e-12])
    with np.errstate(all="raise"):
        values, _ = whitening.eigen(graded[:2, :2])
    assert math.isclose(values[0] * values[1], np.linalg.det(graded[:2, :2]), rel_tol=1e-12)


def whitened_plainly(rows):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in good], np.float32).astype(float)).astype(int) + 100_000
    n, s = len(x), x.sum(0)
    cov = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    return good, n, ((n * x - s) ** 2).sum(1), (x - s / n) @ vectors / np.sqrt(values), values / np.trace(cov)


def test_whitening(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = whitening.whiten(df).collect()
    good, n, deviation, want, explained = whitened_plainly([tuple(r) for r in df.select("vec_id", "embedding").collect()])
    place = {i: k for k, (i, _) in enumerate(good)}
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    mine = np.zeros((n, 8))
    for r in got:
        assert r["deviation"] == deviation[place[r["vec_id"]]]
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
        assert r["identity_error"] < 1e-9
        mine[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
    signs = np.sign((mine * want).sum(0))
    assert np.abs(mine * signs - want).max() < 1e-9


def test_whitening_awkward(spark):
    schema = "vec_id long, embedding array<float>, n int, whitened string"
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None, 2.0]), (3, [nan, 0.0, 0.0]), (4, [inf, 0.0, 0.0]), (5, []), (6, [1.0])]
    good = [(BIG + 1, [0.5, 0.25, 0.0]), (BIG + 3, [0.0, 0.25, 0.5]), (None, [1.0, 0.25, 0.0]), (None, [1.0, 0.25, 0.0])]
    frame = lambda rows: spark.createDataFrame([(*r, 7, "x") for r in rows], schema).repartition(3)
    got = whitening.whiten(frame(bad + good)).collect()
    # the middle entry never changes: two components
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted((i or 0, c) for i, _ in good for c in (1, 2))
    assert all(r["n"] == 4 and r["identity_error"] < 1e-9 for r in got)
    assert whitening.whiten(frame(bad + good).limit(0)).count() == 0
    assert whitening.whiten(frame([(i, [1.0, 2.0]) for i in range(4)])).count() == 0  # no spread
    assert whitening.whiten(frame([(1, []), (2, [])])).count() == 0
    huge = whitening.whiten(frame([(1, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()
    assert len(huge) == 2 and all(r["deviation"] is None for r in huge)


# --- prefix trie --------------------------------------------------------------------------------------


def trie_plainly(rows):
    conv = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c in conv:
        conv[c] = [t[2:] for t in sorted(conv[c])]
    seq = {}
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 4
        seq[c] = tuple(conv.get(c - int(math.fmod(c, 20)), [])[:h] + conv[c][h:])
    nodes = collections.defaultdict(list)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
            leaves[p[:d]] += not children[p]
    sha = lambda m, p: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seq[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(m, p)) for p, m in nodes.items()), key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def assert_trie(df, per_shard):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.trie(df, per_shard)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie_plainly(rows)


@pytest.mark.parametrize("per_shard", [100_000, 30])
def test_trie(spark, per_shard):
    assert_trie(spark.read.parquet(f"{SF}/conversations.parquet"), per_shard)


def test_trie_awkward(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (2, 0, "", ""), (3, 5, "user", None), (-41, 0, "user", "x"), (-40, 0, "user", "y z"),
            (None, 0, "user", "nobody"), (40, 0, "user", "one " * 50_000), (41, 0, "user", "u"), (BIG, 0, "user", "u"), (BIG + 1, 0, "user", "u")]
    rows += [(100, i, "user", f"turn {i}") for i in range(700)] + [(101, i, "user", f"turn {i}") for i in range(650)]
    odd = spark.createDataFrame([(*r, 1, b"") for r in rows], TURNS + ", depth int, name binary")
    for per_shard in (100_000, 100):
        assert_trie(odd, per_shard)
    assert prefix_trie.trie(odd.limit(0)).count() == 0
    assert prefix_trie.trie(odd.where("conv_id is null")).count() == 0


def test_trie_hot_groups(spark):
    """Thousands of equal conversations, thousands that share their first turns, over many shards."""
    rows = [(c, i, "user", f"same {i}") for c in range(6000) for i in range(5)]
    rows += [(c, i, "user", f"same {i}" if i < 4 else f"own {c}") for c in range(10_000, 13_000) for i in range(6)]
    assert_trie(spark.createDataFrame(rows, TURNS), 500)


def test_medians_and_tree():
    assert sorted(prefix_trie.medians(10)) == list(range(10)) and next(prefix_trie.medians(10)) == 5
    tree = prefix_trie.Tree()
    seqs = [[i] for i in range(1023)]
    for i in prefix_trie.medians(len(seqs)):
        tree.insert(seqs[i])

    def height(at):
        return 0 if at < 0 else 1 + max(height(tree.left[at]), height(tree.right[at]))

    assert height(tree.down[0]) == 10
