"""Near-duplicate documents by SetSketch.

Every document's set of five-word shingles is reduced to registers holding exponentially spaced, truncated
minima: the register of the union of two sets is the larger register, so sketches merge, and the share of
equal registers follows the Jaccard similarity. Bands of register values bring similar documents together;
pairs that meet are judged by the maximum-likelihood estimate of their similarity from all registers, and
what may be similar enough is confirmed on the full shingle sets.

With 128 registers in 32 bands of four, two sets at similarity 0.85 share no band once in 10^10 pairs, and
the estimate is five standard errors below it for a pair to be passed over.

No group is expanded into pairs. Equal sets are one class from the start. In every band bucket the smallest class
meets all others (links in a star), components are found, and only buckets that still hold several components are
searched on, in blocks whose sketches are compared inside a task. A pair is looked at once, in the bucket of the first
band it shares. A task hands on no pairs but the members that may have a partner; these meet again with their full
sets, are verified there and joined in sets of components, so that a block of any similarity hands out fewer links
than it has members. So no link that joins components is lost, and output stays small for a bucket of any size.

Defined results: null or wordless texts have no shingles and are linked with nothing; a text of fewer than five words
is one shingle. A document is named by doc_id and text: rows equal in both are one document, and texts that share a
doc_id are judged each for itself and appear each with its own row. A null doc_id gets rows as well, is linked with
nothing, has no component and is kept. Ties do not arise: a component's name is its smallest doc_id. Columns other than
doc_id and text are not looked at, and are kept whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import discard, keyed, stored, text_key, unpacked
from inkveil.llm.components import components
from inkveil.llm.shingles import Hasher, mixed

REGISTERS, BANDS = 128, 32
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
PERCENT = 85
DOUBT = 0.16  # five standard errors of the estimate at 0.85
STEP = 1e-5
BLOCK, BLOCK_BYTES = 512, 32 << 20  # members and bytes of full sets of a block
SMALL_ROWS = 2048  # rows of small buckets that share a group
PAIRS_AT_ONCE = 1 << 15
PAIRS_PER_TASK = 50_000_000
NAMED_ROWS = 1 << 21  # up to here the names of wanted documents are broadcast, about 24 bytes each


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (sets x REGISTERS, uint16) of sorted distinct hash arrays.

    Each element sends ascending exponential points to random registers; it stops at the first point above
    all minima of its set, so elements of large sets send about one point each.
    """
    n = len(sets)
    low = np.full(n * REGISTERS, np.inf)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    element = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    point = np.zeros(len(element))
    turn = 0
    while len(element):
        bits = mixed(element, 1000 + turn)
        point = point - np.log(((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / (RATE * REGISTERS)
        # The register comes from the low bits, which the 53 bits of the step leave out in part: mix again.
        register = (mixed(bits, 7) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(low, owner * REGISTERS + register, point)
        bound = low.reshape(n, REGISTERS).max(axis=1)
        go = point < bound[owner]
        element, owner, point = element[go], owner[go], point[go]
        turn += 1
    with np.errstate(divide="ignore"):
        value = np.floor(1.0 - np.log(low) / np.log(BASE))
    return np.clip(value, 0, TOP + 1).astype(np.uint16).reshape(n, REGISTERS)


def _likelihood(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
    """The log-likelihood of a similarity per row, from the numbers of larger, smaller and equal registers; and its upper end."""
    more, less = np.count_nonzero(a > b, axis=1), np.count_nonzero(a < b, axis=1)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1.0 - u
    part = lambda x: -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / np.log(BASE)
    tiny = 1e-12

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = part(u - v * j), part(v - u * j)
        return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))

    return likelihood, np.minimum(u / v, v / u)


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity per row."""
    likelihood, high = _likelihood(a, b, size_a, size_b)
    low = np.zeros(len(high))
    for _ in range(30):  # the likelihood has one maximum
        one, two = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(one) > likelihood(two)
        low, high = np.where(left, low, one), np.where(left, two, high)
    return (low + high) / 2


def likely(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the estimate reaches ``PERCENT`` less ``DOUBT``: as there is one maximum, the likelihood then still rises there."""
    likelihood, high = _likelihood(a, b, size_a, size_b)
    at = np.full(len(high), PERCENT / 100 - DOUBT)
    return (high >= at) & (likelihood(at + STEP) >= likelihood(at - STEP))


def _registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def _names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over mixed hashes, which with the size name a set."""
    one, two = ([mixed(s, seed).sum(dtype=np.uint64) for s in sets] for seed in (11, 12))
    return np.array(one, np.uint64).view(np.int64), np.array(two, np.uint64).view(np.int64)


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = Hasher()
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.iloc[at : at + 64]
            sets = [hasher.shingles(t) for t in part["text"]]
            f1, f2 = _names(sets)
            yield pd.DataFrame({
                "doc_id": part["doc_id"].array,
                "key": part["key"].array,
                "n_shingles": [len(s) for s in sets],
                "f1": f1,
                "f2": f2,
                "regs": [r.tobytes() for r in sketch(sets)],
            })


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id and key, which name a document, n_shingles, the set's name (f1, f2) and its registers."""
    # As text: an id beside a null would travel as a rounded number.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    drawn = rows.mapInPandas(_sketches, "doc_id string, key long, n_shingles long, f1 long, f2 long, regs binary")
    return drawn.withColumn("doc_id", F.col("doc_id").cast("long"))


def _band_hashes(regs: np.ndarray) -> np.ndarray:
    """Rows x BANDS hashes of band number and register values."""
    regs = regs.astype(np.uint64).reshape(len(regs), BANDS, -1)
    h = mixed(np.broadcast_to(np.arange(BANDS, dtype=np.uint64), regs.shape[:2]), 5)
    for k in range(regs.shape[2]):
        h = mixed(h + regs[:, :, k], k)
    return h.view(np.int64)


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), BANDS), "bucket": _band_hashes(_registers(batch["regs"])).ravel()})


def _likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            na, nb = batch["na"].to_numpy(float), batch["nb"].to_numpy(float)
            good = likely(_registers(batch["ra"]), _registers(batch["rb"]), na, nb)
            yield batch.loc[good, ["a", "b"]]


def _meetings(group: pd.DataFrame, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (x, y) of the likely pairs of a group sorted by bucket and block, in bounded portions: members of
    blocks i and j of one bucket, in different components, that share no band before the bucket's."""
    regs, n = _registers(group["regs"]), group["n"].to_numpy(float)
    bucket, block, comp = group["bucket"].to_numpy(), group["block"].to_numpy(), group["component"].to_numpy()
    band = (_band_hashes(regs) == bucket[:, None]).argmax(axis=1)
    rows = np.arange(len(group))
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(group))
    run = np.searchsorted(ends, rows, side="right")
    # Partners are the rows of block j behind a row of block i: j's rows are the last of the bucket.
    partner = np.append(np.where(block == j, rows, len(group)), len(group))
    first = np.minimum.accumulate(partner[::-1])[::-1][rows + 1]
    count = np.where(block == i, np.maximum(ends[run] - first, 0), 0)
    total, at = np.cumsum(count), 0
    while at < len(group):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        c = count[at:upto]
        x = np.repeat(rows[at:upto], c)
        y = np.repeat(first[at:upto] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        at = upto
        apart = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) * 100 >= PERCENT * np.maximum(n[x], n[y]))
        x, y = x[apart], y[apart]
        shared = (regs[x] == regs[y]).reshape(len(x), BANDS, REGISTERS // BANDS).all(axis=2).argmax(axis=1)
        x, y = x[shared == band[x]], y[shared == band[x]]
        good = likely(regs[x], regs[y], n[x], n[y])
        yield x[good], y[good]


def _with_partners(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """The members of a group that have a likely partner in it."""
    group = group.sort_values(["bucket", "block"], ignore_index=True)
    seen = np.zeros(len(group), bool)
    for x, y in _meetings(group, int(key[1]), int(key[2])):
        seen[x] = seen[y] = True
    return group.loc[seen, ["slot", "i", "j", "bucket", "block", "id"]]


def _verified(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Links of a group, verified on the full sets, as far as they join components that no earlier one has joined."""
    group = group.sort_values(["bucket", "block"], ignore_index=True)
    ids = group["id"].to_numpy()
    sets = [np.frombuffer(h, np.uint64) for h in group["hashes"]]
    names, comp = np.unique(group["component"].to_numpy(), return_inverse=True)
    above = np.arange(len(names))

    def top(c: int) -> int:
        while above[c] != c:
            above[c] = above[above[c]]
            c = above[c]
        return c

    found = []
    for x, y in _meetings(group, int(key[1]), int(key[2])):
        for p, q in zip(x.tolist(), y.tolist()):
            one, two = top(comp[p]), top(comp[q])
            if one != two:
                small, large = sorted((sets[p], sets[q]), key=len)
                at = np.searchsorted(large, small)
                both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
                if 100 * both >= PERCENT * (len(small) + len(large) - both):
                    above[max(one, two)] = min(one, two)
                    found.append((ids[p], ids[q]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = Hasher()
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.iloc[at : at + 64]
            sets = [hasher.shingles(t) for t in part["text"]]
            f1, f2 = _names(sets)
            right = (f1 == part["f1"].to_numpy()) & (f2 == part["f2"].to_numpy())  # not another text of the same doc_id
            yield pd.DataFrame({"id": part["id"].array, "hashes": [s.tobytes() for s in sets]}).loc[right]


def texts_of(wanted: DataFrame, docs: DataFrame, bound: int = NAMED_ROWS) -> DataFrame:
    """doc and text of the documents named in ``wanted``. Where these are few, texts of others are left out where they
    stand, before anything is shuffled; where there are too many names for a broadcast, the join deals out all texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    if wanted.count() <= bound:
        texts = texts.join(F.broadcast(wanted.select("doc").distinct()), "doc", "left_semi")
    return texts


def full_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """id and hashes, the whole shingle set, of some classes: only the texts of their smallest doc_ids are shingled again."""
    wanted = stored(classes.join(ids, "id", "left_semi").select("id", "doc", "f1", "f2"), "dedup-wanted")
    texts = texts_of(wanted, docs).join(wanted, "doc").select("id", "f1", "f2", "text")
    return stored(texts.mapInPandas(_sets, "id long, hashes binary").dropDuplicates(["id"]), "dedup-sets")


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        for k, (x, y) in enumerate(zip(batch["ha"], batch["hb"])):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[k] = 100 * both >= PERCENT * (len(x) + len(y) - both)
        yield batch.loc[keep, ["a", "b"]]


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    sets = full_sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), classes, docs)
    joined = pairs.join(sets.toDF("b", "hb"), "b").join(sets.toDF("a", "ha"), "a")
    links = stored(joined.mapInPandas(_linked, "a long, b long"), "dedup-links")
    discard(sets)
    return links


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between classes that give the same components as all links would.

    ``classes``: id, doc, n, f1, f2, regs; one row per distinct shingle set.
    """
    bands = stored(classes.mapInPandas(_bands, "id long, bucket long"), "dedup-bands")
    buckets = bands.groupBy("bucket").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(bands.join(buckets, "bucket").select("bucket", "id", "first"), "dedup-shared")
    discard(bands)
    star = shared.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    sized = star.join(side("b"), "b").join(side("a"), "a").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    first = confirmed(stored(sized.mapInPandas(_likely, "a long, b long"), "dedup-star"), classes, docs)

    labels = components(first)
    marked = classes.join(labels, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    members = stored(shared.select("bucket", "id").join(marked, "id"), "dedup-members")
    discard(shared)
    size, weight = F.count(F.lit(1)), F.sum("n") * 8
    mixed_up = stored(
        members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), size.alias("size"), weight.alias("bytes"))
        .where("low <> high")
        .select("bucket", "size", "bytes", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")),
        "dedup-mixed",
    )
    small = mixed_up.where("blocks = 1").agg(F.sum("size"), F.sum("bytes")).first()
    slots = max(1, (small[0] or 0) // SMALL_ROWS, (small[1] or 0) // BLOCK_BYTES)
    pairs = mixed_up.agg(F.sum(F.col("size").cast("double") * F.col("size"))).first()[0] or 0
    # As many tasks as there is work: the rows are small, so that their bytes would say too little.
    tasks = max(int(mixed_up.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs / 2 / PAIRS_PER_TASK))
    # Buckets of one block share groups; a larger bucket has groups of its own, named by itself beside -1.
    slot = F.struct(F.when(F.col("blocks") == 1, F.pmod("bucket", F.lit(slots))).otherwise(-1).alias("at"), F.when(F.col("blocks") > 1, F.col("bucket")).alias("own"))
    spread = members.join(mixed_up.select("bucket", "blocks"), "bucket").withColumns({"slot": slot, "block": F.pmod(F.xxhash64("id"), "blocks").cast("int")})
    dealt = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select(
        F.to_json("slot").alias("slot"), "i", "j", "bucket", "block", "id", "n", "component"
    )
    regs = classes.select("id", "regs")
    names = ["slot", "i", "j"]
    partners = stored(
        dealt.join(regs, "id").repartition(tasks, *names).groupBy(*names)
        .applyInPandas(_with_partners, "slot string, i int, j int, bucket long, block int, id long"),
        "dedup-partners",
    )
    sets = full_sets(partners.select("id").distinct(), classes, docs)
    full = stored(sets.join(marked, "id").join(regs, "id"), "dedup-full")
    discard(sets)
    rest = partners.join(full, "id").repartition(tasks, *names).groupBy(*names).applyInPandas(_verified, "a long, b long")
    second = stored(rest.distinct(), "dedup-rest")
    for table in (members, partners, full):
        discard(table)
    return first.union(second)


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, key, copies, n_shingles, group, component_id; one row per document. ``group`` tells groups apart that a
    repeated doc_id gives the same name; it is null without words or doc_id."""
    drawn = stored(sketches(docs), "dedup-sketches")
    # The registers follow from the set, so any row's will do. The numbers are fixed by the table they are stored in.
    classes = stored(
        drawn.where("doc_id is not null and n_shingles > 0").groupBy("f1", "f2", F.col("n_shingles").alias("n"))
        .agg(F.any_value("regs").alias("regs"), F.min("doc_id").alias("doc"))
        .withColumn("id", F.monotonically_increasing_id()),
        "dedup-classes",
    )
    found = stored(components(links(classes, docs)), "dedup-components")
    members = classes.select("id", "f1", "f2", F.col("n").alias("n_shingles"), "doc").join(found, "id", "left")
    smallest = members.where("component is not null").groupBy("component").agg(F.min("doc").alias("least"))
    named = members.join(smallest, "component", "left").select(
        "f1", "f2", "n_shingles", F.coalesce("component", "id").alias("_group"), F.coalesce("least", "doc").alias("_name")
    )
    sets = [F.min(c).alias(c) for c in ("n_shingles", "f1", "f2")]
    rows = drawn.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("copies"), *sets)
    there = F.col("doc_id").isNotNull()
    return rows.join(named, ["f1", "f2", "n_shingles"], "left").select(
        "doc_id", "key", "copies", "n_shingles",
        F.when(there, F.col("_group")).alias("group"),
        F.when(there, F.coalesce("_name", "doc_id")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per document (doc_id and text)."""
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return _judged(docs).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that their group keeps: one document, that of the smallest doc_id (of several texts under
    it the one with the smallest key), as one row. Documents without words stay as one row each, null ids with all rows."""
    judged = stored(_judged(docs).where("doc_id is not null"), "dedup-judged")
    name = F.struct("doc_id", "key")
    first = judged.where("group is not null").groupBy("group").agg(F.min(name).alias("first"))
    gone = judged.join(first, "group").where(name != F.col("first"))
    names = lambda t: t.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    kept = keyed(docs).join(names(gone), ["_id", "_key"], "left_anti")
    repeated = names(judged.where("copies > 1"))
    once = kept.join(repeated, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select("_row")
    rest = kept.join(repeated, ["_id", "_key"], "left_anti").select("_row")
    return unpacked(rest.union(once), docs.columns)
