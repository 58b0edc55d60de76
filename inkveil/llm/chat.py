"""Collapsing logged conversation snapshots and rendering what remains.

A log often holds a conversation once per turn, each snapshot a prefix of the next. Turns are hashed, rolling
sums of the hashes name every prefix, and a conversation goes if a longer one has its name among its own proper
prefixes (an anti-join). Of equal conversations the smallest id stays.

Turn numbers and sums run inside blocks and are carried over by one row per block, so one conversation with
very many turns is spread over tasks; copies of a conversation are reduced to one name before any join.
Long conversations are rendered in segments of SEGMENT turns, to be read one after the other.

Defined results: turns are in the order of ``turn`` (null first), equal ones by role and text; a null conv_id is a
conversation of its own, the smallest; null roles and texts differ from empty ones when compared, and are empty
when rendered. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import stored

SEGMENT = 1000
_BLOCK = 1024  # consecutive values of ``turn`` that are numbered together
_NAMES = ["s1", "s2"]
_SUM = "decimal(38,0)"


def _turn_hash(seed: int) -> Column:
    """Depends on the turn's place, so that plain sums over turns name a prefix: order and content count."""
    return F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text").cast(_SUM)


def _numbered(turns: DataFrame) -> DataFrame:
    """conv_id, role, text and ``place`` from 0, in order."""
    blocks = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.floor(F.col("turn") / _BLOCK).alias("block"))
    # Many equal turn values are split further by a hash of what they hold, which is part of their order.
    part = F.when(F.col("turn").isNull(), F.pmod(F.xxhash64("role", "text"), F.lit(64))).otherwise(F.lit(0)).alias("part")
    blocks = blocks.select("*", part)
    inside = Window.partitionBy("conv_id", "block", "part").orderBy("turn", "role", "text")
    across = Window.partitionBy("_c").orderBy("_b", "_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.col("part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_c", "_b", "_p", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    rows = blocks.withColumn("_at", F.row_number().over(inside) - 1)
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b")) & (F.col("part") == F.col("_p"))
    return rows.join(before, same).select("conv_id", "role", "text", (F.col("_at") + F.col("_before")).cast("long").alias("place"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place, s1, s2: the name of the prefix that ends at each place."""
    block = F.floor(F.col("place") / _BLOCK).alias("block")
    hashed = turns.select("conv_id", "place", block, *[_turn_hash(i).alias(n) for i, n in enumerate(_NAMES)])
    across = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.groupBy(F.col("conv_id").alias("_c"), F.col("block").alias("_b")).agg(*[F.sum(n).cast(_SUM).alias(n) for n in _NAMES])
    before = sums.select("_c", "_b", *[F.coalesce(F.sum(n).over(across), F.lit(0)).cast(_SUM).alias(f"_{n}") for n in _NAMES])
    rows = hashed.select("conv_id", "place", "block", *[F.sum(n).over(inside).cast(_SUM).alias(n) for n in _NAMES])
    joined = rows.join(before, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    return joined.select("conv_id", "place", *[(F.col(n) + F.col(f"_{n}")).cast(_SUM).alias(n) for n in _NAMES])


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that no longer one begins with, one of equal ones; rows of ``turns``
    are numbered in ``place``. Returns the numbered turns of those conversations."""
    numbered = stored(_numbered(turns), "chat-turns")
    prefixes = stored(_prefixes(numbered), "chat-prefixes")
    ends = numbered.groupBy(F.col("conv_id").alias("_c")).agg(F.max("place").alias("_last"))
    marked = prefixes.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")))
    name = ["place", *_NAMES]
    whole = marked.where(F.col("place") == F.col("_last")).groupBy(*name).agg(F.min(F.struct(F.col("conv_id").alias("conv_id"))).alias("one"))
    inner = marked.where(F.col("place") < F.col("_last")).select(*name).distinct()
    kept = whole.join(inner, name, "left_anti").select(F.col("one.conv_id").alias("_c"), (F.col("place") + 1).alias("n_turns"))
    return numbered.join(kept, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, segment, n_turns (of the conversation), text: the maximal conversations in chat markup."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    rows = maximal(turns).select("conv_id", "n_turns", F.floor(F.col("place") / SEGMENT).alias("segment"), F.struct("place", line.alias("line")).alias("r"))
    parts = rows.groupBy("conv_id", "n_turns", "segment").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return parts.select("conv_id", "segment", "n_turns", F.array_join("r.line", "").alias("text"))
