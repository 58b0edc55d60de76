"""Order-dependent building blocks that do not put a whole group into one task.

A window over one key is processed by one task, so a key holding a large share of the rows would stall
the job. Each helper here cuts a group into ranges or buckets of its order value, works inside them, and
carries a one-row summary of each across them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.session import stored

def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], number: str = "n", total: str | None = None
) -> DataFrame:
    """``row_number`` within ``keys``, optionally with the group's row count.

    The rows are sorted into ranges of (keys, order) whose boundaries are measured, so a large group lies in many ranges
    and a range holds many small groups. A row's place in its range is known there; one row per range and group carries
    the numbers across. The ranges are stored, for both readings have to see the same ones.
    """
    by = [*[F.col(k) for k in keys], *order]
    # Stored before, too: the boundaries are measured in a run of their own, which would compute the rows once more.
    ranged = stored(df, "to-number").repartitionByRange(*by).sortWithinPartitions(*by)
    rows = stored(ranged.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_place")), "numbered")
    names = [f"_k{i}" for i in range(len(keys))]
    sizes = rows.groupBy(F.col("_range").alias("_r"), *[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    group = Window.partitionBy(*names)
    before = F.coalesce(F.sum("_size").over(group.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(
        *names, "_r", (before + 1 - F.col("_first")).alias("_shift"), F.sum("_size").over(group).alias("_total")
    )
    same = F.col("_range") == F.col("_r")
    for k, n in zip(keys, names):
        same = same & rows[k].eqNullSafe(F.col(n))
    out = rows.join(offsets, same).withColumn(number, (F.col("_place") + F.col("_shift")).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop(*names, "_range", "_place", "_r", "_shift", "_total")


def keep_first(
    df: DataFrame, keys: Sequence[str], same: Column, order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Of the rows equal in ``same`` within ``keys``, the one lowest in ``order``.

    An aggregate, not a window: equal rows are combined before the shuffle, and a large group spreads
    over its distinct values. Where ``columns`` begin with ``order`` the rows are shuffled without a copy of it.
    """
    row = F.struct(*columns)
    first = F.min(row) if tuple(columns[: len(order)]) == tuple(order) else F.min_by(row, F.struct(*order))
    return df.groupBy(*keys, same.alias("_same")).agg(first.alias("_row")).select(*keys, "_row.*")


def ordered_concat(
    df: DataFrame, keys: Sequence[str], order: str, value: str, separator: str, name: str = "text"
) -> DataFrame:
    """Join a group's strings in order, first within buckets of the order value, then across them."""
    part = df.withColumn("_b", F.floor(F.col(order) / 10_000))

    def joined(pairs: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["v"]), separator)

    inner = part.groupBy(*keys, "_b").agg(
        joined(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(value, F.lit("")).alias("v")))).alias("_t"),
        F.count(F.lit(1)).alias("_n"),
    )
    return inner.groupBy(*keys).agg(
        joined(F.collect_list(F.struct(F.col("_b").alias("o"), F.col("_t").alias("v")))).alias(name),
        F.sum("_n").alias("n_parts"),
    )
