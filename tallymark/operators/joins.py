"""Join helpers: size-checked broadcast, set differences, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a lookup may have to be sent to every executor (rule tables hold hundreds).
BROADCAST_ROWS = 200_000


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the side is known to be small.

    The check reads at most ``max_rows + 1`` rows.  A larger side keeps no hint, so the
    join shuffles on its key and adaptive execution splits hot keys.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def same(*columns: str):
    """Null-safe equality between sides ``a`` and ``b`` on every named column."""
    return reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns])


def one_row(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in ``order``, then by its other columns; joined on ``key`` it cannot multiply the other side."""
    rest = [c for c in df.columns if c != key]
    by = [*order, *[c for c in rest if c not in order]]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return first.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def key_differences(a: DataFrame, b: DataFrame, keys, names=("a", "b")) -> DataFrame:
    """Keys on one side only, with the side that has them; one join, both directions."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    left = a.select(*keys).distinct().withColumn("_l", F.lit(1))
    right = b.select(*keys).distinct().withColumn("_r", F.lit(1))
    only = F.when(F.col("_r").isNull(), names[0]).when(F.col("_l").isNull(), names[1])
    return left.join(right, keys, "full_outer").select(*keys, only.alias("only_in")).where(
        "only_in is not null"
    )


def unequal_counts(a: DataFrame, b: DataFrame, keys, left: str, right: str) -> DataFrame:
    """Keys whose counts differ between two tables; an absent row counts zero."""
    return (
        a.join(b, keys, "full_outer")
        .select(*keys, F.coalesce(left, F.lit(0)).alias(left), F.coalesce(right, F.lit(0)).alias(right))
        .where(F.col(left) != F.col(right))
    )


def or_zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))
