"""Top-k per group and numbered listings that do not gather a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.joins import small
from tallymark.session import durable


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, position: str, salts: int = 64
) -> DataFrame:
    """The first ``k`` rows of every group, numbered.

    A group is first cut to its ``k`` best within each of ``salts`` pieces, so a group that
    holds most of the table is ranked by many tasks and only ``k * salts`` rows meet.
    The cut is exact: a row among the first ``k`` of its group is so in its piece.
    """
    piece = Window.partitionBy(*keys, "_salt").orderBy(*order)
    group = Window.partitionBy(*keys).orderBy(*order)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    return (
        df.withColumn("_salt", salt)
        .withColumn(position, F.row_number().over(piece))
        .where(F.col(position) <= k)
        .drop("_salt")
        .withColumn(position, F.row_number().over(group))
        .where(F.col(position) <= k)
    )


def numbered(
    df: DataFrame, order: list[str], position: str, by: list[str] | None = None, partitions: int = 0
) -> DataFrame:
    """Number all rows in ``order`` (within ``by``) without a one-task sort.

    Rows are range-partitioned and sorted once and written to the checkpoint folder, so
    the numbering cannot shift if a task is retried.  Each row's place inside its partition
    plus the sizes of the partitions before it is its number; only those sizes, one row per
    partition and group, are gathered.
    """
    by = by or []
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    placed = durable(
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", 33))
    )
    sizes = placed.groupBy("_part", *by).agg(
        F.count("*").alias("_n"), F.min("_place").alias("_start")
    )
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    on = reduce(
        lambda a, b: a & b,
        [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ["_part", *by]],
    )
    number = F.col("o._before") + F.col("r._place") - F.col("o._start") + 1
    return placed.alias("r").join(small(offsets).alias("o"), on).select(
        *[F.col(f"r.{c}") for c in df.columns], number.alias(position)
    )


def first_offenders(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """A short listing to act on, each row with the exact total it is a sample of."""
    total = df.agg(F.count("*").alias("n_total")).withColumn("_one", F.lit(1))
    head = df.orderBy(*order).limit(k).withColumn("_one", F.lit(1))
    return head.join(F.broadcast(total), "_one").drop("_one")
