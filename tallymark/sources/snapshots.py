"""Dated snapshots that are there as a whole or not at all.

Data is written to a folder of its own for each attempt, checked, and then named by one row of the manifest, which is the
commit.  Readers join the manifest, so what a killed or refused attempt left behind is never seen, and partitions
of other snapshots are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.session import exists

MANIFEST = "snapshot string, attempt string, n_rows bigint, at timestamp"


class SnapshotError(ValueError):
    """A snapshot is there already, failed its check, or none is finished."""


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The finished snapshots."""
    path = f"{root}/manifest"
    return spark.read.schema(MANIFEST).parquet(path) if exists(spark, path) else spark.createDataFrame([], MANIFEST)


def stage(df: DataFrame, root: str, snapshot: str) -> str:
    """Write ``df`` where no reader looks; the name of the attempt."""
    attempt = uuid.uuid4().hex
    df.write.parquet(f"{root}/data/snapshot={snapshot}/attempt={attempt}")
    return attempt


def publish(df: DataFrame, root: str, snapshot: str, least_rows: int = 1) -> None:
    """Stage ``df``, check that what was written can be read and has rows, and commit it.

    Raises:
        SnapshotError: the snapshot is published already, or has fewer than ``least_rows`` rows.
    """
    spark = df.sparkSession
    if not manifest(spark, root).where(F.col("snapshot") == snapshot).isEmpty():
        raise SnapshotError(f"snapshot {snapshot} is published already")
    attempt = stage(df, root, snapshot)
    n = spark.read.schema(df.schema).parquet(f"{root}/data/snapshot={snapshot}/attempt={attempt}").count()
    if n < least_rows:
        raise SnapshotError(f"snapshot {snapshot} has {n} rows, fewer than {least_rows}")
    row = spark.range(1).select(F.lit(snapshot).alias("snapshot"), F.lit(attempt).alias("attempt"), F.lit(n).cast("bigint").alias("n_rows"), F.current_timestamp().alias("at"))
    row.write.mode("append").parquet(f"{root}/manifest")


def read_published(spark: SparkSession, root: str, newest: bool = False) -> DataFrame:
    """The rows of all finished snapshots, or of the newest, with the column ``snapshot``.

    Of a snapshot that two writers published at once, the first commit counts.
    """
    done = manifest(spark, root).groupBy("snapshot").agg(F.min_by("attempt", F.struct("at", "attempt")).alias("attempt"))
    if newest:
        done = done.orderBy(F.desc("snapshot")).limit(1)
    if done.isEmpty():
        raise SnapshotError("no finished snapshot")
    rows = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data")
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("snapshot", "attempt")})
    return rows.join(F.broadcast(done), ["snapshot", "attempt"], "left_semi").drop("attempt")
