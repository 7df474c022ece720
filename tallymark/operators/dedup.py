"""Keep-first de-duplication that survives one id holding a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.joins import same

#: Keys longer than this, such as whole texts, are shuffled and compared as their SHA-256.
LONG_KEY = 64


def _slim(key: str) -> Column:
    """The key as text, blank if null; a long one by its digest, which is longer than any key left as it is."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.when(F.length(text) > LONG_KEY, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per ``key`` in ``order``, which must identify a row.

    Blank and null keys count as copies of each other.  The winners are found by a
    minimum over the order columns alone, which combines on the map side, so a hot key
    sends one slim row per task; the full rows then meet them on the winning position,
    which is unique and cannot be skewed.
    """
    keyed = df.withColumn("_key", _slim(key))
    winners = keyed.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"))
    first = winners.select("_key", "_first.*")
    return keyed.alias("a").join(first.alias("b"), same("_key", *order), "left_semi").drop("_key")


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Rows in, distinct ids and the copies a keep-first pass would drop."""
    per_id = df.groupBy(_slim(key).alias("_id")).agg(F.count("*").alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_unique")
    ).withColumn("n_duplicates", F.col("n_rows") - F.col("n_unique"))


def reconcile_capture(df: DataFrame, key: str, requested: DataFrame) -> DataFrame:
    """Fetched, unique, copies, shortfall and whether unique equals what was expected.

    ``requested`` is a manifest ``(requested, expected)`` of any number of slices; they add up.
    """
    counts = duplicate_count(df, key).withColumn("_one", F.lit(1))
    return counts.join(F.broadcast(requested.agg(F.sum("requested").alias("requested"), F.sum("expected").alias("expected")).withColumn("_one", F.lit(1))), "_one").select(
        F.col("n_rows").alias("fetched"),
        "n_unique",
        "n_duplicates",
        (F.col("requested") - F.col("n_rows")).alias("shortfall"),
        (F.col("n_unique") == F.col("expected")).alias("reconciles"),
    )
