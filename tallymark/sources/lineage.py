"""What a run was made from: a digest per rule file, written by the run, checked by its readers.

A digest is a sum over rows, so it is combined on the map side, needs no order and no list of rows, and
still tells a repeated row from a single one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.contracts import freshness
from tallymark.session import exists
from tallymark.sources.rules import RuleBook

LINEAGE = "file string, version int, sha256 string"
#: Hex digits of a row's hash that are summed as one number, and how many such numbers there are.
PART, PARTS = 8, 8


class StaleOutput(RuntimeError):
    """An output was made from rules that are no longer the current ones."""


def table_digest(rows: DataFrame, by: Sequence[str], leave: Sequence[str] = ()) -> DataFrame:
    """``(*by, n_rows, sha256)``: a digest of each group's rows as a multiset.

    A row counts with all its columns, by name, each ``-`` or its length in bytes, ``:`` and its value; those
    in ``by`` and ``leave`` do not.
    """
    names = sorted(c for c in rows.columns if c not in (*by, *leave))
    said = [F.col(c).cast("string") for c in names]
    line = F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said])
    hashed = rows.select(*by, F.sha2(line, 256).alias("_h"))
    sums = [F.sum(F.conv(F.substring("_h", 1 + PART * i, PART), 16, 10).cast("bigint")).alias(f"_s{i}") for i in range(PARTS)]
    total = hashed.groupBy(*by).agg(F.count("*").alias("n_rows"), *sums)
    digest = F.sha2(F.concat_ws(",", F.col("n_rows").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(PARTS)]), 256)
    return total.select(*by, "n_rows", digest.alias("sha256"))


def book_lineage(spark: SparkSession, book: RuleBook) -> DataFrame:
    """``(file, version, sha256)`` of the dictionaries of a rule book."""
    schema = "dictionary string, category string, role string, idx int, kind string, case_sensitive boolean, pattern string"
    versions = spark.createDataFrame([*book.versions], "file string, version int")
    digests = table_digest(spark.createDataFrame(book.rows(), schema), ["dictionary"]).withColumnRenamed("dictionary", "file")
    return digests.join(F.broadcast(versions), "file", "left").select("file", "version", "sha256")


def write_lineage(lineage: DataFrame, out: str) -> None:
    lineage.coalesce(1).write.mode("errorifexists").parquet(f"{out}/lineage")


def check_lineage(spark: SparkSession, out: str, current: DataFrame) -> DataFrame:
    """``(file, version, state)`` of each rule file that the run at ``out`` recorded.

    The one state of an output that recorded nothing is ``unrecorded``: a number that cannot be verified is not a verified one.
    """
    if not exists(spark, f"{out}/lineage"):
        return spark.createDataFrame([(None, None, "unrecorded")], "file string, version int, state string")
    return freshness(spark.read.parquet(f"{out}/lineage"), current)


def read_current(spark: SparkSession, out: str, name: str, book: RuleBook, stale_ok: bool = False) -> DataFrame:
    """The table ``name`` of the run at ``out``, if it was made from the rules of ``book``.

    Raises:
        StaleOutput: the rules have changed or gone since, or the run recorded none; not with ``stale_ok``.
    """
    if not stale_ok:
        bad = check_lineage(spark, out, book_lineage(spark, book)).where("state <> 'current'").orderBy("file").collect()
        if bad:
            raise StaleOutput(f"{out}: " + "; ".join(f"{r['file']} v{r['version']}: {r['state']}" for r in bad))
    return spark.read.parquet(f"{out}/{name}/data")
