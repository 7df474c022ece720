"""Pieces that land, change and go: redo what is not done yet, by digest.

A *piece* is one file, or the files of one folder, that hold records.  The ledger has a line for every piece and
content that was worked off, with the size and time of its files; a line that is torn is none.  A sweep looks at the listing
first: only pieces whose size or time moved are read for a digest of their rows, and only those whose digest is not in
the ledger are worked off.  Results are written below ``piece=../digest=..`` and become visible by
the line that is appended afterwards; so a run that dies leaves nothing half done, and a piece that changes replaces its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.session import exists, written
from tallymark.sources.lineage import table_digest

LINE = "piece string, bytes long, modified string, digest string, at long"
#: A folder ``piece=name`` of files.
PIECE = r"piece=([^/]+)/"


def _piece(path: str | Column, pattern: str) -> Column:
    return F.regexp_extract(path, pattern, 1).alias("piece")


def read_pieces(spark: SparkSession, path: str, schema, fmt: str = "parquet", pattern: str = PIECE) -> DataFrame:
    """The records of a landing folder with the name of their piece."""
    rows = spark.read.schema(schema).format(fmt).load(path)
    return rows.select(*[c for c in rows.columns if c != "piece"], _piece("_metadata.file_path", pattern))


def listing(spark: SparkSession, path: str, pattern: str = PIECE) -> DataFrame:
    """``(piece, bytes, modified)`` from the names, sizes and times of files; nothing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(_piece("path", pattern), "length", "modificationTime").groupBy("piece").agg(
        F.sum("length").alias("bytes"), F.max("modificationTime").cast("string").alias("modified")
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole line of each piece."""
    if not exists(spark, path):
        return spark.createDataFrame([], LINE)
    lines = spark.read.text(path).select(F.from_json("value", LINE).alias("l")).select("l.*")
    whole = lines.where("piece is not null and digest is not null and at is not null")
    newest = whole.groupBy("piece").agg(F.max_by(F.struct("bytes", "modified", "digest", "at"), "at").alias("n"))
    return newest.select("piece", "n.*")


def _append(lines: DataFrame, path: str) -> None:
    at = F.unix_micros(F.current_timestamp()).alias("at")
    line = F.to_json(F.struct("piece", "bytes", "modified", "digest", at))
    lines.select(line.alias("value")).coalesce(1).write.mode("append").text(path)


def sweep(
    records: DataFrame, listed: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, ledger: str
) -> DataFrame:
    """Work off what is new or has changed; ``(piece, bytes, modified, digest)`` of the pieces that were.

    ``transform`` must keep the column ``piece``.
    """
    spark = records.sparkSession
    done = read_ledger(spark, ledger).select("piece", F.col("bytes").alias("_b"), F.col("modified").alias("_m"), F.col("digest").alias("_d"))
    moved = listed.join(done, "piece", "left").where("_d is null or _b <> bytes or _m <> modified")
    moved = written(moved, "moved")
    read = records.join(moved.select("piece"), "piece", "left_semi")
    digests = table_digest(read, ["piece"]).select("piece", F.col("sha256").alias("digest"))
    # a piece without records has the digest of none
    found = moved.join(digests, "piece", "left").withColumn("digest", F.coalesce("digest", F.lit("empty")))
    found = written(found, "digests")
    todo = found.where("_d is null or _d <> digest").drop("_b", "_m", "_d")
    if not todo.isEmpty():
        work = records.join(todo.select("piece"), "piece", "left_semi")
        made = transform(work).join(todo.select("piece", "digest"), "piece")
        made.write.partitionBy("piece", "digest").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(out)
    # the commit; pieces that were only touched get a line, too, so that they are not read again
    _append(found.select("piece", "bytes", "modified", "digest"), ledger)
    return todo


def current(spark: SparkSession, out: str, ledger: str, listed: DataFrame) -> DataFrame:
    """The results of the pieces that are there, in the content the ledger names last."""
    live = read_ledger(spark, ledger).join(listed.select("piece"), "piece", "left_semi").select("piece", "digest")
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(out)
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("piece", "digest")})
    return rows.join(live, ["piece", "digest"], "left_semi").drop("digest")
