"""Record and device tables: scans with checked columns, sinks with provenance."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.dedup import keep_first
from tallymark.operators.registry import DATE_COLUMN, DEVICE_COLUMNS

#: The flat record table (one row per paper), as a schema any reader takes.
RECORD_SCHEMA = (
    "pmid string, doi string, title string, abstract string, has_abstract boolean, "
    "abstract_structured boolean, abstract_sections int, journal string, journal_iso string, "
    "year int, year_source string, article_date_year int, pub_date_year int, "
    "publication_types array<string>, mesh_descriptors array<string>, "
    "mesh_major_descriptors array<string>, language string, languages array<string>, "
    "record_type string, source_file string"
)
LIST_COLUMNS = ("publication_types", "mesh_descriptors", "mesh_major_descriptors", "languages")
REQUIRED_RECORD_COLUMNS = ("pmid", "title", "abstract", "year", "record_type")
TOLERATED_DEVICE_COLUMNS = ("submission",)


class TableError(ValueError):
    """A table lacks, or has unexpected, columns or rows."""


def require(df: DataFrame, columns, exact: bool = False, tolerated=()) -> DataFrame:
    """Check column names; only the schema is looked at."""
    found = [c for c in df.columns if c not in tolerated]
    missing = [c for c in columns if c not in found]
    extra = [c for c in found if c not in columns] if exact else []
    if missing or extra:
        raise TableError(f"missing column(s): {missing}; unexpected column(s): {extra}")
    return df.select(*found)


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def header_of(spark: SparkSession, path: str, comment: str | None = None) -> list[str]:
    """Column names of a CSV, with a byte-order mark dropped."""
    reader = spark.read.option("header", True)
    if comment:
        reader = reader.option("comment", comment)
    return [c.lstrip("\ufeff") for c in reader.csv(path).columns]


def read_text_csv(
    spark: SparkSession, path: str, comment: str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with every column as text; blank cells stay blank.

    Files are split between tasks unless cells may hold line breaks (``multi_line``).
    """
    reader = (
        spark.read.schema(text_schema(header_of(spark, path, comment)))
        .option("header", True)
        .option("enforceSchema", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
    )
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def read_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Record table from parquet or CSV, id as text, required columns checked."""
    if path.rstrip("/").endswith(".csv"):
        df = read_text_csv(spark, path, multi_line=multi_line).withColumn("year", F.col("year").try_cast("int"))
    else:
        df = spark.read.parquet(path)
    return require(df, REQUIRED_RECORD_COLUMNS).withColumn("pmid", F.col("pmid").cast("string"))


def read_titles(records: DataFrame, order: list[str]) -> DataFrame:
    """Id, title and abstract only, first row per id."""
    slim = records.select(*dict.fromkeys(["pmid", "title", "abstract", *order]))
    return keep_first(slim, "pmid", order).select("pmid", "title", "abstract")


def read_commented_csv(spark: SparkSession, path: str, schema: str, required=None) -> DataFrame:
    """CSV with ``#`` header lines; must have its columns and at least one row."""
    columns = T.StructType.fromDDL(schema).fieldNames()
    found = header_of(spark, path, "#")
    missing = [c for c in (required or columns) if c not in found]
    if missing:
        raise TableError(f"{path}: missing required column(s): {', '.join(missing)}")
    typed = {f.name: f.dataType for f in T.StructType.fromDDL(schema).fields}
    full = T.StructType([T.StructField(c, typed.get(c, T.StringType())) for c in found])
    df = spark.read.option("comment", "#").option("header", True).schema(full).csv(path)
    if df.isEmpty():
        raise TableError(f"{path}: table has no rows")
    return df.select(*[c for c in columns if c in found])


def read_devices(spark: SparkSession, path: str) -> DataFrame:
    """Device list: all text, exactly the required columns once tolerated ones are dropped."""
    return require(
        read_text_csv(spark, path),
        [*DEVICE_COLUMNS, DATE_COLUMN],
        exact=True,
        tolerated=TOLERATED_DEVICE_COLUMNS,
    )


def typed_labeled(df: DataFrame) -> DataFrame:
    """Casts for a labeled device table read back as text; identifiers stay text."""
    flags = [c for c in ("counted", "code_overridden", "has_classification") if c in df.columns]
    return df.withColumns(
        {
            "year": F.col("year").try_cast("int"),
            **{c: F.lower(F.trim(F.col(c).cast("string"))) == "true" for c in flags},
        }
    )


def flat(records: DataFrame) -> DataFrame:
    """List columns joined on ``"; "`` for the CSV twin."""
    lists = [c for c in LIST_COLUMNS if c in records.columns]
    return records.withColumns({c: F.coalesce(F.concat_ws("; ", c), F.lit("")) for c in lists})


def write_records(records: DataFrame, path: str) -> None:
    """Parquet keeps the lists; the CSV beside it is for reading."""
    records.write.mode("errorifexists").parquet(f"{path}/parquet")
    flat(records).write.mode("errorifexists").option("header", True).csv(f"{path}/csv")


def write_table(df: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """A table and, beside it, what it was made from; data files carry no header lines."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    rows = [(path.rstrip("/").rsplit("/", 1)[-1], k, str(v)) for k, v in provenance.items()]
    notes = df.sparkSession.createDataFrame(rows, "output string, key string, value string")
    notes.coalesce(1).write.mode("errorifexists").parquet(f"{path}/provenance")


def run_metrics(**parts: DataFrame) -> DataFrame:
    """Aggregates as one ``(metric, key, value)`` table.

    Each part has a key column followed by a count column, or just a count.
    """
    out = None
    for name, part in parts.items():
        *keys, value = part.columns
        row = part.select(
            F.lit(name).alias("metric"),
            F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"),
            F.col(value).cast("bigint").alias("value"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def observed(df: DataFrame, name: str, metrics: dict[tuple[str, str], Column]) -> tuple[DataFrame, Observation]:
    """``df`` with counts that are taken while it is written; ``metrics`` by ``(metric, key)``."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    return df.observe(seen, *[F.coalesce(m, F.lit(0)).cast("bigint").alias("/".join(k)) for k, m in metrics.items()]), seen


def observed_metrics(spark: SparkSession, seen: Observation) -> DataFrame:
    """What was counted while the table was written, as ``(metric, key, value)``; waits for the write."""
    rows = [(*name.split("/", 1), value) for name, value in seen.get.items()]
    return spark.createDataFrame(rows, "metric string, key string, value bigint")


def write_snapshot(df: DataFrame, root: str, snapshot: str, column: str = "snapshot") -> None:
    """A dated capture, never written over: an existing one is an error."""
    df.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{column}={snapshot}")
