"""JSON lookups and dated snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKUP_FIELDS = (
    "device_name",
    "definition",
    "regulation_number",
    "device_class",
    "medical_specialty_description",
    "review_panel",
)


def last_wins(rows: DataFrame, key: str, order: list[str], fields) -> DataFrame:
    """Trimmed fields, blank as null, of the last row per non-blank key."""
    clean = rows.select(
        F.trim(key).alias(key), *order, *[F.nullif(F.trim(f), F.lit("")).alias(f) for f in fields]
    ).where(F.coalesce(F.length(key), F.lit(0)) > 0)
    latest = F.max_by(F.struct(*fields), F.struct(*order)).alias("r")
    return clean.groupBy(key).agg(latest).select(key, "r.*")


def read_lookup(
    spark: SparkSession,
    path: str,
    key: str = "product_code",
    fields=LOOKUP_FIELDS,
    multi_line: bool = True,
) -> DataFrame:
    """``results[]`` of every JSON file under ``path``; later files win.

    Set ``multi_line`` to false for files with one document per line, which can be split.
    """
    names = list(dict.fromkeys([key, *fields]))
    item = ", ".join(f"{n}: string" for n in names)
    docs = spark.read.schema(f"results array<struct<{item}>>").option("multiLine", multi_line).json(path)
    rows = docs.select(
        F.col("_metadata.file_path").alias("_file"), F.posexplode("results").alias("_pos", "r")
    ).select("_file", "_pos", "r.*")
    return last_wins(rows, key, ["_file", "_pos"], [n for n in names if n != key])


def nested_fields(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Typed fields of a JSON text column beside the other columns."""
    schema = ", ".join(f"{name} {dtype}" for name, dtype in fields.items())
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.from_json(column, schema).alias("_j")).select(*rest, "_j.*")


def latest_finished(captures: DataFrame, manifest: DataFrame, column: str = "snapshot") -> DataFrame:
    """Rows of the newest snapshot that its manifest says is finished.

    The newest date is one value, so it becomes a literal and prunes partitions.
    """
    newest = manifest.agg(F.max(column).alias("s")).first()["s"]
    if newest is None:
        raise FileNotFoundError("no finished snapshot")
    return captures.where(F.col(column) == F.lit(newest))
