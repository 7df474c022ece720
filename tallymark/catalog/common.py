"""Registration of queries, and the pieces of SQL they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}

#: White space and word characters as RE2 class members.
RE2_SPACE = (
    r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}"
)
RE2_WORD = r"\p{L}\p{N}_"


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists the inventory rows it exercises."""

    def register(fn):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_norm(expr: str) -> str:
    """White space collapsed and trimmed."""
    return f"trim(regexp_replace(coalesce({expr}, ''), '[{RE2_SPACE}]+', ' ', 'g'))"
