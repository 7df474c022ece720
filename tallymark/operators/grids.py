"""Dense axes, running totals and series spans.  All inputs here are count tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.joins import or_zero


def year_axis(df: DataFrame, year: str = "year", years: tuple[int, int] | None = None) -> DataFrame:
    """Every year from the first to the last in ``df`` (or the span given)."""
    if years is None:
        span = df.agg(F.min(year).alias("lo"), F.max(year).alias("hi")).where("lo is not null")
    else:
        span = df.sparkSession.range(1).select(F.lit(years[0]).alias("lo"), F.lit(years[1]).alias("hi"))
    return span.select(F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("year"))


def each(df: DataFrame, name: str, values) -> DataFrame:
    """Repeat every row once per value of a fixed list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def zero_filled(grid: DataFrame, counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    filled = grid.join(counts, keys, "left")
    return filled.withColumn(value, or_zero(value).cast("bigint"))


def running_total(df: DataFrame, by, order: str, value: str, alias: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(alias, F.sum(value).over(w))


def position_in(values, c) -> Column:
    """Rank of a value in a fixed list; unknown values last."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c) if isinstance(c, str) else c)
    return F.when(at > 0, at).otherwise(F.lit(len(values) + 1))


def dense_counts(
    counts: DataFrame, by: list[str], value: str, years: tuple[int, int] | None = None
) -> DataFrame:
    """Zero-filled ``by`` x year from a sparse count table, over the groups present."""
    axis = year_axis(counts, years=years)
    span = axis.agg(F.array_sort(F.collect_list("year")).alias("_axis")).withColumn("_one", F.lit(1))
    groups = counts.select(*by).distinct().withColumn("_one", F.lit(1))
    # one-row side: the axis itself, at most a few thousand years long
    grid = groups.join(F.broadcast(span), "_one").select(*by, F.explode("_axis").alias("year"))
    return zero_filled(grid, counts, [*by, "year"], value)


def from_first_reach(series: DataFrame, by: str, cumulative: str, at_least: int = 1) -> DataFrame:
    """Rows from the first year a group's running total reaches ``at_least``."""
    w = Window.partitionBy(by)
    first = F.min(F.when(F.col(cumulative) >= at_least, F.col("year"))).over(w)
    return series.withColumn("_first", first).where("year >= _first").drop("_first")


def undrawn_span(series: DataFrame, by: str, cumulative: str) -> DataFrame:
    """Leading years before the first reach, per group; none if there are no such years."""
    spans = series.groupBy(by).agg(
        F.min("year").alias("first_year"),
        F.min(F.when(F.col(cumulative) >= 1, F.col("year"))).alias("reached"),
    )
    return spans.where("reached > first_year").select(
        by, F.col("first_year").alias("from_year"), (F.col("reached") - 1).alias("to_year")
    )


def leading_zero_run(series: DataFrame, by: list[str], value: str, at_least: int) -> DataFrame:
    """Leading run of zero years, if long enough and followed by a non-zero year."""
    spans = series.groupBy(*by).agg(
        F.min("year").alias("first_year"),
        F.min(F.when(F.col(value) > 0, F.col("year"))).alias("reached"),
    )
    return spans.where(F.col("reached") - F.col("first_year") >= at_least).select(
        *by, F.col("first_year").alias("from_year"), (F.col("reached") - 1).alias("to_year")
    )


def series_from(series: DataFrame, starts: dict[tuple[str, str], int]) -> DataFrame:
    """Cut named (theme, domain) series at their first meaningful year."""
    start = None
    for (theme, domain), year in starts.items():
        test = (F.col("theme") == theme) & (F.col("domain") == domain)
        start = F.when(test, year) if start is None else start.when(test, year)
    if start is None:
        return series
    return series.where(start.isNull() | (F.col("year") >= start))


def select_series(series: DataFrame, pairs) -> DataFrame:
    """Keep only the named (theme, domain) pairs.

    Raises:
        ValueError: a theme is not in the table; a figure must not lose a line without a word.
    """
    pairs = list(pairs)
    asked = series.sparkSession.createDataFrame([(t,) for t, _ in pairs] or [], "theme string").distinct()
    unknown = [r["theme"] for r in asked.join(series.select("theme").distinct(), "theme", "left_anti").orderBy("theme").collect()]
    if unknown:
        raise ValueError(f"no series of theme(s) {', '.join(unknown)}")
    keep = reduce(lambda a, p: a | ((F.col("theme") == p[0]) & (F.col("domain") == p[1])), pairs, F.lit(False))
    return series.where(keep)
