"""Year and date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.text import col


def choose_year(article, issue, history=None, issue_is_free_text=None) -> Column:
    """Publication year and the field it came from, as ``struct<year, year_source>``.

    An electronic date earlier than the issue date wins; otherwise the issue date, the
    electronic date alone, then the day the record was first seen.
    """
    article, issue = col(article), col(issue)
    history = F.lit(None).cast("int") if history is None else col(history)
    issue_name = F.lit("PubDate")
    if issue_is_free_text is not None:
        issue_name = F.when(col(issue_is_free_text), "PubDate[MedlineDate]").otherwise(issue_name)

    def picked(year, name):
        return F.struct(year.cast("int").alias("year"), name.alias("year_source"))

    return (
        F.when(article < issue, picked(article, F.lit("ArticleDate")))
        .when(issue.isNotNull(), picked(issue, issue_name))
        .when(article.isNotNull(), picked(article, F.lit("ArticleDate")))
        .when(history.isNotNull(), picked(history, F.lit("PubMedPubDate[pubmed]")))
        .otherwise(picked(F.lit(None), F.lit("none")))
    )


def earliest_year(years) -> Column:
    """Smallest of several years, nulls ignored."""
    return F.array_min(col(years))


def decision_date(text, fmt: str = "MM/dd/yyyy") -> Column:
    """Text date as a DATE; null when it does not parse."""
    return F.try_to_date(col(text), fmt)


def iso_or_blank(date) -> Column:
    return F.coalesce(F.date_format(col(date), "yyyy-MM-dd"), F.lit(""))


def partial_flag(year, partial_year: int | None) -> Column:
    """1 on the one year the data does not cover to its end."""
    if partial_year is None:
        return F.lit(0)
    return (col(year) == F.lit(partial_year)).cast("int")
