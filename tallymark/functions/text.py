"""Text columns: joining, whitespace, years in free text, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.patterns import SPACE, WORD
from tallymark.vocab import EXCERPT_CONTEXT, TITLE_ABSTRACT_SEPARATOR, YEAR_IN_TEXT

#: A year starts and ends in a digit, so a word edge is just "no word character there".
YEAR = f"(?<![{WORD}]){YEAR_IN_TEXT}(?![{WORD}])"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def match_text(title="title", abstract="abstract") -> Column:
    """Title and abstract as the one string every rule reads."""
    return F.concat(
        F.coalesce(col(title), F.lit("")),
        F.lit(TITLE_ABSTRACT_SEPARATOR),
        F.coalesce(col(abstract), F.lit("")),
    )


def folded(text) -> Column:
    """Lower case under the same folding as a case-insensitive match.

    Three letters fold to ASCII only by way of their upper case, so they are replaced by
    hand: dotted capital I, dotless i and long s.
    """
    plain = col(text)
    for letter, base in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        plain = F.replace(plain, F.lit(letter), F.lit(base))
    return F.lower(plain)


def words(low) -> Column:
    """Distinct words of a folded text."""
    return F.array_distinct(F.split(col(low), f"[^{WORD}]+"))


#: ``SPACE`` behind two ranges that hold all of it: a letter is told from white space by two comparisons instead of ten.
_RUN = rf"[\x00-\x20\x85-\u3000&&[{SPACE}]]+"


def normalise_space(text) -> Column:
    """Every run of white space becomes one blank; ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), _RUN, " "))


def first_year(text) -> Column:
    """First four-digit year in free text, or null."""
    found = F.regexp_extract(F.coalesce(col(text), F.lit("")), YEAR, 1)
    return F.nullif(found, F.lit("")).try_cast("int")


def first_non_empty(*values) -> Column:
    """First value that is not blank, else the empty string."""
    return F.coalesce(*[F.nullif(normalise_space(v), F.lit("")) for v in values], F.lit(""))


def tag_list(value, is_array: bool = False) -> Column:
    """Array or ``"; "``-joined string to a distinct list of trimmed, non-empty tags."""
    parts = col(value) if is_array else F.split(col(value), ";")
    trimmed = F.transform(parts, lambda x: F.trim(x))
    kept = F.array_distinct(F.filter(trimmed, lambda x: F.length(x) > 0))
    return F.coalesce(kept, F.array().cast("array<string>"))


def sections_text(sections) -> Column:
    """Assemble ``array<struct<label, text>>`` into text, structured flag and count."""
    s = col(sections)
    labelled = lambda x: F.length(F.trim(F.coalesce(x["label"], F.lit("")))) > 0
    full = F.filter(s, lambda x: F.length(x["text"]) > 0)
    lines = F.transform(
        full,
        lambda x: F.when(labelled(x), F.concat(F.trim(x["label"]), F.lit(": "), x["text"]))
        .otherwise(x["text"]),
    )
    n = F.coalesce(F.size(full), F.lit(0))
    return F.struct(
        F.coalesce(F.array_join(lines, "\n\n"), F.lit("")).alias("text"),
        (F.coalesce(F.exists(s, labelled), F.lit(False)) & (n > 0)).alias("structured"),
        n.alias("sections"),
    )


def excerpt(text, start, end, context: int = EXCERPT_CONTEXT) -> Column:
    """Characters ``start`` to ``end`` with ``context`` either side; ``...`` where cut."""
    t, size = col(text), F.length(col(text))
    left = F.greatest(col(start) - context, F.lit(0))
    right = F.least(col(end) + context, size)
    return F.concat(
        F.when(left > 0, "...").otherwise(""),
        normalise_space(F.substring(t, left + 1, right - left)),
        F.when(right < size, "...").otherwise(""),
    )
