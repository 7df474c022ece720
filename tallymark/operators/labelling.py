"""The labelling job: every rule against every record, in one pass over the text.

``annotate`` is the only place that touches text.  It yields one row per input record
with the exclusion reason, the label flags and the rules that fired;
labels, provenance rows and the exclusion ledger are all projections of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.labels import domain_of, set_size
from tallymark.functions.patterns import sql_literal
from tallymark.functions.text import excerpt, folded, match_text, tag_list, words
from tallymark.operators.joins import small
from tallymark.operators.rule_index import fired_by_index
from tallymark.sources.rules import Rule, RuleBook
from tallymark.vocab import (
    BOOK_RECORD_TYPES,
    CATCH_ALL,
    MINIMUM_LABELS,
    SECONDARY_TYPES,
)

#: Up to so many rules are one expression over the text; more are looked up by the words of the text.
UNROLLED = 400
REQUIRED = ("pmid", "title", "abstract", "year", "record_type")
#: Ordinal of "no rule named anything", beside the rules' own ordinals.
FALLBACK = -1
NO_NAME = "no named modality matched"


FIRED = "array<struct<ordinal:int,n_hits:int,a:int,b:int>>"


def _present(rule: Rule) -> str | None:
    """A cheap test that a text must pass for the rule to match.

    A phrase needs its words among the words of the text.  Other rules need a literal their
    pattern cannot match without.
    """
    if rule.words:
        return " AND ".join(f"array_contains(_words, {sql_literal(w)})" for w in rule.words)
    if rule.literals:
        return "(" + " OR ".join(f"contains(_low, {sql_literal(x)})" for x in rule.literals) + ")"
    return None


def fires(rule: Rule) -> str:
    """Does one rule match?  The cheap test goes first and settles most records; a phrase that is one word needs nothing more."""
    regex = f"rlike(_text, {sql_literal(rule.java)})"
    present = _present(rule)
    if present is None:
        return regex
    return present if rule.words == (rule.pattern.strip().lower(),) else f"({present} AND {regex})"


def _fired(rules: list[Rule], details: bool) -> str:
    """The rules that fire; with ``details`` also how often, and where the first match lies.

    Every pattern is a literal, so it is compiled once per task.  With ``details`` a rule that may match reads the text
    once for all its matches, and one that does match once more for the place of the first.  Rules
    are written as SQL text: hundreds of them are one parse instead of thousands of calls into the JVM.
    """
    if not rules:
        return f"CAST(array() AS {FIRED})"

    def entry(r: Rule) -> str:
        if not details:
            none = ", ".join(f"'{f}', CAST(NULL AS INT)" for f in ("n_hits", "a", "b"))
            return f"CASE WHEN {fires(r)} THEN named_struct('ordinal', {r.ordinal}, {none}) END"
        java = sql_literal(r.java)
        first = f"IF(_wide, length(regexp_extract(_text, {sql_literal(r.java_after_prefix)}, 1)), regexp_instr(_text, {java}) - 1)"
        found = (
            f"IF(size(m) > 0, transform(array({first}), i -> named_struct('ordinal', {r.ordinal}, "
            f"'n_hits', size(m), 'a', i, 'b', i + length(m[0])))[0], NULL)"
        )
        return f"CASE WHEN {_present(r) or 'TRUE'} THEN transform(array(regexp_extract_all(_text, {java}, 0)), m -> {found})[0] END"

    return f"filter(array({', '.join(entry(r) for r in rules)}), x -> x IS NOT NULL)"


def _year() -> Column:
    """The year as a number; text and NaN are none."""
    year = F.col("year").try_cast("double")
    return F.when(~F.isnan(year), year)


def exclusion_reason(year_range: tuple[int, int] | None = None) -> Column:
    """First field-based reason a record may not enter the corpus, or null."""
    year = _year()
    reason = (
        F.when(F.col("record_type").isin(*BOOK_RECORD_TYPES), "book_records")
        .when(F.trim(F.coalesce(F.col("pmid").cast("string"), F.lit(""))) == "", "missing_pmid")
        .when(year.isNull(), "missing_year")
    )
    if year_range is not None:
        reason = reason.when((year < year_range[0]) | (year > year_range[1]), "outside_date_range")
    return reason


def primary_flag(records: DataFrame) -> Column:
    """1 unless a record carries a secondary publication type; 1 for all without tags."""
    if "publication_types" not in records.columns:
        return F.lit(1)
    types = _tags(records)
    secondary = F.arrays_overlap(types, F.array(*[F.lit(t) for t in SECONDARY_TYPES]))
    return (~secondary).cast("int")


def _tags(records: DataFrame) -> Column:
    dtype = dict(records.dtypes)["publication_types"]
    return tag_list("publication_types", is_array=dtype.startswith("array"))


def annotate(
    records: DataFrame,
    book: RuleBook,
    year_range: tuple[int, int] | None = None,
    details: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per record: exclusion reason, flags, and the rules that fired.

    ``details`` adds counts and excerpts to the fired rules, for the provenance table; ``keep`` names further
    columns of the records that stay.
    """
    missing = [c for c in REQUIRED if c not in records.columns]
    if missing:
        raise ValueError(f"record table missing required column(s): {', '.join(missing)}")
    # Records filtered out by a field get a null text, so no rule is tried on them.
    base = records.select(
        F.trim(F.coalesce(F.col("pmid").cast("string"), F.lit(""))).alias("pmid"),
        _year().try_cast("int").alias("year"),
        (F.col("year_source") if "year_source" in records.columns else F.lit("")).alias("year_source"),
        primary_flag(records).alias("is_primary_research"),
        exclusion_reason(year_range).alias("reason"),
        *keep,
        F.when(exclusion_reason(year_range).isNull(), match_text()).alias("_text"),
    ).withColumn("_low", folded("_text")).withColumn("_words", words("_low"))
    if details:
        base = base.withColumn("_wide", F.col("_text").rlike(r"[\x{10000}-\x{10FFFF}]"))

    categories = [("theme", k) for k in book.themes] + [
        ("modality", k) for k in (*book.modalities, *book.match_only)
    ]
    excluding = [(d, k) for d, k in categories if book.of_category(d, k, "exclude")]
    indexed = len(book.rules) > UNROLLED
    if indexed:
        both = fired_by_index(base, book, details, _fired, excerpt)
        empty = "array<struct<ordinal:int,n_hits:int,excerpt:string>>" if details else "array<struct<ordinal:int>>"
        unruled = {f"_inc_{d}_{k}": F.array().cast(empty) for d, k in categories if f"_inc_{d}_{k}" not in both.columns}
        both = both.withColumns(unruled)
        said = f", 'n_hits', 0, 'excerpt', {sql_literal(NO_NAME)}" if details else ""
    else:
        empty, said = FIRED, ", 'n_hits', 0, 'a', -1, 'b', -1"
        included = base.selectExpr(
            "*",
            *[f"{_fired(book.of_category(d, k, 'include'), details)} AS `_inc_{d}_{k}`" for d, k in categories],
        )
        # Exclude rules are only consulted where an include rule of the category fired.
        both = included.selectExpr(
            "*",
            *[
                f"IF(size(`_inc_{d}_{k}`) > 0, {_fired(book.of_category(d, k, 'exclude'), details)}, "
                f"CAST(array() AS {FIRED})) AS `_exc_{d}_{k}`"
                for d, k in excluding
            ],
        )

    def stands(d: str, k: str) -> str:
        kept = f" AND size(`_exc_{d}_{k}`) = 0" if (d, k) in excluding else ""
        return f"(size(`_inc_{d}_{k}`) > 0{kept})"

    named = [k for k in book.modalities if k != CATCH_ALL]
    any_named = " OR ".join(stands("modality", k) for k in named) or "FALSE"
    by_pattern = stands("modality", CATCH_ALL)
    outside = ", ".join(f"IF({stands('modality', k)}, {sql_literal(k)}, NULL)" for k in book.match_only)
    fired = ", ".join(
        [f"`_inc_{d}_{k}`" for d, k in categories] + [f"`_exc_{d}_{k}`" for d, k in excluding]
    )
    no_name = (
        f"IF(NOT ({any_named}) AND NOT {by_pattern}, "
        f"array(named_struct('ordinal', {FALLBACK}{said})), CAST(array() AS {empty}))"
    )
    row = both.selectExpr(
        "pmid",
        "year",
        "year_source",
        "is_primary_research",
        "reason",
        *keep,
        *([] if indexed else ["_text"]),
        *[f"CAST({stands('theme', k)} AS INT) AS `theme_{k}`" for k in book.themes],
        *[f"CAST({stands('modality', k)} AS INT) AS `mod_{k}`" for k in named],
        f"CAST({by_pattern} OR NOT ({any_named}) AS INT) AS mod_{CATCH_ALL}",
        f"filter(array(CAST(NULL AS STRING), {outside or 'NULL'}), x -> x IS NOT NULL) AS _outside",
        f"flatten(array({fired}, {no_name})) AS fired",
    )
    found = F.col("fired")
    if not indexed:
        found = F.transform(found, _with_excerpt if details else lambda f: F.struct(f["ordinal"].alias("ordinal")))
    row = row.withColumns({"fired": found, "domain": domain_of(book.modalities)}).withColumn(
        "reason",
        F.coalesce(
            "reason",
            F.when((F.col("domain") == "none") & (F.size("_outside") > 0), "non_specialty_only"),
        ),
    )
    order = [f"theme_{k}" for k in book.themes] + [f"mod_{k}" for k in book.modalities]
    columns = [
        "pmid", "year", "year_source", *order, "domain", "is_primary_research", "reason", *keep, "_outside", "fired",
    ]
    # One generated row per record: a boundary no filter is pushed through, so a later
    # condition on a label cannot make Spark evaluate the rules a second time.
    return row.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in columns]))))


def _with_excerpt(f: Column) -> Column:
    words = F.when(f["ordinal"] == FALLBACK, NO_NAME).otherwise(excerpt("_text", f["a"], f["b"]))
    return F.struct(f["ordinal"].alias("ordinal"), f["n_hits"].alias("n_hits"), words.alias("excerpt"))


def labels(annotated: DataFrame) -> DataFrame:
    """Wide 0/1 label table of the retained records."""
    return annotated.where(F.col("reason").isNull()).drop("reason", "_outside", "fired")


def route_of() -> Column:
    """By which route an annotated row reached the catch-all: ``pattern``, ``fallback`` or ``none``."""
    fell_back = F.exists("fired", lambda f: f["ordinal"] == FALLBACK)
    return F.when(fell_back, "fallback").when(F.col(f"mod_{CATCH_ALL}") == 1, "pattern").otherwise("none")


def record_routes(annotated: DataFrame) -> DataFrame:
    """The route of each retained record, read off its own row."""
    return annotated.where(F.col("reason").isNull()).select("pmid", route_of().alias("other_route"))


def keys_of(table: DataFrame, prefix: str) -> list[str]:
    return [c[len(prefix):] for c in table.columns if c.startswith(prefix)]


def pattern_hits(annotated: DataFrame, book: RuleBook) -> DataFrame:
    """One row per retained record and rule that fired.

    Counts and excerpts are there if ``annotated`` was made with details.  Only ids, flags and short excerpts are exploded, never the text; the rule table is
    broadcast if it is small.  A record that carries the catch-all only for
    want of a name has one ``fallback`` row.
    """
    kept = annotated.where(F.col("reason").isNull())
    flags = [c for c in kept.columns if c.startswith(("theme_", "mod_"))]
    standing = F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in flags])
    # every retained record has at least one entry; the outer form only keeps Spark from
    # reasoning about the size of an array that is an expression over all the rules
    rows = kept.select("pmid", "_outside", standing.alias("_standing"), F.inline_outer("fired"))
    counted = ["n_hits"] if "n_hits" in rows.columns else []
    quoted = ["excerpt"] if counted else []
    rules = small(book.table(annotated.sparkSession, fallback=FALLBACK))
    flag = F.concat(F.when(F.col("dictionary") == "theme", "theme_").otherwise("mod_"), "category")
    stood = F.array_contains("_standing", flag) | F.array_contains("_outside", F.col("category"))
    return rows.join(rules, "ordinal").select(
        "pmid",
        "dictionary",
        "category",
        "role",
        "pattern_id",
        "kind",
        "case_sensitive",
        "pattern",
        *counted,
        F.coalesce(stood, F.lit(False)).cast("int").alias("category_matched"),
        *quoted,
    )


def ledger(annotated: DataFrame, book: RuleBook, minimum: dict[str, int] | None = None) -> DataFrame:
    """Every exclusion as ``(pmid, reason, applies_to)``: one pass, several rows a record."""
    minimum = MINIMUM_LABELS if minimum is None else minimum
    kept = F.col("reason").isNull()
    size = set_size(book.modalities)

    def entry(when: Column, reason, scope: str) -> Column:
        reason = reason if isinstance(reason, Column) else F.lit(reason)
        return F.when(when, F.struct(reason.alias("reason"), F.lit(scope).alias("applies_to")))

    entries = [
        entry(~kept, F.col("reason"), "corpus"),
        entry(kept & (F.col("is_primary_research") == 0), "secondary_publication_type", "panel_a"),
    ]
    for theme, least in minimum.items():
        if theme in book.themes:
            short = (F.col(f"theme_{theme}") == 1) & (size < least) & (F.col("is_primary_research") == 1)
            entries.append(entry(kept & short, "below_minimum_modalities", f"panel_a:{theme}"))
    rows = F.filter(F.array(*entries), lambda x: x.isNotNull())
    return (
        annotated.select("pmid", F.explode_outer(rows).alias("e"))
        .select("pmid", "e.*")
        .where("reason is not null")
    )


def secondary_tally(records: DataFrame, year_range: tuple[int, int] | None = None) -> DataFrame:
    """Records per secondary publication type, before the label-based exclusion."""
    found = F.array_intersect(_tags(records), F.array(*[F.lit(t) for t in SECONDARY_TYPES]))
    return (
        records.where(exclusion_reason(year_range).isNull())
        .select(F.explode(found).alias("publication_type"))
        .groupBy("publication_type")
        .agg(F.count("*").alias("n_records"))
    )
