"""Table contracts.  Each check returns problems as ``(check, key, detail)``; an empty
result is a pass, and raising is the caller's choice."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import patterns
from tallymark.operators.grids import dense_counts
from tallymark.operators.joins import key_differences, unequal_counts
from tallymark.vocab import (
    CATCH_ALL,
    CONFIDENCES,
    DECISIONS,
    DEVICE_CATEGORIES,
    MIN_EVIDENCE_CHARS,
    NEITHER_SIDE,
    PATHOLOGY_SIDE,
    RADIOLOGY_SIDE,
)

PROBLEM = "check string, key string, detail string"


def _found(df: DataFrame, check: str, key, detail) -> DataFrame:
    to = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        F.lit(check).alias("check"),
        to(key).cast("string").alias("key"),
        to(detail).cast("string").alias("detail"),
    )


def all_problems(*checks: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def contract_report(
    df: DataFrame,
    rows: dict[str, tuple[Column, Column]] | None = None,
    unique: dict[str, list[str]] | None = None,
    depends: dict[str, tuple[list[str], list[str]]] | None = None,
) -> DataFrame:
    """Any number of checks of one table in one scan and one aggregate, as ``(check, key, detail)``.

    ``rows`` has what is bad in a row and the key it is reported under: a problem for each key, with the number of rows.
    ``unique`` has columns that together must not repeat, ``depends`` columns and others that they determine: a problem for
    each key, with the number of rows or of different values.  Good rows of a row check never leave their task; of
    key checks one slim entry a row does, combined on the map side.
    """
    said = lambda names: F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    nothing = F.lit(None).cast("bigint")

    def entry(check: str, kind: int, key: Column, value: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), F.lit(kind).alias("kind"), F.coalesce(key.cast("string"), F.lit("")).alias("key"), value.alias("value"))

    entries = [F.when(F.coalesce(bad, F.lit(True)), entry(name, 0, key, nothing)) for name, (bad, key) in (rows or {}).items()]
    entries += [entry(name, 1, said(names), nothing) for name, names in (unique or {}).items()]
    entries += [entry(name, 2, said(names), F.xxhash64(said(others))) for name, (names, others) in (depends or {}).items()]
    found = df.select(F.explode(F.array(*entries)).alias("e")).where("e is not null").select("e.*")
    total = found.groupBy("check", "kind", "key").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    bad = total.where("kind = 0 or (kind = 1 and n > 1) or (kind = 2 and lo <> hi)")
    return bad.select("check", "key", F.when(F.col("kind") == 2, "differs").otherwise(F.col("n").cast("string")).alias("detail"))


def column_set(df: DataFrame, required, tolerated=(), exact: bool = True) -> DataFrame:
    """Missing and unexpected columns; only the schema is read."""
    found = [c for c in df.columns if c not in tolerated]
    rows = [("column_missing", c, "") for c in required if c not in found]
    if exact:
        rows += [("column_unexpected", c, "") for c in found if c not in required]
    return df.sparkSession.createDataFrame(rows, PROBLEM)


def whole_numbers(df: DataFrame, column: str, minimum: int | None = None) -> DataFrame:
    value = F.col(column).try_cast("double")
    bad = value.isNull() | (value % 1 != 0)
    if minimum is not None:
        bad = bad | (value < minimum)
    return _found(
        df.agg(F.count_if(bad).alias("n"), F.min(F.when(bad, F.col(column).cast("string"))).alias("v"))
        .where("n > 0"),
        "not_whole_number",
        column,
        F.concat_ws(" ", F.col("n").cast("string"), F.coalesce("v", F.lit("null"))),
    )


def vocabulary(df: DataFrame, column: str, allowed) -> DataFrame:
    bad = df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
    return _found(
        bad.groupBy(column).agg(F.count("*").alias("n")),
        "unknown_value",
        F.concat_ws("=", F.lit(column), F.coalesce(F.col(column).cast("string"), F.lit(""))),
        F.col("n"),
    )


def set_vocabulary(df: DataFrame, column: str, allowed, separator: str = "+") -> DataFrame:
    """Members of joined label sets that no vocabulary names; empty sets count as one."""
    member = F.explode(F.split(F.coalesce(F.col(column), F.lit("")), re.escape(separator)))
    return vocabulary(df.select(member.alias(column)), column, allowed)


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return _found(
        df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "repeated_key", name, F.col("n")
    )


def functional_dependency(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that map to more than one value.  Pairs are made distinct before they meet."""
    pairs = df.select(key, value).distinct()
    n = pairs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return _found(n, "not_functional", F.col(key), F.col("n"))


def agrees_with(df: DataFrame, key: str, value: str, mapping: dict[str, str]) -> DataFrame:
    expected = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    want = F.try_element_at(expected, F.col(key))
    bad = df.where(~F.coalesce(F.col(value).eqNullSafe(want), F.lit(False)))
    return _found(
        bad.groupBy(key, value).agg(F.count("*").alias("n")), "disagrees", F.concat_ws("/", key, value), F.col("n")
    )


def dense_axis(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Group and year pairs absent from a table that should be dense."""
    counts = df.groupBy(*by, "year").agg(F.sum(value).alias(value))
    grid = dense_counts(counts, by, value).select(*by, "year")
    gap = grid.join(df.select(*by, "year"), [*by, "year"], "left_anti")
    return _found(gap, "year_absent", F.concat_ws("/", *by), F.col("year"))


def running_sum(df: DataFrame, by: list[str], value: str, cumulative: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    bad = df.withColumn("_sum", F.sum(value).over(w)).where(F.col("_sum") != F.col(cumulative))
    return _found(
        bad, "not_running_sum", F.concat_ws("/", *by, F.col("year").cast("string")), F.concat_ws("<>", F.col(cumulative).cast("string"), F.col("_sum").cast("string"))
    )


def date_agrees(df: DataFrame, id_: str, date: str, year: str, required: list[str]) -> DataFrame:
    """Blank required fields, dates that are not ISO dates, years that are not the date's."""
    parsed = F.try_to_date(F.col(date).cast("string"), "yyyy-MM-dd")
    blank = reduce(
        lambda a, b: a | b, [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in required]
    )
    check = (
        F.when(blank, "blank_field")
        .when(parsed.isNull(), "bad_date")
        .when(F.year(parsed) != F.col(year), "year_disagrees")
    )
    bad = df.withColumn("_check", check).where("_check is not null")
    return bad.select(
        F.col("_check").alias("check"), F.col(id_).cast("string").alias("key"),
        F.col(date).cast("string").alias("detail"),
    )


def one_partial_year(df: DataFrame, flag: str = "partial_year") -> DataFrame:
    """Flag values other than 0 and 1, and more than one flagged year."""
    bad = df.where(~F.coalesce(F.col(flag).isin(0, 1), F.lit(False)))
    values = _found(bad.groupBy(flag).agg(F.count("*").alias("n")), "flag_not_binary", F.col(flag), F.col("n"))
    years = df.where(F.col(flag) == 1).agg(F.countDistinct("year").alias("n")).where("n > 1")
    return values.unionByName(_found(years, "several_partial_years", flag, F.col("n")))


def binary_labels(df: DataFrame, flags: list[str], id_: str = "pmid") -> DataFrame:
    bad = F.filter(
        F.array(*[F.when(~F.coalesce(F.col(c).isin(0, 1), F.lit(False)), F.lit(c)) for c in flags]),
        lambda x: x.isNotNull(),
    )
    rows = df.select(F.col(id_), F.explode(bad).alias("c"))
    return _found(rows, "label_not_binary", F.col(id_), F.col("c")).unionByName(unique_key(df, [id_]))


def strata_cover(themes: DataFrame, strata: DataFrame, modalities: DataFrame) -> DataFrame:
    """Themes without a stratum; modalities not on exactly one side.

    ``themes (theme)``, ``strata (theme)`` and ``modalities (modality)`` may hold anything any number of times.
    """
    bare = themes.select("theme").distinct().join(strata.select("theme"), "theme", "left_anti")
    m = F.col("modality")
    sides = sum(m.isin(*side).cast("int") for side in (RADIOLOGY_SIDE, PATHOLOGY_SIDE, NEITHER_SIDE))
    off = modalities.select("modality").distinct().where(sides != 1)
    return _found(bare, "theme_without_stratum", F.col("theme"), "").unionByName(_found(off, "modality_side", m, sides))


def code_rule(assigned: DataFrame, excluded: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """A code is three capitals, in one category, and counted or excluded but not both."""
    codes = assigned.select("code").unionByName(excluded.select("code"))
    shape = _found(codes.where(~F.col("code").rlike("^[A-Z]{3}$")), "malformed_code", F.col("code"), "")
    several = functional_dependency(assigned, "code", "category")
    twice = unique_key(assigned.select("code", "category"), ["code", "category"])
    both = _found(
        assigned.select("code").distinct().join(excluded.select("code").distinct(), "code"),
        "counted_and_excluded", F.col("code"), "",
    )
    repeated = unique_key(excluded.select("code"), ["code"])
    category = vocabulary(assigned, "category", DEVICE_CATEGORIES)
    parts = [shape, several, twice, both, repeated, category]
    if overrides is not None:
        joined = overrides.select("code", F.col("domain").alias("_o")).join(
            assigned.select("code", F.col("domain").alias("_d")), "code", "left"
        )
        parts.append(_found(joined.where("_d is null"), "override_unlisted", F.col("code"), ""))
        parts.append(_found(joined.where("_d <> _o"), "override_domain", F.col("code"), F.col("_o")))
    return all_problems(*parts)


def decision_rule(decisions: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Valid decisions with a reason, one per device, as many as their file declares."""
    c = F.col
    text = lambda name: F.trim(F.coalesce(c(name), F.lit("")))
    yes = c("decision") == "oncology"
    tests = {
        "blank_device": text("submission_number") == "",
        "unknown_decision": ~F.coalesce(c("decision").isin(*DECISIONS), F.lit(False)),
        "category_required": yes & ~text("category").isin(*DEVICE_CATEGORIES),
        "confidence_required": yes & ~text("confidence").isin(*CONFIDENCES),
        "category_not_allowed": ~yes & (text("category") != ""),
        "evidence_too_short": F.length(text("evidence")) < MIN_EVIDENCE_CHARS,
    }
    names = F.filter(
        F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull()
    )
    rows = decisions.select("submission_number", F.explode(names).alias("check")).select(
        "check", c("submission_number").alias("key"), F.lit("").alias("detail")
    )
    key = decisions.select(F.upper(text("submission_number")).alias("submission_number"))
    parts = [rows, unique_key(key, ["submission_number"])]
    if declared is not None:
        counts = decisions.groupBy("source").agg(F.count("*").alias("found"))
        off = unequal_counts(declared.select("source", "declared"), counts, ["source"], "declared", "found")
        parts.append(
            _found(off, "declared_count", c("source"), F.concat_ws("<>", c("declared").cast("string"), c("found").cast("string")))
        )
    return all_problems(*parts)


def term_rules(rules: DataFrame, expected: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Every problem of a rule table at once, of any size.

    Kinds, cases, includes and categories are aggregates and anti-joins.  Patterns are translated by a helper on the
    executors and compiled where they will run, in the JVM.
    """
    c = F.col
    r = rules.select("dictionary", "category", "role", "idx", "kind", "case_sensitive", "pattern")
    stated = r.where("pattern is not null or kind is not null")
    where = F.concat(c("category"), F.lit("."), c("role"), F.lit("["), c("idx").cast("string"), F.lit("]"))
    translated = F.pandas_udf(_translated, "java string, check string, detail string")
    tried = stated.withColumn("_t", translated("kind", "case_sensitive", "pattern"))
    blank = F.coalesce(c("pattern"), F.lit("")).rlike(rf"\A[{patterns.SPACE}]*\z")

    def problem(check, detail) -> Column:
        return F.struct((check if isinstance(check, Column) else F.lit(check)).alias("check"), detail.alias("detail"))

    compiles = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), c("_t.java")).isNotNull()
    found = (
        F.when(blank, problem("empty_pattern", F.lit("")))
        .when(~F.coalesce(c("kind").isin("phrase", "regex"), F.lit(False)), problem("unknown_kind", F.coalesce("kind", F.lit("None"))))
        .when(
            (c("kind") == "regex") & c("case_sensitive") & c("pattern").rlike(r"\A\(\?[a-zA-Z]*i[a-zA-Z]*\)"),
            problem("contradictory_case", c("pattern")),
        )
        .when(c("_t.check").isNotNull(), problem(c("_t.check"), c("_t.detail")))
        .when(~compiles, problem("not_expressible", c("pattern")))
    )
    rows = tried.select(where.alias("key"), found.alias("p")).where("p is not null").select("p.check", "key", "p.detail")
    is_include = ((c("role") == "include") & (c("pattern").isNotNull() | c("kind").isNotNull())).cast("int")
    have = r.groupBy("dictionary", "category").agg(F.coalesce(F.sum(is_include), F.lit(0)).alias("n"))
    bare = have.where((c("n") == 0) & (c("category") != CATCH_ALL))
    parts = [rows, _found(bare, "no_include", c("category"), c("dictionary"))]
    if expected:
        spark = rules.sparkSession
        wanted = spark.createDataFrame([(d, k) for d, keys in expected.items() for k in keys], "dictionary string, category string")
        keys = ["dictionary", "category"]
        parts.append(_found(wanted.join(have, keys, "left_anti"), "category_missing", c("category"), c("dictionary")))
        known = have.where(c("dictionary").isin(*expected))
        parts.append(_found(known.join(wanted, keys, "left_anti"), "category_unknown", c("category"), c("dictionary")))
    return all_problems(*parts)


def _translated(kind: pd.Series, case: pd.Series, pattern: pd.Series) -> pd.DataFrame:
    """A rule's pattern for the JVM, or why there is none."""

    def one(k, flag, source):
        flag = None if pd.isna(flag) else bool(flag)
        try:
            if k == "phrase":
                return patterns.phrase_to_java(source or "", bool(flag)), None, None
            if k == "regex":
                re.compile(source or "")
                return patterns.regex_to_java(source or "", flag), None, None
        except re.error:
            return None, "will_not_compile", source
        except patterns.RuleError as problem:
            return None, "not_expressible", str(problem)
        return None, None, None

    return pd.DataFrame([one(*row) for row in zip(kind, case, pattern)], columns=["java", "check", "detail"])


def version_ledger(ledger: DataFrame, current: DataFrame) -> DataFrame:
    """``ledger(file, version, sha256)``: one digest per version, and today's is recorded."""
    distinct = ledger.select("file", "version", "sha256").distinct()
    reused = distinct.groupBy("file", "version").agg(F.count("*").alias("n")).where("n > 1")
    a = current.select("file", "version", F.col("sha256").alias("now"))
    moved = a.join(distinct, ["file", "version"], "left").where(
        F.col("sha256").isNull() | ~F.startswith(F.col("now"), F.col("sha256"))
    )
    name = F.concat_ws(" v", "file", F.col("version").cast("string"))
    return _found(reused, "version_reused", name, F.col("n")).unionByName(
        _found(
            moved,
            "ledger_mismatch",
            name,
            F.when(F.col("sha256").isNull(), "unrecorded").otherwise("changed"),
        )
    )


def freshness(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """State of each rule file since a run: missing, changed (with or without a new version),
    or current."""
    now = current.select("file", F.col("version").alias("v_now"), F.col("sha256").alias("sha_now"))
    state = (
        F.when(F.col("sha_now").isNull(), "missing")
        .when(F.col("sha_now") == F.col("sha256"), "current")
        .when(F.col("v_now") == F.col("version"), "changed_same_version")
        .otherwise("changed_new_version")
    )
    return recorded.join(now, "file", "left").select("file", "version", state.alias("state"))


def combos_sum_to_theme(combos: DataFrame, totals: DataFrame, shortfalls: DataFrame) -> DataFrame:
    """Combination counts per theme equal its primary total less the records held out."""
    got = combos.groupBy("theme").agg(F.sum("n_papers").alias("found"))
    want = (
        totals.select(F.col("key").alias("theme"), "n_primary")
        .join(shortfalls.select("theme", "panel_a"), "theme", "left")
        .select("theme", (F.col("n_primary") - F.coalesce("panel_a", F.lit(0))).alias("expected"))
    )
    off = unequal_counts(want, got, ["theme"], "expected", "found")
    return _found(off, "combination_total", F.col("theme"), F.concat_ws("<>", F.col("expected").cast("string"), F.col("found").cast("string")))


def domains_sum_to_all(series: DataFrame) -> DataFrame:
    """The four domains of a theme and year add up to its ``all`` row."""
    is_all = F.col("domain") == "all"
    sums = series.groupBy("theme", "year").agg(
        F.sum(F.when(is_all, F.col("n_papers")).otherwise(0)).alias("total"),
        F.sum(F.when(~is_all, F.col("n_papers")).otherwise(0)).alias("parts"),
    )
    return _found(
        sums.where("total <> parts"), "domain_sum", F.concat_ws("/", "theme", F.col("year").cast("string")),
        F.concat_ws("<>", F.col("total").cast("string"), F.col("parts").cast("string")),
    )


def cross_table(auth: DataFrame, cumulative: DataFrame, pathways: DataFrame) -> DataFrame:
    """The detail table, the annual series and the pathway table state the same counts.

    Every table says its counts as rows ``(check, key, left, right)``; they meet in one aggregate, and sums that
    differ are the problems.  ``auth`` may be the registry or a ``registry.profile`` of it.
    """
    c, text = F.col, lambda name: F.col(name).cast("string")
    n = c("n_devices") if "n_devices" in auth.columns else F.lit(1)
    last = cumulative.groupBy("category").agg(F.max_by("cumulative_count", "year").alias("final"))

    def said(df: DataFrame, *facts: tuple[str, list[Column], Column | None, Column | None]) -> DataFrame:
        zero = F.lit(0)
        rows = [
            F.struct(
                F.lit(check).alias("check"), F.concat_ws("/", *key).alias("key"),
                (zero if left is None else left).cast("bigint").alias("left"), (zero if right is None else right).cast("bigint").alias("right"),
            )
            for check, key, left, right in facts
        ]
        return df.select(F.inline(F.array(*rows)))

    facts = [
        said(
            auth,
            ("annual_count", [text("category"), text("year")], n, None),
            ("pathway_count", [text("category"), text("pathway")], n, None),
            ("final_cumulative", [text("category")], n, None),
        ),
        said(cumulative, ("annual_count", [text("category"), text("year")], None, c("annual_count"))),
        said(last, ("final_cumulative", [text("category")], None, c("final")), ("pathway_total", [text("category")], c("final"), None)),
        said(
            pathways,
            ("pathway_count", [text("category"), text("pathway")], None, c("count")),
            ("pathway_total", [text("category")], None, c("count")),
        ),
    ]
    sums = all_problems(*facts).groupBy("check", "key").agg(F.sum("left").alias("l"), F.sum("right").alias("r"))
    return sums.where("l <> r").select("check", "key", F.concat_ws("<>", text("l"), text("r")).alias("detail"))


def set_difference(a: DataFrame, b: DataFrame, keys: list[str], names=("missing", "extra")) -> DataFrame:
    return _found(
        key_differences(a, b, keys, names), "key_set", F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.col("only_in")
    )
