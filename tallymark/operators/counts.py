"""Counts over the label table.

Everything here reads a *profile*: the label table grouped by all its flags, domain,
year and population, with a count.  It is built in one pass with map-side combining and
holds one row per distinct combination, so the reports below cost next to nothing and
no hot theme ever meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.dates import partial_flag
from tallymark.functions.labels import capped, flag_sum, label_set, set_size
from tallymark.functions.rates import rate
from tallymark.operators.grids import each, position_in, year_axis, zero_filled
from tallymark.operators.joins import or_zero, small
from tallymark.operators.labelling import FALLBACK, keys_of, record_routes
from tallymark.session import written
from tallymark.sources.rules import RuleBook
from tallymark.vocab import (
    CATCH_ALL,
    DOMAIN_SERIES,
    MIN_PAPERS_PER_COLUMN,
    MINIMUM_LABELS,
    MODALITIES,
    THEMES,
    TOP_COMBINATIONS,
    canonical_order,
)


def label_profile(labels: DataFrame) -> DataFrame:
    flags = [c for c in labels.columns if c.startswith(("theme_", "mod_"))]
    if "is_primary_research" not in labels.columns:
        labels = labels.withColumn("is_primary_research", F.lit(1))
    return labels.groupBy(*flags, "domain", "year", "is_primary_research").agg(
        F.count("*").alias("n")
    )


def _profile(table: DataFrame) -> DataFrame:
    """A profile as it is; a label table is profiled once and the result written, so that
    the rules behind it are not run again by every report that reads the profile twice."""
    return table if "n" in table.columns else written(label_profile(table), "label-profile")


def _themes(table: DataFrame) -> list[str]:
    return canonical_order(keys_of(table, "theme_"), THEMES)


def _modalities(table: DataFrame) -> list[str]:
    return canonical_order(keys_of(table, "mod_"), MODALITIES)


def _each_theme(table: DataFrame, allowed: dict[str, Column] | None = None) -> DataFrame:
    """One row per theme a profile row carries (and is allowed in)."""
    allowed = allowed or {}
    carried = F.array(
        *[
            F.when((F.col(f"theme_{k}") == 1) & allowed.get(k, F.lit(True)), F.lit(k))
            for k in _themes(table)
        ]
    )
    return table.withColumn("theme", F.explode(F.filter(carried, lambda x: x.isNotNull())))


def combination_counts(
    table: DataFrame, primary_only: bool = True, minimum: dict[str, int] | None = None
) -> DataFrame:
    """Records per theme and exact label set, ranked within the theme."""
    minimum = MINIMUM_LABELS if minimum is None else minimum
    profile = table if "n" in table.columns else label_profile(table)
    mods = _modalities(profile)
    size = set_size(mods)
    allowed = {}
    if primary_only:
        profile = profile.where("is_primary_research = 1")
        allowed = {k: size >= least for k, least in minimum.items()}
    counts = (
        _each_theme(profile, allowed)
        .groupBy("theme", label_set(mods).alias("modality_set"), size.alias("n_modalities"))
        .agg(F.sum("n").alias("n_papers"))
    )
    order = Window.partitionBy("theme").orderBy(F.desc("n_papers"), "n_modalities", "modality_set")
    return counts.withColumn("rank_in_theme", F.row_number().over(order))


def theme_year_counts(
    table: DataFrame, partial_year: int | None = None, years: tuple[int, int] | None = None
) -> DataFrame:
    """Dense theme x domain x year; ``all`` is the total of the four domains."""
    profile = _profile(table)
    counts = _each_theme(profile).groupBy("theme", "domain", "year").agg(F.sum("n").alias("n_papers"))
    # grouping sets over the small count table give the totals without a second scan
    counts = counts.groupingSets(
        [["theme", "domain", "year"], ["theme", "year"]], "theme", "domain", "year"
    ).agg(F.sum("n_papers").alias("n_papers"))
    counts = counts.withColumn("domain", F.coalesce("domain", F.lit("all")))
    grid = each(year_axis(profile, years=years), "domain", DOMAIN_SERIES)
    grid = each(grid, "theme", _themes(profile))
    return zero_filled(grid, counts, ["theme", "domain", "year"], "n_papers").select(
        "theme", "domain", "year", "n_papers", partial_flag("year", partial_year).alias("partial_year")
    )


def minimum_shortfalls(table: DataFrame, minimum: dict[str, int] | None = None) -> DataFrame:
    """Records below a theme's minimum: among primary research, and corpus-wide."""
    minimum = MINIMUM_LABELS if minimum is None else minimum
    profile = _profile(table)
    size = set_size(_modalities(profile))
    themes = [t for t in minimum if t in _themes(profile)]
    short = {t: (F.col(f"theme_{t}") == 1) & (size < minimum[t]) for t in themes}
    sums = []
    for t in themes:
        primary = short[t] & (F.col("is_primary_research") == 1)
        sums += [
            F.sum(F.when(primary, F.col("n"))).alias(f"p_{t}"),
            F.sum(F.when(short[t], F.col("n"))).alias(f"c_{t}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("theme"),
                F.lit(minimum[t]).alias("minimum"),
                or_zero(f"p_{t}").alias("panel_a"),
                or_zero(f"c_{t}").alias("corpus_wide"),
            )
            for t in themes
        ]
    )
    return profile.agg(*sums).select(F.inline(rows))


def label_totals(table: DataFrame) -> DataFrame:
    """Per theme, modality, domain, none and two-or-more: retained and primary counts."""
    profile = _profile(table)
    themes, mods = _themes(profile), _modalities(profile)
    n_themes = flag_sum([f"theme_{k}" for k in themes])
    n_named = flag_sum([f"mod_{k}" for k in mods if k != CATCH_ALL])

    def group(kind, key, when):
        return F.when(when, F.struct(F.lit(kind).alias("kind"), key.alias("key")))

    groups = (
        [group("theme", F.lit(k), F.col(f"theme_{k}") == 1) for k in themes]
        + [group("theme", F.lit("(no theme)"), n_themes == 0)]
        + [group("theme", F.lit("(two or more themes)"), n_themes > 1)]
        + [group("modality", F.lit(k), F.col(f"mod_{k}") == 1) for k in mods]
        + [group("modality", F.lit("(two or more named)"), n_named > 1)]
        + [group("domain", F.col("domain"), F.lit(True))]
        + [group("population", F.lit("retained"), F.lit(True))]
    )
    member = F.explode(F.filter(F.array(*groups), lambda x: x.isNotNull())).alias("g")
    counts = (
        profile.select("n", "is_primary_research", member)
        .groupBy("g.kind", "g.key")
        .agg(
            F.sum("n").alias("n_retained"),
            F.sum(F.when(F.col("is_primary_research") == 1, F.col("n")).otherwise(0)).alias("n_primary"),
        )
    )
    fixed = [("theme", k) for k in [*themes, "(no theme)", "(two or more themes)"]]
    fixed += [("modality", k) for k in [*mods, "(two or more named)"]]
    wanted = table.sparkSession.createDataFrame(fixed, "kind string, key string")
    return (
        counts.join(F.broadcast(wanted), ["kind", "key"], "full_outer")
        .select("kind", "key", or_zero("n_retained").alias("n_retained"), or_zero("n_primary").alias("n_primary"))
    )


def labels_per_record(table: DataFrame, top: int = 4) -> DataFrame:
    """Histogram of named labels per record; the last bucket means that many or more."""
    profile = _profile(table)
    named = [f"mod_{k}" for k in _modalities(profile) if k != CATCH_ALL]
    counts = profile.groupBy(capped(flag_sum(named), top).alias("n_named")).agg(
        F.sum("n").alias("n_papers")
    )
    axis = profile.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("n_named"))
    return zero_filled(axis, counts, ["n_named"], "n_papers")


def exclusion_counts(annotated: DataFrame, reasons) -> DataFrame:
    """Records per reason in a fixed order, zeros kept."""
    counts = annotated.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n_records"))
    spark = annotated.sparkSession
    wanted = spark.createDataFrame(
        [(r, i) for i, r in enumerate(reasons, 1)], "reason string, position int"
    )
    return counts.join(F.broadcast(wanted), "reason", "right").select(
        "position", "reason", or_zero("n_records").alias("n_records")
    )


def rule_firing_counts(hits: DataFrame) -> DataFrame:
    """Records per rule that fired.

    A record has one hit row for a rule, so rows are counted, on the map side; ids are unique after the keep-first pass.
    """
    return hits.groupBy("pattern_id", "pattern", "role").agg(F.count("*").alias("n_records"))


def silent_rules(rules: DataFrame, hits: DataFrame) -> DataFrame:
    """Rules that fired on no record."""
    fired = hits.select("pattern_id").distinct()
    return rules.join(F.broadcast(fired), "pattern_id", "left_anti").select("pattern_id", "pattern")


def catch_all_routes(annotated: DataFrame) -> DataFrame:
    """Records that reached the catch-all by one of its rules, by fallback, and in all."""
    route = F.col("other_route")
    return record_routes(annotated).agg(
        F.count_if(route == "pattern").alias("by_pattern"),
        F.count_if(route == "fallback").alias("by_fallback"),
        F.count_if(route != "none").alias("total"),
    )


def by_data_type(annotated: DataFrame, book: RuleBook, types: dict[str, str], dictionary: str = "modality", category: str = CATCH_ALL) -> DataFrame:
    """Per data type, which one or several rules of a category stand for: records, and records resting on it alone.

    A record counts once for a type however many of its rules fired; the answer for a record comes from its own row.
    ``types`` gives the type of each ``pattern_id``, the fallback's among them.
    """
    rules = [r for r in book.rules if (r.dictionary, r.category, r.role) == (dictionary, category, "include")]
    of = {r.ordinal: types[r.pattern_id] for r in rules if r.pattern_id in types}
    patterns = {t: " | ".join(r.pattern_id for r in rules if types.get(r.pattern_id) == t) for t in of.values()}
    fallback = f"{category}:fallback"
    if category == CATCH_ALL and fallback in types:
        of[FALLBACK] = types[fallback]
        patterns[types[fallback]] = " | ".join(x for x in (patterns.get(types[fallback]), fallback) if x)
    type_of = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    found = F.transform("fired", lambda f: F.try_element_at(type_of, f["ordinal"]))
    kinds = F.array_distinct(F.filter(found, lambda t: t.isNotNull()))
    rows = annotated.where("reason is null").select(kinds.alias("_k")).select(F.size("_k").alias("k"), F.explode("_k").alias("data_type"))
    listed = F.create_map(*[F.lit(x) for pair in patterns.items() for x in pair])
    return rows.groupBy("data_type").agg(
        F.count("*").alias("n_papers"), F.count_if(F.col("k") == 1).alias("n_papers_sole_evidence")
    ).select("data_type", "n_papers", "n_papers_sole_evidence", F.element_at(listed, F.col("data_type")).alias("patterns"))


def catch_all_breakdown(hits: DataFrame, titles: DataFrame, n_titles: int = 2) -> DataFrame:
    """Per rule of the catch-all: records, records resting on it alone, example titles.

    Example titles are the first few by id; they are kept with a bounded minimum per rule
    before anything is gathered.
    """
    from tallymark.operators.ranking import top_per_group

    other = hits.where((F.col("category") == CATCH_ALL) & F.col("role").isin("include", "fallback"))
    per_record = other.groupBy("pmid").agg(F.array_sort(F.collect_set("pattern_id")).alias("rules"))
    pairs = per_record.select("pmid", F.size("rules").alias("k"), F.explode("rules").alias("pattern_id"))
    counts = pairs.groupBy("pattern_id").agg(
        F.count("*").alias("n_papers"), F.count_if(F.col("k") == 1).alias("n_papers_sole_evidence")
    )
    chosen = top_per_group(pairs, ["pattern_id"], [F.col("pmid")], n_titles, "pos")
    # a few rows a rule, stored, so that only their texts are picked out of the corpus
    chosen = written(chosen, "examples")
    picked = titles.join(small(chosen.select("pmid").distinct()), "pmid", "left_semi").select("pmid", "title")
    examples = (
        chosen.join(picked, "pmid", "left")
        .groupBy("pattern_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("t"))
        .select("pattern_id", F.array_join(F.col("t.title"), " || ").alias("example_titles"))
    )
    route = F.when(F.col("pattern_id").endswith(":fallback"), "fallback").otherwise("pattern")
    return counts.join(examples, "pattern_id").select(
        "pattern_id", route.alias("route"), "n_papers", "n_papers_sole_evidence", "example_titles"
    )


def pattern_census(hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Of the judged records a rule fired on, how many were judged right."""
    fired = hits.where("role = 'include'").select("pmid", "pattern_id").distinct()
    return (
        fired.join(verdicts.select("pmid", "verdict"), "pmid")
        .groupBy("pattern_id")
        .agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == 1).alias("tp"))
        .withColumn("precision", rate("tp", "n"))
    )


def top_combinations(
    combos: DataFrame, top_n: int = TOP_COMBINATIONS, floor: int = MIN_PAPERS_PER_COLUMN
) -> DataFrame:
    """The combinations shown per theme, largest first, richer sets first among equals.

    Sets below ``floor`` give way only where enough larger ones exist to fill the block.
    """
    theme = Window.partitionBy("theme")
    enough = F.count_if(F.col("n_papers") >= floor).over(theme) >= top_n
    order = theme.orderBy(F.desc("n_papers"), F.desc("n_modalities"), "modality_set")
    return (
        combos.withColumn("_enough", enough)
        .where(~F.col("_enough") | (F.col("n_papers") >= floor))
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= top_n)
        .select("theme", "modality_set", "n_modalities", "n_papers", "position")
    )


def tail_summary(combos: DataFrame, top_n: int = TOP_COMBINATIONS) -> DataFrame:
    """Per theme: sets and records shown, and what the remainder column carries."""
    shown = top_combinations(combos, top_n).select("theme", "modality_set", F.lit(1).alias("shown"))
    marked = combos.join(shown, ["theme", "modality_set"], "left")
    is_shown = F.col("shown").isNotNull()
    return (
        marked.groupBy("theme")
        .agg(
            F.count_if(is_shown).alias("shown_sets"),
            F.count_if(~is_shown).alias("remainder_sets"),
            F.sum(F.when(is_shown, F.col("n_papers")).otherwise(0)).alias("shown_papers"),
            F.sum(F.when(~is_shown, F.col("n_papers")).otherwise(0)).alias("remainder_papers"),
            F.sum("n_papers").alias("total_papers"),
        )
        .withColumn("remainder_share", F.coalesce(rate("remainder_papers", "total_papers"), F.lit(0.0)))
    )


def series_summary(series: DataFrame, by: list[str], value: str) -> DataFrame:
    """Total and peak per series."""
    return series.groupBy(*by).agg(F.sum(value).alias("total"), F.max(value).alias("peak"))


def share_of(df: DataFrame, by: list[str], value: str, alias: str = "share") -> DataFrame:
    """Each row's share of its group's total; count tables only."""
    return df.withColumn(alias, rate(value, F.sum(value).over(Window.partitionBy(*by))))


def in_vocabulary_order(df: DataFrame, *ranked: tuple[str, tuple]) -> DataFrame:
    """Sort by fixed lists, unknown values last and alphabetical."""
    order = reduce(lambda a, c: [*a, position_in(c[1], c[0]), F.col(c[0])], ranked, [])
    return df.orderBy(*order)


def parse_summary(records: DataFrame, captured: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """What a scan produced, as ``(metric, key, value)``, from one grouped pass.

    With the records as ``captured``, before copies were dropped, and the capture's ``files``, it also says
    how many of either there were.
    """
    profile = records.groupBy(
        "record_type", "has_abstract", "abstract_structured", "year_source", "language", "year"
    ).agg(F.count("*").alias("n"))

    def metric(name, key=None, when=None):
        entry = F.struct(
            F.lit(name).alias("metric"),
            (F.lit("") if key is None else F.coalesce(key.cast("string"), F.lit(""))).alias("key"),
        )
        return F.when(F.lit(True) if when is None else when, entry)

    c = F.col
    rows = F.array(
        metric("records"),
        metric("records_by_type", c("record_type")),
        metric("without_abstract", when=~c("has_abstract")),
        metric("structured_abstract", when=c("abstract_structured")),
        metric("unstructured_abstract", when=c("has_abstract") & ~c("abstract_structured")),
        metric("without_year", when=c("year").isNull()),
        metric("year_source", c("year_source")),
        metric("language", c("language")),
        metric("year", c("year"), c("year").isNotNull()),
    )
    summary = (
        profile.select("n", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("m"))
        .groupBy("m.metric", "m.key")
        .agg(F.sum("n").alias("value"))
    )
    if files is not None:
        summary = summary.unionByName(files.agg(F.count("*").alias("value")).select(F.lit("files").alias("metric"), F.lit("").alias("key"), "value"))
    if captured is not None:
        signed = captured.select(F.lit(1).alias("n")).unionByName(records.select(F.lit(-1).alias("n")))
        dropped = signed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value"))
        summary = summary.unionByName(dropped.select(F.lit("duplicate_pmids_dropped").alias("metric"), F.lit("").alias("key"), "value"))
    return summary
