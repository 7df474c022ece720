"""Reproducible stratified sampling.

A draw orders each stratum by a hash of seed, stratum and id.  That makes it repeatable
from the seed, blind to the order of the input, and independent between strata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.labels import any_flag, differing, disagreement_count, disagreement_string, label_string
from tallymark.operators.joins import small
from tallymark.operators.ranking import top_per_group
from tallymark.session import written
from tallymark.vocab import (
    AUDIT_SIZES,
    MODALITIES,
    RARE_MODALITIES,
    SAMPLE_SIZES,
    STRATA,
    TARGETED_CATEGORY,
    TARGETED_STRATA,
    THEMES,
)


def draw_key(seed: int, stratum, id_="pmid") -> Column:
    stratum = F.col(stratum) if isinstance(stratum, str) else stratum
    return F.md5(F.concat_ws("|", F.lit(str(seed)), stratum, F.col(id_)))


def assign_strata(labels: DataFrame, strata=STRATA, rare=RARE_MODALITIES) -> DataFrame:
    """Each record joins the first stratum it qualifies for."""
    missing = [k for k in THEMES if f"theme_{k}" in labels.columns and k not in strata]
    if missing:
        raise ValueError(f"themes without a stratum would never be measured: {', '.join(missing)}")
    stratum = None
    for name in strata:
        if name == "no_theme":
            continue
        test = any_flag([f"mod_{m}" for m in rare]) if name == "rare_modality" else F.col(f"theme_{name}") == 1
        stratum = F.when(test, name) if stratum is None else stratum.when(test, name)
    return labels.withColumn("stratum", stratum.otherwise("no_theme"))


def claim_strata(labels: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Overlapping strata as SQL conditions, in the caller's order; unclaimed rows leave."""
    stratum = None
    for name, condition in conditions.items():
        test = F.expr(condition)
        stratum = F.when(test, name) if stratum is None else stratum.when(test, name)
    return labels.withColumn("stratum", stratum).where("stratum is not null")


def _draw(frame: DataFrame, seed: int, sizes: dict[str, int]) -> DataFrame:
    wanted = {k: int(v) for k, v in sizes.items() if v > 0}
    size_of = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    populations = frame.groupBy("stratum").agg(F.count("*").alias("n_population"))
    drawn = top_per_group(
        frame.where(F.col("stratum").isin(*wanted)),
        ["stratum"],
        [draw_key(seed, "stratum"), F.col("pmid")],
        max(wanted.values()),
        "_draw",
    ).where(F.col("_draw") <= F.try_element_at(size_of, F.col("stratum")))
    # one row per stratum
    return (
        drawn.drop("_draw")
        .join(F.broadcast(populations), "stratum")
        .withColumn(
            "n_sampled",
            F.least(F.try_element_at(size_of, F.col("stratum")).cast("bigint"), F.col("n_population")),
        )
        .withColumn("weight", F.col("n_population") / F.col("n_sampled"))
    )


def draw_sample(labels: DataFrame, seed: int, sizes: dict[str, int] | None = None, strata=STRATA) -> DataFrame:
    """Stratified sample with population, sampled size and weight; small strata whole."""
    sizes = dict(SAMPLE_SIZES if sizes is None else sizes)
    unknown = sorted(set(sizes) - set(strata))
    if unknown:
        raise ValueError(f"unknown stratum in sizes: {', '.join(unknown)}")
    return _draw(assign_strata(labels, strata), seed, sizes)


def draw_targeted(
    labels: DataFrame,
    sizes: dict[str, int],
    seed: int,
    already_read: DataFrame | None = None,
    strata: dict[str, str] | None = None,
    category: dict[str, str] | None = None,
) -> DataFrame:
    """Sample of rule-positive strata, leaving out ids read in earlier rounds."""
    strata = TARGETED_STRATA if strata is None else strata
    category = TARGETED_CATEGORY if category is None else category
    unknown = sorted(set(sizes) - set(strata))
    if unknown:
        raise ValueError(f"unknown stratum in sizes: {', '.join(unknown)}")
    if already_read is not None:
        labels = labels.join(already_read.select("pmid"), "pmid", "left_anti")
    frame = claim_strata(labels, {name: strata[name] for name in sizes})
    names = F.create_map(*[F.lit(x) for pair in category.items() for x in pair])
    return _draw(frame, seed, sizes).withColumn("category", F.try_element_at(names, F.col("stratum")))


def blind_sheet(sample: DataFrame, records: DataFrame, seed: int) -> DataFrame:
    """Numbered reading sheet: id and text only, in an order that says nothing.

    The sample is as large as the sizes asked for, so numbering it in one task is bounded.
    """
    text = records.select("pmid", "title", F.coalesce("abstract", F.lit("")).alias("abstract"))
    shuffled = Window.orderBy(draw_key(seed, F.lit("sheet")), "pmid")
    return (
        text.join(small(sample.select("pmid")), "pmid")
        .withColumn("has_abstract", (F.length("abstract") > 0).cast("int"))
        .withColumn("item", F.row_number().over(shuffled))
        .select("item", "pmid", "title", "abstract", "has_abstract")
    )


def missing_text(sample: DataFrame, records: DataFrame) -> DataFrame:
    """Sampled ids with no text; the sheet must not be used unless this is empty."""
    ids = sample.select("pmid")
    there = records.join(small(ids.distinct()), "pmid", "left_semi").where("title is not null").select("pmid")
    return ids.join(there, "pmid", "left_anti")


def refresh_labels(sample: DataFrame, labels: DataFrame) -> DataFrame:
    """Today's rule labels under a draw that stays as it was; a lost id keeps null labels."""
    flags = [c for c in sample.columns if c.startswith(("theme_", "mod_"))]
    kept = sample.drop(*flags)
    fresh = labels.select("pmid", *flags).join(small(sample.select("pmid")), "pmid", "left_semi")
    return kept.join(fresh, "pmid", "left").select(*sample.columns)


def lost_ids(refreshed: DataFrame) -> DataFrame:
    flag = next(c for c in refreshed.columns if c.startswith(("theme_", "mod_")))
    return refreshed.where(F.col(flag).isNull()).select("pmid")


def audit_sheet(
    joined: DataFrame,
    records: DataFrame,
    seed: int,
    sizes: dict[str, int] | None = None,
    themes=THEMES,
    modalities=MODALITIES,
) -> DataFrame:
    """A random part and a part drawn from the remaining disagreements, never overlapping."""
    sizes = {**AUDIT_SIZES, **(sizes or {})}
    keys = [*themes, *modalities]
    conflict = F.greatest(*[d.cast("int") for d in differing(keys)]) == 1
    id_ = [F.col("pmid")]
    one = joined.withColumn("_all", F.lit(1))
    first = top_per_group(
        one, ["_all"], [draw_key(seed, F.lit("random")), *id_], sizes["random"], "_p"
    )
    rest = one.where(conflict).join(F.broadcast(first.select("pmid")), "pmid", "left_anti")
    second = top_per_group(
        rest, ["_all"], [draw_key(seed, F.lit("disagreement")), *id_], sizes["disagreement"], "_p"
    ).select(*first.columns)
    chosen = first.withColumn("audit_stratum", F.lit("random")).unionByName(
        second.withColumn("audit_stratum", F.lit("disagreement"))
    )
    # the rows that were drawn, stored, pick their texts out of the corpus
    chosen = written(chosen, "audit")
    text = records.join(small(chosen.select("pmid")), "pmid", "left_semi").select("pmid", "title", F.coalesce("abstract", F.lit("")).alias("abstract"))
    blank = [F.lit("").alias(c) for c in ("author_themes", "author_modalities", "author_verdict", "author_note")]
    extra = [c for c in ("agent_uncertain", "agent_note") if c in joined.columns]
    return chosen.join(text, "pmid", "left").select(
        "audit_stratum",
        "pmid",
        "stratum",
        disagreement_count(keys).alias("n_disagreements"),
        disagreement_string(keys).alias("disagreed_on"),
        "title",
        "abstract",
        label_string(themes, "agent_").alias("agent_themes"),
        label_string(themes, "rule_").alias("rule_themes"),
        label_string(modalities, "agent_").alias("agent_modalities"),
        label_string(modalities, "rule_").alias("rule_modalities"),
        *extra,
        *blank,
    )
