"""Rules against a second labeler: agreement, disagreements, causes, routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.labels import any_flag
from tallymark.functions.rates import f1, rate, wilson
from tallymark.operators.joins import key_differences
from tallymark.vocab import CATCH_ALL, CAUSES, MODALITIES, ROUTE_CLAIMS

_META = {"uncertain": "agent_uncertain", "note": "agent_note", "other_datatype": "agent_other_datatype"}


def bare(column: str) -> str:
    """``theme_x`` and ``mod_x`` both address category ``x``."""
    return column.split("_", 1)[1]


def join_labels(design: DataFrame, agent: DataFrame) -> DataFrame:
    """One row per sampled record: ``rule_<key>`` beside ``agent_<key>``."""
    flags = [c for c in design.columns if c.startswith(("theme_", "mod_"))]
    carried = [c for c in ("stratum", "n_population", "n_sampled", "weight") if c in design.columns]
    rules = design.select("pmid", *carried, *[F.col(c).alias(f"rule_{bare(c)}") for c in flags])
    mine = agent.select(
        "pmid",
        *[F.col(c).alias(f"agent_{bare(c)}") for c in flags if c in agent.columns],
        *[F.col(c).alias(name) for c, name in _META.items() if c in agent.columns],
    )
    return rules.join(mine, "pmid")


def id_mismatch(design: DataFrame, agent: DataFrame) -> DataFrame:
    """Ids only one side has; a join over a non-empty result would move denominators."""
    return key_differences(design, agent, "pmid", ("sample", "agent"))


def long_pairs(joined: DataFrame, keys) -> DataFrame:
    """``(pmid, stratum, weight, category, rule, agent)``: one row per record and category."""
    carried = [c for c in ("pmid", "stratum", "weight", "agent_uncertain") if c in joined.columns]
    pairs = F.array(
        *[
            F.struct(
                F.lit(k).alias("category"),
                F.col(f"rule_{k}").alias("rule"),
                F.col(f"agent_{k}").alias("agent"),
            )
            for k in keys
        ]
    )
    return joined.select(*carried, F.inline(pairs))


def agreement_table(joined: DataFrame, keys) -> DataFrame:
    """Counts, rates with intervals, and weighted estimates for each category."""
    cells = {"tp": (1, 1), "fp": (1, 0), "fn": (0, 1), "tn": (0, 0)}
    sums = []
    for name, (r, a) in cells.items():
        hit = (F.col("rule") == r) & (F.col("agent") == a)
        sums.append(F.count_if(hit).alias(name))
        sums.append(F.sum(F.when(hit, F.col("weight")).otherwise(0.0)).alias(f"w_{name}"))
    table = long_pairs(joined, keys).groupBy("category").agg(*sums)
    table = table.withColumns({"n_system": F.expr("tp + fp"), "n_reference": F.expr("tp + fn")})
    p_lo, p_hi = wilson("tp", "n_system")
    r_lo, r_hi = wilson("tp", "n_reference")
    w_system, w_reference = F.expr("w_tp + w_fp"), F.expr("w_tp + w_fn")
    return table.select(
        "category", "tp", "fp", "fn", "tn", "n_system", "n_reference",
        rate("tp", "n_system").alias("precision"), p_lo.alias("precision_lo"), p_hi.alias("precision_hi"),
        rate("tp", "n_reference").alias("recall"), r_lo.alias("recall_lo"), r_hi.alias("recall_hi"),
        f1("tp", "fp", "fn").alias("f1"),
        rate("w_tp", w_system).alias("est_precision"),
        rate("w_tp", w_reference).alias("est_recall"),
        f1("w_tp", "w_fp", "w_fn").alias("est_f1"),
        w_system.alias("est_papers_system"),
        w_reference.alias("est_papers_reference"),
    )


def disagreements(joined: DataFrame, keys) -> DataFrame:
    """One row per record and category where the two labelers differ."""
    uncertain = F.col("agent_uncertain") if "agent_uncertain" in joined.columns else F.lit(0)
    return (
        long_pairs(joined, keys)
        .where("rule <> agent")
        .select(
            "pmid", "stratum", "category", "rule", "agent",
            F.when(F.col("rule") == 1, "false_positive").otherwise("false_negative").alias("kind"),
            uncertain.alias("agent_uncertain"),
        )
    )


def exact_match_rate(joined: DataFrame, keys) -> DataFrame:
    """Per stratum: records on which every category agrees."""
    every = reduce(lambda a, b: a & b, [F.col(f"rule_{k}") == F.col(f"agent_{k}") for k in keys])
    return (
        joined.groupBy("stratum")
        .agg(F.count_if(every).alias("n_match"), F.count("*").alias("n"))
        .withColumn("rate", rate("n_match", "n"))
    )


def cause_problems(causes: DataFrame, splits: DataFrame) -> DataFrame:
    """Disagreements without a cause, causes without a disagreement, unknown codes."""
    key = F.concat_ws("/", "pmid", "category")
    ends = key_differences(splits, causes, ["pmid", "category"], ("uncoded", "spurious")).select(
        F.col("only_in").alias("check"), key.alias("key")
    )
    bad = causes.where(~F.col("cause").isin(*CAUSES)).select(
        F.lit("unknown_cause").alias("check"), key.alias("key")
    )
    return ends.unionByName(bad)


def cause_summary(causes: DataFrame, splits: DataFrame) -> DataFrame:
    """Disagreements by cause and direction; the direction is the disagreement's own."""
    own = splits.select("pmid", "category", "kind")
    counts = (
        causes.drop("kind")
        .join(own, ["pmid", "category"], "left")
        .groupBy("cause")
        .pivot("kind", ["false_negative", "false_positive"])
        .count()
        .na.fill(0, ["false_negative", "false_positive"])
        .withColumn("total", F.expr("false_negative + false_positive"))
    )
    from tallymark.operators.counts import share_of

    return share_of(counts.withColumn("_all", F.lit(1)), ["_all"], "total").drop("_all")


def score_routes(joined: DataFrame, modalities=MODALITIES) -> DataFrame:
    """Each route against the claim it makes, with an interval.

    The pattern route claims a data type beyond the named ones; the fallback claims that
    none of the named ones is there.
    """
    named = any_flag([f"agent_{k}" for k in modalities if k != CATCH_ALL])
    by_pattern = F.col("other_route").isin("pattern", "both")
    by_fallback = F.col("other_route") == "fallback"
    one = joined.agg(
        F.count_if(by_pattern).alias("n_pattern"),
        F.count_if(by_pattern & (F.col("agent_other_datatype") == 1)).alias("ok_pattern"),
        F.count_if(by_fallback).alias("n_fallback"),
        F.count_if(by_fallback & ~named).alias("ok_fallback"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(route).alias("route"),
                F.lit(claim).alias("claim"),
                F.col(f"n_{route}").alias("n"),
                F.col(f"ok_{route}").alias("correct"),
            )
            for route, claim in ROUTE_CLAIMS.items()
        ]
    )
    lo, hi = wilson("correct", "n")
    return one.select(F.inline(rows)).select(
        "*", rate("correct", "n").alias("precision"), lo.alias("lo"), hi.alias("hi")
    )
