"""Sampling properties, scoring rules and contracts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions.rates import f1, wilson
from tallymark.operators import contracts, sampling, scoring
from tallymark.plans.measure_rules import measure
from tallymark.vocab import MODALITIES, STRATA, THEMES

SIZES = {"agentic_ai": 5, "rare_modality": 4, "foundation_models": 6, "no_theme": 8}


@pytest.fixture(scope="module")
def labels(spark):
    rng = random.Random(11)
    data = [
        (str(i), *[int(rng.random() < 0.08) for _ in THEMES], *[int(rng.random() < 0.1) for _ in MODALITIES])
        for i in range(900)
    ]
    columns = ["pmid string", *[f"theme_{k} int" for k in THEMES], *[f"mod_{k} int" for k in MODALITIES]]
    return spark.createDataFrame(data, ", ".join(columns))


def test_strata_partition(labels):
    strata = sampling.assign_strata(labels)
    assert strata.count() == 900 and strata.where("stratum IS NULL").isEmpty()
    both = strata.where("theme_agentic_ai = 1 AND theme_foundation_models = 1")
    assert both.where("stratum <> 'agentic_ai'").isEmpty()
    with pytest.raises(ValueError, match="digital_twins"):
        sampling.assign_strata(labels, [s for s in STRATA if s != "digital_twins"])


def test_draw_is_repeatable_and_blind_to_order(labels, rows):
    first = rows(sampling.draw_sample(labels, 1, SIZES), "pmid", "stratum", "weight")
    assert first == rows(sampling.draw_sample(labels.orderBy(F.desc("pmid")).repartition(5), 1, SIZES), "pmid", "stratum", "weight")
    assert first != rows(sampling.draw_sample(labels, 2, SIZES), "pmid", "stratum", "weight")


def test_resizing_one_stratum_leaves_the_others(labels, rows):
    a = sampling.draw_sample(labels, 1, SIZES).where("stratum <> 'no_theme'")
    b = sampling.draw_sample(labels, 1, {**SIZES, "no_theme": 40}).where("stratum <> 'no_theme'")
    assert rows(a, "pmid") == rows(b, "pmid")


def test_small_strata_are_taken_whole_and_weights_restore_the_population(labels):
    sample = sampling.draw_sample(labels, 1, {"agentic_ai": 10_000, "no_theme": 8})
    sums = {
        r["stratum"]: (r["n"], r["w"], r["p"])
        for r in sample.groupBy("stratum")
        .agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.max("n_population").alias("p"))
        .collect()
    }
    assert sums["agentic_ai"][0] == sums["agentic_ai"][2]
    assert sums["no_theme"][0] == 8
    assert all(math.isclose(w, p) for _, w, p in sums.values())
    with pytest.raises(ValueError, match="unknown stratum"):
        sampling.draw_sample(labels, 1, {"nowhere": 3})


def test_targeted_draw(labels, rows):
    read = labels.where("theme_digital_twins = 1").limit(5).select("pmid")
    sizes = {"digital_twins": 8, "genomics_alone": 8}
    sample = sampling.draw_targeted(labels, sizes, 3, read)
    assert sample.join(read, "pmid").isEmpty()
    assert sample.where("stratum = 'digital_twins' AND theme_digital_twins = 0").isEmpty()
    assert rows(sample.select("category").distinct()) == [("digital_twins",), ("genomics",)]


def test_blind_sheet_and_missing_text(labels, spark):
    sample = sampling.draw_sample(labels, 1, SIZES)
    records = labels.select("pmid", F.concat(F.lit("t"), "pmid").alias("title"), F.lit(None).cast("string").alias("abstract"))
    sheet = sampling.blind_sheet(sample, records, 1).orderBy("item").collect()
    assert [r["item"] for r in sheet] == list(range(1, len(sheet) + 1)) and len(sheet) == sample.count()
    assert set(sheet[0].asDict()) == {"item", "pmid", "title", "abstract", "has_abstract"}
    assert [r["pmid"] for r in sheet] != sorted(r["pmid"] for r in sheet)
    assert sampling.missing_text(sample, records).isEmpty()
    assert sampling.missing_text(sample, records.where("pmid < '5'")).count() > 0


@pytest.fixture(scope="module")
def joined(spark):
    rng = random.Random(2)
    data = [
        (str(i), rng.choice(["s1", "s2"]), float(rng.randint(1, 9)), *[int(rng.random() < 0.4) for _ in range(4)], 0)
        for i in range(120)
    ]
    return spark.createDataFrame(
        data,
        "pmid string, stratum string, weight double, rule_a int, agent_a int, rule_b int, agent_b int, agent_uncertain int",
    )


def test_agreement_against_plain_counts(joined):
    data = [r.asDict() for r in joined.collect()]
    for row in scoring.agreement_table(joined, ["a", "b"]).collect():
        k = row["category"]
        cell = lambda r, a, w: sum(w(x) for x in data if (x[f"rule_{k}"], x[f"agent_{k}"]) == (r, a))
        one, weight = (lambda x: 1), (lambda x: x["weight"])
        assert (row["tp"], row["fp"], row["fn"], row["tn"]) == tuple(cell(*c, one) for c in ((1, 1), (1, 0), (0, 1), (0, 0)))
        assert math.isclose(row["est_precision"], cell(1, 1, weight) / (cell(1, 1, weight) + cell(1, 0, weight)))
        assert math.isclose(row["est_papers_reference"], cell(1, 1, weight) + cell(0, 1, weight))


def test_undefined_rates(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (2, 1, 1)], "tp int, fp int, fn int")
    assert [r[0] if r[0] is None else round(r[0], 6) for r in df.select(f1("tp", "fp", "fn")).collect()] == [None, 0.0, 0.666667]
    lo, hi = wilson("tp", F.col("tp") + F.col("fp"))
    got = [(r[0], r[1]) for r in df.select(lo, hi).collect()]
    assert got[0] == (None, None) and got[1][0] == 0.0
    known = spark.createDataFrame([(17, 25)], "k int, n int").select(*wilson("k", "n")).first()
    assert (round(known[0], 2), round(known[1], 2)) == (0.48, 0.83)


def test_disagreements_and_causes(joined, spark, rows):
    splits = scoring.disagreements(joined, ["a", "b"])
    assert splits.where("rule = 1 AND kind <> 'false_positive'").isEmpty()
    causes = splits.select("pmid", "category", F.lit("rule_gap").alias("cause"), F.lit("wrong way").alias("kind"))
    assert scoring.cause_problems(causes, splits).isEmpty()
    summary = scoring.cause_summary(causes, splits).first()
    assert summary["total"] == splits.count() and summary["share"] == 1.0
    assert summary["false_positive"] == splits.where("rule = 1").count()
    spurious = causes.where("category = 'a'").unionByName(
        spark.createDataFrame([("x", "a", "no_such", "")], "pmid string, category string, cause string, kind string")
    )
    checks = {r["check"] for r in scoring.cause_problems(spurious, splits).collect()}
    assert checks == {"uncoded", "spurious", "unknown_cause"}


def test_audit_halves_never_overlap(joined, spark):
    keys = dict(themes=["a"], modalities=["b"])
    records = joined.select("pmid", F.lit("t").alias("title"), F.lit(None).cast("string").alias("abstract"))
    sheet = sampling.audit_sheet(joined, records, 4, {"random": 10, "disagreement": 12}, **keys)
    got = sheet.collect()
    assert len(got) == 22 and len({r["pmid"] for r in got}) == 22
    assert all(r["n_disagreements"] > 0 for r in got if r["audit_stratum"] == "disagreement")
    assert all((r["disagreed_on"] == "(none)") == (r["n_disagreements"] == 0) for r in got)


def test_measure_refuses_sheets_that_do_not_match(spark, labels):
    sample = sampling.draw_sample(labels, 1, SIZES)
    flags = [c for c in sample.columns if c.startswith(("theme_", "mod_"))]
    sheet = sample.select("pmid", *flags)
    scores = measure(sample, sheet, labels)
    assert scores.agreement.where("fp + fn > 0").isEmpty() and scores.disagreements.isEmpty()
    assert scores.exact_match.where("rate < 1").isEmpty()
    with pytest.raises(ValueError, match="same ids"):
        measure(sample, sheet.where("pmid <> '" + sample.first()["pmid"] + "'"))
    with pytest.raises(ValueError, match="absent"):
        measure(sample, sheet, labels.where("pmid < '3'"))


def test_routes_are_scored_against_their_own_claims(spark):
    named = [k for k in MODALITIES if k != "other"]
    schema = ", ".join(["pmid string", "other_route string", "agent_other_datatype int", *[f"agent_{k} int" for k in named]])
    row = lambda i, route, other, any_named: (i, route, other, any_named, *[0] * (len(named) - 1))
    df = spark.createDataFrame(
        [row("1", "pattern", 1, 1), row("2", "both", 0, 0), row("3", "fallback", 0, 0), row("4", "fallback", 1, 1), row("5", "none", 1, 0)],
        schema,
    )
    got = {r["route"]: (r["n"], r["correct"], r["precision"]) for r in scoring.score_routes(df).collect()}
    assert got == {"pattern": (2, 1, 0.5), "fallback": (2, 1, 0.5)}


def test_term_rule_problems_come_together(spark):
    rules = spark.createDataFrame(
        [
            ("theme", "a", "include", 0, "regex", None, "([a-z"),
            ("theme", "a", "include", 1, "glob", None, "x"),
            ("theme", "a", "include", 2, "phrase", None, "  "),
            ("theme", "b", "include", 0, "regex", True, "(?i)x"),
            ("theme", "c", "exclude", 0, "phrase", None, "x"),
            ("theme", "d", "include", 0, "regex", None, "(?<=a+)b"),
            ("theme", "e", "include", 0, "regex", None, r"[^\W]x"),
            ("modality", "other", "include", 0, None, None, None),
        ],
        "dictionary string, category string, role string, idx int, kind string, case_sensitive boolean, pattern string",
    )
    got = {(r["check"], r["key"]) for r in contracts.term_rules(rules, {"theme": ("a", "b", "z")}).collect()}
    assert got == {
        ("will_not_compile", "a.include[0]"), ("unknown_kind", "a.include[1]"), ("empty_pattern", "a.include[2]"),
        ("contradictory_case", "b.include[0]"), ("no_include", "c"), ("will_not_compile", "d.include[0]"),
        ("not_expressible", "e.include[0]"), ("category_missing", "z"),
        ("category_unknown", "c"), ("category_unknown", "d"), ("category_unknown", "e"),
    }


def test_version_ledger_and_freshness(spark, rows):
    ledger = spark.createDataFrame(
        [("a", 1, "aa"), ("a", 2, "bb"), ("b", 1, "cc"), ("b", 1, "dd")], "file string, version int, sha256 string"
    )
    now = spark.createDataFrame([("a", 2, "bbff"), ("b", 2, "ee")], "file string, version int, sha256 string")
    assert rows(contracts.version_ledger(ledger, now)) == [
        ("ledger_mismatch", "b v2", "unrecorded"), ("version_reused", "b v1", "2"),
    ]
    ran = spark.createDataFrame([("a", 1, "x"), ("b", 2, "ee"), ("c", 1, "y")], "file string, version int, sha256 string")
    assert rows(contracts.freshness(ran, now), "file", "state") == [
        ("a", "changed_new_version"), ("b", "current"), ("c", "missing"),
    ]


def test_many_checks_in_one_scan(spark):
    rows = [(1, "a", 1.0, "x"), (1, "a", 1.5, "x"), (2, "b", None, "y"), (3, "b", 2.0, "z"), (None, "c", 3.0, "z")]
    df = spark.createDataFrame(rows, "id int, kind string, n double, of string")
    report = contracts.contract_report(
        df,
        rows={"not_whole": (F.col("n") % 1 != 0, F.col("id")), "odd_kind": (~F.col("kind").isin("a", "b"), F.col("kind"))},
        unique={"id_twice": ["id"], "never": ["id", "n"]},
        depends={"kind_of": (["kind"], ["of"])},
    )
    # what cannot be tested is a problem, too: a null is no whole number
    assert sorted(tuple(r) for r in report.collect()) == [
        ("id_twice", "1", "2"), ("kind_of", "b", "differs"), ("not_whole", "1", "1"), ("not_whole", "2", "1"), ("odd_kind", "c", "1")
    ]
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1
    assert contracts.contract_report(df.limit(0), unique={"x": ["id"]}).isEmpty()
