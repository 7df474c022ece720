"""The labelling job on a small corpus with known answers."""

import pytest
from pyspark.sql import functions as F

from tallymark.operators import counts, labelling, scoring
from tallymark.plans.label_corpus import label_corpus, write_corpus
from tallymark.session import scratch_path
from tallymark.sources.rules import RuleBook, fingerprint, read_rule_file
from tallymark.vocab import MODALITIES, RECORD_EXCLUSIONS, THEMES

RULES = [
    ("theme", "foundation_models", "include", 0, "phrase", None, "foundation model"),
    ("theme", "multimodal_integration", "include", 0, "regex", None, r"(?i)\bmulti[- ]?modal"),
    ("theme", "multimodal_integration", "exclude", 0, "regex", None, r"(?i)\bmultimodal therapy\b"),
    ("theme", "digital_twins", "include", 0, "phrase", None, "digital twin"),
    ("theme", "agentic_ai", "include", 0, "regex", None, r"(?i)\bagents?\b"),
    ("theme", "agentic_ai", "exclude", 0, "regex", None, r"(?i)\bcontrast agents?\b"),
    ("theme", "clinical_fda", "include", 0, "phrase", None, "510(k)"),
    ("theme", "virtual_staining", "include", 0, "phrase", None, "stain transfer"),
    ("modality", "mri", "include", 0, "phrase", None, "mri"),
    ("modality", "ct", "include", 0, "regex", None, r"\bCTs?\b"),
    ("modality", "ct", "include", 1, "phrase", None, "computed tomography"),
    ("modality", "he_histology", "include", 0, "phrase", None, "whole slide imaging"),
    ("modality", "genomics", "include", 0, "phrase", None, "rna"),
    ("modality", "other", "include", 0, "phrase", None, "dermoscopy"),
    ("modality", "non_specialty", "include", 0, "phrase", None, "endoscopy"),
]

# pmid, title, abstract, year, record_type, publication_types
RECORDS = [
    ("1", "A foundation model", "CT and MRI of the chest. CT again.", 2020, "PubmedArticle", "Journal Article"),
    ("2", "Multimodal fusion", "MRI only", 2021, "PubmedArticle", "Journal Article"),
    ("3", "Multimodal therapy", "multi-modal care with MRI", 2021, "PubmedArticle", ""),
    ("4", "Agents", "a contrast agent for CT", 2021, "PubmedArticle", None),
    ("5", "Digital twin and multimodal", "whole\nslide  imaging with computed tomography", 2022, "PubmedArticle", "Review; Journal Article"),
    ("6", "Nothing", "to see", 2022, "PubmedArticle", "Journal Article"),
    ("7", "Dermoscopy", "with MRI", 2022, "PubmedArticle", "Letter"),
    ("8", "Endoscopy", "alone", 2022, "PubmedArticle", "Review"),
    ("9", "Endoscopy", "and RNA", 2022, "PubmedArticle", "Journal Article"),
    ("10", "Endoscopy", "and CT", 2022, "PubmedArticle", "Journal Article"),
    ("11", "A foundation model book", "CT", 2022, "PubmedBookArticle", "Journal Article"),
    ("  ", "A foundation model", "CT", 2022, "PubmedArticle", "Journal Article"),
    ("12", "A foundation model", "CT", None, "PubmedArticle", "Journal Article"),
    ("13", "A foundation model", "CT", 2014, "PubmedArticle", "Journal Article"),
    ("14", "Cleared: 510(k).", None, 2023, "PubmedArticle", "Journal Article"),
    ("15", "a qPCR Ct value", "", 2023, "PubmedArticle", "Journal Article"),
    (None, None, "CT", None, "PubmedBookArticle", "Journal Article"),
]
WINDOW = (2015, 2023)


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(
        RECORDS, "pmid string, title string, abstract string, year int, record_type string, publication_types string"
    )


@pytest.fixture(scope="module")
def book():
    return RuleBook.of(RULES)


@pytest.fixture(scope="module")
def run(records, book):
    return label_corpus(records, book, WINDOW, details=True)


@pytest.fixture(scope="module")
def by_id(run):
    return {r["pmid"]: r.asDict() for r in run.labels.collect()}


def carried(row, prefix):
    return {k[len(prefix):] for k, v in row.items() if k.startswith(prefix) and v == 1}


def test_labels(by_id):
    assert sorted(by_id, key=int) == ["1", "2", "3", "4", "5", "6", "7", "10", "14", "15"]
    assert carried(by_id["1"], "theme_") == {"foundation_models"}
    assert carried(by_id["1"], "mod_") == {"ct", "mri"}
    assert carried(by_id["3"], "theme_") == set()
    assert carried(by_id["4"], "theme_") == set()
    assert carried(by_id["5"], "theme_") == {"digital_twins", "multimodal_integration"}
    assert carried(by_id["5"], "mod_") == {"ct", "he_histology"}
    assert by_id["5"]["domain"] == "both" and by_id["6"]["domain"] == "none"
    assert carried(by_id["6"], "mod_") == {"other"}
    assert carried(by_id["7"], "mod_") == {"mri", "other"}
    assert carried(by_id["10"], "mod_") == {"ct"}
    assert carried(by_id["14"], "theme_") == {"clinical_fda"}
    assert carried(by_id["15"], "mod_") == {"other"}


def test_label_columns_follow_the_canonical_order(run):
    columns = run.labels.columns
    themes = [c[6:] for c in columns if c.startswith("theme_")]
    assert themes == [k for k in THEMES if k in themes]
    mods = [c[4:] for c in columns if c.startswith("mod_")]
    assert mods == [k for k in MODALITIES if k in mods] and "non_specialty" not in mods


def test_unknown_category_gets_a_column_at_the_end(records):
    extra = RuleBook.of([*RULES, ("modality", "sonar", "include", 0, "phrase", None, "sonar")])
    assert extra.modalities[-1] == "sonar" and extra.modalities[-2] == "other"


def test_first_reason_wins_and_every_reason_is_counted(run):
    counted = {r["reason"]: r["n_records"] for r in run.exclusions.collect()}
    assert counted == {
        "book_records": 2,
        "missing_pmid": 1,
        "missing_year": 1,
        "outside_date_range": 1,
        "non_specialty_only": 2,
    }
    order = [r["reason"] for r in run.exclusions.orderBy("position").collect()]
    assert order == list(RECORD_EXCLUSIONS)


def test_conjunctive_exclusion_needs_no_side_and_the_match(by_id):
    # genomics gives no side, so the endoscopy paper with RNA leaves; the one with CT stays
    assert "9" not in by_id and "8" not in by_id and "10" in by_id


def test_ledger(run, rows):
    got = rows(run.ledger.where("applies_to <> 'corpus'"), "pmid", "reason", "applies_to")
    assert got == [
        ("2", "below_minimum_modalities", "panel_a:multimodal_integration"),
        ("5", "secondary_publication_type", "panel_a"),
        ("7", "secondary_publication_type", "panel_a"),
    ]
    assert run.ledger.where("applies_to = 'corpus'").count() == 7


def test_secondary_tally_is_taken_before_the_label_exclusion(records, rows):
    got = rows(labelling.secondary_tally(records, WINDOW))
    assert got == [("Letter", 1), ("Review", 2)]


def test_hits(run, rows):
    ct = {r["pmid"]: r for r in run.hits.where("pattern_id = 'ct:include[0]'").collect()}
    assert ct["1"]["n_hits"] == 2 and ct["1"]["category_matched"] == 1
    assert ct["1"]["excerpt"] == "A foundation model CT and MRI of the chest. CT again."
    suppressed = rows(run.hits.where("category = 'agentic_ai'"), "role", "n_hits", "category_matched")
    assert suppressed == [("exclude", 1, 0), ("include", 2, 0)]
    fallback = rows(run.hits.where("role = 'fallback'"), "pmid", "pattern_id", "n_hits", "category_matched")
    assert [r[0] for r in fallback] == ["14", "15", "6"] and fallback[0][1:] == ("other:fallback", 0, 1)
    assert run.hits.where("pmid IN ('8', '9')").isEmpty()
    match_only = rows(run.hits.where("category = 'non_specialty'"), "pmid", "category_matched")
    assert match_only == [("10", 1)]


def test_hits_without_details_hold_the_same_rules(records, book, run, rows):
    plain = label_corpus(records, book, WINDOW).hits
    assert "excerpt" not in plain.columns
    assert rows(plain, "pmid", "pattern_id") == rows(run.hits, "pmid", "pattern_id")


def test_rules_run_once_when_labels_are_filtered(run):
    plan = run.labels.where("theme_digital_twins = 1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("510") <= 4 and plan.count("Generate") == 1


def test_catch_all_routes(run):
    got = counts.catch_all_routes(run.annotated).first()
    assert (got["by_pattern"], got["by_fallback"], got["total"]) == (1, 3, 4)
    routes = {r["pmid"]: r["other_route"] for r in labelling.record_routes(run.annotated).collect()}
    assert routes["7"] == "pattern" and routes["6"] == "fallback" and routes["1"] == "none"


def test_no_tag_column_means_all_primary(records, book):
    got = label_corpus(records.drop("publication_types"), book, WINDOW).labels
    assert got.where("is_primary_research = 0").isEmpty()


def test_tags_may_be_an_array(records, book, rows):
    arrays = records.withColumn("publication_types", F.split("publication_types", "; "))
    assert rows(label_corpus(arrays, book, WINDOW).labels, "pmid", "is_primary_research") == rows(
        label_corpus(records, book, WINDOW).labels, "pmid", "is_primary_research"
    )


def test_missing_column_is_named(records, book):
    with pytest.raises(ValueError, match="abstract"):
        label_corpus(records.drop("abstract"), book)


def test_years_that_are_no_numbers(spark, book, rows):
    made = [("1", "mri", "", y, "PubmedArticle") for y in ("n.d.", "NaN", "", None, "2020", " 2021 ", "1e9", "2016.0")]
    records = spark.createDataFrame([(str(i), *r[1:]) for i, r in enumerate(made)], "pmid string, title string, abstract string, year string, record_type string")
    done = label_corpus(records, book, WINDOW)
    assert rows(done.labels, "pmid", "year") == [("4", 2020), ("5", 2021), ("7", 2016)]
    assert {r.pmid: r.reason for r in done.ledger.where("applies_to = 'corpus'").collect()} == {
        "0": "missing_year", "1": "missing_year", "2": "missing_year", "3": "missing_year", "6": "outside_date_range"
    }
    nan = records.limit(1).withColumn("year", F.lit(float("nan")))
    assert rows(label_corpus(nan, book, WINDOW).ledger, "reason") == [("missing_year",)]


def test_rule_file_round_trip(spark, tmp_path, book):
    import json

    cats = {}
    for d, c, role, _, kind, case, pattern in RULES:
        if d == "modality":
            cats.setdefault(c, {"include": [], "exclude": []})[role].append({"pattern": pattern, "kind": kind})
    cats["pet"] = {"include": None}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"version": 4, "categories": cats}, indent=1))
    table = read_rule_file(spark, str(path), "modality")
    read = RuleBook.from_table(table)
    assert [r.pattern_id for r in read.rules] == [r.pattern_id for r in book.rules if r.dictionary == "modality"]
    assert "pet" in read.modalities
    assert fingerprint(table).first()["version"] == 4


def test_whole_run_is_written(spark, run, rows):
    out = scratch_path(spark, "run")
    write_corpus(run, out, {"rules": "v1"}, 2023)
    labels = spark.read.parquet(f"{out}/paper_labels/data")
    assert rows(labels) == rows(run.labels)
    assert rows(spark.read.parquet(f"{out}/exclusions/data")) == rows(run.ledger)
    combos = spark.read.parquet(f"{out}/combination_counts/data")
    assert rows(combos, "theme", "modality_set", "n_papers") == [
        ("clinical_fda", "other", 1),
        ("foundation_models", "ct+mri", 1),
    ]
    notes = spark.read.parquet(f"{out}/combination_counts/provenance")
    assert ("combination_counts", "rules", "v1") in rows(notes) and len(rows(notes)) == 5
    metrics = {(r["metric"], r["key"]): r["value"] for r in spark.read.parquet(f"{out}/run_metrics/data").collect()}
    assert metrics[("records_retained", "")] == 10 and metrics[("records_primary", "")] == 8
    assert metrics[("shortfall_panel_a", "multimodal_integration")] == 1
