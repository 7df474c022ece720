"""The precedence rule, the count tables and their reconciliation."""

import pytest
from pyspark.sql import functions as F

from tallymark.operators import contracts, registry
from tallymark.plans.classify_registry import classify_registry

RAW = [
    # date, number, device, company, panel, code
    ("01/05/2019", "K1", "d1", "c", "Radiology", "AAA"),          # by code
    ("02/05/2019", "k2 ", "d2", None, "Radiology", "GGG"),        # by decision on the device
    ("03/05/2020", "K3", "d3", "c", "Radiology", "AAA"),          # code says yes, device says no
    ("03/05/2020", "K4", "d4", "c", "Radiology", "AAA"),          # undecided device
    ("03/05/2020", "K5", "d5", "c", "Cardio", "GGG"),             # generic code, not decided
    ("03/05/2020", "K6", "d6", "c", "Cardio", "NNN"),             # named exclusion
    ("03/05/2020", "K7", "d7", "c", "Pathology", "ZZZ"),          # gap on an in-scope panel
    ("03/05/2020", "K8", "d8", "c", "Cardio", "ZZZ"),             # unlisted elsewhere
    ("03/05/2020", "X9", "d9", "c", "Radiology", "AAA"),          # no pathway
    ("2020-03-05", "K10", "d10", "c", "Radiology", "AAA"),        # no date
    ("06/30/2022", "DEN11", "d11", "c", "Pathology", "PPP"),      # other panel, De Novo
    ("06/30/2022", "P12/S1", "d12", "c", "Pathology", "AAA"),     # decided on an assigned code
]
COLUMNS = ["Date of Final Decision", "Submission Number", "Device", "Company", "Panel (Lead)", "Primary Product Code"]


@pytest.fixture(scope="module")
def run(spark):
    devices = spark.createDataFrame(RAW, [f"{c}" for c in COLUMNS])
    lookup = spark.createDataFrame(
        [("AAA", "Radiology", "892.1"), ("PPP", None, "1")],
        "product_code string, medical_specialty_description string, regulation_number string",
    )
    assigned = spark.createDataFrame(
        [
            ("AAA", "radiology_cancer_detection", "radiology", "Detection", "892.2050", False),
            ("PPP", "pathology", "pathology", "Pathology", None, True),
        ],
        "code string, category string, domain string, category_label string, regulation_number string, overridden boolean",
    )
    excluded = spark.createDataFrame(
        [("GGG", "indeterminate", 2), ("NNN", "not_oncology", 5)], "code string, `group` string, n bigint"
    )
    decisions = spark.createDataFrame(
        [
            (" K2", "oncology", "pathology", "high"),
            ("K3", "not_oncology", "", ""),
            ("K4", "unresolved", "", ""),
            ("p12/s1", "oncology", "pathology", "medium"),
        ],
        "submission_number string, decision string, category string, confidence string",
    )
    return classify_registry(devices, lookup, assigned, excluded, decisions), assigned, excluded, lookup


def test_one_reason_per_device(run):
    got = {r["device"]: r["exclusion_reason"] for r in run[0].labeled.collect()}
    assert got == {
        "d1": "", "d2": "", "d3": "device_not_oncology", "d4": "device_unresolved", "d5": "code_indeterminate",
        "d6": "code_not_oncology", "d7": "code_unlisted_in_panel", "d8": "code_unlisted_off_panel",
        "d9": "pathway_unknown", "d10": "no_decision_date", "d11": "", "d12": "",
    }


def test_assignment_columns(run):
    got = {r["device"]: r for r in run[0].labeled.collect()}
    assert (got["d2"]["category"], got["d2"]["basis"], got["d2"]["adjudication_confidence"]) == ("pathology", "device", "high")
    assert got["d2"]["regulation_number"] == "" and got["d2"]["company"] == ""
    # decided device under an assigned code: the decision's category, the code's number
    assert (got["d12"]["category"], got["d12"]["regulation_number"]) == ("pathology", "892.2050")
    assert got["d12"]["pathway"] == "PMA" and got["d11"]["pathway"] == "De Novo"
    assert got["d11"]["code_overridden"] and not got["d2"]["has_classification"]
    assert got["d3"]["domain"] == got["d3"]["pathway"] == ""
    assert got["d1"]["openfda_regulation_number"] == "892.1" and got["d11"]["openfda_medical_specialty_description"] == ""


def test_tables_are_dense_and_agree(run, rows):
    job = run[0]
    assert [r["submission_number"] for r in job.authorizations.collect()] == ["K1", "k2", "DEN11", "P12/S1"]
    series = rows(job.cumulative.where("category = 'pathology'"), "year", "annual_count", "cumulative_count")
    assert series == [(2019, 1, 1), (2020, 0, 1), (2021, 0, 1), (2022, 2, 3)]
    assert job.pathways.count() == 6
    assert job.problems().isEmpty()
    short = job.labeled.where("counted AND device <> 'd1'")
    checks = {r["check"] for r in contracts.cross_table(short, job.cumulative, job.pathways).collect()}
    assert checks == {"annual_count", "pathway_count", "final_cumulative"}


def test_reports(run, rows):
    job, assigned, excluded, lookup = run
    panels = {r["domain"]: (r["n_devices"], r["n_panel_matches"]) for r in registry.panel_agreement(job.labeled).collect()}
    assert panels == {"pathology": (3, 2), "radiology": (1, 1)}
    scope = registry.scope_coverage(job.labeled).first()
    assert (scope["n_devices"], scope["n_counted"], scope["n_excluded"], scope["n_unlisted"]) == (9, 4, 4, 1)
    kinds = rows(registry.specialty_disagreements(assigned, lookup, "medical_specialty_description"), "code", "kind")
    assert kinds == [("PPP", "unstated")]
    flags = rows(registry.regulation_differences(assigned, lookup, "regulation_number"), "code", "flag")
    assert flags == [("AAA", "differs"), ("PPP", "override")]
    drift = rows(registry.excluded_code_drift(job.labeled, excluded), "code", "config_n", "observed_n")
    assert drift == [("NNN", 5, 1)]
    assert registry.partial_year(job.labeled.where("counted")).first()[0] == 2022


def test_snapshot_date(spark):
    raw = spark.createDataFrame([("01/02/2020",), ("bad",), ("12/31/2019",)], ["Date of Final Decision"])
    got = registry.snapshot_date(raw).first()
    assert (str(got["snapshot_date"]), got["n_unparsable"]) == ("2020-01-02", 1)
    assert registry.snapshot_date(raw.where(F.lit(False))).isEmpty()


def test_a_category_has_one_domain(spark):
    table = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "category string, domain string")
    found = contracts.functional_dependency(table, "category", "domain").collect()
    assert [(r["check"], r["key"], r["detail"]) for r in found] == [("not_functional", "a", "2")]
