"""Registry documents that overlap, and snapshots that are there as a whole or not at all."""

import json

import pytest
from pyspark.sql import functions as F

from tallymark.operators import grids, registry
from tallymark.operators.joins import one_row
from tallymark.sources import snapshots
from tallymark.sources.registry_documents import CodeRule, Decisions
from tallymark.session import scratch_path

REASON = "a reason that is long enough to check"


def code_document(categories, overrides=(), excluded=None, version=1):
    cats = {k: {"label": k.title(), "domain": d, "codes": [{"code": c, "regulation_number": r} for c, r in codes]} for k, (d, codes) in categories.items()}
    groups = {g: {"reason": "r", "codes": [{"code": c, "n": 1, "why": "w"} for c in codes]} for g, codes in (excluded or {}).items()}
    return {"version": version, "categories": cats, "overrides": [{"code": c, "domain": d, "regulation_number": r} for c, d, r in overrides], "excluded": groups}


def entry(device, decision="oncology", category="pathology", confidence="high", evidence=REASON):
    return {"submission": device, "device": "d", "product_code": "AAA", "decision": decision, "category": category, "confidence": confidence, "evidence": evidence}


def found(df):
    return sorted((r["check"], r["key"], r["detail"]) for r in df.collect())


@pytest.fixture
def write(tmp_path):
    def put(name, content):
        (tmp_path / name).write_text(content if isinstance(content, str) else json.dumps(content, indent=1))
        return str(tmp_path)

    return put


def test_documents_fold_into_one_table(spark, write, rows):
    write("a.json", code_document({"pathology": ("pathology", [("AAA", "864.1"), (" BBB ", "864.2")])}, [("BBB", "pathology", "1.2")], {"not_oncology": ["NNN"]}))
    path = write("b.json", code_document({"radiology_cancer_detection": ("radiology", [("CCC", None)])}, (), {"indeterminate": ["III"]}))
    rule = CodeRule(spark, path)
    assert found(rule.problems()) == []
    assert rows(rule.assigned, "code", "category", "regulation_number", "overridden") == [
        ("AAA", "pathology", "864.1", False), ("BBB", "pathology", "1.2", True), ("CCC", "radiology_cancer_detection", None, False)
    ]
    assert rows(rule.excluded, "code", "group") == [("III", "indeterminate"), ("NNN", "not_oncology")]


def test_conflicts_are_rows_and_devices_are_not_multiplied(spark, write):
    write("a.json", code_document({"pathology": ("pathology", [("AAA", "1"), ("bad", "2")])}, [("ZZZ", "pathology", "3")], {"not_oncology": ["NNN"], "other": ["OOO"]}))
    write("b.json", code_document({"radiology_cancer_detection": ("radiology", [("AAA", "1"), ("NNN", "4")])}, (), {"not_oncology": ["NNN"]}, None))
    path = write("c.json", '{"version": 1, "categories": ')
    rule = CodeRule(spark, path)
    problems = found(rule.problems())
    assert {(c, k) for c, k, _ in problems} == {
        ("malformed_code", "bad"), ("not_functional", "AAA"), ("override_unlisted", "ZZZ"), ("counted_and_excluded", "NNN"),
        ("repeated_key", "NNN"), ("unknown_group", "other"), ("bad_version", "b.json"), ("unreadable", "c.json"),
    }
    devices = spark.createDataFrame(
        [(f"K{i}", "2020-01-01", 2020, "d", "c", "Radiology", code, "510(k)") for i, code in enumerate(("AAA", "NNN", "QQQ"))],
        "submission_number string, decision_date string, year int, device string, company string, panel_lead string, product_code string, pathway string",
    )
    decided = spark.createDataFrame([("k0", "oncology", "pathology", "high"), ("K0", "not_oncology", "", "")], "submission_number string, decision string, category string, confidence string")
    # the raw listings hold codes and devices twice; every device comes out once all the same
    out = registry.classify_devices(devices, rule.listed, rule.dropped, decided)
    assert sorted(r.submission_number for r in out.collect()) == ["K0", "K1", "K2"]


def test_decisions(spark, write, rows):
    write("a.json", {"version": 1, "n_devices": 2, "adjudicated": [entry(" p1 "), entry("P2", "not_oncology", "")]})
    path = write("b.json", {"version": 1, "adjudicated": [entry("P3")]})
    good = Decisions(spark, path)
    assert found(good.problems()) == []
    assert rows(good.decisions, "submission_number", "decision", "source") == [("P1", "oncology", "a.json"), ("P2", "not_oncology", "a.json"), ("P3", "oncology", "b.json")]
    write("c.json", {"version": 0, "n_devices": 7, "adjudicated": [entry("p1", "not_oncology", ""), entry("P4", "probably", ""), entry("P5", category="x"), entry("P6", evidence="no"), entry("", "unresolved", "")]})
    path = write("d.json", {"version": 1, "n_devices": 3, "adjudicated": []})
    bad = Decisions(spark, path)
    assert found(bad.problems()) == [
        ("bad_version", "c.json", "0"), ("blank_device", "", ""), ("category_required", "P5", ""), ("decided_twice", "P1", "a.json says oncology, c.json says not_oncology"),
        ("declared_count", "c.json", "7<>5"), ("declared_count", "d.json", "3<>0"), ("evidence_too_short", "P6", ""), ("unknown_decision", "P4", ""),
    ]
    assert bad.decisions.where("submission_number = 'P1'").count() == 1


def test_one_row(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), (None, 3, "n")], "k string, o int, v string")
    assert rows(one_row(df, "k", ["o"]).where("k is not null")) == [("a", 1, "y")] and one_row(df, "k", []).count() == 2


def test_snapshots(spark):
    root = scratch_path(spark, "snaps")
    with pytest.raises(snapshots.SnapshotError, match="no finished"):
        snapshots.read_published(spark, root)
    snapshots.publish(spark.range(2), root, "2026-01-01")
    snapshots.publish(spark.range(3), root, "2026-02-01")
    snapshots.stage(spark.range(9), root, "2026-03-01")  # killed before its commit
    with pytest.raises(snapshots.SnapshotError, match="published already"):
        snapshots.publish(spark.range(4), root, "2026-02-01")
    with pytest.raises(snapshots.SnapshotError, match="0 rows"):
        snapshots.publish(spark.range(0), root, "2026-04-01")
    assert snapshots.read_published(spark, root, newest=True).select("snapshot").distinct().collect()[0][0] == "2026-02-01"
    assert snapshots.read_published(spark, root).count() == 5
    snapshots.publish(spark.range(9), root, "2026-03-01")  # tried again
    assert snapshots.read_published(spark, root, newest=True).count() == 9


def test_an_unknown_theme_is_refused(spark):
    series = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", "all")], "theme string, domain string")
    assert [tuple(r) for r in grids.select_series(series, [("a", "b|c")]).collect()] == [("a", "b|c")]
    with pytest.raises(ValueError, match="q, z"):
        grids.select_series(series, [("a", "all"), ("z", "all"), ("q", "all")])
    assert grids.select_series(series, []).where(F.lit(True)).collect() == []
