"""Digests of rule tables, stale outputs, and pieces that are worked off again."""

import pytest

from tallymark.plans.label_corpus import label_corpus, write_corpus
from tallymark.session import scratch_path
from tallymark.sources import lineage
from tallymark.sources.rules import RuleBook
from tallymark.streaming import incremental, resume

RULES = [("theme", "multimodal_integration", "include", 0, "phrase", None, "x"), ("modality", "mri", "include", 0, "phrase", None, "y"), ("modality", "ct", "include", 0, None, None, None)]
RECORDS = [("1", "x", "y", 2020, "PubmedArticle"), ("2", "q", "y", 2020, "PubmedArticle")]
SCHEMA = "pmid string, title string, abstract string, year int, record_type string"


def digest(spark, rows):
    found = lineage.table_digest(spark.createDataFrame(rows, "k string, a string, b int").repartition(3), ["k"])
    return {r.k: (r.n_rows, r.sha256) for r in found.collect()}


def test_digests_of_multisets(spark):
    rows = [("f", "x", 1), ("f", "y", None), ("g", "x", 1)]
    base = digest(spark, rows)
    assert digest(spark, rows[::-1]) == base and base["f"] != base["g"]
    assert digest(spark, [*rows, rows[0]])["f"] != base["f"] and digest(spark, [*rows, rows[0]])["g"] == base["g"]
    # a null is not its text, and values do not run into each other
    assert digest(spark, [("f", None, 1)]) != digest(spark, [("f", "-", 1)])
    assert digest(spark, [("f", "1", 12)]) != digest(spark, [("f", "11", 2)])


def test_stale_output_is_refused(spark):
    out = scratch_path(spark, "lineage-test")
    book = RuleBook.of(RULES, {"theme": 7, "modality": 4})
    write_corpus(label_corpus(spark.createDataFrame(RECORDS, SCHEMA), book), out, {"note": "n"})
    assert lineage.read_current(spark, out, "paper_labels", book).count() == 2
    notes = {r.key: r.value for r in spark.read.parquet(f"{out}/paper_labels/provenance").collect()}
    assert notes["theme_version"] == "7" and len(notes["modality_sha256"]) == 64 and notes["note"] == "n"

    def states(rows, versions):
        now = RuleBook.of(rows, versions)
        return {r.file: r.state for r in lineage.check_lineage(spark, out, lineage.book_lineage(spark, now)).collect()}, now

    same = {"theme": 7, "modality": 4}
    assert states(RULES[::-1], same)[0] == {"theme": "current", "modality": "current"}
    edited = [(*RULES[0][:6], "xx"), *RULES[1:]]
    found, now = states(edited, same)
    assert found == {"theme": "changed_same_version", "modality": "current"}
    with pytest.raises(lineage.StaleOutput, match="theme v7: changed_same_version"):
        lineage.read_current(spark, out, "paper_labels", now)
    assert lineage.read_current(spark, out, "paper_labels", now, stale_ok=True).count() == 2
    assert states(edited, {"theme": 8, "modality": 4})[0]["theme"] == "changed_new_version"
    found, now = states(RULES[1:], {"modality": 4})
    assert found["theme"] == "missing"
    with pytest.raises(lineage.StaleOutput, match="missing"):
        lineage.read_current(spark, out, "paper_labels", now)
    assert states(RULES[:2], same)[0]["modality"] == "changed_same_version"  # a category without a rule is gone
    assert [r.state for r in lineage.check_lineage(spark, scratch_path(spark, "nothing"), lineage.book_lineage(spark, book)).collect()] == ["unrecorded"]


def test_sweeps(spark):
    root = scratch_path(spark, "sweeps")
    at, out, ledger = f"{root}/in", f"{root}/out", f"{root}/ledger"

    def land(rows):
        df = spark.createDataFrame(rows, "piece string, v string").repartition(1)
        df.write.partitionBy("piece").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(at)

    def sweep(transform=lambda df: df.where("v <> 'drop'")):
        records = resume.read_pieces(spark, at, "v string")
        todo = resume.sweep(records, resume.listing(spark, at), transform, out, ledger)
        return sorted(r.piece for r in todo.collect())

    def now():
        return sorted((r.piece, r.v) for r in resume.current(spark, out, ledger, resume.listing(spark, at)).collect())

    land([("a", "1"), ("a", "2"), ("b", "3"), ("007", "4")])
    assert sweep() == ["007", "a", "b"] and sweep() == []
    assert now() == [("007", "4"), ("a", "1"), ("a", "2"), ("b", "3")]
    land([("a", "9"), ("c", "5")])  # one changes, one is new
    with pytest.raises(ZeroDivisionError):  # a run that dies before it has written
        sweep(lambda df: 1 / 0)
    assert now() == [("007", "4"), ("b", "3")] or now() == [("007", "4"), ("a", "1"), ("a", "2"), ("b", "3")]
    assert sweep() == ["a", "c"]
    assert now() == [("007", "4"), ("a", "9"), ("b", "3"), ("c", "5")]
    land([("b", "3")])  # touched, with the same rows
    assert sweep() == []
    for torn in ('{"piece": "b", "by', "", '{"piece": "b", "digest": null}', "not json"):
        spark.createDataFrame([(torn,)], "value string").write.mode("append").text(ledger)
    assert sweep() == []
    land([("a", "drop")])  # nothing of the new content is retained
    assert sweep() == ["a"] and now() == [("007", "4"), ("b", "3"), ("c", "5")]


def test_first_seen_over_restarts(spark, tmp_path):
    root = str(tmp_path)
    for part in (["a", "b", "a"], ["b", "c", None], ["a", "d", None], []):
        spark.createDataFrame([(x,) for x in part], "k string").repartition(2).write.mode("append").parquet(f"{root}/in")
        stream = incremental.landed(spark, f"{root}/in", "k string")
        incremental.pass_on_first_seen(stream, "k", f"{root}/out", f"{root}/state", buckets=3)
    found = [r.k or "none" for r in incremental.read_first_seen(spark, f"{root}/out").collect()]
    assert sorted(found) == ["a", "b", "c", "d", "none"]
    assert not (tmp_path / "state" / "state").exists()  # nothing is kept in a state store
