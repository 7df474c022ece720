import warnings

import numpy as np
from pyspark.sql import functions as F

from tallymark.llm.mixing import Classifier, fit, judged, mix, plan, rates, solve

TARGETS = {"a": 0.7, "b": 0.3}
WORDS = {"a": "red blue green", "b": "seven eight nine"}


def corpus(n=60):
    rows, labels = [], []
    for i in range(n):
        kind = "b" if i % 4 == 0 else "a"
        rows.append((i, f"{WORDS[kind]} w{i % 7} " * (1 + i % 5)))
        if i % 2 == 0:
            labels.append((i, kind))
    return rows, labels


def test_totals_meet_the_targets_and_rates_are_never_negative(spark, docs):
    rows, labels = corpus()
    table, mixture = plan(docs(rows), spark.createDataFrame(labels, "doc_id long, domain string"), TARGETS)
    assert np.abs(mixture.reached - mixture.wanted).max() < 2e-3 * mixture.wanted.sum()
    found = rates(docs(rows), spark.createDataFrame(labels, "doc_id long, domain string"), TARGETS).collect()
    assert len(found) == len(rows) and min(r.rate for r in found) >= 0
    assert all((r.p_b > 0.5) == (r.doc_id % 4 == 0) for r in found)
    assert all(abs(r.p_a + r.p_b - 1) < 1e-9 and abs(r.copies - r.rate) <= 1 for r in found)
    total = np.array([sum(r.n_tokens * r.rate * p for r, p in ((r, r["p_" + d]) for r in found)) for d in "ab"])
    assert np.allclose(total, mixture.reached)


def test_a_small_target_is_met_or_named(spark, docs):
    table, labels = docs([(i, "word " * 10) for i in range(100)]), ("a", "b")
    sure = Classifier(labels, np.zeros((1 << 18, 2)), np.zeros(2))
    told = table.selectExpr("doc_id", "doc_id key", "10L n_tokens", "if(doc_id < 50, array(0.999d, 0.001d), array(0d, 1d)) p")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        mixture = solve(told, sure, {"a": 0.995, "b": 0.005})
    assert mixture.missed == () and abs(mixture.reached[1] / mixture.wanted[1] - 1) <= 0.01
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        # every text counts for both alike
        mixture = solve(judged(table, sure), sure, {"a": 0.99, "b": 0.01})
    assert mixture.missed == labels and any("off their targets" in str(w.message) for w in said)


def test_labels_of_other_documents_take_no_place(spark, docs):
    rows, labels = corpus()
    labelled = spark.createDataFrame(labels + [(i, "a") for i in range(1_000, 3_000)], "doc_id long, domain string")
    model = fit(docs(rows), labelled, ("a", "b"), most=len(labels))
    p = {r.doc_id: r.p for r in judged(docs(rows), model).collect()}
    assert all((p[i][1] > 0.5) == (i % 4 == 0) for i, _ in rows)


def test_an_unwanted_domain_goes(spark, docs):
    rows, labels = corpus()
    found = rates(docs(rows), spark.createDataFrame(labels, "doc_id long, domain string"), {"a": 0.99, "b": 0.01}).collect()
    assert max(r.rate for r in found if r.doc_id % 4 == 0) < 0.2 < 1 <= min(r.rate for r in found if r.doc_id % 4)


def test_mixed_rows_are_the_copies_and_keep_all_columns(spark, docs):
    rows, labels = corpus()
    labelled = spark.createDataFrame(labels, "doc_id long, domain string")
    table = docs(rows).withColumn("p", F.lit("x")).withColumn("key", F.lit(1))
    mixed = mix(table, labelled, TARGETS)
    assert mixed.columns == table.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in rates(docs(rows), labelled, TARGETS).collect() if r.copies}


def test_no_labels_no_text_no_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert rates(docs([]), none, TARGETS).collect() == []
    found = rates(docs([(1, None), (2, ""), (3, "some words")]), spark.createDataFrame([(None, "a"), (9, "b"), (3, None)], "doc_id long, domain string"), TARGETS).collect()
    assert [(r.p_a, r.rate) for r in found if r.doc_id < 3] == [(0.5, 1.0)] * 2 and len(found) == 3


def test_unknown_words_leave_the_prior():
    model = Classifier(("a", "b"), np.zeros((1 << 18, 2)), np.log([0.25, 0.75]))
    import pyarrow as pa

    p, tokens = model.posteriors(pa.array(["what ever", None]))
    assert np.allclose(p, [[0.25, 0.75], [0.5, 0.5]]) and tokens.tolist() == [2, 0]
