"""Nulls, empty tables, repeated rows and clashing extra columns in every operator over documents, vectors and turns."""

from tallymark.llm.chat import read_back, segments
from tallymark.llm.decontaminate import drop_contaminated, report
from tallymark.llm.jaccard_join import join, keep_one
from tallymark.llm.language import keep_known, predict, train
from tallymark.llm.mixing import mix, rates
from tallymark.llm.neighbours import nearest
from tallymark.llm.packing import pack, unpack
from tallymark.llm.substring_dedup import drop_repeats

from pyspark.sql import functions as F

EXTRA = ", k1 string, k2 int, seed string, spans string, n int, path string, d1 string, chosen string, domain string, n_tokens string, p string, score string, rate int, buckets int"
NONE = (None,) * 14
LONG = " ".join(f"w{i % 9973}x{i % 17}" for i in range(60_000))
ROWS = [(1, LONG), (1, LONG), (2, LONG), (3, None), (4, ""), (5, " \n"), (None, "some words, without an id"), (None, None), (6, "ÄÖ 漢字 😀"), (7, "one")]


def test_documents_with_clashing_columns(spark, docs):
    table = docs([(*r, *NONE) for r in ROWS], EXTRA)
    ids = sorted((r[0] for r in ROWS), key=str)

    def ids_of(df):
        return sorted((r.doc_id for r in df.collect()), key=str)

    model = train(spark.createDataFrame([("one two", "en"), ("漢字", "zh"), (None, "en"), ("x", None)], "text string, lang string"))
    bench = spark.createDataFrame([("a", "one", 1), (None, "one", 1), ("b", None, 1), ("c", "", 1)], "item_id string, text string, doc_id int")
    labelled = spark.createDataFrame([(1, "good"), (None, "toxic"), (7, None), (99, "junk")], "doc_id long, domain string")
    assert ids_of(drop_repeats(table)) == ids and ids_of(predict(table, model)) == ids
    assert ids_of(join(table)) == ids and ids_of(rates(table, labelled)) == ids
    found = {(r.doc_id, r.n_words): r for r in report(table, bench).collect()}
    assert len(found) == 9 and found[(7, 1)].contaminated and sum(r.contaminated for r in found.values()) == 1
    kept = keep_one(table)
    # equal texts: one stays; wordless rows all stay
    assert kept.columns == table.columns and ids_of(kept) == sorted([1, 3, 4, 5, None, None, 6, 7], key=str)
    clean = drop_contaminated(table, bench)
    assert clean.columns == table.columns and ids_of(clean) == sorted([x for x in ids if x != 7], key=str)
    assert keep_known(table, model, 0.0).columns == mix(table, labelled).columns == table.columns
    unique = table.where("doc_id > 1")
    assert {r.doc_id: r.text for r in unpack(pack(unique)).collect()} == {i: t for i, t in ROWS if i and i > 1 and t}


def test_repeats_of_equal_rows(docs):
    found = sorted((r.doc_id, r.n_words, r.n_removed) for r in drop_repeats(docs([r for r in ROWS if r[0] is not None])).collect() if r.n_words > 50)
    assert found == [(1, 60_000, 0), (1, 60_000, 0), (2, 60_000, 60_000)]


def test_empty_tables(spark, docs):
    none = docs([])
    bench = spark.createDataFrame([], "item_id string, text string")
    labelled = spark.createDataFrame([], "doc_id long, domain string")
    model = train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in predict(docs(ROWS), model).collect()} == {"und"}
    for out in (drop_repeats(none), predict(none, model), report(none, bench), drop_contaminated(none, bench), join(none), keep_one(none), rates(none, labelled), mix(none, labelled), pack(none)):
        assert out.collect() == []
    assert not any(r.contaminated for r in report(docs(ROWS), bench).collect())
    assert len(mix(docs(ROWS), labelled).collect()) >= len(ROWS)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(vectors, F.col("vec_id") % 2 == 0).collect() == []
    assert read_back(segments(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_vectors_with_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (7, []), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0])]
    table = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, v string, cell int, part int, block int")
    found = sorted(tuple(r) for r in nearest(table, F.col("vec_id") % 2 == 0).collect())
    assert found == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (2, 1, 0, 0.5), (2, 2, 1, 0.25)]


def test_turns_with_clashing_columns(spark):
    rows = [(1, 0, "user", "hi", "x", 1), (1, 1, "assistant", "yes", "x", 1), (None, 0, "user", None, "x", 1), (2, None, None, "", "x", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string, kind int")
    found = {r.conv_id: (r.n_turns, r.loss_chars) for r in read_back(segments(turns)).collect()}
    assert found[1] == (2, 3) and found[2] == (1, 0)
