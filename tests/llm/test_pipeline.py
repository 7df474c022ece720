"""Every stage against a plain count of what it must keep, on the small tables."""

import corpus_pipeline
from tallymark.llm.decontaminate import report
from tallymark.llm.jaccard_join import join
from tallymark.llm.packing import unpack
from tallymark.llm.scratch import written

TABLES = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_it_kept(spark):
    before = docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, TABLES), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    groups = join(kept["language_id"]).select("class_id").distinct().count()
    assert kept["near_duplicates"].count() == groups
    bench = spark.read.parquet(f"{TABLES}/benchmark.parquet")
    clean = report(kept["near_duplicates"], bench).where("not contaminated").select("doc_id")
    assert sorted(r.doc_id for r in kept["decontamination"].collect()) == sorted(r.doc_id for r in clean.collect())
    toxic = spark.read.parquet(f"{TABLES}/labels.parquet").where("toxic = 1").select("doc_id")
    lost = kept["decontamination"].join(kept["mixing"], "doc_id", "left_anti")
    assert lost.count() <= 0.2 * kept["decontamination"].count()
    assert lost.join(toxic, "doc_id").count() >= 1 or not kept["decontamination"].join(toxic, "doc_id").count()
    texts = {r.doc_id: r.text for r in unpack(kept["packing"]).collect()}
    mixed = kept["mixing"].groupBy("doc_id").count().where("count = 1").join(kept["mixing"], "doc_id").collect()
    assert all(texts[r.doc_id] == r.text for r in mixed)
