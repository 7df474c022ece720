"""From raw documents to packed training sequences, in five stages.

Each stage reads what the one before it wrote; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm.decontaminate import drop_contaminated
from tallymark.llm.jaccard_join import keep_one
from tallymark.llm.language import keep_known, train
from tallymark.llm.mixing import label_domain, mix
from tallymark.llm.packing import pack
from tallymark.llm.scratch import written

#: The posterior that a document's language needs.
LEAST_LANGUAGE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is surely one of the labelled ones; null and letterless texts go."""
    return keep_known(docs, train(docs.select("text", "lang")), LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mixture asks for: toxic ones seldom, clean ones at least once."""
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", label_domain().alias("domain")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("packing", packing),
]

#: Random buckets, a trained classifier and a tokenizer are beyond SQL; ``tests/llm/test_pipeline.py`` checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
