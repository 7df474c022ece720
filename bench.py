"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallymark import catalog  # noqa: E402
from tallymark.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
HEADLINE = (
    "label_corpus",
    "pattern_hits",
    "exclusion_ledger",
    "combination_counts",
    "theme_year_counts",
    "label_totals",
    "rule_firing_counts",
    "classified_devices",
    "cumulative_by_year",
    "pathway_counts",
    "stratified_sample",
    "agreement_table",
    "audit_sheet",
    "keep_first",
    "order_part_sets",
    "numbered_orders",
    "dense_customer_years",
    "repeated_keys",
    "xml_record_scan",
    "page_scan",
)


def many_rules(spark, n: int = 232):
    """The corpus rules filled up to ``n`` with phrases of the benchmark texts."""
    from pyspark.sql import functions as F

    from tallymark.catalog import corpus
    from tallymark.sources.rules import RuleBook
    from tallymark.vocab import MODALITIES

    words = (
        spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
        .select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
        .where(F.length("w") > 3)
        .distinct()
        .orderBy("w")
        .limit(n - len(corpus.RULE_ROWS))
    )
    rows = list(corpus.RULE_ROWS)
    for i, r in enumerate(words.collect()):
        kind, pattern = ("regex", rf"(?i)\b{r['w']}s?\b") if i % 3 else ("phrase", r["w"])
        rows.append(("modality", MODALITIES[i % len(MODALITIES)], "include", 100 + i, kind, None, pattern))
    return RuleBook.of(rows)


def labelling_rate(spark, n_docs: int) -> float:
    from tallymark.catalog import corpus
    from tallymark.plans.label_corpus import label_corpus

    start = time.perf_counter()
    run = label_corpus(corpus.records(spark, SF_DIR), many_rules(spark), corpus.YEARS)
    run.labels.write.format("noop").mode("overwrite").save()
    return round(n_docs / (time.perf_counter() - start), 1)


def main() -> None:
    spark = build_session(
        "tallymark-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    n_docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    queries["label_corpus"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # warm-up

    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)

    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "label_records_per_second": round(n_docs / took["label_corpus"], 1),
                "label_records_per_second_232_rules": labelling_rate(spark, n_docs),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
