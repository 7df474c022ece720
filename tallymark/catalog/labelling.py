"""Labelling queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallymark.catalog import corpus
from tallymark.catalog.common import query, sql_text
from tallymark.operators import counts, labelling
from tallymark.plans.label_corpus import write_corpus
from tallymark.session import scratch_path
from tallymark.sources.rules import RuleBook, read_rule_file
from tallymark.vocab import RECORD_EXCLUSIONS, SECONDARY_TYPES

LABEL_SELECT = f"SELECT pmid, year, year_source, {corpus.THEME_COLS}, {corpus.MOD_COLS}, domain, is_primary_research FROM labels_"

_REASONS = ", ".join(f"({i}, '{r}')" for i, r in enumerate(RECORD_EXCLUSIONS, 1))


@query("label_corpus", "M1 M2 M3 M5 M6 M7 M8 P1 P11 P12 P28 J4 F1 F2", f"WITH {corpus.labels_sql()} {LABEL_SELECT}")
def label_corpus(spark, sf_dir):
    return corpus.run(spark, sf_dir).labels


@query("pattern_hits", "M4 M5 P20", f"WITH {corpus.hits_sql()} SELECT * FROM hits")
def pattern_hits(spark, sf_dir):
    return corpus.run(spark, sf_dir, details=True).hits


@query(
    "exclusion_ledger",
    "F1 F2 U1",
    f"""WITH {corpus.flags_sql()}
SELECT pmid, reason, 'corpus' AS applies_to FROM flags WHERE reason IS NOT NULL
UNION ALL
SELECT pmid, 'secondary_publication_type', 'panel_a' FROM flags WHERE reason IS NULL AND is_primary_research = 0
UNION ALL
SELECT pmid, 'below_minimum_modalities', 'panel_a:multimodal_integration' FROM flags
WHERE reason IS NULL AND is_primary_research = 1 AND theme_multimodal_integration = 1
  AND {' + '.join(f"mod_{k}" for k in corpus.MODALITIES)} < 2""",
)
def exclusion_ledger(spark, sf_dir):
    return corpus.run(spark, sf_dir).ledger


@query(
    "exclusion_counts",
    "A6",
    f"""WITH {corpus.flags_sql()}, wanted(position, reason) AS (VALUES {_REASONS})
SELECT CAST(w.position AS INTEGER) AS position, w.reason, count(f.pmid) AS n_records
FROM wanted w LEFT JOIN flags f ON f.reason = w.reason GROUP BY ALL""",
)
def exclusion_counts(spark, sf_dir):
    return corpus.run(spark, sf_dir).exclusions


@query(
    "secondary_type_tally",
    "A7 P10",
    f"""WITH {corpus.flags_sql()},
tags AS (SELECT pmid, trim(unnest(string_split(publication_types, ';'))) AS publication_type
  FROM flags WHERE early_reason IS NULL)
SELECT publication_type, count(DISTINCT pmid) AS n_records FROM tags
WHERE publication_type IN ({', '.join(f"'{t}'" for t in SECONDARY_TYPES)}) GROUP BY 1""",
)
def secondary_type_tally(spark, sf_dir):
    return labelling.secondary_tally(corpus.records(spark, sf_dir), corpus.YEARS)


@query(
    "rule_firing_counts",
    "A10",
    f"""WITH {corpus.hits_sql()} SELECT pattern_id, pattern, role, count(DISTINCT pmid) AS n_records
FROM hits GROUP BY ALL""",
)
def rule_firing_counts(spark, sf_dir):
    return counts.rule_firing_counts(corpus.run(spark, sf_dir).hits)


@query(
    "top_firing_rules",
    "O3",
    f"""WITH {corpus.hits_sql()} SELECT pattern_id, pattern, role, count(DISTINCT pmid) AS n_records
FROM hits GROUP BY ALL ORDER BY n_records DESC, pattern_id LIMIT 25""",
)
def top_firing_rules(spark, sf_dir):
    fired = counts.rule_firing_counts(corpus.run(spark, sf_dir).hits)
    return fired.orderBy(F.desc("n_records"), "pattern_id").limit(25)


@query(
    "silent_rules",
    "J12",
    f"""WITH {corpus.hits_sql()}, rules(pattern_id, pattern) AS (VALUES
{', '.join(f"('{r.pattern_id}', {sql_text(r.pattern)})" for r in corpus.rule_book().rules)})
SELECT pattern_id, pattern FROM rules WHERE pattern_id NOT IN (SELECT pattern_id FROM hits)""",
)
def silent_rules(spark, sf_dir):
    job = corpus.run(spark, sf_dir)
    return counts.silent_rules(job.book.table(spark), job.hits)


@query(
    "catch_all_routes",
    "A11",
    f"""WITH {corpus.hits_sql()}
SELECT (SELECT count(DISTINCT pmid) FROM hits WHERE category = 'other' AND role = 'include' AND category_matched = 1) AS by_pattern,
  (SELECT count(DISTINCT pmid) FROM hits WHERE role = 'fallback') AS by_fallback,
  (SELECT coalesce(CAST(sum(mod_other) AS BIGINT), 0) FROM labels_) AS total""",
)
def catch_all_routes(spark, sf_dir):
    return counts.catch_all_routes(corpus.run(spark, sf_dir).annotated)


@query(
    "catch_all_breakdown",
    "A26",
    f"""WITH {corpus.hits_sql()},
pairs AS (SELECT DISTINCT pmid, pattern_id FROM hits WHERE category = 'other' AND role IN ('include', 'fallback')),
k AS (SELECT pmid, count(*) AS k FROM pairs GROUP BY 1),
named AS (SELECT p.pattern_id, p.pmid, k.k, l.title,
    row_number() OVER (PARTITION BY p.pattern_id ORDER BY p.pmid) AS pos
  FROM pairs p JOIN k USING (pmid) JOIN labels_ l USING (pmid))
SELECT pattern_id, CASE WHEN pattern_id LIKE '%:fallback' THEN 'fallback' ELSE 'pattern' END AS route,
  count(*) AS n_papers, count(*) FILTER (k = 1) AS n_papers_sole_evidence,
  string_agg(title, ' || ' ORDER BY pos) FILTER (pos <= 2) AS example_titles
FROM named GROUP BY ALL""",
)
def catch_all_breakdown(spark, sf_dir):
    job = corpus.run(spark, sf_dir)
    return counts.catch_all_breakdown(job.hits, corpus.records(spark, sf_dir))


#: What the rules of two categories stand for; a record with several rules of one type counts once for it.
TYPES = {
    ("modality", "other"): {"other:include[0]": "articles", "other:include[1]": "conjunctions", "other:fallback": "not determined"},
    ("theme", "clinical_fda"): {
        "clinical_fda:include[0]": "licences", "clinical_fda:include[1]": "telephone numbers", "clinical_fda:include[2]": "licences", "clinical_fda:include[3]": "clearances",
    },
}
_TYPES = ", ".join(f"('{c}', '{p}', '{t}')" for (_, c), kinds in TYPES.items() for p, t in kinds.items())


@query(
    "catch_all_by_data_type",
    "A26",
    f"""WITH {corpus.hits_sql()}, types(category, pattern_id, data_type) AS (VALUES {_TYPES}),
pairs AS (SELECT DISTINCT pmid, t.category, data_type FROM hits JOIN types t USING (pattern_id)),
k AS (SELECT pmid, category, count(*) AS k FROM pairs GROUP BY ALL),
named AS (SELECT category, data_type, string_agg(pattern_id, ' | ' ORDER BY pattern_id) AS patterns FROM types GROUP BY ALL)
SELECT category, data_type, count(*) AS n_papers, count(*) FILTER (k = 1) AS n_papers_sole_evidence, any_value(patterns) AS patterns
FROM pairs JOIN k USING (pmid, category) JOIN named USING (category, data_type) GROUP BY ALL""",
)
def catch_all_by_data_type(spark, sf_dir):
    """The catch-all by data type, and a theme some of whose rules stand for the same thing."""
    job = corpus.run(spark, sf_dir)
    parts = [
        counts.by_data_type(job.annotated, job.book, kinds, d, c).withColumn("category", F.lit(c)) for (d, c), kinds in TYPES.items()
    ]
    return parts[0].unionByName(parts[1])


@query(
    "observed_metrics",
    "S12 A7 A11",
    f"""WITH {corpus.hits_sql()},
tags AS (SELECT pmid, trim(unnest(string_split(publication_types, ';'))) AS t FROM flags WHERE early_reason IS NULL)
SELECT 'records_in' AS metric, '' AS key, count(*) AS value FROM flags
UNION ALL SELECT 'catch_all_route', 'pattern', count(*) FILTER (mod_other = 1 AND NOT fell_back) FROM flags WHERE reason IS NULL
UNION ALL SELECT 'catch_all_route', 'fallback', count(*) FILTER (fell_back) FROM flags WHERE reason IS NULL
UNION ALL SELECT 'rules_fired', '', count(*) FILTER (role <> 'fallback') FROM hits
UNION ALL SELECT 'secondary_type', t, count(DISTINCT pmid) FROM tags WHERE t IN ({', '.join(f"'{t}'" for t in SECONDARY_TYPES)}) GROUP BY t""",
)
def observed_metrics(spark, sf_dir):
    """Counts that were taken while the annotated rows were written, and the tally of secondary types."""
    out = scratch_path(spark, "label-run")
    write_corpus(corpus.run(spark, sf_dir), out, {"corpus": sf_dir}, corpus.PARTIAL_YEAR)
    return spark.read.parquet(f"{out}/run_metrics/data").where("metric IN ('records_in', 'catch_all_route', 'rules_fired', 'secondary_type')")


@query(
    "labels_from_rule_file",
    "S9 S11",
    f"WITH {corpus.labels_sql()} {LABEL_SELECT}",
)
def labels_from_rule_file(spark, sf_dir):
    """Rules written out as documents, read back as a rule table, then applied."""
    tables = []
    for dictionary in ("theme", "modality"):
        cats: dict[str, dict[str, list]] = {}
        for d, category, role, _, kind, case, pattern in corpus.RULE_ROWS:
            if d == dictionary:
                side = cats.setdefault(category, {"include": [], "exclude": []})
                entry = {"pattern": pattern, "kind": kind}
                if case is not None:
                    entry["case_sensitive"] = case
                side[role].append(entry)
        path = scratch_path(spark, f"rules-{dictionary}")
        doc = json.dumps({"version": 3, "categories": cats}, ensure_ascii=False)
        spark.createDataFrame([(doc,)], "value string").write.text(path)
        tables.append(read_rule_file(spark, path, dictionary))
    book = RuleBook.from_table(tables[0].unionByName(tables[1]))
    from tallymark.plans.label_corpus import label_corpus as label

    return label(corpus.records(spark, sf_dir), book, corpus.YEARS).labels


@query(
    "label_run_tables",
    "S10 S11 S12 M8",
    f"""WITH {corpus.hits_sql()}
SELECT 'paper_labels' AS output, count(*) AS n_rows FROM labels_
UNION ALL SELECT 'pattern_hits', count(*) FROM hits
UNION ALL SELECT 'exclusions', (SELECT count(*) FROM flags WHERE reason IS NOT NULL)
  + (SELECT count(*) FROM labels_ WHERE is_primary_research = 0)
  + (SELECT count(*) FROM labels_ WHERE is_primary_research = 1 AND theme_multimodal_integration = 1
     AND {' + '.join(f"mod_{k}" for k in corpus.MODALITIES)} < 2)""",
)
def label_run_tables(spark, sf_dir):
    """The whole run written to the shared folder, and its outputs read back and counted."""
    out = scratch_path(spark, "label-run")
    write_corpus(corpus.run(spark, sf_dir, details=True), out, {"corpus": sf_dir}, corpus.PARTIAL_YEAR)
    rows = None
    for name in ("paper_labels", "pattern_hits", "exclusions"):
        part = spark.read.parquet(f"{out}/{name}/data").agg(F.count("*").alias("n_rows"))
        part = part.select(F.lit(name).alias("output"), "n_rows")
        rows = part if rows is None else rows.unionByName(part)
    return rows


