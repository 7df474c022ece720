"""Count tables over the label table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.catalog import corpus
from tallymark.catalog.common import query, table
from tallymark.functions.rates import rate
from tallymark.operators import counts, dedup, grids, ranking
from tallymark.vocab import DOMAIN_SERIES, MIN_ZERO_RUN, MODALITIES, SECONDARY_TYPES, THEMES

_SIZE = " + ".join(f"mod_{k}" for k in MODALITIES)
_NAMED = " + ".join(f"mod_{k}" for k in MODALITIES if k != "other")
_SET = "list_aggregate(list_sort(list_filter([" + ", ".join(
    f"CASE WHEN mod_{k} = 1 THEN '{k}' END" for k in MODALITIES
) + "], lambda x: x IS NOT NULL)), 'string_agg', '+')"
_THEME_LIST = "[" + ", ".join(f"CASE WHEN theme_{k} = 1 THEN '{k}' END" for k in THEMES) + "]"

COMBOS = f"""{corpus.labels_sql()},
members AS (SELECT unnest({_THEME_LIST}) AS theme, {_SET} AS modality_set,
    {_SIZE} AS n_modalities FROM labels_ WHERE is_primary_research = 1),
combos0 AS (SELECT theme, modality_set, n_modalities, count(*) AS n_papers FROM members
  WHERE theme IS NOT NULL AND (theme <> 'multimodal_integration' OR n_modalities >= 2) GROUP BY ALL),
combos AS (SELECT theme, modality_set, CAST(n_modalities AS INTEGER) AS n_modalities, n_papers,
    CAST(row_number() OVER (PARTITION BY theme ORDER BY n_papers DESC, n_modalities, modality_set) AS INTEGER)
      AS rank_in_theme FROM combos0)"""


@query("combination_counts", "A1 W1 F3 F4 P13 P14", f"WITH {COMBOS} SELECT * FROM combos")
def combination_counts(spark, sf_dir):
    return counts.combination_counts(corpus.run(spark, sf_dir).labels)


SERIES = f"""{corpus.labels_sql()},
member AS (SELECT unnest({_THEME_LIST}) AS theme, domain, year FROM labels_),
axis AS (SELECT unnest(generate_series((SELECT min(year) FROM labels_), (SELECT max(year) FROM labels_))) AS year),
grid AS (SELECT t.theme, d.domain, a.year FROM (VALUES {', '.join(f"('{k}')" for k in THEMES)}) t(theme),
  (VALUES {', '.join(f"('{k}')" for k in DOMAIN_SERIES)}) d(domain), axis a),
series AS (SELECT g.theme, g.domain, CAST(g.year AS INTEGER) AS year, count(m.theme) AS n_papers,
    CAST(g.year = {corpus.PARTIAL_YEAR} AS INTEGER) AS partial_year
  FROM grid g LEFT JOIN member m ON m.theme = g.theme AND m.year = g.year AND (g.domain = 'all' OR m.domain = g.domain)
  GROUP BY ALL)"""


@query("theme_year_counts", "A2 G1 P27", f"WITH {SERIES} SELECT * FROM series")
def theme_year_counts(spark, sf_dir):
    return counts.theme_year_counts(corpus.run(spark, sf_dir).labels, corpus.PARTIAL_YEAR)


_SHORT = f"theme_multimodal_integration = 1 AND {_SIZE} < 2"


@query(
    "minimum_shortfalls",
    "A5",
    f"""WITH {corpus.labels_sql()} SELECT 'multimodal_integration' AS theme, 2 AS minimum,
count(*) FILTER ({_SHORT} AND is_primary_research = 1) AS panel_a, count(*) FILTER ({_SHORT}) AS corpus_wide FROM labels_""",
)
def minimum_shortfalls(spark, sf_dir):
    return counts.minimum_shortfalls(corpus.run(spark, sf_dir).labels)


def _total(kind: str, key: str, when: str) -> str:
    return (
        f"SELECT '{kind}' AS kind, '{key}' AS key, count(*) FILTER ({when}) AS n_retained, "
        f"count(*) FILTER (({when}) AND is_primary_research = 1) AS n_primary FROM labels_"
    )


_N_THEMES = " + ".join(f"theme_{k}" for k in THEMES)
_TOTALS = (
    [_total("theme", k, f"theme_{k} = 1") for k in THEMES]
    + [_total("theme", "(no theme)", f"{_N_THEMES} = 0"), _total("theme", "(two or more themes)", f"{_N_THEMES} > 1")]
    + [_total("modality", k, f"mod_{k} = 1") for k in MODALITIES]
    + [_total("modality", "(two or more named)", f"{_NAMED} > 1"), _total("population", "retained", "TRUE")]
    + ["SELECT 'domain', domain, count(*), count(*) FILTER (is_primary_research = 1) FROM labels_ GROUP BY domain"]
)


@query("label_totals", "A8", f"WITH {corpus.labels_sql()} {' UNION ALL '.join(_TOTALS)}")
def label_totals(spark, sf_dir):
    return counts.label_totals(corpus.run(spark, sf_dir).labels)


@query(
    "labels_per_record",
    "A9 P30",
    f"""WITH {corpus.labels_sql()}, b(n_named) AS (VALUES (0), (1), (2), (3), (4))
SELECT b.n_named, count(l.pmid) AS n_papers FROM b LEFT JOIN labels_ l ON least({_NAMED}, 4) = b.n_named GROUP BY 1""",
)
def labels_per_record(spark, sf_dir):
    return counts.labels_per_record(corpus.run(spark, sf_dir).labels)


@query(
    "run_metrics",
    "S12",
    f"""WITH {corpus.labels_sql()},
totals AS ({' UNION ALL '.join(_TOTALS)})
SELECT 'records_retained' AS metric, '' AS key, count(*) AS value FROM labels_
UNION ALL SELECT 'records_primary', '', count(*) FILTER (is_primary_research = 1) FROM labels_
UNION ALL SELECT 'excluded', w.reason, count(f.pmid) FROM (VALUES {', '.join(f"('{r}')" for r in
    ("book_records", "missing_pmid", "missing_year", "outside_date_range", "non_specialty_only"))}) w(reason)
  LEFT JOIN flags f ON f.reason = w.reason GROUP BY w.reason
UNION ALL SELECT 'label_retained', kind || '/' || key, n_retained FROM totals
UNION ALL SELECT 'label_primary', kind || '/' || key, n_primary FROM totals
UNION ALL SELECT 'shortfall_panel_a', 'multimodal_integration', count(*) FILTER ({_SHORT} AND is_primary_research = 1) FROM labels_
UNION ALL SELECT 'shortfall_corpus', 'multimodal_integration', count(*) FILTER ({_SHORT}) FROM labels_
UNION ALL SELECT 'secondary_type', t, count(DISTINCT pmid) FROM (SELECT pmid, trim(unnest(string_split(publication_types, ';'))) AS t FROM flags WHERE early_reason IS NULL)
WHERE t IN ({', '.join(f"'{t}'" for t in SECONDARY_TYPES)}) GROUP BY t""",
)
def run_metrics(spark, sf_dir):
    job = corpus.run(spark, sf_dir)
    return job.metrics(counts.label_profile(job.labels))


SHOWN = f"""{COMBOS},
ranked AS (SELECT *, count(*) FILTER (n_papers >= 2) OVER (PARTITION BY theme) >= 12 AS enough FROM combos),
shown AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY n_papers DESC, n_modalities DESC, modality_set) AS position
  FROM ranked WHERE NOT enough OR n_papers >= 2 QUALIFY position <= 12)"""


@query(
    "top_combinations",
    "W4 F11 O3",
    f"WITH {SHOWN} SELECT theme, modality_set, n_modalities, n_papers, CAST(position AS INTEGER) AS position FROM shown",
)
def top_combinations(spark, sf_dir):
    return counts.top_combinations(counts.combination_counts(corpus.run(spark, sf_dir).labels))


@query(
    "tail_summary",
    "A21 P26",
    f"""WITH {SHOWN}, marked AS (SELECT c.*, s.position IS NOT NULL AS is_shown FROM combos c LEFT JOIN shown s USING (theme, modality_set))
SELECT theme, count(*) FILTER (is_shown) AS shown_sets, count(*) FILTER (NOT is_shown) AS remainder_sets,
  CAST(coalesce(sum(n_papers) FILTER (is_shown), 0) AS BIGINT) AS shown_papers,
  CAST(coalesce(sum(n_papers) FILTER (NOT is_shown), 0) AS BIGINT) AS remainder_papers,
  CAST(sum(n_papers) AS BIGINT) AS total_papers,
  CAST(coalesce(sum(n_papers) FILTER (NOT is_shown), 0) AS DOUBLE) / sum(n_papers) AS remainder_share
FROM marked GROUP BY theme""",
)
def tail_summary(spark, sf_dir):
    return counts.tail_summary(counts.combination_counts(corpus.run(spark, sf_dir).labels))


@query(
    "series_summary",
    "A23",
    f"""WITH {SERIES} SELECT theme, domain, CAST(sum(n_papers) AS BIGINT) AS total, max(n_papers) AS peak
FROM series GROUP BY ALL""",
)
def series_summary(spark, sf_dir):
    series = counts.theme_year_counts(corpus.run(spark, sf_dir).labels, corpus.PARTIAL_YEAR)
    return counts.series_summary(series, ["theme", "domain"], "n_papers")


DRAWN = [("foundation_models", "all"), ("clinical_fda", "radiology"), ("agentic_ai", "all")]
STARTS = {("agentic_ai", "all"): 1999}


@query(
    "selected_series",
    "F8 F9",
    f"""WITH {SERIES} SELECT * FROM series
WHERE (theme, domain) IN ({', '.join(f"('{t}', '{d}')" for t, d in DRAWN)}) AND NOT (theme = 'agentic_ai' AND domain = 'all' AND year < 1999)""",
)
def selected_series(spark, sf_dir):
    series = counts.theme_year_counts(corpus.run(spark, sf_dir).labels, corpus.PARTIAL_YEAR)
    return grids.series_from(grids.select_series(series, DRAWN), STARTS)


# Orders as dated series: a status within a priority class is dense in time, a customer is not.
SPARSE = """sparse AS (
  SELECT o_custkey AS custkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY ALL),
span AS (SELECT min(year) AS lo, max(year) AS hi FROM sparse),
grid AS (SELECT c.custkey, CAST(y AS INTEGER) AS year FROM (SELECT DISTINCT custkey FROM sparse) c,
  (SELECT unnest(generate_series(lo, hi)) AS y FROM span)),
dense AS (SELECT g.custkey, g.year, coalesce(s.n, 0) AS n FROM grid g LEFT JOIN sparse s USING (custkey, year))"""


def customer_years(spark, sf_dir):
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year"))
        .agg(F.count("*").alias("n"))
    )


@query("dense_customer_years", "G2", f"WITH {SPARSE} SELECT * FROM dense")
def dense_customer_years(spark, sf_dir):
    return grids.dense_counts(customer_years(spark, sf_dir), ["custkey"], "n")


@query(
    "leading_zero_run",
    "W5",
    f"""WITH {SPARSE}, f AS (SELECT custkey, min(year) AS first_year, min(year) FILTER (n > 0) AS reached FROM dense GROUP BY 1)
SELECT custkey, first_year AS from_year, reached - 1 AS to_year FROM f WHERE reached - first_year >= {MIN_ZERO_RUN}""",
)
def leading_zero_run(spark, sf_dir):
    dense = grids.dense_counts(customer_years(spark, sf_dir), ["custkey"], "n")
    return grids.leading_zero_run(dense, ["custkey"], "n", MIN_ZERO_RUN)


@query(
    "series_from_first_reach",
    "W6 W2 F9",
    f"""WITH {SPARSE}, r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY custkey ORDER BY year) AS BIGINT) AS cumulative FROM dense)
SELECT custkey, year, n, cumulative FROM r WHERE cumulative >= 1""",
)
def series_from_first_reach(spark, sf_dir):
    dense = grids.dense_counts(customer_years(spark, sf_dir), ["custkey"], "n")
    return grids.from_first_reach(
        grids.running_total(dense, "custkey", "year", "n", "cumulative"), "custkey", "cumulative"
    )


@query(
    "undrawn_years",
    "A24",
    f"""WITH {SPARSE}, f AS (SELECT custkey, min(year) AS first_year, min(year) FILTER (n > 0) AS reached FROM dense GROUP BY 1)
SELECT custkey, first_year AS from_year, reached - 1 AS to_year FROM f WHERE reached > first_year""",
)
def undrawn_years(spark, sf_dir):
    dense = grids.dense_counts(customer_years(spark, sf_dir), ["custkey"], "n")
    return grids.undrawn_span(
        grids.running_total(dense, "custkey", "year", "n", "cumulative"), "custkey", "cumulative"
    )


@query(
    "priority_share",
    "P26 A22",
    """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY o_orderstatus) AS share FROM c""",
)
def priority_share(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return counts.share_of(n, ["o_orderstatus"], "n")


@query(
    "parse_summary",
    "A20",
    f"""WITH {corpus.RECORDS_SQL}, r AS (SELECT *, abstract <> '' AS has_abstract,
  abstract <> '' AND strpos(abstract, chr(10)) > 0 AS structured FROM records)
SELECT 'records' AS metric, '' AS key, count(*) AS value FROM r
UNION ALL SELECT 'records_by_type', record_type, count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'without_abstract', '', count(*) FROM r WHERE NOT has_abstract HAVING count(*) > 0
UNION ALL SELECT 'structured_abstract', '', count(*) FROM r WHERE structured HAVING count(*) > 0
UNION ALL SELECT 'unstructured_abstract', '', count(*) FROM r WHERE has_abstract AND NOT structured HAVING count(*) > 0
UNION ALL SELECT 'without_year', '', count(*) FROM r WHERE year IS NULL HAVING count(*) > 0
UNION ALL SELECT 'year_source', year_source, count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'language', language, count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM r WHERE year IS NOT NULL GROUP BY ALL""",
)
def parse_summary(spark, sf_dir):
    records = corpus.records(spark, sf_dir).withColumns(
        {
            "has_abstract": F.col("abstract") != "",
            "abstract_structured": F.contains("abstract", F.lit("\n")),
        }
    )
    return counts.parse_summary(records)


# --- keep-first over documents that are copies of each other -----------------------

@query(
    "keep_first",
    "W8 R2",
    """SELECT doc_id, text, lang, source FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY source, doc_id) = 1""",
)
def keep_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return dedup.keep_first(docs, "text", ["source", "doc_id"])


@query(
    "keep_first_conversation",
    "W8",
    """SELECT conv_id, turn, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) = 1""",
)
def keep_first_conversation(spark, sf_dir):
    return dedup.keep_first(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role"])


@query(
    "capture_reconciliation",
    "A25",
    """SELECT count(*) AS fetched, count(DISTINCT text) AS n_unique, count(*) - count(DISTINCT text) AS n_duplicates,
  (SELECT count(*) FROM orders) - count(*) AS shortfall,
  count(DISTINCT text) = (SELECT count(DISTINCT doc_id) FROM labels) AS reconciles FROM documents""",
)
def capture_reconciliation(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").agg(F.count("*").alias("requested"))
    expected = table(spark, sf_dir, "labels").agg(F.countDistinct("doc_id").alias("expected"))
    manifest = asked.withColumn("_one", F.lit(1)).join(F.broadcast(expected.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return dedup.reconcile_capture(table(spark, sf_dir, "documents"), "text", manifest)


@query(
    "pattern_census",
    "A27",
    f"""WITH {corpus.hits_sql()}, j AS (SELECT DISTINCT h.pmid, h.pattern_id, l.quality FROM hits h
  JOIN labels l ON CAST(l.doc_id AS VARCHAR) = h.pmid WHERE role = 'include')
SELECT pattern_id, count(*) AS n, count(*) FILTER (quality = 1) AS tp,
  CAST(count(*) FILTER (quality = 1) AS DOUBLE) / count(*) AS precision FROM j GROUP BY 1""",
)
def pattern_census(spark, sf_dir):
    verdicts = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("pmid"), F.col("quality").alias("verdict")
    )
    return counts.pattern_census(corpus.run(spark, sf_dir, details=True).hits, verdicts)


# --- label sets of entities that are not texts: event types per user, part types per order

_EVENTS = ("click", "error", "purchase", "signup", "view")


@query(
    "user_event_sets",
    "P13 A1 W1",
    """WITH s AS (SELECT user_id, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS modality_set,
    CAST(count(DISTINCT event_type) AS INTEGER) AS n_modalities FROM events GROUP BY 1),
c AS (SELECT modality_set, n_modalities, count(*) AS n_papers FROM s GROUP BY ALL)
SELECT *, CAST(row_number() OVER (ORDER BY n_papers DESC, n_modalities, modality_set) AS INTEGER) AS position FROM c""",
)
def user_event_sets(spark, sf_dir):
    flags = [F.max((F.col("event_type") == e).cast("int")).alias(f"mod_{e}") for e in _EVENTS]
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(*flags)
    from tallymark.functions.labels import label_set, set_size

    sets = users.groupBy(label_set(_EVENTS).alias("modality_set"), set_size(_EVENTS).alias("n_modalities")).agg(
        F.count("*").alias("n_papers")
    )
    order = [F.desc("n_papers"), F.col("n_modalities"), F.col("modality_set")]
    ranked = ranking.top_per_group(sets.withColumn("_g", F.lit(1)), ["_g"], order, 2 ** len(_EVENTS), "position")
    return ranked.drop("_g")


@query(
    "order_part_sets",
    "P13 A1 A21",
    """WITH s AS (SELECT l_orderkey, string_agg(DISTINCT p_type, '+' ORDER BY p_type) AS type_set, count(DISTINCT p_type) AS k
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT type_set, CAST(k AS INTEGER) AS n_types, count(*) AS n_orders FROM s GROUP BY ALL""",
)
def order_part_sets(spark, sf_dir):
    """Sets are six flags folded with ``max``, so a huge order never lists its lines."""
    from tallymark.functions.labels import label_set, set_size
    from tallymark.operators.joins import small

    types = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(small(parts), "l_partkey")
    flags = [F.max((F.col("p_type") == t).cast("int")).alias(f"mod_{t}") for t in types]
    orders = lines.groupBy("l_orderkey").agg(*flags)
    return orders.groupBy(label_set(types).alias("type_set"), set_size(types).alias("n_types")).agg(
        F.count("*").alias("n_orders")
    )


@query(
    "numbered_orders",
    "W10 O1",
    """SELECT o_orderstatus, o_orderkey, CAST(o_orderdate AS DATE) AS order_date,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS position FROM orders""",
)
def numbered_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderstatus", "o_orderkey", F.to_date("o_orderdate").alias("order_date")
    )
    return ranking.numbered(orders, ["order_date", "o_orderkey"], "position", ["o_orderstatus"])


@query(
    "first_offenders",
    "O4",
    """SELECT o_orderkey, o_totalprice, count(*) OVER () AS n_total FROM orders WHERE o_totalprice > 400000
ORDER BY o_orderkey LIMIT 40""",
)
def first_offenders(spark, sf_dir):
    bad = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_orderkey", "o_totalprice")
    return ranking.first_offenders(bad, ["o_orderkey"], 40)


@query(
    "vocabulary_order",
    "O2",
    f"""WITH {corpus.labels_sql()}, m AS (SELECT unnest({_THEME_LIST}) AS theme FROM labels_)
SELECT theme, count(*) AS n, CAST(list_position([{', '.join(f"'{k}'" for k in THEMES)}], theme) AS BIGINT) AS position
FROM m WHERE theme IS NOT NULL GROUP BY ALL ORDER BY position""",
)
def vocabulary_order(spark, sf_dir):
    labels = corpus.run(spark, sf_dir).labels
    carried = F.filter(
        F.array(*[F.when(F.col(f"theme_{k}") == 1, F.lit(k)) for k in THEMES]), lambda x: x.isNotNull()
    )
    n = labels.select(F.explode(carried).alias("theme")).groupBy("theme").agg(F.count("*").alias("n"))
    return counts.in_vocabulary_order(
        n.withColumn("position", grids.position_in(THEMES, "theme").cast("bigint")), ("theme", THEMES)
    )


@query(
    "domain_rate",
    "P25",
    f"""WITH {corpus.labels_sql()} SELECT domain, count(*) AS n, count(*) FILTER (is_primary_research = 1) AS k,
CAST(count(*) FILTER (is_primary_research = 1) AS DOUBLE) / nullif(count(*), 0) AS rate FROM labels_ GROUP BY 1""",
)
def domain_rate(spark, sf_dir):
    labels = corpus.run(spark, sf_dir).labels
    n = labels.groupBy("domain").agg(
        F.count("*").alias("n"), F.count_if(F.col("is_primary_research") == 1).alias("k")
    )
    return n.withColumn("rate", rate("k", "n"))


