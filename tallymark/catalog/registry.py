"""The registry over the test tables.

An order plays a device: its status gives the prefix of the submission number, the nation
of its customer the product code, the market segment the lead panel.  Nations play the
lookup; dear orders play the decisions on single devices.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallymark.catalog.common import query, table
from tallymark.operators import contracts, registry
from tallymark.plans.classify_registry import classify_registry, write_registry
from tallymark.session import scratch_path
from tallymark.sources import registry_documents
from tallymark.sources.lookup import last_wins
from tallymark.vocab import CATEGORY_DOMAIN, DEVICE_CATEGORIES, DEVICE_EXCLUSIONS, PATHWAYS

ASSIGNED = [
    ("NAA", "radiology_cancer_detection", "892.2050", False),
    ("NAB", "radiology_cancer_detection", "892.2090", False),
    ("NAC", "radiology_cancer_detection", "892.2", True),
    ("NAD", "radiology_radiation_therapy", "892.5050", False),
    ("NAE", "radiology_radiation_therapy", None, False),
    ("NAF", "pathology", "864.3700", False),
    ("NAG", "pathology", "892.6", False),
]
LABELS = {
    "radiology_cancer_detection": "Radiology: cancer detection",
    "radiology_radiation_therapy": "Radiology: radiation therapy",
    "pathology": "Pathology",
}
EXCLUDED = [
    ("NAH", "not_oncology", 600),
    ("NAI", "not_oncology", 0),
    ("NAJ", "indeterminate", 600),
    ("NAK", "indeterminate", 12),
]


def assigned(spark):
    rows = [(c, k, CATEGORY_DOMAIN[k], LABELS[k], r, o) for c, k, r, o in ASSIGNED]
    return spark.createDataFrame(
        rows,
        "code string, category string, domain string, category_label string, "
        "regulation_number string, overridden boolean",
    )


def excluded(spark):
    return spark.createDataFrame(EXCLUDED, "code string, `group` string, n bigint")


def code_of(nation):
    return F.concat(F.lit("NA"), F.char(F.lit(65) + nation))


def raw_devices(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", "c_mktsegment"
    )
    c = F.col
    return orders.join(customers, "o_custkey").select(
        F.when(c("o_totalprice") < 3000, "not given")
        .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
        .alias("Date of Final Decision"),
        F.concat(
            F.when(c("o_totalprice") > 495000, "X")
            .when(c("o_orderstatus") == "F", "K")
            .when(c("o_orderstatus") == "O", " p")
            .otherwise("DEN"),
            c("o_orderkey").cast("string"),
        ).alias("Submission Number"),
        c("c_name").alias("Device"),
        F.when(c("o_orderpriority") != "5-LOW", c("o_orderpriority")).alias("Company"),
        F.when(c("c_mktsegment") == "HOUSEHOLD", "Radiology")
        .when(c("c_mktsegment") == "MACHINERY", "Pathology")
        .otherwise(F.initcap("c_mktsegment"))
        .alias("Panel (Lead)"),
        code_of(c("c_nationkey")).alias("Primary Product Code"),
    )


def lookup(spark, sf_dir):
    """Nations as lookup rows; those of the last region have none, and one has blanks."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"
    )
    rows = nations.where("r_name <> 'MIDDLE EAST'").select(
        code_of(F.col("n_nationkey")).alias("product_code"),
        F.col("n_name").alias("device_name"),
        F.concat(F.lit("892."), F.col("n_nationkey").cast("string")).alias("regulation_number"),
        F.when(F.col("r_name") == "AFRICA", " ")
        .when(F.col("r_name") == "AMERICA", "Radiology")
        .otherwise(F.initcap("r_name"))
        .alias("medical_specialty_description"),
        F.col("n_nationkey").alias("_pos"),
    )
    return last_wins(
        rows, "product_code", ["_pos"], ["device_name", "regulation_number", "medical_specialty_description"]
    )


def decisions(spark, sf_dir):
    """Devices decided one by one: the dearest orders of three priorities."""
    c = F.col
    return (
        raw_devices(spark, sf_dir)
        .join(
            table(spark, sf_dir, "orders").select(
                c("o_orderkey").cast("string").alias("_key"), "o_totalprice", "o_orderpriority"
            ),
            F.regexp_extract("Submission Number", r"(\d+)$", 1) == c("_key"),
        )
        .where("o_totalprice > 450000 AND o_orderpriority < '4'")
        .select(
            F.lower("Submission Number").alias("submission_number"),
            F.when(c("o_orderpriority") == "1-URGENT", "oncology")
            .when(c("o_orderpriority") == "2-HIGH", "not_oncology")
            .otherwise("unresolved")
            .alias("decision"),
            F.when(
                c("o_orderpriority") == "1-URGENT",
                F.when(c("o_totalprice") > 480000, "pathology").otherwise("radiology_cancer_detection"),
            ).otherwise("").alias("category"),
            F.when(c("o_orderpriority") == "1-URGENT", "high").otherwise("").alias("confidence"),
        )
    )


def job(spark, sf_dir):
    return classify_registry(
        raw_devices(spark, sf_dir), lookup(spark, sf_dir), assigned(spark), excluded(spark), decisions(spark, sf_dir)
    )


# --- the same in SQL ---------------------------------------------------------------
_RULE = ", ".join(
    f"('{c}', '{k}', '{CATEGORY_DOMAIN[k]}', '{LABELS[k]}', {repr(r) if r else 'NULL'}, {str(o).upper()})"
    for c, k, r, o in ASSIGNED
)
_DROP = ", ".join(f"('{c}', '{g}', {n})" for c, g, n in EXCLUDED)
BASE = f"""raw AS (
  SELECT o_orderkey, o_totalprice, o_orderpriority,
    CASE WHEN o_totalprice < 3000 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d,
    CASE WHEN o_totalprice > 495000 THEN 'X' WHEN o_orderstatus = 'F' THEN 'K' WHEN o_orderstatus = 'O' THEN 'p'
      ELSE 'DEN' END || o_orderkey AS submission_number,
    c_name AS device, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE '' END AS company,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Radiology' WHEN 'MACHINERY' THEN 'Pathology'
      ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS panel_lead,
    'NA' || chr(65 + c_nationkey) AS product_code
  FROM orders JOIN customer ON c_custkey = o_custkey),
devices AS (
  SELECT *, coalesce(strftime(d, '%Y-%m-%d'), '') AS decision_date, CAST(year(d) AS INTEGER) AS year,
    CASE WHEN upper(submission_number) LIKE 'DEN%' THEN 'De Novo' WHEN upper(submission_number) LIKE 'K%' THEN '510(k)'
      WHEN upper(submission_number) LIKE 'P%' THEN 'PMA' ELSE '' END AS pathway
  FROM raw),
assigned(code, category, domain, category_label, regulation_number, overridden) AS (VALUES {_RULE}),
excluded(code, grp, n) AS (VALUES {_DROP}),
lookup AS (
  SELECT 'NA' || chr(65 + n_nationkey) AS product_code, n_name AS device_name, '892.' || n_nationkey AS regulation_number,
    CASE r_name WHEN 'AFRICA' THEN NULL WHEN 'AMERICA' THEN 'Radiology'
      ELSE upper(r_name[1]) || lower(r_name[2:]) END AS medical_specialty_description
  FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'MIDDLE EAST'),
decisions AS (
  SELECT upper(submission_number) AS key,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'oncology' WHEN '2-HIGH' THEN 'not_oncology' ELSE 'unresolved' END AS decision,
    CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_totalprice > 480000 THEN 'pathology'
      ELSE 'radiology_cancer_detection' END ELSE '' END AS dcat,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' ELSE '' END AS confidence
  FROM raw WHERE o_totalprice > 450000 AND o_orderpriority < '4'),
dlabels AS (SELECT DISTINCT category AS dcat, domain AS ddom, category_label AS dlab FROM assigned),
reasoned AS (
  SELECT v.*, x.*, a.category AS acat, a.domain AS adom, a.category_label AS alab, a.regulation_number AS areg,
    a.overridden, e.grp, l.product_code IS NOT NULL AS has_classification, l.device_name AS l_name,
    l.regulation_number AS l_reg, l.medical_specialty_description AS l_spec, dl.ddom, dl.dlab,
    CASE WHEN (CASE WHEN x.decision IS NOT NULL THEN x.decision = 'oncology' ELSE a.code IS NOT NULL END) THEN
        CASE WHEN pathway = '' THEN 'pathway_unknown' WHEN decision_date = '' THEN 'no_decision_date' ELSE '' END
      WHEN x.decision IS NOT NULL THEN 'device_' || x.decision
      WHEN e.code IS NOT NULL THEN 'code_' || e.grp
      WHEN panel_lead IN ('Radiology', 'Pathology') THEN 'code_unlisted_in_panel'
      ELSE 'code_unlisted_off_panel' END AS exclusion_reason
  FROM devices v LEFT JOIN decisions x ON x.key = upper(v.submission_number)
    LEFT JOIN assigned a ON a.code = v.product_code LEFT JOIN excluded e ON e.code = v.product_code
    LEFT JOIN lookup l ON l.product_code = v.product_code LEFT JOIN dlabels dl ON dl.dcat = x.dcat),
labeled AS (
  SELECT submission_number, decision_date, year, device, company, panel_lead, product_code,
    CASE WHEN exclusion_reason <> '' THEN '' WHEN coalesce(dcat, '') <> '' THEN ddom ELSE coalesce(adom, '') END AS domain,
    CASE WHEN exclusion_reason <> '' THEN '' WHEN coalesce(dcat, '') <> '' THEN dcat ELSE coalesce(acat, '') END AS category,
    CASE WHEN exclusion_reason <> '' THEN '' WHEN coalesce(dcat, '') <> '' THEN dlab ELSE coalesce(alab, '') END AS category_label,
    CASE WHEN exclusion_reason = '' THEN pathway ELSE '' END AS pathway,
    CASE WHEN exclusion_reason = '' THEN coalesce(areg, '') ELSE '' END AS regulation_number,
    exclusion_reason = '' AS counted,
    CASE WHEN exclusion_reason <> '' THEN '' WHEN coalesce(dcat, '') <> '' THEN 'device' ELSE 'code' END AS basis,
    CASE WHEN exclusion_reason = '' AND coalesce(dcat, '') <> '' THEN confidence ELSE '' END AS adjudication_confidence,
    exclusion_reason, coalesce(overridden, FALSE) AS code_overridden, has_classification,
    coalesce(l_name, '') AS openfda_device_name, coalesce(l_reg, '') AS openfda_regulation_number,
    coalesce(l_spec, '') AS openfda_medical_specialty_description
  FROM reasoned),
auth AS (SELECT submission_number, decision_date, year, device, company, panel_lead, product_code, domain, category,
    category_label, pathway, regulation_number FROM labeled WHERE counted)"""


@query("classified_devices", "J1 J3 P18 P19 P21 P22 P23", f"WITH {BASE} SELECT * FROM labeled")
def classified_devices(spark, sf_dir):
    return job(spark, sf_dir).labeled


@query("authorizations", "F5 O1", f"WITH {BASE} SELECT * FROM auth ORDER BY decision_date, submission_number")
def authorizations(spark, sf_dir):
    return job(spark, sf_dir).authorizations


CUMULATIVE = f"""{BASE},
sparse AS (SELECT category, domain, year, count(*) AS n FROM auth GROUP BY ALL),
axis AS (SELECT unnest(generate_series((SELECT min(year) FROM auth), (SELECT max(year) FROM auth))) AS year),
cumulative AS (SELECT CAST(a.year AS INTEGER) AS year, g.category, g.domain, coalesce(s.n, 0) AS annual_count,
    CAST(sum(coalesce(s.n, 0)) OVER (PARTITION BY g.category ORDER BY a.year) AS BIGINT) AS cumulative_count
  FROM (SELECT DISTINCT category, domain FROM sparse) g, axis a
  LEFT JOIN sparse s ON s.category = g.category AND s.year = a.year)"""


@query("cumulative_by_year", "A3 G2 W2", f"WITH {CUMULATIVE} SELECT * FROM cumulative")
def cumulative_by_year(spark, sf_dir):
    return job(spark, sf_dir).cumulative


PATHWAY = f"""{BASE},
paths AS (SELECT g.domain, g.category, p.pathway, count(a.submission_number) AS "count"
  FROM (SELECT DISTINCT domain, category FROM auth) g, (VALUES {', '.join(f"('{p}')" for p in PATHWAYS)}) p(pathway)
  LEFT JOIN auth a ON a.category = g.category AND a.domain = g.domain AND a.pathway = p.pathway GROUP BY ALL)"""


@query("pathway_counts", "A4 G3", f"WITH {PATHWAY} SELECT * FROM paths")
def pathway_counts(spark, sf_dir):
    return job(spark, sf_dir).pathways


@query(
    "domain_pathway_share",
    "A22 P26",
    f"""WITH {PATHWAY}, s AS (SELECT domain, pathway, CAST(sum("count") AS BIGINT) AS "count" FROM paths GROUP BY ALL)
SELECT *, CAST("count" AS DOUBLE) / sum("count") OVER (PARTITION BY domain) AS share FROM s""",
)
def domain_pathway_share(spark, sf_dir):
    return registry.domain_pathway_share(job(spark, sf_dir).pathways)


@query(
    "registry_finals",
    "A24",
    f"""WITH {CUMULATIVE} SELECT category, domain, max(cumulative_count) AS final,
min(year) FILTER (cumulative_count >= 1) AS first_year FROM cumulative GROUP BY ALL""",
)
def registry_finals(spark, sf_dir):
    return registry.series_finals(job(spark, sf_dir).cumulative)


@query(
    "sparse_running_total",
    "W11",
    f"""WITH {BASE}, c AS (SELECT domain, year, count(*) AS annual_count FROM auth GROUP BY ALL)
SELECT *, CAST(sum(annual_count) OVER (PARTITION BY domain ORDER BY year) AS BIGINT) AS cumulative_count FROM c""",
)
def sparse_running_total(spark, sf_dir):
    return registry.sparse_running_total(job(spark, sf_dir).labeled.where("counted"))


@query(
    "device_exclusion_counts",
    "A6",
    f"""WITH {BASE}, w(position, reason) AS (VALUES {', '.join(f"({i}, '{r}')" for i, r in enumerate(DEVICE_EXCLUSIONS, 1))})
SELECT CAST(position AS INTEGER) AS position, reason, count(submission_number) AS n_records FROM w LEFT JOIN labeled ON exclusion_reason = reason GROUP BY ALL""",
)
def device_exclusion_counts(spark, sf_dir):
    return registry.reason_counts(job(spark, sf_dir).labeled, DEVICE_EXCLUSIONS)


@query(
    "code_counts",
    "A19",
    f"""WITH {BASE} SELECT a.code, count(d.submission_number) AS n FROM assigned a
LEFT JOIN devices d ON d.product_code = a.code GROUP BY 1""",
)
def code_counts(spark, sf_dir):
    return registry.code_counts(registry.derive_fields(raw_devices(spark, sf_dir)), assigned(spark))


@query(
    "registry_tally",
    "A19",
    f"""WITH {BASE}, c AS (SELECT * FROM labeled WHERE counted)
SELECT 'basis' AS kind, basis AS key, count(*) AS n FROM c GROUP BY basis
UNION ALL SELECT 'category', category, count(*) FROM c GROUP BY category
UNION ALL SELECT 'domain_pathway', domain || '/' || pathway, count(*) FROM c GROUP BY domain, pathway""",
)
def registry_tally(spark, sf_dir):
    return registry.tally(job(spark, sf_dir).labeled)


@query(
    "panel_agreement",
    "A18",
    f"""WITH {BASE} SELECT domain, count(*) AS n_devices, count(*) FILTER (lower(panel_lead) = domain) AS n_panel_matches,
CAST(count(*) FILTER (lower(panel_lead) = domain) AS DOUBLE) / count(*) AS rate FROM auth GROUP BY 1""",
)
def panel_agreement(spark, sf_dir):
    return registry.panel_agreement(job(spark, sf_dir).labeled)


@query(
    "other_panels",
    "A18",
    f"""WITH {BASE} SELECT domain, panel_lead, count(*) AS n_devices FROM auth
WHERE lower(panel_lead) <> domain GROUP BY ALL""",
)
def other_panels(spark, sf_dir):
    return registry.other_panels(job(spark, sf_dir).labeled)


@query(
    "codes_without_record",
    "J2 U5",
    f"""WITH {BASE} SELECT product_code, count(*) AS n_devices FROM devices
WHERE product_code NOT IN (SELECT product_code FROM lookup) GROUP BY 1""",
)
def codes_without_record(spark, sf_dir):
    return registry.codes_without_record(
        registry.derive_fields(raw_devices(spark, sf_dir)), lookup(spark, sf_dir)
    )


@query(
    "specialty_disagreements",
    "J10",
    f"""WITH {BASE} SELECT a.code, a.category, a.domain AS config_domain,
  coalesce(medical_specialty_description, '(no record)') AS lookup_specialty,
  CASE WHEN l.product_code IS NULL THEN 'no_record' WHEN lower(coalesce(medical_specialty_description, '')) IN ('', 'unknown')
    THEN 'unstated' ELSE 'conflict' END AS kind
FROM assigned a LEFT JOIN lookup l ON l.product_code = a.code
  AND EXISTS (SELECT 1 FROM devices v WHERE v.product_code = l.product_code)
WHERE lower(coalesce(medical_specialty_description, '')) <> lower(a.domain)""",
)
def specialty_disagreements(spark, sf_dir):
    used = registry.derive_fields(raw_devices(spark, sf_dir)).select("product_code").distinct()
    seen = lookup(spark, sf_dir).join(used, "product_code", "left_semi")
    return registry.specialty_disagreements(assigned(spark), seen, "medical_specialty_description")


@query(
    "regulation_differences",
    "J15",
    f"""WITH {BASE}, j AS (SELECT a.code, coalesce(a.regulation_number, '-') AS config_regulation,
  coalesce(l.regulation_number, '-') AS lookup_regulation, a.overridden,
  a.regulation_number <> l.regulation_number AS differs FROM assigned a LEFT JOIN lookup l ON l.product_code = a.code
  AND EXISTS (SELECT 1 FROM devices v WHERE v.product_code = l.product_code))
SELECT code, config_regulation, lookup_regulation, CASE WHEN differs THEN 'differs' ELSE 'override' END AS flag
FROM j WHERE differs OR overridden""",
)
def regulation_differences(spark, sf_dir):
    used = registry.derive_fields(raw_devices(spark, sf_dir)).select("product_code").distinct()
    seen = lookup(spark, sf_dir).join(used, "product_code", "left_semi")
    return registry.regulation_differences(assigned(spark), seen, "regulation_number")


@query(
    "excluded_code_drift",
    "J11",
    f"""WITH {BASE}, o AS (SELECT product_code, count(*) AS n FROM devices GROUP BY 1)
SELECT e.code, e.grp AS "group", CAST(e.n AS BIGINT) AS config_n, coalesce(o.n, 0) AS observed_n
FROM excluded e LEFT JOIN o ON o.product_code = e.code WHERE e.n <> coalesce(o.n, 0)""",
)
def excluded_code_drift(spark, sf_dir):
    return registry.excluded_code_drift(registry.derive_fields(raw_devices(spark, sf_dir)), excluded(spark))


@query(
    "scope_coverage",
    "F10",
    f"""WITH {BASE} SELECT count(*) AS n_devices, count(*) FILTER (counted) AS n_counted,
count(*) FILTER (NOT counted AND exclusion_reason <> 'code_unlisted_in_panel') AS n_excluded,
count(*) FILTER (exclusion_reason = 'code_unlisted_in_panel') AS n_unlisted
FROM labeled WHERE panel_lead IN ('Radiology', 'Pathology')""",
)
def scope_coverage(spark, sf_dir):
    return registry.scope_coverage(job(spark, sf_dir).labeled)


@query(
    "unlisted_codes",
    "F10 O4",
    f"""WITH {BASE} SELECT product_code, count(*) AS n_devices, min(device) AS example FROM labeled
WHERE exclusion_reason = 'code_unlisted_in_panel' GROUP BY 1""",
)
def unlisted_codes(spark, sf_dir):
    return registry.unlisted_codes(job(spark, sf_dir).labeled)


@query(
    "snapshot_date",
    "A28",
    f"""WITH {BASE} SELECT max(d) AS snapshot_date, count(*) FILTER (d IS NULL) AS n_unparsable, count(*) AS n_rows FROM raw""",
)
def snapshot_date(spark, sf_dir):
    return registry.snapshot_date(raw_devices(spark, sf_dir))


@query(
    "partial_year",
    "P27",
    f"""WITH {BASE}, m AS (SELECT max(year) AS y, max(CAST(decision_date AS DATE)) AS d FROM auth)
SELECT CASE WHEN year(d) < y OR month(d) < 12 THEN y END AS partial_year FROM m""",
)
def partial_year(spark, sf_dir):
    return registry.partial_year(job(spark, sf_dir).labeled.where("counted"))


_METRICS = "\nUNION ALL ".join(
    [f"SELECT 'devices_excluded' AS metric, '{r}' AS key, count(*) FILTER (exclusion_reason = '{r}') AS value FROM labeled" for r in DEVICE_EXCLUSIONS]
    + [f"SELECT 'counted_by', '{b}', count(*) FILTER (counted AND basis = '{b}') FROM labeled" for b in ("device", "code")]
    + [f"SELECT 'counted_in', '{k}', count(*) FILTER (counted AND category = '{k}') FROM labeled" for k in DEVICE_CATEGORIES]
)


@query(
    "registry_metrics",
    "S12",
    f"""WITH {BASE} {_METRICS}
UNION ALL SELECT 'devices_in', '', count(*) FROM labeled UNION ALL SELECT 'devices_counted', '', count(*) FILTER (counted) FROM labeled
UNION ALL SELECT 'without_lookup', '', count(*) FILTER (NOT has_classification) FROM labeled
UNION ALL SELECT 'code_overridden', '', count(*) FILTER (counted AND code_overridden) FROM labeled""",
)
def registry_metrics(spark, sf_dir):
    """Counts that were taken while the labeled devices were written."""
    out = scratch_path(spark, "registry-run")
    write_registry(job(spark, sf_dir), out, {"devices": sf_dir})
    return spark.read.parquet(f"{out}/run_metrics/data")


@query("registry_cross_table", "J9", "SELECT '' AS \"check\", '' AS key, '' AS detail WHERE FALSE")
def registry_cross_table(spark, sf_dir):
    """Written tables that must agree; every disagreement is a row, so none is expected."""
    out = scratch_path(spark, "registry-run")
    run = job(spark, sf_dir)
    write_registry(run, out, {"devices": sf_dir})
    read = lambda name: spark.read.parquet(f"{out}/{name}/data")
    return contracts.cross_table(read("authorizations"), read("cumulative_by_year"), read("pathway_by_domain"))


@query(
    "registry_cross_table_drift",
    "J9",
    f"""WITH {CUMULATIVE},
stale AS (SELECT * FROM auth WHERE pathway <> 'PMA'),
paths AS (SELECT category, pathway, count(*) AS n FROM auth WHERE pathway <> 'De Novo' GROUP BY ALL),
last AS (SELECT category, max_by(cumulative_count, year) AS n FROM cumulative GROUP BY 1),
facts AS (
  SELECT 'annual_count' AS "check", category || '/' || year AS key, 1 AS l, 0 AS r FROM stale
  UNION ALL SELECT 'annual_count', category || '/' || year, 0, annual_count FROM cumulative
  UNION ALL SELECT 'pathway_count', category || '/' || pathway, 1, 0 FROM stale
  UNION ALL SELECT 'pathway_count', category || '/' || pathway, 0, n FROM paths
  UNION ALL SELECT 'final_cumulative', category, 1, 0 FROM stale
  UNION ALL SELECT 'final_cumulative', category, 0, n FROM last
  UNION ALL SELECT 'pathway_total', category, n, 0 FROM last
  UNION ALL SELECT 'pathway_total', category, 0, n FROM paths)
SELECT "check", key, CAST(sum(l) AS BIGINT) || '<>' || CAST(sum(r) AS BIGINT) AS detail FROM facts GROUP BY ALL HAVING sum(l) <> sum(r)""",
)
def registry_cross_table_drift(spark, sf_dir):
    """The same check against a detail table that has lost its PMA rows and a pathway table without De Novo."""
    run = job(spark, sf_dir)
    return contracts.cross_table(
        run.profile.where("pathway <> 'PMA'"), run.cumulative, run.pathways.where("pathway <> 'De Novo'")
    )


def write_documents(spark, sf_dir) -> tuple[str, str]:
    """The code rule as two documents and the decisions as three; some of what they say, they say twice."""
    out = scratch_path(spark, "documents")
    number = {c: r for c, _, r, _ in ASSIGNED}

    def document(codes, overridden, dropped):
        kinds = {}
        for code, category, stated, _ in codes:
            kinds.setdefault(category, []).append({"code": code, "regulation_number": None if code in overridden else stated})
        categories = {k: {"label": LABELS[k], "domain": CATEGORY_DOMAIN[k], "codes": v} for k, v in kinds.items()}
        groups = {}
        for code, group, n in dropped:
            groups.setdefault(group, {"reason": "r", "codes": []})["codes"].append({"code": code, "n": n, "why": "w"})
        domain = {c: CATEGORY_DOMAIN[k] for c, k, _, _ in ASSIGNED}
        overrides = [{"code": c, "domain": domain[c], "regulation_number": number[c]} for c in overridden]
        return json.dumps({"version": 1, "categories": categories, "overrides": overrides, "excluded": groups})

    texts = [document(ASSIGNED[:4], ["NAC"], EXCLUDED[:2]), document(ASSIGNED[3:], [], EXCLUDED[1:])]
    for i, text in enumerate(texts):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{out}/codes/part={i}")
    c = F.col
    entry = F.struct(
        c("submission_number").alias("submission"), F.lit("d").alias("device"), F.lit("NAA").alias("product_code"), "decision", "category", "confidence",
        F.lit("stated in the summary of the decision").alias("evidence"),
    )
    made = decisions(spark, sf_dir).withColumn("doc", F.when(c("decision") == "oncology", "a.json").otherwise("b.json"))
    # the third document repeats what the second says on unresolved devices
    again = made.where("decision = 'unresolved'").withColumn("doc", F.lit("c.json"))
    grouped = made.unionByName(again).groupBy("doc").agg(F.collect_list(entry).alias("adjudicated"))
    n = F.when(c("doc") == "a.json", F.lit(1).cast("bigint")).otherwise(F.size("adjudicated").cast("bigint"))
    grouped.withColumns({"version": F.lit(2), "n_devices": n}).write.partitionBy("doc").json(f"{out}/decisions")
    return f"{out}/codes/*", f"{out}/decisions/*"


@query("registry_from_documents", "S9 Q11 Q12 J3", f"WITH {BASE} SELECT * FROM labeled")
def registry_from_documents(spark, sf_dir):
    """The registry under rules read from documents that overlap: no device is multiplied."""
    codes, decided = write_documents(spark, sf_dir)
    rule = registry_documents.CodeRule(spark, codes)
    devices = registry.attach_lookup(registry.derive_fields(raw_devices(spark, sf_dir)), lookup(spark, sf_dir))
    return registry.classify_devices(devices, rule.assigned, rule.excluded, registry_documents.Decisions(spark, decided).decisions)


@query(
    "document_problems",
    "S9 Q11 Q12",
    f"""WITH {BASE}
SELECT 'repeated_key' AS "check", 'NAD/radiology_radiation_therapy' AS key, '2' AS detail
UNION ALL SELECT 'repeated_key', 'NAI', '2'
UNION ALL SELECT 'declared_count', 'a.json', '1<>' || count(*) FROM decisions WHERE decision = 'oncology' HAVING count(*) > 1
UNION ALL SELECT 'decided_twice', key, 'b.json says unresolved, c.json says unresolved' FROM decisions WHERE decision = 'unresolved'""",
)
def document_problems(spark, sf_dir):
    """What the overlapping documents disagree on or say twice."""
    codes, decided = write_documents(spark, sf_dir)
    return contracts.all_problems(
        registry_documents.CodeRule(spark, codes).problems(), registry_documents.Decisions(spark, decided, r"doc=([^/]+)/").problems()
    )
