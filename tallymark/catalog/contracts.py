"""Contract queries: each finds real problems, or their absence, in the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.catalog import corpus, registry
from tallymark.catalog.common import query, table
from tallymark.catalog.counting import COMBOS, SERIES, customer_years
from tallymark.operators import contracts, counts, grids, labelling
from tallymark.operators import registry as devices
from tallymark.session import scratch_path, written
from tallymark.sources import lineage, tables
from tallymark.sources.rules import RuleBook
from tallymark.vocab import DEVICE_CATEGORIES, STRATA

_NONE = "SELECT '' AS \"check\", '' AS key, '' AS detail WHERE FALSE"
_ROW = '"check", key, detail'


@query("columns_expected", "Q1", """SELECT * FROM (VALUES ('column_missing', 'title', ''), ('column_missing', 'pmid', ''),
('column_unexpected', 'doc_id', ''), ('column_unexpected', 'text', ''), ('column_unexpected', 'source', '')) t("check", key, detail)""")
def columns_expected(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return contracts.column_set(docs, ["pmid", "title", "lang"], tolerated=["n_chars"])


@query(
    "whole_number_columns",
    "Q2",
    """SELECT 'not_whole_number' AS "check", 'o_totalprice' AS key, count(*) || ' ' || min(CAST(o_totalprice AS VARCHAR)) AS detail
FROM orders WHERE o_totalprice <> floor(o_totalprice) HAVING count(*) > 0""",
)
def whole_number_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return contracts.all_problems(
        contracts.whole_numbers(orders, "o_totalprice", 0), contracts.whole_numbers(orders, "o_custkey", 0)
    )


@query(
    "contract_report",
    "Q2 Q3 Q4 Q5 Q7",
    """SELECT 'quantity_not_whole' AS "check", CAST(l_linenumber AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem WHERE l_quantity <> floor(l_quantity) GROUP BY 2
UNION ALL SELECT 'large_discount', CAST(l_linenumber AS VARCHAR), CAST(count(*) AS VARCHAR) FROM lineitem WHERE l_discount > 0.05 GROUP BY 2
UNION ALL SELECT 'unknown_flag', l_returnflag, CAST(count(*) AS VARCHAR) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY 2
UNION ALL SELECT 'shipped_twice', l_orderkey || '/' || l_partkey, CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1
UNION ALL SELECT 'several_suppliers', CAST(l_partkey AS VARCHAR), 'differs' FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1""",
)
def contract_report(spark, sf_dir):
    """Five checks of the line items in one scan."""
    c = F.col
    return contracts.contract_report(
        table(spark, sf_dir, "lineitem"),
        rows={
            "quantity_not_whole": (c("l_quantity") != F.floor("l_quantity"), c("l_linenumber")),
            "large_discount": (c("l_discount") > 0.05, c("l_linenumber")),
            "unknown_flag": (~c("l_returnflag").isin("A", "N"), c("l_returnflag")),
        },
        unique={"shipped_twice": ["l_orderkey", "l_partkey"]},
        depends={"several_suppliers": (["l_partkey"], ["l_suppkey"])},
    )


@query(
    "unknown_values",
    "Q3",
    """SELECT 'unknown_value' AS "check", 'p_type=' || p_type AS key, CAST(count(*) AS VARCHAR) AS detail FROM part
WHERE p_type NOT IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO') GROUP BY p_type""",
)
def unknown_values(spark, sf_dir):
    return contracts.vocabulary(table(spark, sf_dir, "part"), "p_type", ["ECONOMY", "LARGE", "MEDIUM", "PROMO"])


@query(
    "unknown_set_members",
    "Q3",
    f"""WITH {COMBOS}, m AS (SELECT unnest(string_split(modality_set, '+')) AS m FROM combos)
SELECT 'unknown_value' AS "check", 'modality_set=' || m AS key, CAST(count(*) AS VARCHAR) AS detail FROM m
WHERE m NOT IN ('ihc', 'mri', 'ct', 'pet', 'genomics', 'clinical_data') GROUP BY m""",
)
def unknown_set_members(spark, sf_dir):
    combos = counts.combination_counts(corpus.run(spark, sf_dir).labels)
    return contracts.set_vocabulary(combos, "modality_set", ["ihc", "mri", "ct", "pet", "genomics", "clinical_data"])


@query(
    "repeated_keys",
    "Q4",
    """SELECT 'repeated_key' AS "check", l_orderkey || '/' || l_linenumber AS key, CAST(count(*) AS VARCHAR) AS detail
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def repeated_keys(spark, sf_dir):
    return contracts.unique_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "functional_dependency",
    "Q5",
    """SELECT 'not_functional' AS "check", p_name AS key, CAST(count(DISTINCT p_brand) AS VARCHAR) AS detail FROM part
GROUP BY p_name HAVING count(DISTINCT p_brand) > 1""",
)
def functional_dependency(spark, sf_dir):
    return contracts.functional_dependency(table(spark, sf_dir, "part"), "p_name", "p_brand")


@query(
    "nation_region_agrees",
    "Q5",
    """SELECT 'disagrees' AS "check", n_name || '/' || n_regionkey AS key, '1' AS detail FROM nation
WHERE NOT (n_name = 'NATION_0' AND n_regionkey = 0) AND NOT (n_name = 'NATION_1' AND n_regionkey = 1)""",
)
def nation_region_agrees(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").withColumn("region", F.col("n_regionkey").cast("string"))
    return contracts.agrees_with(nations, "n_name", "region", {"NATION_0": "0", "NATION_1": "1"})


@query(
    "absent_years",
    "Q6",
    """WITH c AS (SELECT o_custkey AS k, year(o_orderdate) AS y FROM orders GROUP BY ALL),
a AS (SELECT unnest(generate_series((SELECT min(y) FROM c), (SELECT max(y) FROM c))) AS y)
SELECT 'year_absent' AS "check", CAST(k AS VARCHAR) AS key, CAST(a.y AS VARCHAR) AS detail
FROM (SELECT DISTINCT k FROM c) g, a WHERE (k, a.y) NOT IN (SELECT (k, y) FROM c)""",
)
def absent_years(spark, sf_dir):
    return contracts.dense_axis(customer_years(spark, sf_dir), ["custkey"], "n")


@query("running_sums", "W7", _NONE)
def running_sums(spark, sf_dir):
    dense = grids.dense_counts(customer_years(spark, sf_dir), ["custkey"], "n")
    stored = grids.running_total(dense, "custkey", "year", "n", "total")
    return contracts.running_sum(stored, ["custkey"], "n", "total")


@query(
    "running_sums_wrong",
    "W7",
    """WITH c AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY ALL),
s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY k ORDER BY y) AS BIGINT) AS t FROM c)
SELECT 'not_running_sum' AS "check", k || '/' || y AS key, n || '<>' || t AS detail FROM s WHERE n <> t""",
)
def running_sums_wrong(spark, sf_dir):
    stored = customer_years(spark, sf_dir).withColumn("total", F.col("n"))
    return contracts.running_sum(stored, ["custkey"], "n", "total")


@query(
    "date_agreement",
    "Q7",
    """WITH d AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_totalprice < 3000 THEN 'not given'
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t, year(o_orderdate) + CASE WHEN o_totalprice > 490000 THEN 1 ELSE 0 END AS y,
    CASE WHEN o_totalprice BETWEEN 100000 AND 101000 THEN ' ' ELSE o_orderpriority END AS p FROM orders)
SELECT CASE WHEN trim(p) = '' THEN 'blank_field' WHEN t = 'not given' THEN 'bad_date' ELSE 'year_disagrees' END AS "check",
  CAST(o_orderkey AS VARCHAR) AS key, t AS detail FROM d
WHERE trim(p) = '' OR t = 'not given' OR year(CAST(t AS DATE)) <> y""",
)
def date_agreement(spark, sf_dir):
    price = F.col("o_totalprice")
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(price < 3000, "not given").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"),
        (F.year("o_orderdate") + (price > 490000).cast("int")).alias("y"),
        F.when(price.between(100000, 101000), " ").otherwise(F.col("o_orderpriority")).alias("p"),
    )
    return contracts.date_agrees(df, "o_orderkey", "d", "y", ["p"])


@query(
    "several_partial_years",
    "Q8",
    f"""WITH {SERIES} SELECT 'several_partial_years' AS "check", 'partial_year' AS key, CAST(count(DISTINCT year) AS VARCHAR) AS detail
FROM series WHERE year >= 2000 HAVING count(DISTINCT year) > 1""",
)
def several_partial_years(spark, sf_dir):
    series = counts.theme_year_counts(corpus.run(spark, sf_dir).labels)
    return contracts.one_partial_year(series.withColumn("partial_year", (F.col("year") >= 2000).cast("int")))


@query(
    "labels_not_binary",
    "Q9",
    """SELECT 'label_not_binary' AS "check", CAST(p_partkey AS VARCHAR) AS key, 'p_size' AS detail FROM part WHERE p_size NOT IN (0, 1)""",
)
def labels_not_binary(spark, sf_dir):
    return contracts.binary_labels(table(spark, sf_dir, "part"), ["p_size"], "p_partkey")


@query("reader_labels_valid", "Q9", _NONE)
def reader_labels_valid(spark, sf_dir):
    return contracts.binary_labels(table(spark, sf_dir, "labels"), ["quality", "toxic"], "doc_id")


@query(
    "rule_cover",
    "Q10",
    f"""WITH {COMBOS}, m AS (SELECT DISTINCT unnest(string_split(modality_set, '+')) AS m FROM combos)
SELECT 'theme_without_stratum' AS "check", theme AS key, '' AS detail FROM (SELECT DISTINCT theme FROM combos) t
WHERE theme NOT IN ({', '.join(f"'{s}'" for s in STRATA if s != 'digital_twins')})""",
)
def rule_cover(spark, sf_dir):
    """Themes and modalities seen in the corpus, against strata that leave one theme out."""
    combos = counts.combination_counts(corpus.run(spark, sf_dir).labels)
    strata = spark.createDataFrame([(s,) for s in STRATA if s != "digital_twins"], "theme string")
    members = combos.select(F.explode(F.split("modality_set", r"\+")).alias("modality"))
    return contracts.strata_cover(combos, strata, members)


@query(
    "code_rule",
    "Q11",
    f"""WITH {registry.BASE}, used AS (SELECT DISTINCT product_code AS code FROM devices)
SELECT 'counted_and_excluded' AS "check", code AS key, '' AS detail FROM used WHERE code IN (SELECT code FROM assigned)
UNION ALL SELECT 'override_unlisted', code, '' FROM used WHERE code NOT IN (SELECT code FROM assigned)
UNION ALL SELECT 'override_domain', u.code, 'pathology' FROM used u JOIN assigned a USING (code) WHERE a.domain <> 'pathology'""",
)
def code_rule(spark, sf_dir):
    """Every code in use listed as excluded and overridden to one domain: each clash is a row."""
    used = devices.derive_fields(registry.raw_devices(spark, sf_dir)).select(F.col("product_code").alias("code")).distinct()
    return contracts.code_rule(registry.assigned(spark), used, used.withColumn("domain", F.lit("pathology")))


@query(
    "decision_rule",
    "Q12",
    f"""WITH {registry.BASE}, d AS (SELECT lower(submission_number) AS s, CASE o_orderpriority WHEN '1-URGENT' THEN 'oncology'
    WHEN '2-HIGH' THEN 'not_oncology' ELSE 'undecided' END AS decision, CASE WHEN o_totalprice > 480000 THEN 'pathology' ELSE '' END AS category,
    o_orderpriority AS evidence FROM raw WHERE o_totalprice > 450000)
SELECT 'unknown_decision' AS "check", s AS key, '' AS detail FROM d WHERE decision = 'undecided'
UNION ALL SELECT 'category_required', s, '' FROM d WHERE decision = 'oncology' AND category NOT IN ({', '.join(f"'{c}'" for c in DEVICE_CATEGORIES)})
UNION ALL SELECT 'confidence_required', s, '' FROM d WHERE decision = 'oncology'
UNION ALL SELECT 'category_not_allowed', s, '' FROM d WHERE decision <> 'oncology' AND category <> ''
UNION ALL SELECT 'evidence_too_short', s, '' FROM d WHERE length(evidence) < 25
UNION ALL SELECT 'declared_count', 'all', '10<>' || count(*) FROM d HAVING count(*) <> 10""",
)
def decision_rule(spark, sf_dir):
    raw = registry.raw_devices(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("_key"), "o_totalprice", "o_orderpriority"
    )
    joined = raw.join(orders, F.regexp_extract("Submission Number", r"(\d+)$", 1) == F.col("_key"))
    rows = joined.where("o_totalprice > 450000").select(
        F.lower(F.trim("Submission Number")).alias("submission_number"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "oncology")
        .when(F.col("o_orderpriority") == "2-HIGH", "not_oncology")
        .otherwise("undecided")
        .alias("decision"),
        F.when(F.col("o_totalprice") > 480000, "pathology").otherwise("").alias("category"),
        F.lit("").alias("confidence"),
        F.col("o_orderpriority").alias("evidence"),
        F.lit("all").alias("source"),
    )
    declared = spark.createDataFrame([("all", 10)], "source string, declared bigint")
    return contracts.decision_rule(rows, declared)


@query(
    "domain_sums",
    "Q15",
    f"""WITH {SERIES}, s AS (SELECT theme, year, CAST(coalesce(sum(n_papers) FILTER (domain = 'all'), 0) AS BIGINT) AS total,
  CAST(coalesce(sum(n_papers) FILTER (domain NOT IN ('all', 'both')), 0) AS BIGINT) AS parts FROM series GROUP BY ALL)
SELECT 'domain_sum' AS "check", theme || '/' || year AS key, total || '<>' || parts AS detail FROM s WHERE total <> parts""",
)
def domain_sums(spark, sf_dir):
    """The partition identity on a table that has lost one domain."""
    series = counts.theme_year_counts(corpus.run(spark, sf_dir).labels)
    return contracts.domains_sum_to_all(series.where("domain <> 'both'"))


@query("count_identities", "Q15", _NONE)
def count_identities(spark, sf_dir):
    profile = written(counts.label_profile(corpus.run(spark, sf_dir).labels), "label-profile")
    totals = counts.label_totals(profile).where("kind = 'theme' AND key NOT LIKE '(%'")
    return contracts.all_problems(
        contracts.combos_sum_to_theme(
            counts.combination_counts(profile), totals, counts.minimum_shortfalls(profile)
        ),
        contracts.domains_sum_to_all(counts.theme_year_counts(profile)),
    )


@query(
    "count_identities_drift",
    "Q15",
    f"""WITH {COMBOS}, kept AS (SELECT theme, sum(n_papers) AS found FROM combos WHERE modality_set <> 'other' GROUP BY 1),
want AS (SELECT theme, sum(n_papers) AS expected FROM combos GROUP BY 1)
SELECT 'combination_total' AS "check", theme AS key, CAST(expected AS BIGINT) || '<>' || CAST(coalesce(found, 0) AS BIGINT) AS detail
FROM want LEFT JOIN kept USING (theme) WHERE expected <> coalesce(found, 0)""",
)
def count_identities_drift(spark, sf_dir):
    """The combination identity on a table that has lost the rows of one label set."""
    profile = written(counts.label_profile(corpus.run(spark, sf_dir).labels), "label-profile")
    totals = counts.label_totals(profile).where("kind = 'theme' AND key NOT LIKE '(%'")
    combos = counts.combination_counts(profile).where("modality_set <> 'other'")
    return contracts.combos_sum_to_theme(combos, totals, counts.minimum_shortfalls(profile))


@query(
    "key_sets",
    "U2",
    """SELECT 'key_set' AS "check", CAST(doc_id AS VARCHAR) AS key, 'missing' AS detail FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def key_sets(spark, sf_dir):
    return contracts.set_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


# Rule files stand beside versions of the data: a source is a file, a language its version.
@query(
    "version_ledger",
    "Q14",
    """WITH l AS (SELECT DISTINCT source AS file, lang AS version, md5(CAST(n_chars > 1000 AS VARCHAR)) AS sha FROM documents),
c AS (SELECT source AS file, max(lang) AS version, 'none' AS sha FROM documents GROUP BY 1)
SELECT 'version_reused' AS "check", file || ' v' || version AS key, CAST(count(*) AS VARCHAR) AS detail FROM l GROUP BY file, version HAVING count(*) > 1
UNION ALL SELECT 'ledger_mismatch', c.file || ' v' || c.version, 'changed' FROM c JOIN l USING (file, version)""",
)
def version_ledger(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ledger = docs.select(
        F.col("source").alias("file"), F.col("lang").alias("version"),
        F.md5((F.col("n_chars") > 1000).cast("string")).alias("sha256"),
    )
    current = docs.groupBy(F.col("source").alias("file")).agg(F.max("lang").alias("version")).withColumn(
        "sha256", F.lit("none")
    )
    return contracts.version_ledger(ledger, current)


@query(
    "rule_freshness",
    "J13",
    """WITH r AS (SELECT source AS file, min(lang) AS version, CAST(count(*) AS VARCHAR) AS sha FROM documents GROUP BY 1),
n AS (SELECT d.source AS file, min(lang) AS version, CAST(count(*) AS VARCHAR) AS sha FROM documents d
  JOIN labels l USING (doc_id) WHERE d.source <> 'src5' GROUP BY 1)
SELECT r.file, r.version, CASE WHEN n.sha IS NULL THEN 'missing' WHEN n.sha = r.sha THEN 'current'
  WHEN n.version = r.version THEN 'changed_same_version' ELSE 'changed_new_version' END AS state
FROM r LEFT JOIN n USING (file)""",
)
def rule_freshness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    state = lambda df: df.groupBy(F.col("source").alias("file")).agg(
        F.min("lang").alias("version"), F.count("*").cast("string").alias("sha256")
    )
    read = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").where("source <> 'src5'")
    return contracts.freshness(state(docs), state(read))


@query(
    "term_rules",
    "Q13 S9",
    """WITH r AS (SELECT p_type, p_name, min(p_partkey) AS idx, min(p_size) AS least FROM part GROUP BY ALL),
w AS (SELECT *, p_type || '.' || CASE WHEN p_type = 'PROMO' THEN 'exclude' ELSE 'include' END || '[' || idx || ']' AS key FROM r)
SELECT 'empty_pattern' AS "check", key, '' AS detail FROM w WHERE least = 1
UNION ALL SELECT 'unknown_kind', key, 'glob' FROM w WHERE least > 2
UNION ALL SELECT DISTINCT 'no_include', p_type, 'theme' FROM w WHERE p_type = 'PROMO'
UNION ALL SELECT 'category_missing', 'BULK', 'theme'
UNION ALL SELECT DISTINCT 'category_unknown', p_type, 'theme' FROM w WHERE p_type = 'ECONOMY'""",
)
def term_rules(spark, sf_dir):
    """Part names as phrase rules of their type, some of them blank or of an unknown kind."""
    least = F.col("least")
    rules = (
        table(spark, sf_dir, "part")
        .groupBy("p_type", "p_name")
        .agg(F.min("p_partkey").cast("int").alias("idx"), F.min("p_size").alias("least"))
        .select(
            F.lit("theme").alias("dictionary"),
            F.col("p_type").alias("category"),
            F.when(F.col("p_type") == "PROMO", "exclude").otherwise("include").alias("role"),
            "idx",
            F.when(least > 2, "glob").otherwise("phrase").alias("kind"),
            F.lit(None).cast("boolean").alias("case_sensitive"),
            F.when(least == 1, " ").otherwise(F.col("p_name")).alias("pattern"),
        )
    )
    return contracts.term_rules(rules, {"theme": ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "BULK")})


@query(
    "labels_by_fingerprinted_rules",
    "J13 S11 P28",
    f"""WITH {corpus.labels_sql()}, n AS (SELECT count(*) AS n_records FROM labels_)
SELECT 'before' AS edit, unnest(['theme', 'modality']) AS file, 3 AS version, 'current' AS state, n_records FROM n
UNION ALL SELECT 'after', 'theme', 3, 'current', n_records FROM n UNION ALL SELECT 'after', 'modality', 3, 'changed_same_version', n_records FROM n""",
)
def labels_by_fingerprinted_rules(spark, sf_dir):
    """A run records its rules; once one of them is edited, its labels no longer pass as current."""
    versions = {"theme": 3, "modality": 3}
    book = RuleBook.of(corpus.RULE_ROWS, versions)
    edited = RuleBook.of([(*r[:6], r[6] + "s") if r[1] == "pet" else r for r in corpus.RULE_ROWS], versions)
    out = scratch_path(spark, "lineage")
    tables.write_table(labelling.labels(labelling.annotate(corpus.records(spark, sf_dir), book, corpus.YEARS)), f"{out}/paper_labels", {})
    lineage.write_lineage(lineage.book_lineage(spark, book), out)
    n = lineage.read_current(spark, out, "paper_labels", book).agg(F.count("*").alias("n_records")).withColumn("_one", F.lit(1))
    states = [
        lineage.check_lineage(spark, out, lineage.book_lineage(spark, now)).select(F.lit(name).alias("edit"), "file", "version", "state", F.lit(1).alias("_one"))
        for name, now in (("before", book), ("after", edited))
    ]
    return states[0].unionByName(states[1]).join(F.broadcast(n), "_one").drop("_one")


# Parts as rules: the last digit of the key names the file, and so its version.
_RULE_TEXT = " || ".join(
    f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("CAST(NULL AS VARCHAR)", "category", "CAST(idx AS VARCHAR)", "kind", "pattern", "role")
)
_RULE_SUMS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query(
    "rule_lineage",
    "J13 S11",
    f"""WITH r AS (SELECT 'rules' || p_partkey % 10 AS file, CAST(p_partkey % 10 + 1 AS INTEGER) AS version, p_type AS category, p_partkey AS idx, 'phrase' AS kind, p_name AS pattern, 'include' AS role FROM part),
h AS (SELECT file, version, sha256({_RULE_TEXT}) AS h FROM r)
SELECT file, version, sha256(concat_ws(',', CAST(count(*) AS VARCHAR), {_RULE_SUMS})) AS sha256,
  CASE WHEN version IN (5, 6, 10) THEN 'changed_same_version' WHEN version IN (7, 8) THEN 'changed_new_version' WHEN version = 9 THEN 'missing' ELSE 'current' END AS state
FROM h GROUP BY file, version""",
)
def rule_lineage(spark, sf_dir):
    """Rule files after a run: two edited, two edited with a new version, one gone, one with a row twice, the others as they were."""
    key, c = F.col("p_partkey") % 10, F.col
    rules = table(spark, sf_dir, "part").select(
        F.concat(F.lit("rules"), key.cast("string")).alias("file"), (key + 1).cast("int").alias("version"),
        c("p_type").alias("category"), F.lit("include").alias("role"), c("p_partkey").alias("idx"), F.lit("phrase").alias("kind"),
        F.lit(None).cast("boolean").alias("case_sensitive"), c("p_name").alias("pattern"),
    )

    def state(df):
        versions = df.groupBy("file").agg(F.max("version").alias("version"))
        return versions.join(lineage.table_digest(df, ["file"], ["version"]), "file").select("file", "version", "sha256")

    edited = c("version").isin(5, 6, 7, 8) & (c("idx") < 20)
    now = rules.where("version <> 9").select(
        "file", F.when(c("version").isin(7, 8), c("version") + 100).otherwise(c("version")).alias("version"),
        "category", "role", "idx", "kind", "case_sensitive", F.when(edited, F.concat("pattern", F.lit("s"))).otherwise(c("pattern")).alias("pattern"),
    )
    recorded = state(rules)
    states = contracts.freshness(recorded, state(now.unionByName(now.where("version = 10 and idx < 20"))))
    return recorded.join(states.select("file", "state"), "file")
