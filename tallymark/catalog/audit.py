"""Sampling and scoring queries.

The second labeler is the ``labels`` table: its quality verdict is read against one theme
of the rules, its toxicity verdict against one modality.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.catalog import corpus
from tallymark.catalog.common import query, table
from tallymark.operators import labelling, sampling, scoring
from tallymark.plans.measure_rules import measure
from tallymark.session import written
from tallymark.vocab import MODALITIES, RARE_MODALITIES, SAMPLE_SIZES, STRATA, TARGETED_STRATA, THEMES

SEED = 20260903
TARGET_SEED = 20260904
KEYS = ("quality", "toxic")
FLAGS = {"theme_quality": "theme_foundation_models", "mod_toxic": "mod_he_histology"}
TARGET_SIZES = {"digital_twins": 20, "genomics_with_histology": 10, "genomics_alone": 15, "clinical_data": 30}

_RARE = " + ".join(f"mod_{m}" for m in RARE_MODALITIES)
_CLAIM = "CASE " + " ".join(
    f"WHEN {f'{_RARE} > 0' if s == 'rare_modality' else f'theme_{s} = 1'} THEN '{s}'" for s in STRATA if s != "no_theme"
) + " ELSE 'no_theme' END"
STRATA_SQL = f"""{corpus.labels_sql()},
strata AS (SELECT *, {_CLAIM} AS stratum FROM labels_),
sizes(stratum, wanted) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in SAMPLE_SIZES.items())}),
pop AS (SELECT stratum, count(*) AS n_population FROM strata GROUP BY 1),
drawn AS (SELECT s.*, p.n_population, least(z.wanted, p.n_population) AS n_sampled,
    CAST(p.n_population AS DOUBLE) / least(z.wanted, p.n_population) AS weight
  FROM strata s JOIN sizes z USING (stratum) JOIN pop p USING (stratum)
  QUALIFY row_number() OVER (PARTITION BY s.stratum ORDER BY md5('{SEED}|' || s.stratum || '|' || pmid), pmid) <= z.wanted)"""
_LABEL_COLS = f"pmid, year, year_source, {corpus.THEME_COLS}, {corpus.MOD_COLS}, domain, is_primary_research"


def labels(spark, sf_dir):
    """The label table, written once: a draw counts its strata and then picks from them."""
    return written(corpus.run(spark, sf_dir).labels, "labels")


@query(
    "stratified_sample",
    "Z1 U3 W3",
    f"WITH {STRATA_SQL} SELECT {_LABEL_COLS}, stratum, n_population, CAST(n_sampled AS BIGINT) AS n_sampled, weight FROM drawn",
)
def stratified_sample(spark, sf_dir):
    return sampling.draw_sample(labels(spark, sf_dir), SEED)


@query("strata_populations", "U3", f"WITH {STRATA_SQL} SELECT * FROM pop")
def strata_populations(spark, sf_dir):
    return sampling.assign_strata(labels(spark, sf_dir)).groupBy("stratum").agg(F.count("*").alias("n_population"))


_TARGET = "CASE " + " ".join(f"WHEN {TARGETED_STRATA[s]} THEN '{s}'" for s in TARGET_SIZES) + " END"


@query(
    "targeted_sample",
    "Z2 U4 F6 F7",
    f"""WITH {corpus.labels_sql()},
fresh AS (SELECT * FROM labels_ WHERE pmid NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)),
claimed AS (SELECT *, {_TARGET} AS stratum FROM fresh),
sizes(stratum, wanted, category) AS (VALUES {', '.join(
    f"('{k}', {v}, '{'genomics' if k.startswith('genomics') else k}')" for k, v in TARGET_SIZES.items())}),
pop AS (SELECT stratum, count(*) AS n_population FROM claimed WHERE stratum IS NOT NULL GROUP BY 1)
SELECT {_LABEL_COLS}, stratum, n_population, CAST(least(wanted, n_population) AS BIGINT) AS n_sampled,
  CAST(n_population AS DOUBLE) / least(wanted, n_population) AS weight, category
FROM claimed JOIN sizes USING (stratum) JOIN pop USING (stratum)
QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('{TARGET_SEED}|' || stratum || '|' || pmid), pmid) <= wanted""",
)
def targeted_sample(spark, sf_dir):
    read = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("pmid"))
    return sampling.draw_targeted(labels(spark, sf_dir), TARGET_SIZES, TARGET_SEED, read)


@query(
    "blind_sheet",
    "Z3 J6 W9",
    f"""WITH {STRATA_SQL} SELECT CAST(row_number() OVER (ORDER BY md5('{SEED}|sheet|' || pmid), pmid) AS INTEGER) AS item,
pmid, title, abstract, CAST(length(abstract) > 0 AS INTEGER) AS has_abstract FROM drawn""",
)
def blind_sheet(spark, sf_dir):
    sample = sampling.draw_sample(labels(spark, sf_dir), SEED)
    return sampling.blind_sheet(sample, corpus.records(spark, sf_dir), SEED)


@query("sample_without_text", "J6", "SELECT '' AS pmid WHERE FALSE")
def sample_without_text(spark, sf_dir):
    sample = sampling.draw_sample(labels(spark, sf_dir), SEED)
    return sampling.missing_text(sample, corpus.records(spark, sf_dir))


@query(
    "sample_lost_text",
    "J6",
    f"""WITH {STRATA_SQL} SELECT pmid FROM drawn JOIN documents ON CAST(doc_id AS VARCHAR) = pmid WHERE source IN ('src1', 'src2', 'src4') OR n_chars % 7 = 0""",
)
def sample_lost_text(spark, sf_dir):
    """The same check against records of which some are gone and others have lost their titles."""
    sample = sampling.draw_sample(labels(spark, sf_dir), SEED)
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pmid"), "n_chars")
    records = corpus.records(spark, sf_dir).where(~F.col("source_file").isin("src1", "src2", "src4")).join(sizes, "pmid")
    return sampling.missing_text(sample, records.withColumn("title", F.when(F.col("n_chars") % 7 != 0, F.col("title"))))


@query(
    "refreshed_sample",
    "J7",
    f"WITH {STRATA_SQL} SELECT {_LABEL_COLS}, stratum, n_population, CAST(n_sampled AS BIGINT) AS n_sampled, weight FROM drawn",
)
def refreshed_sample(spark, sf_dir):
    """A draw whose labels were wiped, refreshed from today's rules, equals the draw."""
    today = labels(spark, sf_dir)
    draw = sampling.draw_sample(today, SEED)
    wiped = draw.withColumns({f"theme_{k}": F.lit(0) for k in THEMES} | {f"mod_{k}": F.lit(0) for k in MODALITIES})
    return sampling.refresh_labels(wiped, today)


# --- the whole labelled part of the corpus as one big sample ------------------------
DESIGN_SQL = f"""{corpus.labels_sql()},
strata AS (SELECT *, {_CLAIM} AS stratum FROM labels_),
pop AS (SELECT stratum, count(*) AS n_population FROM strata GROUP BY 1),
read AS (SELECT s.pmid, s.stratum, s.theme_foundation_models AS r_quality, s.mod_he_histology AS r_toxic,
    l.quality AS a_quality, l.toxic AS a_toxic FROM strata s JOIN labels l ON CAST(l.doc_id AS VARCHAR) = s.pmid),
design AS (SELECT r.*, p.n_population, count(*) OVER (PARTITION BY r.stratum) AS n_sampled,
    CAST(p.n_population AS DOUBLE) / count(*) OVER (PARTITION BY r.stratum) AS weight FROM read r JOIN pop p USING (stratum)),
pairs AS (SELECT pmid, stratum, weight, 'quality' AS category, r_quality AS rule, a_quality AS agent FROM design
  UNION ALL SELECT pmid, stratum, weight, 'toxic', r_toxic, a_toxic FROM design)"""


def agent(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("pmid"),
        F.col("quality").alias("theme_quality"),
        F.col("toxic").alias("mod_toxic"),
    )


def design(spark, sf_dir):
    return written(_design(spark, sf_dir), "design")


def _design(spark, sf_dir):
    strata = sampling.assign_strata(labels(spark, sf_dir))
    slim = strata.select("pmid", "stratum", *[F.col(c).alias(n) for n, c in FLAGS.items()])
    pop = slim.groupBy("stratum").agg(F.count("*").alias("n_population"))
    read = slim.join(agent(spark, sf_dir).select("pmid"), "pmid", "left_semi")
    n = read.groupBy("stratum").agg(F.count("*").alias("n_sampled"))
    counts = pop.join(n, "stratum")  # one row per stratum
    return read.join(F.broadcast(counts), "stratum").withColumn(
        "weight", F.col("n_population") / F.col("n_sampled")
    )


def joined(spark, sf_dir):
    return scoring.join_labels(design(spark, sf_dir), agent(spark, sf_dir))


@query(
    "joined_labels",
    "J5 P29",
    f"""WITH {DESIGN_SQL} SELECT pmid, stratum, n_population, n_sampled, weight, r_quality AS rule_quality, r_toxic AS rule_toxic,
a_quality AS agent_quality, a_toxic AS agent_toxic FROM design""",
)
def joined_labels(spark, sf_dir):
    return joined(spark, sf_dir)


@query(
    "id_mismatch",
    "J5 U2",
    f"""WITH {corpus.labels_sql()}, a AS (SELECT CAST(doc_id AS VARCHAR) AS pmid FROM labels)
SELECT pmid, 'sample' AS only_in FROM labels_ WHERE pmid NOT IN (SELECT pmid FROM a)
UNION ALL SELECT pmid, 'agent' FROM a WHERE pmid NOT IN (SELECT pmid FROM labels_)""",
)
def id_mismatch(spark, sf_dir):
    return scoring.id_mismatch(labels(spark, sf_dir), agent(spark, sf_dir))


def _wilson(k: str, n: str, sign: str) -> str:
    p, z, z2 = f"(CAST({k} AS DOUBLE) / {n})", "1.96", "(1.96 * 1.96)"
    bound = (
        f"(({p} + {z2} / (2 * {n})) {sign} {z} * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0 * {n} * {n}))) / (1 + {z2} / {n})"
    )
    clamp = f"greatest(0.0, {bound})" if sign == "-" else f"least(1.0, {bound})"
    return f"CASE WHEN {n} > 0 THEN CAST({clamp} AS DOUBLE) END"


def _f1(tp: str, fp: str, fn: str) -> str:
    p, r = f"({tp} / ({tp} + {fp}))", f"({tp} / ({tp} + {fn}))"
    return f"CASE WHEN {tp} > 0 THEN 2 * {p} * {r} / ({p} + {r}) WHEN {tp} + {fp} + {fn} = 0 THEN NULL ELSE 0.0 END"


AGREEMENT = f"""WITH {DESIGN_SQL},
c AS (SELECT category, count(*) FILTER (rule = 1 AND agent = 1) AS tp, count(*) FILTER (rule = 1 AND agent = 0) AS fp,
    count(*) FILTER (rule = 0 AND agent = 1) AS fn, count(*) FILTER (rule = 0 AND agent = 0) AS tn,
    coalesce(sum(weight) FILTER (rule = 1 AND agent = 1), 0) AS wtp, coalesce(sum(weight) FILTER (rule = 1 AND agent = 0), 0) AS wfp,
    coalesce(sum(weight) FILTER (rule = 0 AND agent = 1), 0) AS wfn FROM pairs GROUP BY 1),
d AS (SELECT *, tp + fp AS n_system, tp + fn AS n_reference, CAST(tp AS DOUBLE) AS tpd, CAST(fp AS DOUBLE) AS fpd, CAST(fn AS DOUBLE) AS fnd FROM c)
SELECT category, tp, fp, fn, tn, n_system, n_reference,
  tpd / nullif(n_system, 0) AS precision, {_wilson('tp', 'n_system', '-')} AS precision_lo, {_wilson('tp', 'n_system', '+')} AS precision_hi,
  tpd / nullif(n_reference, 0) AS recall, {_wilson('tp', 'n_reference', '-')} AS recall_lo, {_wilson('tp', 'n_reference', '+')} AS recall_hi,
  CAST({_f1('tpd', 'fpd', 'fnd')} AS DOUBLE) AS f1,
  round(wtp / nullif(wtp + wfp, 0), 9) AS est_precision, round(wtp / nullif(wtp + wfn, 0), 9) AS est_recall,
  round(CAST({_f1('wtp', 'wfp', 'wfn')} AS DOUBLE), 9) AS est_f1,
  round(wtp + wfp, 6) AS est_papers_system, round(wtp + wfn, 6) AS est_papers_reference FROM d"""
_ROUNDED = {
    "precision": 9, "precision_lo": 9, "precision_hi": 9, "recall": 9, "recall_lo": 9, "recall_hi": 9, "f1": 9,
    "est_precision": 9, "est_recall": 9, "est_f1": 9, "est_papers_system": 6, "est_papers_reference": 6,
}


@query(
    "agreement_table",
    "A12 A13 P24 P25",
    "SELECT * REPLACE (" + ", ".join(f"round({c}, {n}) AS {c}" for c, n in _ROUNDED.items()) + f") FROM ({AGREEMENT})",
)
def agreement_table(spark, sf_dir):
    """Sums of weights depend on the order of addition, so rates are rounded."""
    sample = design(spark, sf_dir)
    sheet = agent(spark, sf_dir).join(sample.select("pmid"), "pmid", "left_semi")
    scores = measure(sample, sheet).agreement
    return scores.withColumns({c: F.round(c, n) for c, n in _ROUNDED.items()})


@query(
    "thin_evidence",
    "P31",
    f"SELECT category, CASE WHEN least(n_system, n_reference) < 10 THEN '!' ELSE '' END AS mark FROM ({AGREEMENT})",
)
def thin_evidence(spark, sf_dir):
    from tallymark.functions.rates import thin_mark

    table_ = scoring.agreement_table(joined(spark, sf_dir), KEYS)
    return table_.select("category", thin_mark("n_system", "n_reference").alias("mark"))


SPLITS = f"""{DESIGN_SQL},
splits AS (SELECT pmid, stratum, category, rule, agent,
    CASE WHEN rule = 1 THEN 'false_positive' ELSE 'false_negative' END AS kind, 0 AS agent_uncertain
  FROM pairs WHERE rule <> agent)"""


@query("disagreements", "Z5", f"WITH {SPLITS} SELECT * FROM splits")
def disagreements(spark, sf_dir):
    return scoring.disagreements(joined(spark, sf_dir), KEYS)


@query(
    "disagreement_strings",
    "P15 P16 P17",
    f"""WITH {DESIGN_SQL} SELECT pmid,
CAST(r_quality <> a_quality AS INTEGER) + CAST(r_toxic <> a_toxic AS INTEGER) AS n_disagreements,
coalesce(nullif(concat_ws('; ', CASE WHEN r_quality > a_quality THEN 'quality:rule-only' WHEN r_quality < a_quality THEN 'quality:agent-only' END,
  CASE WHEN r_toxic > a_toxic THEN 'toxic:rule-only' WHEN r_toxic < a_toxic THEN 'toxic:agent-only' END), ''), '(none)') AS disagreed_on,
coalesce(nullif(concat_ws('+', CASE WHEN r_quality = 1 THEN 'quality' END, CASE WHEN r_toxic = 1 THEN 'toxic' END), ''), '(none)') AS rule_labels
FROM design""",
)
def disagreement_strings(spark, sf_dir):
    from tallymark.functions.labels import disagreement_count, disagreement_string, label_string

    return joined(spark, sf_dir).select(
        "pmid",
        disagreement_count(KEYS).alias("n_disagreements"),
        disagreement_string(KEYS).alias("disagreed_on"),
        label_string(KEYS, "rule_").alias("rule_labels"),
    )


@query(
    "exact_match_rate",
    "A14",
    f"""WITH {DESIGN_SQL} SELECT stratum, count(*) FILTER (r_quality = a_quality AND r_toxic = a_toxic) AS n_match, count(*) AS n,
CAST(count(*) FILTER (r_quality = a_quality AND r_toxic = a_toxic) AS DOUBLE) / count(*) AS rate FROM design GROUP BY 1""",
)
def exact_match_rate(spark, sf_dir):
    return scoring.exact_match_rate(joined(spark, sf_dir), KEYS)


# Causes are read off the source of the record, as a reader's coding would be read off a sheet.
_CAUSE = """CASE WHEN d.source < 'src13' THEN 'mention_not_use' WHEN d.source < 'src16' THEN 'term_defect'
  WHEN d.source < 'src4' THEN 'rule_gap' ELSE 'definition_boundary' END"""


def causes(spark, sf_dir, splits):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pmid"), "source")
    cause = (
        F.when(F.col("source") < "src13", "mention_not_use")
        .when(F.col("source") < "src16", "term_defect")
        .when(F.col("source") < "src4", "rule_gap")
        .otherwise("definition_boundary")
    )
    return splits.select("pmid", "category").join(docs, "pmid").select("pmid", "category", cause.alias("cause"))


@query(
    "cause_summary",
    "A15 J8",
    f"""WITH {SPLITS}, c AS (SELECT s.*, {_CAUSE} AS cause FROM splits s JOIN documents d ON CAST(d.doc_id AS VARCHAR) = s.pmid),
t AS (SELECT cause, count(*) FILTER (kind = 'false_negative') AS false_negative,
  count(*) FILTER (kind = 'false_positive') AS false_positive, count(*) AS total FROM c GROUP BY 1)
SELECT *, CAST(total AS DOUBLE) / sum(total) OVER () AS share FROM t""",
)
def cause_summary(spark, sf_dir):
    splits = scoring.disagreements(joined(spark, sf_dir), KEYS)
    return scoring.cause_summary(causes(spark, sf_dir, splits), splits)


@query(
    "cause_problems",
    "J8 U2",
    f"""WITH {SPLITS} SELECT 'uncoded' AS "check", pmid || '/' || category AS key FROM splits WHERE category = 'toxic'""",
)
def cause_problems(spark, sf_dir):
    """A coding sheet that leaves out one category: every gap is named."""
    splits = scoring.disagreements(joined(spark, sf_dir), KEYS)
    return scoring.cause_problems(causes(spark, sf_dir, splits.where("category <> 'toxic'")), splits)


ROUTES = f"""{corpus.flags_sql()},
routes AS (SELECT pmid, CASE WHEN mod_other = 0 THEN 'none' WHEN fell_back THEN 'fallback' ELSE 'pattern' END AS other_route,
  {', '.join(f"mod_{k}" for k in MODALITIES)} FROM flags WHERE reason IS NULL)"""


@query("record_routes", "A17 J14", f"WITH {ROUTES} SELECT pmid, other_route FROM routes")
def record_routes(spark, sf_dir):
    run = corpus.run(spark, sf_dir)
    return labelling.record_routes(run.annotated)


_NAMED = " + ".join(f"mod_{k}" for k in MODALITIES if k != "other")


@query(
    "route_scores",
    "A16",
    f"""WITH {ROUTES}, j AS (SELECT r.*, l.toxic, {_NAMED} AS named FROM routes r JOIN labels l ON CAST(l.doc_id AS VARCHAR) = r.pmid),
s AS (SELECT 'pattern' AS route, 'uses a data type outside the named rows' AS claim, count(*) FILTER (other_route IN ('pattern', 'both')) AS n,
    count(*) FILTER (other_route IN ('pattern', 'both') AND toxic = 1) AS correct FROM j
  UNION ALL SELECT 'fallback', 'no named modality could be identified', count(*) FILTER (other_route = 'fallback'),
    count(*) FILTER (other_route = 'fallback' AND named = 0) FROM j)
SELECT *, CAST(correct AS DOUBLE) / nullif(n, 0) AS precision, round({_wilson('correct', 'n', '-')}, 9) AS lo,
  round({_wilson('correct', 'n', '+')}, 9) AS hi FROM s""",
)
def route_scores(spark, sf_dir):
    """Toxicity plays the "other data type" verdict; the named labels play the reader's."""
    run = corpus.run(spark, sf_dir)
    mods = [F.col(f"mod_{k}").alias(f"agent_{k}") for k in MODALITIES]
    verdict = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("pmid"), F.col("toxic").alias("agent_other_datatype")
    )
    read = run.labels.select("pmid", *mods).join(verdict, "pmid")
    routed = read.join(labelling.record_routes(run.annotated), "pmid", "left")
    return scoring.score_routes(routed).withColumns({"lo": F.round("lo", 9), "hi": F.round("hi", 9)})


_N = "CAST(r_quality <> a_quality AS INTEGER) + CAST(r_toxic <> a_toxic AS INTEGER)"


@query(
    "audit_sheet",
    "Z4",
    f"""WITH {DESIGN_SQL},
one AS (SELECT * FROM design QUALIFY row_number() OVER (ORDER BY md5('{SEED}|random|' || pmid), pmid) <= 25),
two AS (SELECT * FROM design WHERE {_N} > 0 AND pmid NOT IN (SELECT pmid FROM one)
  QUALIFY row_number() OVER (ORDER BY md5('{SEED}|disagreement|' || pmid), pmid) <= 25),
chosen AS (SELECT *, 'random' AS audit_stratum FROM one UNION ALL SELECT *, 'disagreement' FROM two)
SELECT audit_stratum, c.pmid, c.stratum, {_N} AS n_disagreements, l.title, l.abstract,
  CASE WHEN a_quality = 1 THEN 'quality' ELSE '(none)' END AS agent_themes,
  CASE WHEN r_quality = 1 THEN 'quality' ELSE '(none)' END AS rule_themes,
  CASE WHEN a_toxic = 1 THEN 'toxic' ELSE '(none)' END AS agent_modalities,
  CASE WHEN r_toxic = 1 THEN 'toxic' ELSE '(none)' END AS rule_modalities
FROM chosen c JOIN labels_ l ON l.pmid = c.pmid""",
)
def audit_sheet(spark, sf_dir):
    sheet = sampling.audit_sheet(
        joined(spark, sf_dir), corpus.records(spark, sf_dir), SEED, themes=["quality"], modalities=["toxic"]
    )
    return sheet.drop("disagreed_on", "author_themes", "author_modalities", "author_verdict", "author_note")


@query(
    "interval_by_nation",
    "P24",
    f"""WITH c AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal > 5000) AS k FROM customer GROUP BY 1)
SELECT c_nationkey, n, k, round({_wilson('k', 'n', '-')}, 9) AS lo, round({_wilson('k', 'n', '+')}, 9) AS hi FROM c""",
)
def interval_by_nation(spark, sf_dir):
    from tallymark.functions.rates import wilson

    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 5000).alias("k")
    )
    lo, hi = wilson("k", "n")
    return n.select("c_nationkey", "n", "k", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))
