"""The labelling corpus over the test tables.

A document plays a paper: its first line is the title, the rest the abstract.  The order
with the same number lends it a year, a record type and the field the year came from.
The rules use words that occur in the test text, under the canonical category names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.catalog.common import RE2_SPACE, RE2_WORD, sql_text, table
from tallymark.plans.label_corpus import CorpusRun, label_corpus
from tallymark.session import spread
from tallymark.sources.rules import Rule, RuleBook
from tallymark.vocab import (
    CATCH_ALL,
    MODALITIES,
    PATHOLOGY_SIDE,
    RADIOLOGY_SIDE,
    SECONDARY_TYPES,
    THEMES,
)

YEARS = (1996, 2001)
PARTIAL_YEAR = 2001

# (dictionary, category, role, idx, kind, case_sensitive, pattern)
RULE_ROWS = [
    ("theme", "foundation_models", "include", 0, "phrase", None, "of the"),
    ("theme", "foundation_models", "include", 1, "phrase", None, "und der"),
    ("theme", "multimodal_integration", "include", 0, "regex", None, r"(?i)\b(los|pour|nicht)\b"),
    ("theme", "multimodal_integration", "include", 1, "phrase", None, "hash"),
    ("theme", "multimodal_integration", "exclude", 0, "phrase", None, "de la"),
    ("theme", "digital_twins", "include", 0, "phrase", None, "thanedble the,"),
    ("theme", "clinical_fda", "include", 0, "regex", None, r"\b(MIT|Apache|BSD) Licen[sc]e\b"),
    ("theme", "clinical_fda", "include", 1, "phrase", None, "+1"),
    ("theme", "clinical_fda", "include", 2, "regex", False, r"\blicensed\b"),
    ("theme", "clinical_fda", "include", 3, "phrase", None, "510(k)"),
    ("theme", "virtual_staining", "include", 0, "phrase", None, "par"),
    ("theme", "virtual_staining", "exclude", 0, "phrase", True, "Le"),
    ("theme", "agentic_ai", "include", 0, "phrase", None, "sich"),
    ("theme", "agentic_ai", "include", 1, "regex", None, r"(?i)\bdas (der|die|und)\b"),
    ("modality", "he_histology", "include", 0, "phrase", None, "anat"),
    ("modality", "ihc", "include", 0, "phrase", None, "hath"),
    ("modality", "ihc", "include", 1, "phrase", None, "èle"),
    ("modality", "spatial_proteomics", "include", 0, "phrase", None, "éç"),
    ("modality", "spatial_transcriptomics", "include", 0, "phrase", None, "für"),
    ("modality", "pathology_report", "include", 0, "regex", None, r"token = \"[0-9a-f]{8}"),
    ("modality", "mri", "include", 0, "phrase", None, "reing"),
    ("modality", "mri", "include", 1, "phrase", None, "la la"),
    ("modality", "ct", "include", 0, "phrase", None, "edha"),
    ("modality", "ct", "exclude", 0, "phrase", None, "edha the"),
    ("modality", "pet", "include", 0, "phrase", None, "inan"),
    ("modality", "ultrasound", "include", 0, "phrase", None, "haing"),
    ("modality", "mammography", "include", 0, "phrase", True, "Ster"),
    ("modality", "xray", "include", 0, "regex", None, r"(?i)\b[a-z0-9.]+@[a-z0-9.]+"),
    ("modality", "radiology_report", "include", 0, "regex", None, r"\b[0-9]{3}-[0-9]{4}\b"),
    ("modality", "genomics", "include", 0, "phrase", None, "los"),
    ("modality", "clinical_data", "include", 0, "phrase", None, "und"),
    ("modality", "other", "include", 0, "phrase", None, "das"),
    ("modality", "other", "include", 1, "phrase", None, "ou"),
    ("modality", "non_specialty", "include", 0, "phrase", None, "que"),
]

#: The regex rules again for RE2, which has no lookaround: (ignore case, word edge before,
#: body, word edge after, body over text whose separators are doubled).
RE2_RULES = {
    "multimodal_integration:include[0]": (True, True, "los|pour|nicht", True, "los|pour|nicht"),
    "clinical_fda:include[0]": (False, True, "(?:MIT|Apache|BSD) Licen[sc]e", True, "(?:MIT|Apache|BSD)  Licen[sc]e"),
    "clinical_fda:include[2]": (True, True, "licensed", True, "licensed"),
    "agentic_ai:include[1]": (True, True, "das (?:der|die|und)", True, "das  (?:der|die|und)"),
    "pathology_report:include[0]": (False, False, 'token = "[0-9a-f]{8}', False, 'token  ==  ""[0-9a-f]{8}'),
    "xray:include[0]": (True, True, "[a-z0-9.]+@[a-z0-9.]+", False, "[a-z0-9.]+@@[a-z0-9.]+"),
    "radiology_report:include[0]": (False, True, "[0-9]{3}-[0-9]{4}", True, "[0-9]{3}--[0-9]{4}"),
}

SECONDARY_BY_SOURCE = {"src3": "Review", "src7": "Editorial; Comment", "src11": "Meta-Analysis; Review"}


def rule_book() -> RuleBook:
    return RuleBook.of(RULE_ROWS)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), "o_orderdate", "o_orderstatus", "o_orderpriority"
    )
    title = F.substring_index("text", "\n", 1)
    types = None
    for source, tags in SECONDARY_BY_SOURCE.items():
        test = F.col("source") == source
        value = F.lit(f"Journal Article; {tags}")
        types = F.when(test, value) if types is None else types.when(test, value)
    return docs.join(orders, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("pmid"),
        title.alias("title"),
        F.when(F.contains("text", F.lit("\n")), F.substring("text", F.length(title) + 2, 2**31 - 1))
        .otherwise("")
        .alias("abstract"),
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderstatus") == "F", "PubDate")
        .when(F.col("o_orderstatus") == "O", "ArticleDate")
        .otherwise("PubMedPubDate[pubmed]")
        .alias("year_source"),
        F.when(F.col("o_orderpriority") == "5-LOW", "PubmedBookArticle")
        .otherwise("PubmedArticle")
        .alias("record_type"),
        types.otherwise("Journal Article").alias("publication_types"),
        F.col("lang").alias("language"),
        F.col("source").alias("source_file"),
    )


RECORDS_SQL = f"""records AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS pmid,
    split_part(d.text, chr(10), 1) AS title,
    CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1) ELSE '' END AS abstract,
    CAST(year(o.o_orderdate) AS INTEGER) AS year,
    CASE o.o_orderstatus WHEN 'F' THEN 'PubDate' WHEN 'O' THEN 'ArticleDate'
      ELSE 'PubMedPubDate[pubmed]' END AS year_source,
    CASE WHEN o.o_orderpriority = '5-LOW' THEN 'PubmedBookArticle' ELSE 'PubmedArticle' END AS record_type,
    CASE d.source {' '.join(f"WHEN '{s}' THEN 'Journal Article; {t}'" for s, t in SECONDARY_BY_SOURCE.items())}
      ELSE 'Journal Article' END AS publication_types,
    d.lang AS language, d.source AS source_file
  FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id)"""


def run(spark: SparkSession, sf_dir: str, details: bool = False) -> CorpusRun:
    return label_corpus(records(spark, sf_dir), rule_book(), YEARS, details)


# --- the same labelling in SQL -----------------------------------------------------

def re2_parts(rule: Rule, doubled: bool = False) -> tuple[str, str, str, str]:
    """(flags, guard before, body, guard after) of a rule for RE2.

    ``doubled`` reads text in which every separator stands twice, so that two matches
    next to each other never need the same one.
    """
    before, after = f"(^|[^{RE2_WORD}])", f"($|[^{RE2_WORD}])"
    if rule.kind == "phrase":
        tokens = rule.pattern.split()
        body = f"[{RE2_SPACE}]+".join(_quoted(t, doubled) for t in tokens)
        word = lambda ch: ch == "_" or ch.isalnum()
        head, tail, fold = word(tokens[0][0]), word(tokens[-1][-1]), not rule.case_flag
    else:
        fold, head, body, tail, wide = RE2_RULES[rule.pattern_id]
        body = wide if doubled else body
    return ("(?is)" if fold else "(?s)", before if head else "()", f"({body})", after if tail else "()")


def _quoted(token: str, doubled: bool) -> str:
    twice = lambda ch: doubled and not (ch == "_" or ch.isalnum())
    return "".join(re.escape(ch) * (2 if twice(ch) else 1) for ch in token)


def re2(rule: Rule, doubled: bool = False) -> str:
    return "".join(re2_parts(rule, doubled))


def _fires_sql(rule: Rule) -> str:
    return f"regexp_matches(t, {sql_text(re2(rule))})"


def flags_sql() -> str:
    """CTEs ``records``, ``texts``, ``fired``, ``flags``: one row per record."""
    book = rule_book()
    fired = ",\n    ".join(f"{_fires_sql(r)} AS r{r.ordinal}" for r in book.rules)

    def stands(d: str, k: str) -> str:
        inc = " OR ".join(f"r{r.ordinal}" for r in book.of_category(d, k, "include")) or "FALSE"
        exc = " OR ".join(f"r{r.ordinal}" for r in book.of_category(d, k, "exclude")) or "FALSE"
        return f"(({inc}) AND NOT ({exc}))"

    named = [k for k in MODALITIES if k != CATCH_ALL]
    cols = [f"CAST({stands('theme', k)} AS INTEGER) AS theme_{k}" for k in THEMES]
    cols += [f"CAST({stands('modality', k)} AS INTEGER) AS mod_{k}" for k in named]
    any_named = " OR ".join(stands("modality", k) for k in named)
    by_pattern = stands("modality", CATCH_ALL)
    cols.append(f"CAST({by_pattern} OR NOT ({any_named}) AS INTEGER) AS mod_{CATCH_ALL}")
    side = lambda keys: "greatest(" + ", ".join(f"mod_{k}" for k in keys) + ") = 1"
    tags = ", ".join(f"'{t}'" for t in SECONDARY_TYPES)
    return f"""{RECORDS_SQL},
texts AS (
  SELECT *, title || ' ' || chr(10) || ' ' || abstract AS t,
    CASE WHEN record_type = 'PubmedBookArticle' THEN 'book_records'
      WHEN pmid IS NULL OR trim(pmid) = '' THEN 'missing_pmid'
      WHEN year IS NULL THEN 'missing_year'
      WHEN year < {YEARS[0]} OR year > {YEARS[1]} THEN 'outside_date_range' END AS early_reason,
    CASE WHEN len(list_intersect([trim(x) for x in string_split(publication_types, ';')],
      [{tags}])) > 0 THEN 0 ELSE 1 END AS is_primary_research
  FROM records),
fired AS (
  SELECT *,
    {fired}
  FROM texts),
flags0 AS (
  SELECT *, {', '.join(cols)},
    {stands('modality', 'non_specialty')} AS outside,
    NOT ({any_named}) AND NOT {by_pattern} AS fell_back
  FROM fired),
flags1 AS (
  SELECT *, CASE WHEN {side(RADIOLOGY_SIDE)} AND {side(PATHOLOGY_SIDE)} THEN 'both'
    WHEN {side(RADIOLOGY_SIDE)} THEN 'radiology' WHEN {side(PATHOLOGY_SIDE)} THEN 'pathology'
    ELSE 'none' END AS domain
  FROM flags0),
flags AS (
  SELECT *, coalesce(early_reason,
    CASE WHEN domain = 'none' AND outside THEN 'non_specialty_only' END) AS reason
  FROM flags1)"""


THEME_COLS = ", ".join(f"theme_{k}" for k in THEMES)
MOD_COLS = ", ".join(f"mod_{k}" for k in MODALITIES)


def labels_sql() -> str:
    """``flags_sql`` and a CTE ``labels`` of retained records."""
    return f"""{flags_sql()},
labels_ AS (
  SELECT pmid, year, year_source, {THEME_COLS}, {MOD_COLS}, domain, is_primary_research, title, abstract
  FROM flags WHERE reason IS NULL)"""


def hits_sql() -> str:
    """``labels_sql`` and a CTE ``hits`` in the provenance columns."""
    book = rule_book()
    selects = []
    for r in book.rules:
        flags, before, body, after = re2_parts(r)
        first = f"{flags}^(.*?){before}{body}{after}"
        prefix = "mod_" if r.dictionary == "modality" else "theme_"
        stood = "outside" if r.category == "non_specialty" else f"{prefix}{r.category} = 1"
        gate = f"r{r.ordinal}"
        if r.role == "exclude":
            includes = book.of_category(r.dictionary, r.category, "include")
            gate += " AND (" + " OR ".join(f"r{i.ordinal}" for i in includes) + ")"
        q = sql_text(first)
        selects.append(
            f"""SELECT pmid, '{r.dictionary}' AS dictionary, '{r.category}' AS category, '{r.role}' AS role,
  '{r.pattern_id}' AS pattern_id, '{r.kind}' AS kind, {int(r.case_sensitive)} AS case_sensitive,
  {sql_text(r.pattern)} AS pattern,
  CAST(len(regexp_extract_all(wide, {sql_text(re2(r, doubled=True))})) AS INTEGER) AS n_hits,
  CAST({stood} AS INTEGER) AS category_matched, t,
  length(regexp_extract(t, {q}, 1)) + length(regexp_extract(t, {q}, 2)) AS pos,
  length(regexp_extract(t, {q}, 3)) AS len
FROM spaced WHERE {gate}"""
        )
    space = f"'[{RE2_SPACE}]+'"
    return f"""{labels_sql()},
spaced AS (
  SELECT *, regexp_replace(t, '([^{RE2_WORD}])', '\\1\\1', 'g') AS wide FROM flags WHERE reason IS NULL),
raw_hits AS (
{' UNION ALL '.join(selects)}),
spans AS (
  SELECT *, greatest(pos - 40, 0) AS lo, least(pos + len + 40, length(t)) AS hi FROM raw_hits),
hits AS (
  SELECT pmid, dictionary, category, role, pattern_id, kind, case_sensitive, pattern, n_hits, category_matched,
    CASE WHEN lo > 0 THEN '...' ELSE '' END
      || trim(regexp_replace(substr(t, lo + 1, hi - lo), {space}, ' ', 'g'))
      || CASE WHEN hi < length(t) THEN '...' ELSE '' END AS excerpt
  FROM spans
  UNION ALL
  SELECT pmid, 'modality', 'other', 'fallback', 'other:fallback', '', 0, '', 0, 1, 'no named modality matched'
  FROM flags WHERE reason IS NULL AND fell_back)"""
