"""Derived columns over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.catalog import corpus
from tallymark.catalog.common import RE2_WORD, query, sql_norm, table
from tallymark.functions import dates, labels, text
from tallymark.vocab import MODALITIES, PATHWAY_PREFIXES, THEMES, canonical_order


@query(
    "match_text",
    "P1",
    f"WITH {corpus.RECORDS_SQL} SELECT pmid, md5(title || ' ' || chr(10) || ' ' || abstract) AS text_md5 FROM records",
)
def match_text(spark, sf_dir):
    return corpus.records(spark, sf_dir).select("pmid", F.md5(text.match_text()).alias("text_md5"))


@query("normalised_text", "P2", f"SELECT doc_id, {sql_norm('text')} AS clean FROM documents")
def normalised_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise_space("text").alias("clean"))


@query(
    "first_year_in_text",
    "P3",
    f"""WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'o' || o_orderkey, 'Ordered ' || strftime(o_orderdate, '%d.%m.%Y') || ', see 2150-' || o_custkey FROM orders)
SELECT id, TRY_CAST(nullif(regexp_extract(text, '(^|[^{RE2_WORD}])(1[5-9][0-9]{{2}}|20[0-9]{{2}}|21[0-9]{{2}})($|[^{RE2_WORD}])', 2), '') AS INTEGER) AS year FROM t""",
)
def first_year_in_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("id"),
        F.concat(
            F.lit("Ordered "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(", see 2150-"), "o_custkey"
        ).alias("text"),
    )
    return docs.unionByName(orders).select("id", text.first_year("text").alias("year"))


@query(
    "chosen_year",
    "P4 P5",
    """WITH s AS (SELECT l_orderkey, min(year(l_shipdate)) AS shipped FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey, shipped AS article, CASE WHEN o_orderpriority <> '1-URGENT' THEN year(o_orderdate) END AS issue,
    CASE WHEN o_orderstatus = 'F' THEN year(o_orderdate) + 1 END AS history, o_orderstatus = 'P' AS free
  FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
SELECT o_orderkey, CAST(CASE WHEN article < issue THEN article ELSE coalesce(issue, article, history) END AS INTEGER) AS year,
  CASE WHEN article < issue THEN 'ArticleDate' WHEN issue IS NOT NULL THEN CASE WHEN free THEN 'PubDate[MedlineDate]' ELSE 'PubDate' END
    WHEN article IS NOT NULL THEN 'ArticleDate' WHEN history IS NOT NULL THEN 'PubMedPubDate[pubmed]' ELSE 'none' END AS year_source
FROM d""",
)
def chosen_year(spark, sf_dir):
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min(F.year("l_shipdate")).alias("article")
    )
    placed = F.year("o_orderdate")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") != "1-URGENT", placed).alias("issue"),
        F.when(F.col("o_orderstatus") == "F", placed + 1).alias("history"),
        (F.col("o_orderstatus") == "P").alias("free"),
    )
    chosen = dates.choose_year("article", "issue", "history", "free")
    return orders.join(shipped, "o_orderkey", "left").select("o_orderkey", chosen.alias("y")).select("o_orderkey", "y.*")


_LINES = f"[{sql_norm('x')} for x in string_split(text, chr(10))]"


@query(
    "assembled_sections",
    "P6",
    f"""WITH l AS (SELECT doc_id, [x for x in {_LINES} if x <> ''] AS lines FROM documents),
p AS (SELECT doc_id, lines, [CASE WHEN starts_with(x, 'Released') OR starts_with(x, 'Licensed') THEN 'LICENSE: ' || x ELSE x END
  for x in lines] AS parts FROM l)
SELECT doc_id, coalesce(array_to_string(parts, chr(10) || chr(10)), '') AS text,
  len([x for x in parts if starts_with(x, 'LICENSE: ')]) > 0 AS structured, CAST(len(parts) AS INTEGER) AS sections FROM p""",
)
def assembled_sections(spark, sf_dir):
    parts = F.transform(
        F.split("text", "\n"),
        lambda x: F.struct(
            F.when(
                F.startswith(text.normalise_space(x), F.lit("Released"))
                | F.startswith(text.normalise_space(x), F.lit("Licensed")),
                " LICENSE ",
            ).alias("label"),
            text.normalise_space(x).alias("text"),
        ),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", parts.alias("s"))
    return docs.select("doc_id", text.sections_text("s").alias("t")).select("doc_id", "t.*")


@query(
    "first_non_empty",
    "P7",
    f"""SELECT doc_id, coalesce(nullif({sql_norm("split_part(text, chr(10), 3)")}, ''), nullif({sql_norm("split_part(text, chr(10), 2)")}, ''),
nullif({sql_norm("split_part(text, chr(10), 1)")}, ''), '') AS line FROM documents""",
)
def first_non_empty(spark, sf_dir):
    lines = [F.split_part("text", F.lit("\n"), F.lit(i)) for i in (3, 2, 1)]
    return table(spark, sf_dir, "documents").select("doc_id", text.first_non_empty(*lines).alias("line"))


@query(
    "tag_lists",
    "P8 P10",
    f"""WITH {corpus.RECORDS_SQL}, t AS (SELECT pmid, list_distinct([trim(x) for x in string_split(publication_types, ';') if trim(x) <> '']) AS tags FROM records)
SELECT pmid, array_to_string(list_sort(tags), '|') AS tags, CAST(len(tags) AS INTEGER) AS n_tags,
  array_to_string(list_sort([x for x in tags if x LIKE '%e%']), '|') AS some FROM t""",
)
def tag_lists(spark, sf_dir):
    tags = text.tag_list("publication_types")
    records = corpus.records(spark, sf_dir).select("pmid", F.array_sort(tags).alias("t"))
    return records.select(
        "pmid",
        F.array_join("t", "|").alias("tags"),
        F.size("t").alias("n_tags"),
        F.array_join(F.filter("t", lambda x: F.contains(x, F.lit("e"))), "|").alias("some"),
    )


@query(
    "prefix_classes",
    "P19",
    """SELECT p_partkey, CASE WHEN p_type LIKE 'ST%' THEN 'standard' WHEN p_type LIKE 'S%' THEN 's-other' WHEN p_type LIKE 'ECO%' THEN 'economy'
WHEN p_type LIKE 'P%' THEN 'promo' ELSE '' END AS class FROM part""",
)
def prefix_classes(spark, sf_dir):
    rule = {"S": "s-other", "ST": "standard", "ECO": "economy", "P": "promo"}
    return table(spark, sf_dir, "part").select(
        "p_partkey", labels.prefix_class(F.concat(F.lit(" "), F.lower("p_type")), rule).alias("class")
    )


@query(
    "label_strings",
    "P12 P13 P14 P15 P28",
    f"""WITH {corpus.labels_sql()} SELECT pmid, domain,
coalesce(nullif(concat_ws('+', {', '.join(f"CASE WHEN theme_{k} = 1 THEN '{k}' END" for k in THEMES)}), ''), '(none)') AS themes,
concat_ws('+', {', '.join(f"CASE WHEN mod_{k} = 1 THEN '{k}' END" for k in sorted(MODALITIES))}) AS modality_set,
CAST({' + '.join(f"mod_{k}" for k in MODALITIES)} AS INTEGER) AS n_modalities FROM labels_""",
)
def label_strings(spark, sf_dir):
    table_ = corpus.run(spark, sf_dir).labels
    mods = canonical_order([c[4:] for c in table_.columns if c.startswith("mod_")], MODALITIES)
    return table_.select(
        "pmid",
        labels.domain_of(mods).alias("domain"),
        labels.label_string(THEMES, "theme_").alias("themes"),
        labels.label_set(mods).alias("modality_set"),
        labels.set_size(mods).alias("n_modalities"),
    )


@query(
    "parsed_dates",
    "P18",
    """WITH t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '31/12/' || year(ts) ELSE strftime(ts, '%m/%d/%Y') END AS s,
  CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS d FROM events)
SELECT event_id, coalesce(strftime(d, '%Y-%m-%d'), '') AS iso, CAST(year(d) AS INTEGER) AS year FROM t""",
)
def parsed_dates(spark, sf_dir):
    written = F.when(F.col("event_type") == "error", F.concat(F.lit("31/12/"), F.year("ts").cast("string"))).otherwise(
        F.date_format("ts", "MM/dd/yyyy")
    )
    parsed = dates.decision_date(written)
    return table(spark, sf_dir, "events").select(
        "event_id", dates.iso_or_blank(parsed).alias("iso"), F.year(parsed).alias("year")
    )


@query(
    "submission_pathways",
    "P19 P21",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '510(k)' WHEN 'O' THEN 'PMA' ELSE 'De Novo' END AS pathway FROM orders""",
)
def submission_pathways(spark, sf_dir):
    number = F.concat(
        F.when(F.col("o_orderstatus") == "F", " k").when(F.col("o_orderstatus") == "O", "P").otherwise("den"),
        F.col("o_orderkey").cast("string"),
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", labels.prefix_class(number, PATHWAY_PREFIXES).alias("pathway")
    )
