"""Scans, sinks and incremental runs.

Formats the test tables do not come in are written from them by Spark, into a fresh path
below the shared folder, and read back.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymark.catalog import corpus
from tallymark.catalog.common import query, sql_norm, sql_text, table
from tallymark.operators import counts, dedup, labelling
from tallymark.session import scratch_path, spread, written
from tallymark.sources import lookup, markup, snapshots, tables
from tallymark.streaming import incremental, resume

# --- literature XML -----------------------------------------------------------------


def _escaped(c):
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


#: Records in one file of the capture, as in one response.
PER_FILE = 100
#: What is wrong with files of a broken capture, by the remainder of their number.
CUT, ENDLESS, ERROR, MALFORMED, FOREIGN, TRAILING, FAULTS = 1, 2, 3, 4, 5, 6, 9
FILE_OF = r"file=([^/]+)/"


def write_record_xml(spark, sf_dir, broken: bool = False) -> str:
    """Documents as literature records, in files as they come from a server; the French ones are captured twice.

    In a ``broken`` capture files are cut within a record or before their end, hold an error message, a
    record with a wrong tag or another format, or go on after their end.
    """
    c = F.col
    orders = table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("y"), "o_orderstatus", "o_orderpriority"
    )
    docs = spread(table(spark, sf_dir, "documents")).join(orders, "doc_id", "left")
    lines = F.transform(F.split("text", "\n"), _escaped)
    body = F.transform(
        F.slice(lines, 2, F.size(lines)),
        lambda x, i: F.concat(
            F.when(i == 0, '<AbstractText Label="PART">').otherwise("<AbstractText>"), x, F.lit("</AbstractText>")
        ),
    )
    year = c("y").cast("string")
    pub_date = (
        F.when(c("o_orderstatus") == "F", F.concat(F.lit("<Year>"), year, F.lit("</Year>")))
        .when(c("o_orderstatus") == "O", F.concat(F.lit("<MedlineDate>"), year, F.lit(" Spring</MedlineDate>")))
        .otherwise("")
    )
    dated = lambda y: F.concat(F.lit("<ArticleDate><Year>"), y.cast("string"), F.lit("</Year></ArticleDate>"))
    article_dates = (
        F.when(c("o_orderpriority") == "1-URGENT", F.concat(dated(c("y") + 1), dated(c("y"))))
        .when(c("o_orderpriority") == "2-HIGH", dated(c("y") - 1))
        .otherwise("")
    )
    lit = F.lit
    head = F.concat(lit('<PMID Version="1">'), c("doc_id").cast("string"), lit("</PMID>"))
    abstract = F.concat(lit("<Abstract>"), F.array_join(body, "\n"), lit("</Abstract>"))
    title = F.concat(
        lit("<ArticleTitle>\n <i>"), F.get(lines, 0), lit("</i> &amp; <sup>x</sup> </ArticleTitle>")
    )
    doi = F.concat(lit("10.1/"), c("doc_id").cast("string"))
    article = F.concat(
        lit("<PubmedArticle><MedlineCitation>"), head, lit("<Article><Journal><JournalIssue><PubDate>"), pub_date,
        lit("</PubDate></JournalIssue><Title>Journal  of "), c("source"),
        lit("</Title><ISOAbbreviation>J "), c("source"), lit("</ISOAbbreviation></Journal>"), title,
        F.when(c("o_orderpriority") == "3-MEDIUM", F.concat(lit('<ELocationID EIdType="doi">'), doi, lit("</ELocationID>"))).otherwise(""),
        abstract, lit("<Language>"), c("lang"), lit("</Language><Language>mul</Language><PublicationTypeList>"),
        lit('<PublicationType UI="D1">Journal Article</PublicationType><PublicationType UI="D2">'), c("source"),
        lit("</PublicationType></PublicationTypeList>"), article_dates, lit("</Article><MeshHeadingList>"),
        lit('<MeshHeading><DescriptorName MajorTopicYN="N">Humans</DescriptorName></MeshHeading>'),
        lit('<MeshHeading><DescriptorName MajorTopicYN="Y">'), c("lang"), lit("</DescriptorName></MeshHeading>"),
        lit("</MeshHeadingList></MedlineCitation><PubmedData><History>"),
        F.coalesce(F.concat(lit('<PubMedPubDate PubStatus="pubmed"><Year>'), (c("y") + 2).cast("string"), lit("</Year></PubMedPubDate>")), lit("")),
        lit("</History>"),
        F.when(c("o_orderpriority") == "1-URGENT", F.concat(lit('<ArticleIdList><ArticleId IdType="pii">p</ArticleId><ArticleId IdType="doi">'), doi, lit("</ArticleId></ArticleIdList>"))).otherwise(""),
        lit("</PubmedData></PubmedArticle>"),
    )
    book = F.concat(
        lit("<PubmedBookArticle><BookDocument>"), head, lit("<Book><BookTitle>Book of "), c("source"),
        lit("</BookTitle><PubDate><Year>"), year, lit("</Year></PubDate></Book>"), title,
        lit("<Language>"), c("lang"), lit("</Language>"), abstract,
        lit("</BookDocument></PubmedBookArticle>"),
    )
    number = F.floor(c("doc_id") / PER_FILE)
    name = F.lpad(number.cast("string"), 6, "0")
    rows = docs.select("doc_id", "lang", number.alias("number"), name.alias("name"), F.when(c("o_orderpriority") == "5-LOW", book).otherwise(article).alias("xml"))
    again = rows.where("lang = 'fr'").withColumn("name", F.concat(F.lit("again-"), "name"))
    fault = c("number") % FAULTS if broken else lit(0)
    wrong = F.when(
        (fault == MALFORMED) & (c("doc_id") % PER_FILE == 3), F.regexp_replace("xml", "</Language>", "</Lang>")
    ).when((fault == CUT) & (c("doc_id") == c("last")), F.substring("xml", 1, 200)).otherwise(c("xml"))
    last = rows.unionByName(again).withColumn("last", F.max("doc_id").over(Window.partitionBy("name")))
    records = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", wrong.alias("xml")))), lambda x: x["xml"]), "\n")
    start, end = lit('<?xml version="1.0" ?>\n<PubmedArticleSet>\n'), lit("\n</PubmedArticleSet>")
    content = (
        F.when(fault == ERROR, F.concat(lit("<eFetchResult><ERROR>Unable to obtain query "), "number", lit("</ERROR></eFetchResult>")))
        .when(fault == FOREIGN, lit("<html><body>Bad gateway</body></html>"))
        .when((fault == CUT) | (fault == ENDLESS), F.concat(start, "records"))
        .when(fault == TRAILING, F.concat(start, "records", end, lit("<p>more</p>")))
        .otherwise(F.concat(start, "records", end))
    )
    out = scratch_path(spark, "xml")
    files = last.groupBy("name", "number").agg(records.alias("records"))
    files.select(c("name").alias("file"), content.alias("value")).write.partitionBy("file").text(out)
    return out


_PART = f"[{sql_norm('x')} for x in string_split(text, chr(10))[2:]]"
XML_SQL = f"""src AS (SELECT d.*, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus AS st, o_orderpriority AS pr
  FROM documents d LEFT JOIN orders ON o_orderkey = doc_id),
parts AS (SELECT *, {_PART} AS raw FROM src),
body AS (SELECT *, [CASE WHEN i = 1 THEN 'PART: ' || x ELSE x END for x, i in raw if x <> ''] AS lines FROM parts),
dates AS (SELECT *, pr = '5-LOW' AS book, CASE WHEN pr = '5-LOW' OR st IN ('F', 'O') THEN y END AS issue,
    CASE pr WHEN '1-URGENT' THEN y WHEN '2-HIGH' THEN y - 1 END AS article FROM body),
xml AS (SELECT CAST(doc_id AS VARCHAR) AS pmid,
  CASE WHEN pr IN ('1-URGENT', '3-MEDIUM') THEN '10.1/' || doc_id ELSE '' END AS doi,
  {sql_norm("split_part(text, chr(10), 1) || ' & x '")} AS title,
  coalesce(array_to_string(lines, chr(10) || chr(10)), '') AS abstract, len(lines) > 0 AS has_abstract,
  len(lines) > 0 AS abstract_structured, CAST(len(lines) AS INTEGER) AS abstract_sections,
  CASE WHEN book THEN 'Book of ' || source ELSE 'Journal of ' || source END AS journal,
  CASE WHEN book THEN '' ELSE 'J ' || source END AS journal_iso,
  CASE WHEN book THEN y WHEN article < issue THEN article ELSE coalesce(issue, article, y + 2) END AS year,
  CASE WHEN book THEN 'Book/PubDate' WHEN article < issue THEN 'ArticleDate' WHEN issue IS NOT NULL THEN
    CASE WHEN st = 'O' THEN 'PubDate[MedlineDate]' ELSE 'PubDate' END WHEN article IS NOT NULL THEN 'ArticleDate'
    WHEN y IS NOT NULL THEN 'PubMedPubDate[pubmed]' ELSE 'none' END AS year_source,
  CASE WHEN NOT book THEN article END AS article_date_year, issue AS pub_date_year,
  CASE WHEN book THEN '' ELSE 'Journal Article; ' || source END AS publication_types,
  CASE WHEN book THEN '' ELSE 'Humans; ' || lang END AS mesh_descriptors,
  CASE WHEN book THEN '' ELSE lang END AS mesh_major_descriptors, lang AS language,
  CASE WHEN book THEN lang ELSE lang || '; mul' END AS languages,
  CASE WHEN book THEN 'PubmedBookArticle' ELSE 'PubmedArticle' END AS record_type FROM dates)"""


def xml_records(spark, sf_dir):
    """Parsed once and written, as a capture is: what follows reads columns, not markup."""
    return markup.read_capture(spark, write_record_xml(spark, sf_dir), FILE_OF)


@query("xml_record_scan", "S1 P4 P5 P6 P7 P8 P9 W8 R2", f"WITH {XML_SQL} SELECT * FROM xml")
def xml_record_scan(spark, sf_dir):
    first = dedup.keep_first(xml_records(spark, sf_dir), "pmid", markup.RECORD_ORDER)
    return tables.flat(first).drop("source_file", "kind", "block", "place", "nth")


@query(
    "xml_capture_counts",
    "A25 A29",
    f"""WITH {XML_SQL} SELECT record_type, count(*) + count(*) FILTER (language = 'fr') AS n_records, count(*) AS n_unique FROM xml GROUP BY 1""",
)
def xml_capture_counts(spark, sf_dir):
    """Per-file counts added up by record type, against distinct ids."""
    raw = markup.read_capture(spark, write_record_xml(spark, sf_dir), FILE_OF, columns=())
    per_file = markup.records_per_file(raw)
    books = per_file.agg(F.sum("n_books").alias("b"), F.sum("n_records").alias("n")).select(
        F.explode(
            F.create_map(F.lit("PubmedBookArticle"), F.col("b"), F.lit("PubmedArticle"), F.col("n") - F.col("b"))
        ).alias("record_type", "n_records")
    )
    unique = raw.groupBy("record_type").agg(F.countDistinct("pmid").alias("n_unique"))
    return books.join(unique, "record_type")


@query("xml_parse_summary", "A20", f"""WITH {XML_SQL},
files AS (SELECT DISTINCT doc_id // {PER_FILE} AS n, '' AS again FROM documents UNION SELECT DISTINCT doc_id // {PER_FILE}, 'again' FROM documents WHERE lang = 'fr')
SELECT 'records' AS metric, '' AS key, count(*) AS value FROM xml
UNION ALL SELECT 'files', '', count(*) FROM files
UNION ALL SELECT 'duplicate_pmids_dropped', '', count(*) FROM documents WHERE lang = 'fr'
UNION ALL SELECT 'records_by_type', record_type, count(*) FROM xml GROUP BY ALL
UNION ALL SELECT 'without_abstract', '', count(*) FROM xml WHERE NOT has_abstract HAVING count(*) > 0
UNION ALL SELECT 'structured_abstract', '', count(*) FROM xml WHERE abstract_structured HAVING count(*) > 0
UNION ALL SELECT 'unstructured_abstract', '', count(*) FROM xml WHERE has_abstract AND NOT abstract_structured HAVING count(*) > 0
UNION ALL SELECT 'without_year', '', count(*) FROM xml WHERE year IS NULL HAVING count(*) > 0
UNION ALL SELECT 'year_source', year_source, count(*) FROM xml GROUP BY ALL
UNION ALL SELECT 'language', language, count(*) FROM xml GROUP BY ALL
UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM xml WHERE year IS NOT NULL GROUP BY ALL""")
def xml_parse_summary(spark, sf_dir):
    path = write_record_xml(spark, sf_dir)
    told = ("has_abstract", "abstract_structured", "year_source", "language", "year")
    captured, files = markup.read_whole(spark, path, FILE_OF, columns=told)
    first = dedup.keep_first(captured, "pmid", markup.RECORD_ORDER)
    return counts.parse_summary(first, captured, files)


#: Files of the broken capture with their number of records and what is wrong with them.
BROKEN_SQL = f"""src AS (SELECT doc_id, doc_id // {PER_FILE} AS n, lpad(CAST(doc_id // {PER_FILE} AS VARCHAR), 6, '0') AS name, lang, o_orderpriority IS NOT DISTINCT FROM '5-LOW' AS book
  FROM documents LEFT JOIN orders ON o_orderkey = doc_id),
captured AS (SELECT * FROM src UNION ALL SELECT doc_id, n, 'again-' || name, lang, book FROM src WHERE lang = 'fr'),
files AS (SELECT name, n, n % {FAULTS} AS fault, count(*) AS records FROM captured GROUP BY name, n),
problems AS (
  SELECT name AS file, 'unbalanced' AS "check", '1 roots opened, 0 closed; ' || records || ' records opened, ' || (records - CASE fault WHEN {CUT} THEN 1 ELSE 0 END) || ' closed' AS detail
    FROM files WHERE fault IN ({CUT}, {ENDLESS})
  UNION ALL SELECT name, 'error_body', 'Unable to obtain query ' || n FROM files WHERE fault = {ERROR}
  UNION ALL SELECT name, 'no_root', '38 bytes' FROM files WHERE fault = {FOREIGN}
  UNION ALL SELECT name, 'trailing_content', '<p>more</p>' FROM files WHERE fault = {TRAILING}
  UNION ALL SELECT name, 'malformed_record', CAST(doc_id AS VARCHAR) FROM captured WHERE n % {FAULTS} = {MALFORMED} AND doc_id % {PER_FILE} = 3)"""


@query("xml_problems", "S1", f"WITH {BROKEN_SQL} SELECT * FROM problems")
def xml_problems(spark, sf_dir):
    """Why files of a capture are refused."""
    path = write_record_xml(spark, sf_dir, broken=True)
    return markup.capture_problems(*markup.scan_files(spark, path, FILE_OF, columns=()))


@query(
    "xml_per_file",
    "S1 A29",
    f"""WITH {BROKEN_SQL} SELECT name AS source_file, count(*) AS n_records, count(*) FILTER (book) AS n_books,
string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY book, doc_id) AS ids FROM captured ANTI JOIN problems ON file = name GROUP BY name""",
)
def xml_per_file(spark, sf_dir):
    """Records and ids of the sound files of a broken capture, articles before books."""
    path = write_record_xml(spark, sf_dir, broken=True)
    per_file = markup.records_per_file(markup.read_capture(spark, path, FILE_OF, skip=True, columns=()))
    return per_file.withColumn("ids", F.array_join("ids", " "))


# --- HTML pages ----------------------------------------------------------------------

def _sql_tag_text(expr: str) -> str:
    out = f"regexp_replace(regexp_replace({expr}, '<br\\s*/?>', ' ', 'g'), '(?s)<[^>]*>', '', 'g')"
    for entity, char in markup.ENTITIES.items():
        out = f"replace({out}, {sql_text(entity)}, {sql_text(char)})"
    return sql_norm(out)


@query(
    "page_scan",
    "S2 P2 P6 P7 P8",
    f"""WITH b AS (SELECT page_id, url, regexp_replace(html, '(?s)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g') AS body FROM pages),
a AS (SELECT *, regexp_extract_all(body, '(?s)<article[^>]*>(.*?)</article>', 1) AS art FROM b),
p AS (SELECT *, [x for x in [{_sql_tag_text("split_part(x, '</p>', 1)")} for x in flatten([string_split_regex(one, '<p(?:\\s[^>]*)?>')[2:] for one in art])] if x <> ''] AS paras FROM a)
SELECT page_id, url, {_sql_tag_text("regexp_extract(body, '(?s)<title[^>]*>(.*?)</title>', 1)")} AS title,
  regexp_extract(body, '<html[^>]*\\blang="([^"]*)"', 1) AS lang,
  regexp_extract_all(body, '<a\\s[^>]*href="([^"]*)"', 1) AS links,
  {_sql_tag_text("regexp_extract(body, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS heading,
  coalesce(array_to_string(paras, chr(10) || chr(10)), '') AS text, CAST(len(paras) AS INTEGER) AS n_paragraphs FROM p""",
)
def page_scan(spark, sf_dir):
    return markup.parse_pages(spread(table(spark, sf_dir, "pages")))


# --- tables --------------------------------------------------------------------------

RECORD_SELECT = "pmid, title, abstract, year, year_source, record_type, publication_types, language, source_file"


@query("record_scan", "S3 S10", f"WITH {corpus.RECORDS_SQL} SELECT {RECORD_SELECT} FROM records")
def record_scan(spark, sf_dir):
    """Parquet keeps what was written."""
    out = scratch_path(spark, "records")
    corpus.records(spark, sf_dir).write.parquet(out)
    return tables.read_records(spark, out)


@query("record_csv_twin", "S3 S6 S10", f"WITH {corpus.RECORDS_SQL} SELECT {RECORD_SELECT} FROM records")
def record_csv_twin(spark, sf_dir):
    """Lists joined for the CSV twin, cells with line breaks and quotes read back whole."""
    from tallymark.functions.text import tag_list

    out = scratch_path(spark, "records")
    records = corpus.records(spark, sf_dir).withColumn("publication_types", tag_list("publication_types"))
    tables.flat(records).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{out}/x.csv")
    return tables.read_records(spark, f"{out}/x.csv")


@query(
    "title_scan",
    "S4",
    f"""WITH {corpus.RECORDS_SQL}, k AS (SELECT language || '-' || source_file AS pmid, title, abstract, CAST(pmid AS BIGINT) AS pos FROM records)
SELECT pmid, title, abstract FROM k QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY pos) = 1""",
)
def title_scan(spark, sf_dir):
    """First record per language and source."""
    records = corpus.records(spark, sf_dir).select(
        F.concat_ws("-", "language", "source_file").alias("pmid"), "title", "abstract",
        F.col("pmid").cast("bigint").alias("pos"),
    )
    return tables.read_titles(records, ["pos"])


@query(
    "commented_csv_scan",
    "S5 S11",
    """SELECT o_orderpriority AS theme, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS INTEGER) AS n_papers FROM orders GROUP BY ALL""",
)
def commented_csv_scan(spark, sf_dir):
    """A count table with comment lines above its header."""
    counted = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(
        F.count("*").alias("n")
    )
    # the header lines come first in every file because sorting puts them there
    lines = counted.select(
        F.lit(1).alias("k"), F.concat_ws(",", "o_orderpriority", F.col("y").cast("string"), F.col("n").cast("string")).alias("value")
    )
    top = spark.createDataFrame(
        [(0, "# file: counts.csv\n# source: orders\ntheme,year,n_papers")], "k int, value string"
    )
    out = scratch_path(spark, "commented")
    lines.unionByName(top).coalesce(1).sortWithinPartitions("k").select("value").write.text(out)
    return tables.read_commented_csv(spark, out, "theme string, year int, n_papers int")


@query(
    "device_csv_scan",
    "S6 Q1 P21",
    """SELECT 'K' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS submission_number, strftime(o_orderdate, '%Y-%m-%d') AS decision_date,
CAST(year(o_orderdate) AS INTEGER) AS year, '892.20' AS regulation_number, o_orderstatus = 'F' AS counted FROM orders""",
)
def device_csv_scan(spark, sf_dir):
    """Leading zeros and trailing zeros survive: every column is read as text, then cast."""
    c = F.col
    out = scratch_path(spark, "devices")
    table(spark, sf_dir, "orders").select(
        F.concat(F.lit("K"), F.lpad(c("o_orderkey").cast("string"), 7, "0")).alias("submission_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("decision_date"),
        F.year("o_orderdate").alias("year"),
        F.lit("892.20").alias("regulation_number"),
        F.when(c("o_orderstatus") == "F", "True").otherwise("False").alias("counted"),
        F.lit("x").alias("submission"),
    ).write.option("header", True).csv(out)
    read = tables.read_text_csv(spark, out)
    wanted = ["submission_number", "decision_date", "year", "regulation_number", "counted"]
    return tables.typed_labeled(tables.require(read, wanted, exact=True, tolerated=["submission"]))


@query(
    "json_lookup_scan",
    "S7",
    """SELECT 'S' || s_suppkey AS product_code, CASE WHEN s_acctbal > 5000 THEN upper(s_name) ELSE s_name END AS device_name,
CASE WHEN s_nationkey >= 10 THEN CAST(s_nationkey AS VARCHAR) END AS regulation_number FROM supplier""",
)
def json_lookup_scan(spark, sf_dir):
    """Two files of lookup records; the later one restates some of them."""
    c = F.col
    out = scratch_path(spark, "lookup")
    code = F.concat(F.lit(" S"), c("s_suppkey").cast("string"))
    number = F.when(c("s_nationkey") >= 10, c("s_nationkey").cast("string")).otherwise(" ")

    def docs(df, name):
        item = F.struct(code.alias("product_code"), name.alias("device_name"), number.alias("regulation_number"))
        blank = F.struct(F.lit(" ").alias("product_code"), F.lit("x").alias("device_name"), F.lit("").alias("regulation_number"))
        return df.select(F.array(item, blank).alias("results"))

    supplier = table(spark, sf_dir, "supplier")
    docs(supplier, c("s_name")).write.json(f"{out}/batch_001")
    docs(supplier.where("s_acctbal > 5000"), F.upper("s_name")).write.json(f"{out}/batch_002")
    return lookup.read_lookup(
        spark, f"{out}/*", fields=["device_name", "regulation_number"], multi_line=False
    )


@query(
    "nested_json_fields",
    "S7",
    "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
)
def nested_json_fields(spark, sf_dir):
    return lookup.nested_fields(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), "props", {"k": "int"})


_TAKEN = "SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS VARCHAR) AS taken FROM orders"
_NEWEST = "(SELECT max(year(o_orderdate)) FROM orders)"


def publish_years(spark, sf_dir):
    """A snapshot of the orders of each year; the write of the newest is killed before its commit."""
    root = scratch_path(spark, "captures")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    years = [r["y"] for r in orders.select("y").distinct().orderBy("y").collect()]  # one row a year
    for year in years:
        put = snapshots.publish if year != years[-1] else snapshots.stage
        put(orders.where(F.col("y") == year).drop("y"), root, f"{year}-12-31")
    return root


@query("latest_snapshot", "S8 R3", f"{_TAKEN} WHERE year(o_orderdate) = {_NEWEST} - 1")
def latest_snapshot(spark, sf_dir):
    """The newest of the yearly captures that is finished."""
    newest = snapshots.read_published(spark, publish_years(spark, sf_dir), newest=True)
    return newest.select("o_orderkey", "o_totalprice", F.substring("snapshot", 1, 4).alias("taken"))


@query("published_snapshots", "S8 R3", f"{_TAKEN} WHERE year(o_orderdate) < {_NEWEST}")
def published_snapshots(spark, sf_dir):
    """All finished captures; what a killed write left is not seen."""
    rows = snapshots.read_published(spark, publish_years(spark, sf_dir))
    return rows.select("o_orderkey", "o_totalprice", F.substring("snapshot", 1, 4).alias("taken"))


# --- incremental ---------------------------------------------------------------------

LABEL_SELECT = f"SELECT pmid, year, {corpus.THEME_COLS}, {corpus.MOD_COLS}, domain FROM labels_"


def _land(df, path):
    df.write.mode("append").parquet(path)


@query("incremental_labels", "R1", f"WITH {corpus.labels_sql()} {LABEL_SELECT}")
def incremental_labels(spark, sf_dir):
    """Records land in two goes; each run labels only what is new."""
    root = scratch_path(spark, "incremental")
    records = corpus.records(spark, sf_dir)
    _land(records.where("language = 'en'"), f"{root}/in")
    book = corpus.rule_book()
    job = lambda df: labelling.labels(labelling.annotate(df, book, corpus.YEARS)).drop(
        "year_source", "is_primary_research"
    )
    for more in (records.where("language <> 'en'"), None):
        stream = incremental.landed(spark, f"{root}/in", records.schema)
        incremental.run_available(stream, job, f"{root}/out", f"{root}/state")
        if more is not None:
            _land(more, f"{root}/in")
    return spark.read.parquet(f"{root}/out")


@query("incremental_first_seen", "R2", "SELECT DISTINCT md5(text) AS text_md5 FROM documents")
def incremental_first_seen(spark, sf_dir):
    """The same text in several slices, which land between runs, is passed on once."""
    root = scratch_path(spark, "first-seen")
    docs = table(spark, sf_dir, "documents").select("lang", F.md5("text").alias("text_md5"))
    for where in ("lang IN ('en', 'de')", "lang IN ('de', 'fr', 'es')", "true"):
        _land(docs.where(where).select("text_md5"), f"{root}/in")
        stream = incremental.landed(spark, f"{root}/in", "text_md5 string")
        incremental.pass_on_first_seen(stream, "text_md5", f"{root}/out", f"{root}/state")
    return incremental.read_first_seen(spark, f"{root}/out")


@query("incremental_relabelled", "R1", f"WITH {corpus.labels_sql()} {LABEL_SELECT}")
def incremental_relabelled(spark, sf_dir):
    """Pieces land in two goes; in between one of them changes and a line of the ledger is torn."""
    root = scratch_path(spark, "resume")
    records = corpus.records(spark, sf_dir).withColumn("piece", F.col("source_file"))
    book = corpus.rule_book()
    job = lambda df: labelling.labels(labelling.annotate(df, book, corpus.YEARS, keep=("piece",)))

    def land(df):
        # a piece is a folder of files: a large source is not left to one task, neither here nor when it is worked off
        dealt = F.pmod(F.xxhash64("pmid"), F.lit(spark.sparkContext.defaultParallelism))
        df.repartition("piece", dealt).write.partitionBy("piece").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/in")

    def sweep():
        landed = resume.read_pieces(spark, f"{root}/in", records.drop("piece").schema)
        resume.sweep(landed, resume.listing(spark, f"{root}/in"), job, f"{root}/out", f"{root}/ledger")

    late, changing = F.col("piece").isin("src1", "src2"), F.col("piece") == "src3"
    land(records.where(~late).withColumn("abstract", F.when(~changing, F.col("abstract"))))
    sweep()
    spark.createDataFrame([('{"piece": "src4", "bytes": 1, "dig',)], "value string").write.mode("append").text(f"{root}/ledger")
    land(records.where(late | changing))
    sweep()
    done = resume.current(spark, f"{root}/out", f"{root}/ledger", resume.listing(spark, f"{root}/in"))
    return done.drop("piece", "year_source", "is_primary_research")
