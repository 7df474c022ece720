"""Markup scans: literature XML and HTML pages to flat tables.

XML is read piece by piece: the file reader cuts where a closing tag of the record format
begins, whichever it is, so one large file of articles or books is shared between tasks and no file has to fit
in memory.  A piece holds at most one record and says what the piece before it closed; added up per file,
that tells a whole file from a cut one.  Plain fields are parsed once per record into a struct, which would tear mixed
content apart; titles and abstract sections carry inline markup, so they are cut out and flattened
as text.

A capture is refused unless every file is whole: one root, opened and closed, every record closed,
nothing after the end, no error body, and records that parse (:func:`capture_problems`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.dates import choose_year
from tallymark.functions.text import first_year, normalise_space, sections_text
from tallymark.session import written

ARTICLE, BOOK = "PubmedArticle", "PubmedBookArticle"

_ID = "array<struct<_VALUE: string, _IdType: string>>"
_ARTICLE = (
    "MedlineCitation struct<PMID: struct<_VALUE: string>, "
    "Article: struct<Journal: struct<Title: string, ISOAbbreviation: string, "
    "JournalIssue: struct<PubDate: struct<Year: string, MedlineDate: string>>>, "
    "ArticleDate: array<struct<Year: string>>, "
    "ELocationID: array<struct<_VALUE: string, _EIdType: string>>, "
    "Language: array<string>, "
    "PublicationTypeList: struct<PublicationType: array<struct<_VALUE: string>>>>, "
    "MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: "
    "struct<_VALUE: string, _MajorTopicYN: string>>>>>, "
    f"PubmedData struct<ArticleIdList: struct<ArticleId: {_ID}>, "
    "History: struct<PubMedPubDate: array<struct<Year: string, _PubStatus: string>>>>"
)
_BOOK = (
    f"BookDocument struct<PMID: struct<_VALUE: string>, ArticleIdList: struct<ArticleId: {_ID}>, "
    "Book: struct<PubDate: struct<Year: string>>, Language: array<string>, "
    "PublicationType: array<struct<_VALUE: string>>>"
)


#: What every closing tag of the format begins with; records, their data parts and the root.
CLOSING = "</Pubmed"
#: Opening tags of roots, records and data parts; the shape of what a piece begins with if it follows a closing tag.
_OPENING = r"<Pubmed(?:Book)?(?:ArticleSet|Article|Data)(?:\s[^>]*)?/?>"
_FOLLOWS = r"\A((?:Book)?(?:ArticleSet|Article|Data))\s*>"
#: The last part of a path, as the name of a file.
FILE_NAME = r"([^/]+)\z"


class CaptureError(ValueError):
    """A capture holds files that must not pass for whole ones."""


def read_pieces(spark: SparkSession, path: str, file_pattern: str = FILE_NAME) -> DataFrame:
    """Every piece of every file: what it opens, what the piece before it closed, and its record.

    ``(source_file, bytes, block, place, nth, closed, tags, error, rest, record_type, xml)``; the last two are null in
    a piece without a record.  ``bytes`` is the size of the file, ``block`` and ``place`` order its pieces; books come
    after articles, the order in which a file's records are taken when copies are dropped.
    ``file_pattern`` takes the name of a file from its path.
    """
    v = F.col("value")
    pieces = spark.read.option("lineSep", CLOSING).text(path).select(
        F.regexp_extract("_metadata.file_path", file_pattern, 1).alias("source_file"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.lit(0).alias("nth"),
        "value",
    )
    record = F.regexp_extract(v, rf"(?s)<(?:{ARTICLE}|{BOOK})(?:\s[^>]*)?>.*\z", 0)
    kind = F.when(F.col("_record") == "", None).when(F.col("_record").rlike(rf"\A<{BOOK}"), BOOK).otherwise(ARTICLE)
    # the cut takes the closing tags away: that of the record, and that of a data part before it
    data = F.regexp_extract("_record", r"<(Pubmed(?:Book)?Data)(?:\s[^>]*)?(?<!/)>", 1)
    ends = F.concat(F.when(data != "", F.concat(F.lit("</"), data, F.lit(">"))).otherwise(""), F.lit("</"), F.col("record_type"), F.lit(">"))
    closed = F.regexp_extract(v, _FOLLOWS, 1)
    return (
        pieces.withColumn("_record", record)
        .withColumn("record_type", kind)
        .select(
            "source_file", "bytes", "block", "place", "nth",
            closed.alias("closed"),
            F.regexp_extract_all(v, F.lit(_OPENING), F.lit(0)).alias("tags"),
            F.when(v.rlike("<ERROR>"), normalise_space(F.regexp_extract(v, r"(?s)<ERROR>(.*?)(?:</ERROR>|\z)", 1))).alias("error"),
            F.when(closed.endswith("Set"), normalise_space(F.regexp_replace(v, _FOLLOWS, ""))).alias("rest"),
            "record_type",
            F.when(F.col("record_type").isNotNull(), F.concat("_record", ends)).alias("xml"),
        )
    )


def read_record_xml(spark: SparkSession, path: str, file_pattern: str = FILE_NAME) -> DataFrame:
    """``(source_file, block, place, nth, record_type, xml)``: one row per record element, sound or not."""
    pieces = read_pieces(spark, path, file_pattern).where("record_type is not null")
    return pieces.select("source_file", "block", "place", "nth", "record_type", "xml")


def flat_text(fragment: Column) -> Column:
    """Text of a markup fragment, inline tags dropped.

    Plain string work serves nearly every fragment; one with numbered characters, CDATA
    or comments goes through an XML parser.
    """
    parsed = F.xpath_string(F.concat(F.lit("<r>"), fragment, F.lit("</r>")), F.lit("/r"))
    return F.when(fragment.contains("&#") | fragment.contains("<!"), normalise_space(parsed)).otherwise(tag_text(fragment))


def _sections(xml: Column) -> Column:
    """``array<struct<label, text>>`` of the abstract parts of a record."""
    abstract = F.regexp_extract(xml, r"(?s)<Abstract(?:\s[^>]*)?>(.*?)</Abstract>", 1)
    parts = F.regexp_extract_all(
        abstract, F.lit(r"(?s)<AbstractText(?:\s[^>]*)?(?:/>|(?<!/)>.*?</AbstractText>)"), F.lit(0)
    )
    return F.transform(
        parts,
        lambda p: F.struct(
            flat_text(F.regexp_extract(p, r"""\A<AbstractText\s[^>]*?\bLabel=["']([^"']*)""", 1)).alias("label"),
            flat_text(p).alias("text"),
        ),
    )


def _element(xml: Column, name: str) -> Column:
    """Flat text of the first element of that name."""
    return flat_text(F.regexp_extract(xml, rf"(?s)<{name}(?:\s[^>]*)?(?<!/)>(.*?)</{name}>", 1))


def _first_id(ids: Column, kind: str) -> Column:
    """First non-empty identifier of type DOI."""
    values = F.transform(
        F.filter(ids, lambda x: F.lower(x[kind]) == "doi"), lambda x: normalise_space(x["_VALUE"])
    )
    return F.get(F.filter(values, lambda v: F.length(v) > 0), 0)


def _texts(items: Column, field: str | None = "_VALUE") -> Column:
    values = F.transform(items, lambda x: normalise_space(x[field] if field else x))
    return F.coalesce(values, F.array().cast("array<string>"))


_BAD = "_unparsed"
_STRICT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}


def parse_records(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The flat record table from ``read_record_xml``, with the ordering columns kept.

    Both record types go through one projection, so a capture is read once.  An expression
    several columns need is a named column first, worked out once.  ``malformed`` marks a record
    that is no well-formed XML; ``keep`` names further columns of ``raw``.
    """
    xml, is_book = F.col("xml"), F.col("record_type") == BOOK
    parsed = raw.withColumns(
        {
            "x": F.when(~is_book, F.from_xml("xml", f"{_ARTICLE}, {_BAD} string", _STRICT)),
            "_b": F.when(is_book, F.from_xml("xml", f"{_BOOK}, {_BAD} string", _STRICT)),
            "_s": _sections(xml),
            "_title": _element(xml, "ArticleTitle"),
            "_book": F.when(is_book, _element(xml, "BookTitle")),
        }
    )
    c, a, b = F.col("x.MedlineCitation"), F.col("x.MedlineCitation.Article"), F.col("_b.BookDocument")
    issue = a["Journal"]["JournalIssue"]["PubDate"]
    entered = F.filter(
        F.col("x.PubmedData.History.PubMedPubDate"), lambda d: d["_PubStatus"] == "pubmed"
    )
    dated = parsed.withColumns(
        {
            "_ay": F.array_min(F.transform(a["ArticleDate"], lambda d: first_year(d["Year"]))),
            "_iy": F.when(is_book, first_year(b["Book"]["PubDate"]["Year"]))
            .when(issue["Year"].isNotNull(), first_year(issue["Year"]))
            .otherwise(first_year(issue["MedlineDate"])),
            "_hy": first_year(F.get(entered, 0)["Year"]),
            "_free": issue["Year"].isNull(),
            "_l": _texts(F.coalesce(a["Language"], b["Language"]), None),
            "_t": sections_text("_s"),
        }
    ).withColumn("_y", choose_year("_ay", "_iy", "_hy", "_free"))
    book_source = F.when(F.col("_iy").isNotNull(), "Book/PubDate").otherwise("none")
    mesh = c["MeshHeadingList"]["MeshHeading"]
    terms = lambda m: F.filter(
        _texts(F.transform(m, lambda h: h["DescriptorName"])), lambda t: F.length(t) > 0
    )
    malformed = F.coalesce(F.col(f"x.{_BAD}"), F.col(f"_b.{_BAD}")).isNotNull()
    said = F.when(malformed, F.regexp_extract(xml, r"<PMID(?:\s[^>]*)?>([^<]*)", 1)).otherwise(F.coalesce(c["PMID"]["_VALUE"], b["PMID"]["_VALUE"]))
    return dated.select(
        normalise_space(said).alias("pmid"),
        F.coalesce(
            _first_id(F.col("x.PubmedData.ArticleIdList.ArticleId"), "_IdType"),
            _first_id(a["ELocationID"], "_EIdType"),
            _first_id(b["ArticleIdList"]["ArticleId"], "_IdType"),
            F.lit(""),
        ).alias("doi"),
        F.coalesce(F.nullif("_title", F.lit("")), "_book", F.lit("")).alias("title"),
        F.col("_t.text").alias("abstract"),
        (F.col("_t.text") != "").alias("has_abstract"),
        F.col("_t.structured").alias("abstract_structured"),
        F.col("_t.sections").alias("abstract_sections"),
        F.when(is_book, F.col("_book")).otherwise(normalise_space(a["Journal"]["Title"])).alias("journal"),
        normalise_space(a["Journal"]["ISOAbbreviation"]).alias("journal_iso"),
        F.when(is_book, F.col("_iy")).otherwise(F.col("_y.year")).alias("year"),
        F.when(is_book, book_source).otherwise(F.col("_y.year_source")).alias("year_source"),
        F.col("_ay").alias("article_date_year"),
        F.col("_iy").alias("pub_date_year"),
        _texts(F.coalesce(a["PublicationTypeList"]["PublicationType"], b["PublicationType"])).alias(
            "publication_types"
        ),
        terms(mesh).alias("mesh_descriptors"),
        terms(F.filter(mesh, lambda h: h["DescriptorName"]["_MajorTopicYN"] == "Y")).alias(
            "mesh_major_descriptors"
        ),
        F.coalesce(F.get("_l", 0), F.lit("")).alias("language"),
        F.col("_l").alias("languages"),
        "record_type",
        "source_file",
        is_book.cast("int").alias("kind"),
        "block",
        "place",
        "nth",
        malformed.alias("malformed"),
        *keep,
    )


#: The order in which a capture's records are taken when copies are dropped.
RECORD_ORDER = ["source_file", "kind", "block", "place", "nth"]


def records_per_file(records: DataFrame) -> DataFrame:
    """Record counts per raw file, how many of them are books, and their ids in the order of the file."""
    placed = F.sort_array(F.collect_list(F.struct(*RECORD_ORDER[1:], "pmid")))
    return records.groupBy("source_file").agg(
        F.count("*").alias("n_records"),
        F.count_if(F.col("record_type") == BOOK).alias("n_books"),
        F.filter(F.transform(placed, lambda x: x["pmid"]), lambda x: x != "").alias("ids"),
    )


# --- whole captures ----------------------------------------------------------------


def capture_files(spark: SparkSession, path: str, file_pattern: str = FILE_NAME) -> DataFrame:
    """``(source_file, bytes)`` of every file of a capture, also those that hold nothing; no content is read.

    A scan passes over empty files, so the names come from its file index, which the driver holds to plan any scan.
    """
    scan = spark.read.format("binaryFile").load(path)
    sized = scan.select(F.regexp_extract("path", file_pattern, 1).alias("source_file"), F.col("length").alias("bytes"))
    return _listed(scan, file_pattern).join(sized, "source_file", "left").select("source_file", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def _listed(scan: DataFrame, file_pattern: str) -> DataFrame:
    """``(source_file)`` of every file in the index of a scan."""
    names = scan.sparkSession.createDataFrame([(f,) for f in scan.inputFiles()], "path string")
    return names.select(F.regexp_extract("path", file_pattern, 1).alias("source_file"))


#: What a piece says besides its record, for :func:`capture_problems`.
PIECE = ("closed", "tags", "error", "rest")


def scan_capture(spark: SparkSession, path: str, file_pattern: str = FILE_NAME) -> DataFrame:
    """All pieces with their records parsed, read once and written to the shared folder."""
    return written(parse_records(read_pieces(spark, path, file_pattern), PIECE), "capture")


def scan_files(
    spark: SparkSession, path: str, file_pattern: str = FILE_NAME, columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """:func:`scan_capture` and :func:`capture_files` from one listing of the folder.

    With ``columns``, of the columns that :func:`parse_records` makes only those are worked out, besides what
    order, id and soundness of the records need.
    """
    scan = read_pieces(spark, path, file_pattern)
    pieces = parse_records(scan, (*PIECE, "bytes"))
    if columns is not None:
        needed = {*columns, *RECORD_ORDER, *PIECE, "pmid", "record_type", "malformed", "bytes"}
        pieces = pieces.select([c for c in pieces.columns if c in needed])
    pieces = written(pieces, "capture")
    sized = pieces.groupBy("source_file").agg(F.max("bytes").alias("bytes"))
    # a file without a piece is empty
    files = _listed(scan, file_pattern).join(sized, "source_file", "left").select("source_file", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return pieces.drop("bytes"), files


def capture_problems(pieces: DataFrame, files: DataFrame) -> DataFrame:
    """``(file, check, detail)``: why a file must not pass for a whole one; no rows for a sound capture.

    ``error_body``: an error message instead of records.  ``no_root``: empty, or another format.  ``unbalanced``: cut
    short, or glued together.  ``trailing_content``: text after the end.  ``malformed_record``: one row
    for each record that does not parse, with its id, in files that are otherwise whole.
    """
    tags = F.col("tags")
    roots = F.filter(tags, lambda t: t.contains("Set"))
    alone = F.filter(roots, lambda t: t.endswith("/>"))
    opened = F.filter(tags, lambda t: t.rlike(r"Article[\s>]"))
    per_file = pieces.groupBy("source_file").agg(
        F.sum(F.size(roots)).alias("roots"),
        (F.sum(F.size(alone)) + F.count_if(F.col("closed").endswith("Set"))).alias("roots_closed"),
        F.sum(F.size(opened)).alias("opened"),
        F.count_if(F.col("closed").endswith("Article")).alias("closed"),
        F.max("error").alias("error"),
        F.max("rest").alias("rest"),
    )
    c = F.col
    balance = F.format_string(
        "%d roots opened, %d closed; %d records opened, %d closed", c("roots"), c("roots_closed"), c("opened"), c("closed")
    )

    def problem(check: str, detail: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), detail.alias("detail"))

    found = (
        F.when(c("error").isNotNull(), problem("error_body", c("error")))
        .when(F.coalesce(c("roots"), F.lit(0)) == 0, problem("no_root", F.concat(c("bytes").cast("string"), F.lit(" bytes"))))
        .when(~((c("roots") == 1) & (c("roots_closed") == 1) & (c("opened") == c("closed"))), problem("unbalanced", balance))
        .when(c("rest") != "", problem("trailing_content", F.substring("rest", 1, 100)))
    )
    whole = files.join(per_file, "source_file", "left").select("source_file", found.alias("p")).where("p is not null")
    bad = pieces.where("malformed").select("source_file", F.lit("malformed_record").alias("check"), F.col("pmid").alias("detail"))
    rows = whole.select("source_file", "p.check", "p.detail").unionByName(bad.join(whole, "source_file", "left_anti"))
    return rows.withColumnRenamed("source_file", "file")


def sound_records(pieces: DataFrame, problems: DataFrame) -> DataFrame:
    """The records of files without a problem."""
    refused = problems.select(F.col("file").alias("source_file")).distinct()
    records = pieces.where("record_type is not null").drop(*PIECE, "malformed")
    return records.join(refused, "source_file", "left_anti")


def read_capture(
    spark: SparkSession, path: str, file_pattern: str = FILE_NAME, skip: bool = False, columns: Sequence[str] | None = None
) -> DataFrame:
    """The records of a capture; a file that is not whole is refused, or left out with ``skip``.

    ``columns`` are those wanted besides id, type and order (:func:`scan_files`); all, if not named.

    Raises:
        CaptureError: files are not whole, and ``skip`` is not set.
    """
    return read_whole(spark, path, file_pattern, skip, columns)[0]


def read_whole(
    spark: SparkSession, path: str, file_pattern: str = FILE_NAME, skip: bool = False, columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The records of :func:`read_capture`, and the capture's files."""
    pieces, files = scan_files(spark, path, file_pattern, columns)
    problems = written(capture_problems(pieces, files), "capture-problems")
    if not skip:
        some = problems.orderBy("file", "check", "detail").limit(10).collect()
        if some:
            raise CaptureError("; ".join(f"{r['file']}: {r['check']} ({r['detail']})" for r in some))
    return sound_records(pieces, problems), files


# --- HTML pages ------------------------------------------------------------------

#: Entities that occur in running text, decoded in this order.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&middot;": "·", "&copy;": "©", "&reg;": "®",
    "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&amp;": "&",
}


def tag_text(html: Column) -> Column:
    """Text of a fragment: tags dropped, entities decoded, white space normalised; passes that find nothing are left out."""
    return F.get(F.transform(F.array(html), _tag_text), 0)


def _tag_text(html: Column) -> Column:
    broken = F.when(html.contains("<br"), F.regexp_replace(html, r"<br\s*/?>", " ")).otherwise(html)
    plain = F.when(html.contains("<"), F.regexp_replace(broken, r"(?s)<[^>]*>", "")).otherwise(html)
    decoded = plain
    for entity, char in ENTITIES.items():
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return normalise_space(F.when(html.contains("&"), decoded).otherwise(plain))


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, language, links, headings and paragraph text of each page."""
    h = F.col(html)
    body = F.regexp_replace(h, r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    articles = F.regexp_extract_all(F.col("_body"), F.lit(r"(?s)<article[^>]*>(.*?)</article>"), F.lit(1))
    # a paragraph that is not closed ends where the next one begins
    inside = F.transform("_articles", lambda a: F.regexp_extract_all(a, F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)(?=</p>|<p[\s>]|\z)"), F.lit(1)))
    paragraphs = F.filter(F.transform(F.flatten(inside), tag_text), lambda t: F.length(t) > 0)
    rest = [c for c in pages.columns if c != html]
    return (
        pages.withColumn("_body", body)
        .withColumn("_articles", articles)
        .select(
            *rest,
            tag_text(F.regexp_extract("_body", r"(?s)<title[^>]*>(.*?)</title>", 1)).alias("title"),
            F.regexp_extract("_body", r'<html[^>]*\blang="([^"]*)"', 1).alias("lang"),
            F.regexp_extract_all("_body", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1)).alias("links"),
            tag_text(F.regexp_extract("_body", r"(?s)<h1[^>]*>(.*?)</h1>", 1)).alias("heading"),
            F.array_join(paragraphs, "\n\n").alias("text"),
            F.size(paragraphs).alias("n_paragraphs"),
        )
    )
