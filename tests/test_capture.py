"""Whole and broken captures: what is refused, and how files are cut into records."""

import pytest
from pyspark.sql import functions as F

from tallymark.functions.text import normalise_space
from tallymark.sources import markup

ARTICLE = '<PubmedArticle><MedlineCitation><PMID Version="1">{i}</PMID><Article><ArticleTitle>T {i}</ArticleTitle></Article></MedlineCitation>{data}</PubmedArticle>\n'
BOOK = "<PubmedBookArticle><BookDocument><PMID>{i}</PMID><Book><BookTitle>B {i}</BookTitle></Book></BookDocument><PubmedBookData><History/></PubmedBookData></PubmedBookArticle>\n"
HEAD, TAIL = '<?xml version="1.0"?>\n<PubmedArticleSet>\n', "</PubmedArticleSet>\n"


def article(i, data="<PubmedData><History/></PubmedData>"):
    return ARTICLE.format(i=i, data=data)


def book(i):
    return BOOK.format(i=i)


def problems(spark, path):
    found = markup.capture_problems(markup.scan_capture(spark, path), markup.capture_files(spark, path))
    return sorted((r.file, r.check, r.detail) for r in found.collect())


def test_sound_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(HEAD + article(1) + book(2) + article(3, "") + article(4, "<PubmedData/>") + TAIL)
    (tmp_path / "b.xml").write_text(HEAD + TAIL)
    (tmp_path / "c.xml").write_text('<?xml version="1.0"?><PubmedArticleSet/>')
    (tmp_path / "d.xml").write_text("<PubmedBookArticleSet>" + book(5) + "</PubmedBookArticleSet>")
    assert problems(spark, str(tmp_path)) == []
    records = markup.read_capture(spark, str(tmp_path))
    per_file = {r.source_file: (r.n_records, r.n_books, r.ids) for r in markup.records_per_file(records).collect()}
    assert per_file == {"a.xml": (4, 1, ["1", "3", "4", "2"]), "d.xml": (1, 1, ["5"])}


@pytest.mark.parametrize(
    "content, check, detail",
    [
        ("", "no_root", "0 bytes"),
        ("<html>no</html>", "no_root", "15 bytes"),
        ("<eFetchResult><ERROR>Empty id list</ERROR></eFetchResult>", "error_body", "Empty id list"),
        (HEAD + article(1) + "<ERROR>later", "error_body", "later"),
        ("<PubmedArticleSet><PubmedArticle>", "unbalanced", "1 roots opened, 0 closed; 1 records opened, 0 closed"),
        (HEAD + article(1) + article(2), "unbalanced", "1 roots opened, 0 closed; 2 records opened, 2 closed"),
        (HEAD + article(1) + article(2)[:-30] + TAIL, "unbalanced", "1 roots opened, 1 closed; 2 records opened, 1 closed"),
        (HEAD + article(1) + TAIL + HEAD + TAIL, "unbalanced", "2 roots opened, 2 closed; 1 records opened, 1 closed"),
        (HEAD + article(1) + TAIL + "junk", "trailing_content", "junk"),
        (HEAD + article(1) + article(2).replace("</Article>", "</Artikel>") + TAIL, "malformed_record", "2"),
        (HEAD + book(3).replace("</Book>", "") + TAIL, "malformed_record", "3"),
        (HEAD + article(4).replace("T 4", "a < b") + TAIL, "malformed_record", "4"),
    ],
)
def test_broken_files(spark, tmp_path, content, check, detail):
    (tmp_path / "ok.xml").write_text(HEAD + article(9) + TAIL)
    (tmp_path / "x.xml").write_text(content)
    assert problems(spark, str(tmp_path)) == [("x.xml", check, detail)]
    with pytest.raises(markup.CaptureError, match=f"x.xml: {check}"):
        markup.read_capture(spark, str(tmp_path))
    assert [r.pmid for r in markup.read_capture(spark, str(tmp_path), skip=True).collect()] == ["9"]


def test_a_file_of_books_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "books.xml").write_text(HEAD + "".join(book(i) for i in range(10_000)) + TAIL)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        raw = markup.read_record_xml(spark, str(tmp_path))
        tasks = raw.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
        assert len(tasks) > 4 and max(t["count"] for t in tasks) < 4_000
        (file,) = markup.records_per_file(markup.read_capture(spark, str(tmp_path))).collect()
        assert (file.n_records, file.n_books) == (10_000, 10_000) and file.ids == [str(i) for i in range(10_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_wanted_columns_only_and_one_listing(spark, tmp_path):
    (tmp_path / "a.xml").write_text(HEAD + article(1) + book(2) + TAIL)
    (tmp_path / "b.xml").write_text(HEAD + article(3).replace("</Article>", "</Artikel>") + TAIL)
    (tmp_path / "c.xml").write_text("")
    path = str(tmp_path)
    pieces, files = markup.scan_files(spark, path, columns=("language",))
    assert "language" in pieces.columns and not {"abstract", "title"} & set(pieces.columns)
    assert sorted(files.collect()) == sorted(markup.capture_files(spark, path).collect())
    found = sorted((r.file, r.check, r.detail) for r in markup.capture_problems(pieces, files).collect())
    assert found == problems(spark, path) == [("b.xml", "malformed_record", "3"), ("c.xml", "no_root", "0 bytes")]
    records, _ = markup.read_whole(spark, path, skip=True, columns=())
    assert sorted((r.pmid, r.record_type) for r in records.collect()) == [("1", markup.ARTICLE), ("2", markup.BOOK)]
    every = set(markup.parse_records(markup.read_record_xml(spark, path)).columns)
    assert set(markup.read_capture(spark, path, skip=True).columns) == every - {"malformed"}


def test_text_of_fragments(spark):
    parts = ["a<br>b", "a <i>b</i> c", "x &amp;lt; y", "&#x41;<!-- c -->B", " p  　\t q ", "plain", "", None]
    got = [r.t for r in spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, p string").orderBy("i").select(markup.flat_text(F.col("p")).alias("t")).collect()]
    assert got == ["a b", "a b c", "x &lt; y", "AB", "p q", "plain", "", ""]


def test_every_white_space_character_is_one_run(spark):
    letters = spark.createDataFrame([(i, f"a{chr(i)}b") for i in range(1, 0x3100)], "id int, t string")
    blank = {r.id for r in letters.where(normalise_space("t") == "a b").collect()}
    assert blank == {i for i in range(1, 0x3100) if chr(i).isspace()}
