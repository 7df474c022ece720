"""Scans, sinks, snapshots and incremental runs."""

import json

import pytest
from pyspark.sql import functions as F

from tallymark import catalog
from tallymark.operators import dedup
from tallymark.session import shared_folder
from tallymark.sources import lookup, markup, tables
from tallymark.streaming import incremental

ARTICLE = """<PubmedArticle><MedlineCitation Status="M"><PMID Version="1">{pmid}</PMID><Article>
<Journal><JournalIssue><PubDate>{pub}</PubDate></JournalIssue><Title>A  Journal</Title><ISOAbbreviation>A J</ISOAbbreviation></Journal>
<ArticleTitle>Use of <i>H&amp;E</i> in CO<sub>2</sub> <b>x</b></ArticleTitle>{abstract}
<Language>eng</Language><Language>fre</Language>
<PublicationTypeList><PublicationType UI="D1">Review</PublicationType></PublicationTypeList>{dates}
</Article><MeshHeadingList><MeshHeading><DescriptorName UI="1" MajorTopicYN="Y">Lung</DescriptorName><QualifierName>q</QualifierName></MeshHeading>
<MeshHeading><DescriptorName UI="2" MajorTopicYN="N">Humans</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><History><PubMedPubDate PubStatus="received"><Year>2001</Year></PubMedPubDate><PubMedPubDate PubStatus="pubmed"><Year>2015</Year></PubMedPubDate></History>
<ArticleIdList><ArticleId IdType="pubmed">1</ArticleId><ArticleId IdType="doi">10.1/{pmid}</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
"""
BOOK = """<PubmedBookArticle><BookDocument><PMID>77</PMID><Book><BookTitle>The <i>Book</i></BookTitle><PubDate><Year>2012</Year></PubDate></Book>
<Language>eng</Language><Abstract><AbstractText>Chapter text</AbstractText></Abstract></BookDocument></PubmedBookArticle>
"""
FULL = '<Abstract><AbstractText Label="AIM">To <b>test</b></AbstractText><AbstractText Label="END"/><AbstractText>Rest.</AbstractText><CopyrightInformation>no</CopyrightInformation></Abstract>'


@pytest.fixture(scope="module")
def capture(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    one = BOOK + ARTICLE.format(pmid="1", pub="<Year>2016</Year>", abstract=FULL, dates="<ArticleDate><Year>2015</Year></ArticleDate><ArticleDate><Year>2014</Year></ArticleDate>")
    one += ARTICLE.format(pmid="2", pub="<MedlineDate>2019 Winter-2020</MedlineDate>", abstract="", dates="<ArticleDate><Year>2021</Year></ArticleDate>")
    two = ARTICLE.format(pmid="1", pub="<Year>1999</Year>", abstract="", dates="")
    two += ARTICLE.format(pmid="3", pub="", abstract="<Abstract><AbstractText>Plain</AbstractText></Abstract>", dates="")
    head = '<?xml version="1.0"?>\n<PubmedArticleSet>\n'
    (folder / "batch_001.xml").write_text(head + one + "</PubmedArticleSet>\n")
    (folder / "batch_002.xml").write_text(head + two + "</PubmedArticleSet>\n")
    return str(folder)


def test_xml_records(spark, capture):
    records = markup.parse_records(markup.read_record_xml(spark, capture))
    assert records.count() == 5
    per_file = {r["source_file"]: (r["n_records"], r["n_books"]) for r in markup.records_per_file(records).collect()}
    assert per_file == {"batch_001.xml": (3, 1), "batch_002.xml": (2, 0)}
    first = {r["pmid"]: r for r in dedup.keep_first(records, "pmid", markup.RECORD_ORDER).collect()}
    assert sorted(first) == ["1", "2", "3", "77"]
    r = first["1"]
    assert r["title"] == "Use of H&E in CO2 x" and r["doi"] == "10.1/1" and r["journal"] == "A Journal"
    assert (r["abstract"], r["abstract_structured"], r["abstract_sections"]) == ("AIM: To test\n\nRest.", True, 2)
    assert (r["year"], r["year_source"], r["article_date_year"], r["pub_date_year"]) == (2014, "ArticleDate", 2014, 2016)
    assert r["mesh_descriptors"] == ["Lung", "Humans"] and r["mesh_major_descriptors"] == ["Lung"]
    assert (r["language"], r["languages"], r["publication_types"]) == ("eng", ["eng", "fre"], ["Review"])
    assert (first["2"]["year"], first["2"]["year_source"], first["2"]["has_abstract"]) == (2019, "PubDate[MedlineDate]", False)
    assert (first["3"]["year"], first["3"]["year_source"]) == (2015, "PubMedPubDate[pubmed]")
    book = first["77"]
    assert (book["title"], book["journal"], book["year"], book["record_type"]) == ("The Book", "The Book", 2012, "PubmedBookArticle")
    assert book["abstract"] == "Chapter text" and book["mesh_descriptors"] == []


def test_small_splits_give_the_same_records(spark, capture, rows):
    whole = markup.parse_records(markup.read_record_xml(spark, capture))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        split = markup.parse_records(markup.read_record_xml(spark, capture))
        assert split.rdd.getNumPartitions() > 2
        got = rows(dedup.keep_first(split, "pmid", markup.RECORD_ORDER), "pmid", "title", "abstract", "year", "source_file")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == rows(dedup.keep_first(whole, "pmid", markup.RECORD_ORDER), "pmid", "title", "abstract", "year", "source_file")


def test_all_text_csv_keeps_digits_and_drops_a_byte_order_mark(spark, tmp_path):
    path = tmp_path / "devices.csv"
    path.write_bytes("﻿Date of Final Decision,Submission Number,Device,Company,Panel (Lead),Primary Product Code,submission\n"
                     "01/02/2020,K0012,\"A, \"\"B\"\"\",,Radiology,892.2050,x\n".encode())
    got = tables.read_devices(spark, str(path))
    row = got.first().asDict()
    assert row["Submission Number"] == "K0012" and row["Primary Product Code"] == "892.2050" and row["Device"] == 'A, "B"'
    assert row["Date of Final Decision"] == "01/02/2020" and row["Company"] in ("", None) and "submission" not in row
    path.write_text("a,b\n1,2\n")
    with pytest.raises(tables.TableError, match="missing"):
        tables.read_devices(spark, str(path))


def test_commented_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("# file: t\n# v1\ntheme,year\na,2019\n")
    assert tables.read_commented_csv(spark, str(path), "theme string, year int").first()["year"] == 2019
    with pytest.raises(tables.TableError, match="n_papers"):
        tables.read_commented_csv(spark, str(path), "theme string, n_papers int")
    path.write_text("# file: t\ntheme,year\n")
    with pytest.raises(tables.TableError, match="no rows"):
        tables.read_commented_csv(spark, str(path), "theme string, year int")


def test_record_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("007", "t", "a\n\"b\", c", 2019, "PubmedArticle", ["x", "y"])],
        "pmid string, title string, abstract string, year int, record_type string, publication_types array<string>",
    )
    tables.write_records(df, str(tmp_path / "out"))
    kept = tables.read_records(spark, str(tmp_path / "out/parquet")).first()
    assert kept["publication_types"] == ["x", "y"] and kept["pmid"] == "007"
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_records(df, str(tmp_path / "out"))
    with pytest.raises(tables.TableError, match="abstract"):
        df.drop("abstract").write.parquet(str(tmp_path / "short"))
        tables.read_records(spark, str(tmp_path / "short"))


def test_lookup_last_file_wins_and_blanks_are_null(spark, tmp_path):
    doc = lambda *r: json.dumps({"meta": 1, "results": [dict(zip(("product_code", "device_name", "regulation_number"), x)) for x in r]}, indent=1)
    (tmp_path / "lookup_001.json").write_text(doc(("AAA", "old", "1"), (" ", "none", "1"), ("BBB", "", " 2 ")))
    (tmp_path / "lookup_002.json").write_text(doc(("AAA ", "new", "")))
    got = {r["product_code"]: (r["device_name"], r["regulation_number"]) for r in lookup.read_lookup(
        spark, str(tmp_path), fields=["device_name", "regulation_number"]).collect()}
    assert got == {"AAA": ("new", None), "BBB": (None, "2")}


def test_snapshots_are_never_written_over(spark, tmp_path):
    root = str(tmp_path / "caps")
    tables.write_snapshot(spark.range(2), root, "2026-01-01")
    tables.write_snapshot(spark.range(3), root, "2026-02-01")
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_snapshot(spark.range(4), root, "2026-02-01")
    captures = spark.read.parquet(root)
    manifest = spark.createDataFrame([("2026-01-01",)], "snapshot string").withColumn("snapshot", F.to_date("snapshot"))
    assert lookup.latest_finished(captures, manifest).count() == 2
    with pytest.raises(FileNotFoundError):
        lookup.latest_finished(captures, manifest.where("false"))


def test_incremental_run_takes_only_new_files(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for n in (3, 5):
        spark.range(n).write.mode("append").parquet(src)
        stream = incremental.landed(spark, src, "id bigint")
        incremental.run_available(stream, lambda df: df.withColumn("x", F.col("id") * 2), out, state)
    assert spark.read.parquet(out).count() == 8
    incremental.run_available(incremental.landed(spark, src, "id bigint"), lambda df: df.withColumn("x", F.col("id")), out, state)
    assert spark.read.parquet(out).count() == 8


def test_shared_folder_is_the_one_the_cluster_names(spark):
    class Named:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.checkpoint.dir": "/named/by/cluster"}.get(key, default)

    assert shared_folder(Named()) == "/named/by/cluster"
    assert shared_folder(spark) == shared_folder(spark)


def test_every_query_has_a_row_in_the_inventory_and_sql():
    queries, sql = catalog.load()
    from tallymark.catalog.common import COVERS

    assert set(sql) <= set(queries) and set(COVERS) == set(queries)
    assert all(COVERS.values())
