"""Registry documents: a code rule and decisions on devices, written as several nested files each.

Any number of documents fold into one table.  What two of them say about the same code or device is not
settled by their order: it is a problem row, and what joins the table to devices has one row for each key
all the same, so no device is ever multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import contracts
from tallymark.operators.joins import one_row

#: Groups of excluded codes; each is a reason in the ledger of a run.
GROUPS = ("not_oncology", "indeterminate")
_CODE = "array<struct<code:string, regulation_number:string>>"
CODE_DOCUMENT = (
    f"version int, categories map<string, struct<label:string, domain:string, codes:{_CODE}>>, "
    "overrides array<struct<code:string, domain:string, regulation_number:string>>, "
    "excluded map<string, struct<reason:string, codes:array<struct<code:string, n:bigint, why:string>>>>"
)
DECISION_DOCUMENT = (
    "version int, codes array<string>, n_devices bigint, adjudicated array<struct<submission:string, device:string, "
    "product_code:string, decision:string, category:string, confidence:string, evidence:string>>"
)
NOTHING = "_unread"


#: The last part of a path, as the name of a document.
NAME = r"([^/]+)\z"


def _documents(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    """One row per file with its name, which ``pattern`` takes from the path; a file that is no such document has its text in ``_unread``."""
    read = spark.read.schema(f"{schema}, {NOTHING} string").option("multiLine", True).option("columnNameOfCorruptRecord", NOTHING).json(path)
    return read.select(F.regexp_extract("_metadata.file_path", pattern, 1).alias("source"), "*")


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


class CodeRule:
    """The tables of the code documents below ``path``."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = NAME):
        c = F.col
        self.documents = _documents(spark, path, CODE_DOCUMENT, pattern)
        in_category = self.documents.select("source", F.explode("categories").alias("category", "c"))
        codes = in_category.select("source", "category", "c.label", "c.domain", F.posexplode("c.codes").alias("place", "x"))
        self.overrides = self.documents.select("source", F.explode("overrides").alias("o")).select(
            "source", _text(c("o.code")).alias("code"), c("o.domain").alias("domain"), c("o.regulation_number").alias("regulation_number")
        )
        change = one_row(self.overrides, "code", ["source"]).select(
            "code", c("regulation_number").alias("_number"), F.lit(True).alias("_overridden")
        )
        listed = codes.select(
            "source", "place", _text(c("x.code")).alias("code"), "category", "domain", c("label").alias("category_label"), c("x.regulation_number").alias("regulation_number")
        )
        #: Every listing of a code, folded with its override.
        self.listed = listed.join(change, "code", "left").select(
            "source", "place", "code", "category", "domain", "category_label",
            F.coalesce("_number", "regulation_number").alias("regulation_number"), F.coalesce("_overridden", F.lit(False)).alias("overridden"),
        )
        self.dropped = self.documents.select("source", F.explode("excluded").alias("group", "e")).select(
            "source", "group", F.posexplode("e.codes").alias("place", "x")
        ).select("source", "place", "group", _text(c("x.code")).alias("code"), c("x.n").alias("n"))

    @property
    def assigned(self) -> DataFrame:
        """One row per code, as ``operators.registry.classify_devices`` takes it."""
        return one_row(self.listed, "code", ["source", "category", "place"]).drop("source", "place")

    @property
    def excluded(self) -> DataFrame:
        return one_row(self.dropped, "code", ["source", "group", "place"]).select("code", "group", "n")

    def problems(self) -> DataFrame:
        """Unreadable documents, missing versions, unknown groups, and all that ``contracts.code_rule`` finds over all documents."""
        group = self.dropped.where(~F.col("group").isin(*GROUPS)).select("source", "group").distinct()
        return contracts.all_problems(
            _unread(self.documents),
            contracts._found(group, "unknown_group", F.col("group"), F.col("source")),
            contracts.code_rule(self.listed, self.dropped, self.overrides),
        )


class Decisions:
    """The entries of the decision documents below ``path``."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = NAME):
        self.documents = _documents(spark, path, DECISION_DOCUMENT, pattern)
        fields = ("device", "product_code", "decision", "category", "confidence", "evidence")
        entries = self.documents.select("source", F.posexplode("adjudicated").alias("place", "x"))
        self.entries = entries.select(
            "source", "place", F.upper(_text(F.col("x.submission"))).alias("submission_number"), *[_text(F.col(f"x.{f}")).alias(f) for f in fields]
        )

    @property
    def decisions(self) -> DataFrame:
        """One row per device."""
        return one_row(self.entries, "submission_number", ["source", "place"]).drop("place")

    def problems(self) -> DataFrame:
        """Unreadable documents, entries that are not valid, counts that differ, and devices decided twice, with who said what."""
        declared = self.documents.where("n_devices is not null").select("source", F.col("n_devices").alias("declared"))
        stated = self.entries.join(declared.select("source"), "source", "left_semi")
        said = F.concat_ws(" says ", "source", "decision")
        several = self.entries.groupBy("submission_number").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(said)), ", ").alias("s")).where("n > 1")
        counts = declared.join(stated.groupBy("source").agg(F.count("*").alias("n")), "source", "left").where("declared <> coalesce(n, 0)")
        return contracts.all_problems(
            _unread(self.documents),
            contracts.decision_rule(self.entries).where("check <> 'repeated_key'"),
            contracts._found(counts, "declared_count", F.col("source"), F.concat_ws("<>", F.col("declared").cast("string"), F.coalesce("n", F.lit(0)).cast("string"))),
            contracts._found(several, "decided_twice", F.col("submission_number"), F.col("s")),
        )


def _unread(documents: DataFrame) -> DataFrame:
    broken = documents.select("source", NOTHING, "version").where(f"{NOTHING} is not null or version is null or version < 1")
    check = F.when(F.col(NOTHING).isNotNull(), "unreadable").otherwise("bad_version")
    return broken.select(check.alias("check"), F.col("source").alias("key"), F.coalesce(F.col("version").cast("string"), F.lit("")).alias("detail"))
