"""Rule tables: term dictionaries as data, read with Spark and held as a rule book.

A rule table has one row per rule.  Only rule tables come to the driver, where their patterns are translated: a few
hundred bytes a rule, whatever the corpus.  A small book becomes one expression, a large one an index (``operators/rule_index.py``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import patterns
from tallymark.vocab import CATCH_ALL, MATCH_ONLY, MODALITIES, THEMES, canonical_order

RULE_SCHEMA = T.StructType(
    [
        T.StructField("dictionary", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("case_sensitive", T.BooleanType()),
        T.StructField("pattern", T.StringType()),
    ]
)

_ENTRY = "array<struct<pattern:string,kind:string,case_sensitive:boolean>>"
_FILE_SCHEMA = f"version int, categories map<string, struct<include:{_ENTRY}, exclude:{_ENTRY}>>"


@dataclass(frozen=True)
class Rule:
    dictionary: str
    category: str
    role: str
    idx: int
    kind: str
    pattern: str
    case_flag: bool | None = None
    ordinal: int = -1

    @property
    def pattern_id(self) -> str:
        return f"{self.category}:{self.role}[{self.idx}]"

    @property
    def case_sensitive(self) -> bool:
        if self.kind == "phrase":
            return bool(self.case_flag)
        return not ("i" in patterns.inline_flags(self.pattern) or self.case_flag is False)

    @property
    def java(self) -> str:
        if self.kind == "phrase":
            return patterns.phrase_to_java(self.pattern, bool(self.case_flag))
        return patterns.regex_to_java(self.pattern, self.case_flag)

    @property
    def java_after_prefix(self) -> str:
        """``java`` with the text before the first match as group 1."""
        if self.kind == "phrase":
            return patterns.after_prefix(self.java)
        return patterns.after_prefix(patterns.regex_to_java(self.pattern, self.case_flag, 1))

    @property
    def words(self) -> tuple[str, ...]:
        """Whole words a case-insensitive phrase needs, or none if that cannot be said."""
        if self.kind != "phrase" or self.case_flag:
            return ()
        return patterns.required_words(self.pattern)

    @property
    def literals(self) -> tuple[str, ...]:
        return patterns.required_literals(self.pattern, self.kind)

    @property
    def filed_under(self) -> tuple[str, ...]:
        """Whole folded words of which a text needs at least one, or none if that cannot be said."""
        return patterns.whole_words(self.pattern, self.kind)


@dataclass(frozen=True)
class RuleBook:
    """Both term dictionaries, ordered, with one ordinal per rule."""

    themes: tuple[str, ...]
    modalities: tuple[str, ...]
    match_only: tuple[str, ...]
    rules: tuple[Rule, ...] = field(repr=False)
    #: The version that each dictionary's file states.
    versions: tuple[tuple[str, int], ...] = ()

    @classmethod
    def of(cls, rows, versions: dict[str, int] | None = None) -> RuleBook:
        """Build from ``(dictionary, category, role, idx, kind, case_sensitive, pattern)``.

        A row with a null pattern declares a category that has no rule of its own.
        """
        rows = list(rows)
        seen: dict[str, list[str]] = {"theme": [], "modality": []}
        rules = []
        for dictionary, category, role, idx, kind, case, pattern in rows:
            if category not in seen[dictionary]:
                seen[dictionary].append(category)
            if pattern is not None:
                rules.append(
                    Rule(dictionary, category, role, idx, kind or "phrase", pattern, case, len(rules))
                )
        labels = [k for k in seen["modality"] if k not in MATCH_ONLY]
        if CATCH_ALL not in labels:
            labels.append(CATCH_ALL)
        return cls(
            tuple(canonical_order(seen["theme"], THEMES)),
            tuple(canonical_order(labels, MODALITIES)),
            tuple(k for k in seen["modality"] if k in MATCH_ONLY),
            tuple(rules),
            tuple(sorted((versions or {}).items())),
        )

    @classmethod
    def from_table(cls, table: DataFrame) -> RuleBook:
        order = ["dictionary", "category_position", "category", "role", "idx"]
        keys = [c for c in order if c in table.columns]
        rows = table.orderBy(*[F.desc(k) if k == "role" else k for k in keys])
        rows = rows.select(*RULE_SCHEMA.fieldNames(), *(["version"] if "version" in table.columns else [])).collect()
        versions = {r["dictionary"]: r["version"] for r in rows if "version" in r and r["version"] is not None}
        return cls.of((tuple(r)[: len(RULE_SCHEMA)] for r in rows), versions)

    def rows(self) -> list[tuple]:
        """The rules, and a row without a pattern for each category, as :meth:`of` takes them."""
        declared = [("theme", k) for k in self.themes] + [("modality", k) for k in (*self.modalities, *self.match_only)]
        stated = [(r.dictionary, r.category, r.role, r.idx, r.kind, r.case_flag, r.pattern) for r in self.rules]
        return stated + [(d, k, None, None, None, None, None) for d, k in declared]

    def of_category(self, dictionary: str, category: str, role: str) -> list[Rule]:
        return [
            r
            for r in self.rules
            if (r.dictionary, r.category, r.role) == (dictionary, category, role)
        ]

    def table(self, spark: SparkSession, fallback: int | None = None) -> DataFrame:
        """The rules with their derived columns, one row per rule.

        ``fallback`` adds the row that stands for "no rule fired" under that ordinal.
        """
        rows = [
            (r.ordinal, r.dictionary, r.category, r.role, r.pattern_id, r.kind,
             int(r.case_sensitive), r.pattern)
            for r in self.rules
        ]
        if fallback is not None:
            rows.append(
                (fallback, "modality", CATCH_ALL, "fallback", f"{CATCH_ALL}:fallback", "", 0, "")
            )
        return spark.createDataFrame(
            rows,
            "ordinal int, dictionary string, category string, role string, pattern_id string, "
            "kind string, case_sensitive int, pattern string",
        )


def read_rule_file(spark: SparkSession, path: str, dictionary: str) -> DataFrame:
    """A dictionary document ``{version, categories: {key: {include, exclude}}}`` as rows."""
    doc = spark.read.schema(_FILE_SCHEMA).option("multiLine", True).json(path)
    cats = doc.select("version", F.posexplode("categories").alias("category_position", "category", "c"))
    none = F.lit(None).cast("array<struct<pattern:string,kind:string,case_sensitive:boolean>>")
    sides = cats.select(
        "version",
        "category_position",
        "category",
        F.explode(
            F.array(
                F.struct(F.lit("include").alias("role"), F.coalesce("c.include", none).alias("e")),
                F.struct(F.lit("exclude").alias("role"), F.coalesce("c.exclude", none).alias("e")),
            )
        ).alias("s"),
    )
    rows = sides.select(
        "version", "category_position", "category", "s.role", F.posexplode_outer("s.e").alias("idx", "r")
    )
    return rows.where((F.col("role") == "include") | F.col("idx").isNotNull()).select(
        F.lit(dictionary).alias("dictionary"),
        "category_position",
        "category",
        "role",
        F.coalesce("idx", F.lit(0)).alias("idx"),
        F.when(F.col("r").isNotNull(), F.coalesce("r.kind", F.lit("phrase"))).alias("kind"),
        "r.case_sensitive",
        "r.pattern",
        "version",
    )


def fingerprint(rules: DataFrame, key: str = "dictionary") -> DataFrame:
    """One digest per rule file over its rows, in whatever order they are."""
    from tallymark.sources.lineage import table_digest

    versions = rules.groupBy(key).agg(F.max("version").alias("version"))
    return versions.join(table_digest(rules, [key], ["version"]), key).select(key, "version", "sha256")
