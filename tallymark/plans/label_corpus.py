"""Label a corpus: scan, filter, match, reduce, write, re-check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators import counts, labelling
from tallymark.sources.lineage import book_lineage, write_lineage
from tallymark.sources.rules import RuleBook
from tallymark.sources.tables import observed, observed_metrics, run_metrics, write_table
from tallymark.vocab import RECORD_EXCLUSIONS


@dataclass(frozen=True)
class CorpusRun:
    """Lazy outputs of one run, all projections of one annotated table."""

    annotated: DataFrame
    book: RuleBook
    #: Records per secondary publication type, before the rules.
    secondary: DataFrame | None = None

    @property
    def labels(self) -> DataFrame:
        return labelling.labels(self.annotated)

    @property
    def hits(self) -> DataFrame:
        return labelling.pattern_hits(self.annotated, self.book)

    @property
    def ledger(self) -> DataFrame:
        return labelling.ledger(self.annotated, self.book)

    @property
    def exclusions(self) -> DataFrame:
        return counts.exclusion_counts(self.annotated, RECORD_EXCLUSIONS)

    def metrics(self, profile: DataFrame) -> DataFrame:
        populations = profile.groupBy().agg(
            F.sum("n").alias("retained"),
            F.sum(F.when(F.col("is_primary_research") == 1, F.col("n")).otherwise(0)).alias("primary"),
        )
        totals = counts.label_totals(profile)
        tally = {} if self.secondary is None else {"secondary_type": self.secondary}
        return run_metrics(
            **tally,
            records_retained=populations.select("retained"),
            records_primary=populations.select("primary"),
            excluded=self.exclusions.select("reason", "n_records"),
            label_retained=totals.select("kind", "key", "n_retained"),
            label_primary=totals.select("kind", "key", "n_primary"),
            shortfall_panel_a=counts.minimum_shortfalls(profile).select("theme", "panel_a"),
            shortfall_corpus=counts.minimum_shortfalls(profile).select("theme", "corpus_wide"),
        )


def label_corpus(
    records: DataFrame,
    book: RuleBook,
    year_range: tuple[int, int] | None = None,
    details: bool = False,
) -> CorpusRun:
    """``details`` is needed for excerpts and hit counts; labels alone are cheaper without."""
    return CorpusRun(
        labelling.annotate(records, book, year_range, details),
        book,
        labelling.secondary_tally(records, year_range) if "publication_types" in records.columns else None,
    )


def run_counts() -> dict[tuple[str, str], Column]:
    """What is counted while the annotated rows are written, so that no count needs a second look at them."""
    kept, route = F.col("reason").isNull(), labelling.route_of()
    return {
        ("records_in", ""): F.count(F.lit(1)),
        **{("catch_all_route", r): F.count_if(kept & (route == r)) for r in ("pattern", "fallback")},
        ("rules_fired", ""): F.sum(F.when(kept, F.size(F.filter("fired", lambda f: f["ordinal"] >= 0)))),
    }


def write_corpus(
    run: CorpusRun, out: str, provenance: dict[str, str], partial_year: int | None = None
) -> None:
    """Evaluate the rules once, write the annotated rows, and reduce from what was written.

    The run records the version and digest of its own rules, in ``lineage`` and beside every table;
    ``sources.lineage.read_current`` refuses its tables once the rules have moved.
    """
    spark = run.annotated.sparkSession
    write_lineage(book_lineage(spark, run.book), out)
    made_from = spark.read.parquet(f"{out}/lineage").collect()  # a row per dictionary
    provenance = {**provenance, **{f"{r['file']}_version": str(r["version"]) for r in made_from}, **{f"{r['file']}_sha256": r["sha256"] for r in made_from}}
    annotated, seen = observed(run.annotated, "labelling", run_counts())
    annotated.write.mode("errorifexists").parquet(f"{out}/annotated")
    done = CorpusRun(spark.read.parquet(f"{out}/annotated"), run.book, run.secondary)
    write_table(done.labels, f"{out}/paper_labels", provenance)
    write_table(done.hits, f"{out}/pattern_hits", provenance)
    write_table(done.ledger, f"{out}/exclusions", provenance)
    labels = spark.read.parquet(f"{out}/paper_labels/data")
    write_table(counts.label_profile(labels), f"{out}/label_profile", provenance)
    profile = spark.read.parquet(f"{out}/label_profile/data")
    write_table(counts.combination_counts(profile), f"{out}/combination_counts", provenance)
    write_table(
        counts.theme_year_counts(profile, partial_year), f"{out}/theme_year_counts", provenance
    )
    write_table(done.metrics(profile).unionByName(observed_metrics(spark, seen)), f"{out}/run_metrics", provenance)
