"""Measure the rules against a second labeler."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallymark.operators import sampling, scoring


@dataclass(frozen=True)
class Measurement:
    """Scores of one labelled sample; ``keys`` are bare category names."""

    joined: DataFrame
    keys: tuple[str, ...]

    @property
    def agreement(self) -> DataFrame:
        return scoring.agreement_table(self.joined, self.keys)

    @property
    def disagreements(self) -> DataFrame:
        return scoring.disagreements(self.joined, self.keys)

    @property
    def exact_match(self) -> DataFrame:
        return scoring.exact_match_rate(self.joined, self.keys)


def measure(design: DataFrame, agent: DataFrame, labels: DataFrame | None = None) -> Measurement:
    """Join a drawn sample to the labels read for it, refreshing the rule side if asked.

    Refuses when the two id sets differ or a sampled record has left the corpus: either
    would change a denominator without saying so.
    """
    if labels is not None:
        design = sampling.refresh_labels(design, labels)
        if not sampling.lost_ids(design).isEmpty():
            raise ValueError("sampled ids are absent from the label table")
    if not scoring.id_mismatch(design, agent).isEmpty():
        raise ValueError("sample and agent sheets do not hold the same ids")
    keys = tuple(scoring.bare(c) for c in design.columns if c.startswith(("theme_", "mod_")))
    return Measurement(scoring.join_labels(design, agent), keys)
