"""Rates and intervals; undefined is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.text import col
from tallymark.vocab import THIN_EVIDENCE_BELOW, WILSON_Z


def rate(numerator, denominator) -> Column:
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def wilson(successes, trials, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Lower and upper end of the score interval of a proportion."""
    n = F.when(col(trials) > 0, col(trials).cast("double"))
    p = col(successes).cast("double") / n
    z2 = z * z
    scale = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / scale
    spread = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / scale
    # greatest and least skip nulls, so the undefined case has to be kept by hand
    low = F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - spread))
    high = F.when(n.isNotNull(), F.least(F.lit(1.0), centre + spread))
    return low, high


def f1(tp, fp, fn) -> Column:
    """Null when there are no cases at all, 0 when there are but none was right."""
    tp, fp, fn = col(tp).cast("double"), col(fp).cast("double"), col(fn).cast("double")
    precision, recall = rate(tp, tp + fp), rate(tp, tp + fn)
    return (
        F.when(tp > 0, 2 * precision * recall / (precision + recall))
        .when(tp + fp + fn == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(0.0))
    )


def thin_mark(n_system, n_reference, below: int = THIN_EVIDENCE_BELOW) -> Column:
    """``!`` where a rate rests on few cases on either side."""
    return F.when(F.least(col(n_system), col(n_reference)) < below, "!").otherwise("")
