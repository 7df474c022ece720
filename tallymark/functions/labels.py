"""Columns over sets of 0/1 label columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.text import col
from tallymark.vocab import PATHOLOGY_SIDE, RADIOLOGY_SIDE


def flag_sum(columns) -> Column:
    return reduce(lambda a, b: a + b, [col(c) for c in columns], F.lit(0))


def any_flag(columns) -> Column:
    return F.greatest(*[col(c) for c in columns], F.lit(0)) == 1


def _set_keys(keys, prefix: str) -> Column:
    picked = F.array(*[F.when(col(f"{prefix}{k}") == 1, F.lit(k)) for k in keys])
    return F.filter(picked, lambda x: x.isNotNull())


def label_set(keys, prefix: str = "mod_") -> Column:
    """Set labels, alphabetical, joined by ``+``."""
    return F.array_join(_set_keys(sorted(keys), prefix), "+")


def label_string(keys, prefix: str) -> Column:
    """Set labels in the order given, joined by ``+``, or ``(none)``."""
    joined = F.array_join(_set_keys(keys, prefix), "+")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("(none)"))


def set_size(keys, prefix: str = "mod_") -> Column:
    return flag_sum([f"{prefix}{k}" for k in keys])


def domain_of(keys, prefix: str = "mod_") -> Column:
    """both / radiology / pathology / none, from the labels a record carries."""
    rad = [f"{prefix}{k}" for k in keys if k in RADIOLOGY_SIDE]
    path = [f"{prefix}{k}" for k in keys if k in PATHOLOGY_SIDE]
    is_rad = any_flag(rad) if rad else F.lit(False)
    is_path = any_flag(path) if path else F.lit(False)
    return (
        F.when(is_rad & is_path, "both")
        .when(is_rad, "radiology")
        .when(is_path, "pathology")
        .otherwise("none")
    )


def differing(keys, a: str = "rule_", b: str = "agent_") -> list[Column]:
    return [col(f"{a}{k}") != col(f"{b}{k}") for k in keys]


def disagreement_count(keys, a: str = "rule_", b: str = "agent_") -> Column:
    return reduce(lambda x, y: x + y, [d.cast("int") for d in differing(keys, a, b)])


def disagreement_string(keys, a: str = "rule_", b: str = "agent_") -> Column:
    """``key:rule-only; key:agent-only`` or ``(none)``."""
    named = F.array(
        *[
            F.when((col(f"{a}{k}") == 1) & (col(f"{b}{k}") == 0), F.lit(f"{k}:rule-only")).when(
                (col(f"{a}{k}") == 0) & (col(f"{b}{k}") == 1), F.lit(f"{k}:agent-only")
            )
            for k in keys
        ]
    )
    joined = F.array_join(F.filter(named, lambda x: x.isNotNull()), "; ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("(none)"))


def capped(n, top: int) -> Column:
    """0, 1, .. , ``top`` meaning "``top`` or more"."""
    return F.least(col(n), F.lit(top))


def prefix_class(text, prefixes: dict[str, str]) -> Column:
    """Class named by the longest matching prefix; empty string when none matches."""
    value = F.upper(F.trim(F.coalesce(col(text), F.lit(""))))
    out = None
    for prefix in sorted(prefixes, key=len, reverse=True):
        test = value.startswith(prefix)
        out = F.when(test, prefixes[prefix]) if out is None else out.when(test, prefixes[prefix])
    return out.otherwise("")
