"""Every operator as a query over the test tables, with its SQL where SQL can say it."""

from __future__ import annotations

from tallymark.catalog.common import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    from tallymark.catalog import (  # noqa: F401
        audit,
        columns,
        contracts,
        counting,
        labelling,
        registry,
        scans,
    )

    return QUERIES, ORACLES
