"""Registered queries over the given tables, each next to its DuckDB equivalent."""

from __future__ import annotations


def collect() -> tuple[dict, dict]:
    from tidepanel.queries import analytics, intraday, panels, preparation, tables

    found, oracles = {}, {}
    for module in (tables, panels, preparation, analytics, intraday):
        found |= module.QUERIES
        oracles |= module.ORACLES
    return found, oracles
