"""All queries of the core and their SQL; the llm subpackage's are added by the entry module if it is there."""

from __future__ import annotations

from . import cookbook, core_problems, inventory, oracles, screening

MODULES = [cookbook, screening, inventory, core_problems]


def queries() -> dict:
    out = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in MODULES:
        out.update(m.ORACLE)
    return out | oracles.build(screening.EDGES) | oracles.UNITS | oracles.DRIFT
