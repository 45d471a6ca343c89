"""All registered queries of the library, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib

FLAGSHIP = "consensus_vote"
MODULES = ["theory", "readings", "votes", "consensus", "windows", "joins", "statistics", "catalog", "texts", "melodies", "scores", "sequences", "structure", "pages", "checks", "measures", "evaluations", "streams"]

_found: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def keep(f):
        _found[f.__name__] = (f, sql)
        return f

    return keep


def _all() -> dict[str, tuple]:
    for name in MODULES:
        importlib.import_module(f"tonalframe.plans.{name}")
    return _found


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in _all().items() if sql}
