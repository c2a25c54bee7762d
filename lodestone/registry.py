"""All registered queries of the library and the SQL that they can be held against."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("plans.lexical", "plans.ranking", "plans.timeline", "plans.quality", "plans.lifecycle", "plans.records", "plans.flow", "plans.questions", "plans.network", "plans.kernels", "plans.feedback", "plans.evidence", "plans.store", "plans.texts", "plans.recall", "plans.governance", "plans.cards", "plans.conflicts", "plans.hops", "plans.resemblance", "plans.journal")


def queries() -> dict:
    out: dict = {}
    for module in MODULES:
        out |= import_module(f"{__package__}.{module}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES:
        out |= import_module(f"{__package__}.{module}").SQL
    return out
