"""All queries over the driver's tables and the SQL that each must equal."""

from __future__ import annotations

import importlib

from lexora.plans import study

MODULES = ("q_text", "q_models", "q_vocab", "q_reports", "q_canonical")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"lexora.plans.{name}")


def queries() -> dict:
    _load()
    return dict(study.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(study.SQL)
