"""All query bindings, imported once so their ``@query`` registrations run."""

from __future__ import annotations

import importlib

from gradus.plans.registry import ORACLE, QUERIES

MODULES = ("q_rank", "q_text", "q_score", "q_split", "q_loss", "q_vec", "q_io")

for _m in MODULES:
    importlib.import_module(f"gradus.plans.{_m}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
