"""Registered queries: one Spark function per operator, with the SQL it must equal."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lakeward.plans.fixtures import Tables


@dataclass(frozen=True)
class Case:
    run: Callable[[Tables], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}

_MODULES = [
    "models",
    "projections",
    "aggregates",
    "functions",
    "quality",
    "sources",
    "sinks",
    "maintenance",
    "catalog",
    "metering",
    "workload",
    "streaming",
    "statements",
]


def case(name: str, sql: str | None = None):
    """Register a function of the given tables under a name."""

    def register(run: Callable[[Tables], DataFrame]):
        if name in CASES:
            raise ValueError(f"case {name} is registered twice")
        CASES[name] = Case(run, sql)
        return run

    return register


def load_all() -> dict[str, Case]:
    for module in _MODULES:
        importlib.import_module(f"lakeward.cases.{module}")
    return CASES
