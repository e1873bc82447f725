"""Queries of the library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .jobs import assembly, behaviour, cohort, composed, devices, filters, live, outputs, recordings, signals, trialwise

_ALL = recordings.QUERIES | signals.QUERIES | cohort.QUERIES | assembly.QUERIES | behaviour.QUERIES | devices.QUERIES | filters.QUERIES | composed.QUERIES | live.QUERIES | trialwise.QUERIES | outputs.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
