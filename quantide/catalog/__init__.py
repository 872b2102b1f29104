"""Every registered query of the quote engine, by the operator's ID, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import calendar, details, learned, models, relational, storage, windows

_MODULES = (relational, windows, calendar, models, learned, details, storage)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.QUERIES["W01_rolling_sum_w60"](spark, sf_dir)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
