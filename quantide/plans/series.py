"""The per-second base table that features, targets and evaluations start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import bars, features, rolling
from ..sources import io


def bar_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered bars, written once to the shared folder: everything else of a query starts from that table."""
    return io.stored(bars.bars(bars.quotes(spark, sf_dir)))


def price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.prices(bar_table(spark, sf_dir))


def with_features(prices: DataFrame, make: Callable[[DataFrame], DataFrame], before: int, after: int = 0, chunk: int = rolling.CHUNK) -> DataFrame:
    """prices with returns and a group of features, in one pass over chunks; before covers the group's windows."""
    return rolling.windowed(prices, lambda df: make(features.returns(df)), before + 4, after, chunk)


def base_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_features(price_table(spark, sf_dir), lambda df: df, 4)
