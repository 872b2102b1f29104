"""Fitted models as a versioned table: a row for each version with its metric and its model as text, appended by a training run
and read back by the best metric (or the latest version), whatever the kind of model."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DDL = "name string, version int, metric double, model string"


def append(spark: SparkSession, path: str, name: str, versions: Iterable[tuple[int, float, str]]) -> None:
    """versions: (version, metric, text). One folder for each name, so that reading one model reads no other's."""
    rows = spark.createDataFrame([(name, int(v), float(m), t) for v, m, t in versions], DDL)
    rows.coalesce(1).write.mode("append").partitionBy("name").parquet(path)


def versions(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(DDL).parquet(path).filter(F.col("name") == name)


def best(spark: SparkSession, path: str, name: str, least: bool = True) -> tuple[int, float, str]:
    """The version of the best metric (the least, or the largest), of equal ones the earliest. A missing name is an error."""
    order = F.col("metric").asc_nulls_last() if least else F.col("metric").desc_nulls_last()
    row = versions(spark, path, name).orderBy(order, "version").first()
    if row is None:
        raise ValueError(f"no model named {name!r}")
    return row["version"], row["metric"], row["model"]


def latest(spark: SparkSession, path: str, name: str) -> tuple[int, float, str]:
    row = versions(spark, path, name).orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError(f"no model named {name!r}")
    return row["version"], row["metric"], row["model"]
