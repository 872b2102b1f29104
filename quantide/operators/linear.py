"""Least squares from sufficient statistics: one pass makes the Gram matrix of all regressors and targets, whatever the
number of rows; the driver solves a small system."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """Sums of products of (1, columns) over the rows that have all of them, and the number of those rows."""
    size = len(columns) + 1

    def run(batches):
        total = np.zeros((size, size))
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *(np.asarray(c.to_numpy(zero_copy_only=False), float) for c in b.columns)])
            x = x[np.isfinite(x).all(1)]
            total += x.T @ x
        yield pa.record_batch([pa.array(np.repeat(np.arange(size), size)), pa.array(np.tile(np.arange(size), size)), pa.array(total.ravel())], ["i", "j", "v"])

    rows = df.select(*(F.col(c).cast("double") for c in columns)).mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((size, size))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return out, int(round(out[0, 0]))


@dataclass
class Linear:
    features: list[str]
    intercept: float
    beta: list[float]
    sigma2: float
    n: int

    def predict(self) -> Column:
        return sum((F.col(c) * b for c, b in zip(self.features, self.beta)), F.lit(self.intercept))


def ols(df: DataFrame, features: list[str], targets: list[str]) -> dict[str, Linear | None]:
    """Least squares of each target, of least norm where the features are dependent; None with fewer rows than
    coefficients."""
    g, _ = gram(df, [*features, *targets])
    return _ols(g, features, targets)


def ols_each(df: DataFrame, wanted: dict[Any, tuple[list[str], str]]) -> dict[Any, Linear | None]:
    """Least squares for each name: (features, target), each on the rows that it can use, from one pass."""
    found = grams(df, wanted)
    return {k: _ols(found[k], f, [t])[t] for k, (f, t) in wanted.items()}


def _ols(g: np.ndarray, features: list[str], targets: list[str]) -> dict[str, Linear | None]:
    n, p = int(round(g[0, 0])), len(features) + 1
    out = {}
    for k, t in enumerate(targets):
        if n < p:
            out[t] = None
            continue
        b = np.linalg.pinv(g[:p, :p], hermitian=True, rcond=1e-12) @ g[:p, p + k]
        res = g[p + k, p + k] - 2 * b @ g[:p, p + k] + b @ g[:p, :p] @ b
        out[t] = Linear(features, float(b[0]), b[1:].tolist(), float(max(res, 0) / max(n - p, 1)), n)
    return out


def grams(df: DataFrame, wanted: dict[Any, tuple[list[str], str]]) -> dict[Any, np.ndarray]:
    """For each name: (features, target) the sums of products of (1, features, target) over the rows that have all of
    those, all from one pass: a row that lacks one target still counts for the others."""
    columns = list(dict.fromkeys(c for f, t in wanted.values() for c in (*f, t)))
    place = {c: k for k, c in enumerate(columns)}
    names = list(wanted)
    own = [[place[c] for c in (*f, t)] for f, t in wanted.values()]

    def run(batches):
        total = [np.zeros((len(o) + 1, len(o) + 1)) for o in own]
        for b in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in b.columns])
            for g, o in zip(total, own):
                y = x[:, o]
                y = np.column_stack([np.ones(len(y)), y])[np.isfinite(y).all(1)]
                g += y.T @ y
        for k, g in enumerate(total):
            i, j = np.indices(g.shape).reshape(2, -1)
            yield pa.record_batch([pa.array(np.full(g.size, k)), pa.array(i), pa.array(j), pa.array(g.ravel())], ["k", "i", "j", "v"])

    sums = df.select(*(F.col(c).cast("double") for c in columns)).mapInArrow(run, "k bigint, i bigint, j bigint, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v"))
    out = [np.zeros((len(o) + 1, len(o) + 1)) for o in own]
    for r in sums.collect():
        out[r["k"]][r["i"], r["j"]] = r["v"]
    return dict(zip(names, out))


def ridge_each(df: DataFrame, wanted: dict[Any, tuple[list[str], str]], alpha: float = 1.0) -> dict[Any, Linear | None]:
    """A ridge model for each name: (features, target), each on the rows that it can use."""
    found = grams(df, wanted)
    return {k: _ridge(found[k], f, [t], alpha)[t] for k, (f, t) in wanted.items()}


def model_table(spark, models: dict[tuple, Linear | None], keys: str) -> DataFrame:
    """The models as rows: the columns of keys (DDL), intercept, beta, sigma2, n_train; those that couldn't be fitted are left out."""
    rows = [(*k, m.intercept, m.beta, m.sigma2, m.n) for k, m in models.items() if m]
    return spark.createDataFrame(rows, f"{keys}, intercept double, beta array<double>, sigma2 double, n_train bigint")


#: Rows of a model table up to which it is sent to every executor; a larger one is joined by shuffling.
BROADCAST_MODELS = 100_000


def looked_up(rows: DataFrame, models: DataFrame, keys: list[str], features: str = "features", to: str = "forecast") -> DataFrame:
    """rows with the forecast of the model of their keys: intercept + beta . features (an array). Rows without a model, or
    without one of the features, get null."""
    small = models.limit(BROADCAST_MODELS + 1).count() <= BROADCAST_MODELS
    met = rows.join(F.broadcast(models) if small else models, keys, "left")
    dot = F.aggregate(F.zip_with(features, "beta", lambda x, b: x * b), F.lit(0.0), lambda a, x: a + x)
    return met.withColumn(to, F.col("intercept") + dot)


def smearing_factor(residual: Column, sigma2: Column, cut: float = 3.0) -> Column:
    """Duan's factor, the mean of exp(residual), with residuals cut at `cut` deviations; an aggregate by model."""
    most = F.sqrt(sigma2) * cut
    return F.avg(F.exp(F.least(F.greatest(residual, -most), most)))


def ridge(df: DataFrame, features: list[str], targets: list[str], alpha: float = 1.0) -> dict[str, Linear | None]:
    """Ridge on standardised features (population deviation, 1 where it is 0), the intercept free."""
    g, _ = gram(df, [*features, *targets])
    return _ridge(g, features, targets, alpha)


def _ridge(g: np.ndarray, features: list[str], targets: list[str], alpha: float) -> dict[str, Linear | None]:
    n, p = int(round(g[0, 0])), len(features)
    if n < p + 1:
        return dict.fromkeys(targets)
    mean = g[0, 1 : p + 1] / n
    cov = g[1 : p + 1, 1 : p + 1] - n * np.outer(mean, mean)
    # A constant column's variance is what rounding leaves of its mean square: it counts as 0.
    square = np.diag(g)[1 : p + 1] / n
    constant = np.diag(cov) / n <= 1e-12 * square
    cov[constant, :] = cov[:, constant] = 0
    sd = np.where(constant, 1.0, np.sqrt(np.maximum(np.diag(cov) / n, 0)))
    zz, out = cov / np.outer(sd, sd), {}
    for k, t in enumerate(targets):
        ybar = g[0, p + 1 + k] / n
        zy = (g[1 : p + 1, p + 1 + k] - n * mean * ybar) / sd
        b = np.linalg.solve(zz + alpha * np.eye(p), zy) / sd
        yy = g[p + 1 + k, p + 1 + k] - n * ybar * ybar
        cy = g[1 : p + 1, p + 1 + k] - n * mean * ybar
        out[t] = Linear(features, float(ybar - mean @ b), b.tolist(), float(max(yy - 2 * b @ cy + b @ cov @ b, 0) / max(n - p - 1, 1)), n)
    return out
