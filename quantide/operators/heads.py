"""A fitted pricing head: logistic regression of a label on market features, by Newton steps over all rows.

A step is one pass: each task adds up the gradient and the Hessian of its rows, Spark sums them by entry, and the driver
solves a system as small as the number of features. Steps end when the largest change of a standardised weight falls
below a tolerance; a step that makes the loss worse is halved. The weights of every step are rows, so that they can be
stored and the best one on other rows chosen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X


def market_features(spot: Column, strike: Column, variance: Column, seconds: Column, eps: float = 1e-8) -> dict[str, Column]:
    """What a price depends on: log-moneyness, variance ahead and its root, d2, and the log of the time left (1 at 900 s). A spot
    of zero counts as eps."""
    moneyness, root = F.ln(X.floored(spot, eps) / (strike + eps)), F.sqrt(variance + eps)
    return {"moneyness": moneyness, "variance_ahead": variance, "root": root, "d2": (moneyness - variance / 2) / (root + eps), "tte": F.ln(seconds + 1) / np.log(901.0).item()}


@dataclass
class Head:
    features: list[str]
    intercept: float
    weights: list[float]
    steps: int
    loss: float

    def probability(self) -> Column:
        z = sum((F.col(c) * w for c, w in zip(self.features, self.weights)), F.lit(self.intercept))
        return 1 / (1 + F.exp(-X.clip(z, -40, 40)))


def _sums(df: DataFrame, features: list[str], label: str, mean: np.ndarray, sd: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the standardised weights (the intercept first), over the rows that have everything."""
    p = len(features) + 1

    def run(batches):
        loss, grad, hess = 0.0, np.zeros(p), np.zeros((p, p))
        for b in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in b.columns])
            x = x[np.isfinite(x).all(1)]
            y, x = x[:, -1], np.column_stack([np.ones(len(x)), (x[:, :-1] - mean) / sd])
            z = np.clip(x @ w, -40, 40)
            q = 1 / (1 + np.exp(-z))
            loss += float((np.logaddexp(0, z) - y * z).sum())
            grad += x.T @ (q - y)
            hess += (x * (q * (1 - q))[:, None]).T @ x
        flat = np.concatenate([[loss], grad, hess.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "v"])

    rows = df.select(*(F.col(c).cast("double") for c in (*features, label))).mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(1 + p + p * p)
    for r in rows:
        out[r["k"]] = r["v"]
    return float(out[0]), out[1 : p + 1], out[p + 1 :].reshape(p, p)


def logistic(df: DataFrame, features: list[str], label: str, penalty: float = 1e-3, tolerance: float = 1e-8, most: int = 25) -> list[Head]:
    """The heads after each step, the last one the fitted one. penalty: of squared standardised weights without the
    intercept, which keeps separable data finite. Features without variance get weight 0; no rows give an empty list."""
    known = df.na.drop(subset=[*features, label]).filter(~sum((F.isnan(F.col(c).cast("double")).cast("int") for c in (*features, label)), F.lit(0)).cast("boolean"))
    stat = known.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}{j}") for j, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not stat["n"]:
        return []
    mean = np.array([stat[f"m{j}"] for j in range(len(features))])
    sd = np.array([stat[f"s{j}"] for j in range(len(features))])
    flat = sd <= 1e-12 * np.maximum(np.abs(mean), 1e-300)
    sd = np.where(flat, 1.0, sd)
    n, p = stat["n"], len(features) + 1
    ridge = np.diag(np.r_[1e-12, np.full(p - 1, penalty)]) * n
    total = lambda loss, w: loss + 0.5 * float(w @ ridge @ w)
    w, out = np.zeros(p), []
    loss, grad, hess = _sums(known, features, label, mean, sd, w)
    for k in range(1, most + 1):
        step = np.linalg.solve(hess + ridge + 1e-9 * np.eye(p), grad + ridge @ w)
        step[1:][flat] = 0
        size = 1.0
        while True:
            to = w - size * step
            new = _sums(known, features, label, mean, sd, to)
            if total(new[0], to) <= total(loss, w) + 1e-9 * abs(loss) or size < 1e-3:
                break
            size /= 2
        w, (loss, grad, hess) = to, new
        own = w[1:] / sd
        out.append(Head(list(features), float(w[0] - own @ mean), own.tolist(), k, loss / n))
        if np.abs(size * step).max() < tolerance:
            break
    return out
