"""Seasonality of variance: a curve over the minutes of the week, and a Fourier regression; removing and restoring them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from . import bars, linear

WEEK = 10080
#: The eight low-pass taps of the Daubechies wavelet with four vanishing moments.
DB4 = (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278)


def minute_means(df: DataFrame, value: str = "s_rv") -> DataFrame:
    """mow, mean: the mean by minute of the week (Monday 0), for each of the 10,080 minutes; null where none is known."""
    means = df.groupBy(X.minute_of_week(F.col("sec")).alias("mow")).agg(F.avg(value).alias("mean"))
    return df.sparkSession.range(WEEK).select(F.col("id").cast("int").alias("mow")).join(means, "mow", "left")


def interpolated(curve: DataFrame) -> DataFrame:
    """mow, mean with gaps on straight lines between their ends; the first and last known values go on outwards. The
    curve has 10,080 rows at any size of the data."""
    back = Window.orderBy("mow").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy("mow").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("mean").isNotNull(), F.struct("mow", "mean"))
    met = curve.withColumns({"a": F.last(at, True).over(back), "b": F.first(at, True).over(ahead)})
    gap = F.col("b.mow") - F.col("a.mow")
    line = F.col("a.mean") + (F.col("b.mean") - F.col("a.mean")) * (F.col("mow") - F.col("a.mow")) / gap
    return met.select("mow", F.when(gap == 0, F.col("a.mean")).otherwise(F.coalesce(line, "a.mean", "b.mean")).alias("mean"))


def _analyse(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    k = len(taps)
    padded = np.concatenate([x[: k - 1][::-1], x, x[-(k - 1) :][::-1]])
    return np.convolve(padded, taps, "valid")[1::2]


def _synthesise(c: np.ndarray, taps: np.ndarray, n: int) -> np.ndarray:
    up = np.zeros(2 * len(c))
    up[::2] = c
    return np.convolve(up, taps)[len(taps) - 2 :][:n]


def smooth(x: np.ndarray, keep: int = 3) -> np.ndarray:
    """The log curve through a wavelet low-pass: the deepest level's approximation and its `keep` - 1 coarsest details,
    as a factor of mean 1."""
    lo = np.array(DB4)
    hi = lo[::-1] * np.array([1, -1] * 4)
    y = np.log(np.maximum(x, 1e-12))
    depth = int(np.log2(len(y) / (len(lo) - 1)))
    sizes, details, a = [], [], y
    for _ in range(depth):
        sizes.append(len(a))
        details.append(_analyse(a, hi[::-1]))
        a = _analyse(a, lo[::-1])
    for level in range(depth - 1, -1, -1):
        d = details[level] if level > depth - keep else np.zeros_like(details[level])
        m = min(len(a), len(d))
        a = _synthesise(a[:m], lo, sizes[level]) + _synthesise(d[:m], hi, sizes[level])
    f = np.exp(a)
    return f / f.mean()


def weekly_factors(df: DataFrame, value: str = "s_rv") -> DataFrame:
    """mow, factor: the smoothed curve of minute means; 10,080 rows pass the driver at any size of the data."""
    rows = interpolated(minute_means(df.withColumn(value, X.finite(value)), value)).orderBy("mow").collect()
    f = smooth(np.array([r["mean"] if r["mean"] is not None else 1.0 for r in rows]))
    return df.sparkSession.createDataFrame([(int(r["mow"]), float(v)) for r, v in zip(rows, f)], "mow int, factor double")


def hours(ts: Column | str) -> Column:
    return bars.micros(ts) / 3_600_000_000


def fourier_fit(df: DataFrame, value: str = "s_rv", periods=(8, 24, 168, 720), harmonics=(4, 12, 25, 4)) -> tuple[linear.Linear, float, list[Column]]:
    """Regression of the log variance on sines and cosines; the model, the mean of its factors, and the basis."""
    basis = X.fourier_basis(hours("sec"), periods, harmonics)
    made = df.select(F.ln(F.coalesce(X.finite(value), F.lit(0.0)) + X.EPS).alias("y"), *basis)
    names = made.columns[1:]
    model = linear.ols(made, names, ["y"])["y"]
    if model is None:
        raise ValueError("too few rows for the seasonal regression")
    mean = made.agg(F.avg(F.exp(model.predict()))).first()[0]
    return model, mean, basis


@dataclass(frozen=True)
class Fourier:
    """A seasonal model of the log variance: an intercept, then a sine and a cosine for each harmonic of each period (hours);
    mean is that of its exponentials over the rows that it was fitted on, so that factors are about 1."""

    periods: tuple[float, ...]
    harmonics: tuple[int, ...]
    coefficients: tuple[float, ...]
    mean: float

    def factor(self, ts: str = "sec") -> Column:
        basis = X.fourier_basis(hours(ts), self.periods, self.harmonics)
        return F.exp(sum((b * c for b, c in zip(basis, self.coefficients[1:])), F.lit(self.coefficients[0]))) / self.mean


def fitted_fourier(df: DataFrame, value: str = "s_rv", periods=(8, 24, 168, 720), harmonics=(4, 12, 25, 4)) -> Fourier:
    model, mean, _ = fourier_fit(df, value, periods, harmonics)
    return Fourier(tuple(periods), tuple(harmonics), (model.intercept, *model.beta), mean)
