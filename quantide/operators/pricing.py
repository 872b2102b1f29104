"""Binary options on periods of a price series: labels, horizons, realised variance, probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from . import bars

PERIOD = 900


def periods(df: DataFrame, seconds: int = PERIOD, price: str = "s_mid") -> DataFrame:
    """period_start, strike (first), end_price (last), n (rows with a price)."""
    start = bars.truncated("sec", seconds).alias("period_start")
    own = df.filter(F.col(price).isNotNull())
    return own.groupBy(start).agg(F.min_by(price, "sec").alias("strike"), F.max_by(price, "sec").alias("end_price"), F.count(price).alias("n"))


def labelled(df: DataFrame, least: int, seconds: int = PERIOD, price: str = "s_mid") -> DataFrame:
    """Rows of periods with at least `least` rows: with period_start, strike, end_price, label, and seconds_left."""
    p = periods(df, seconds, price).filter(F.col("n") >= least).drop("n")
    rows = df.withColumn("period_start", bars.truncated("sec", seconds)).join(p, "period_start")
    into = ((bars.micros("sec") - bars.micros("period_start")) / 1_000_000).cast("long")
    return rows.withColumns({"label": (F.col("end_price") > F.col("strike")).cast("double"), "into": into, "seconds_left": F.lit(seconds) - into})


def with_future_variance(rows: DataFrame, prefix: str = "prefix", period: str = "period_start") -> DataFrame:
    """The realised variance of the rows that the period still has, as a difference of running sums: the period's last one
    comes by the period, not by row number. The last row of a period has nothing ahead and goes."""
    last = rows.groupBy(period).agg(F.max("rn").alias("_last"), F.max_by(prefix, "rn").alias("_then"))
    met = rows.join(last, period).filter("rn < _last")
    return met.withColumn("variance", F.greatest((F.col("_then") - F.col(prefix)).cast("double"), F.lit(0.0))).drop("_last", "_then")


def priced(rows: DataFrame, spot: str = "s_mid", strike: str = "strike", variance: str = "variance", left: str = "seconds_left") -> DataFrame:
    """rows with p. Prices count as EPS at least, so that a spot or strike of zero has a probability, too."""
    v, price = X.floored_variance(F.col(variance), F.col(left)), lambda c: X.floored(F.col(c), X.EPS)
    return rows.withColumn("p", X.binary_probability(price(spot), price(strike), v))


#: Johnson SU parameters of a few times to expiry, in milliseconds; invented, one below the scale threshold.
JSU = ((1_000, 0.02, 1.2, 0.0, 5e-5), (16_000, 0.02, 1.3, 0.0, 4e-3), (60_000, 0.01, 1.4, 0.0, 8e-3), (300_000, 0.01, 1.5, 0.0, 2e-2), (900_000, 0.0, 1.6, 0.0, 3e-2))
LEAST_SCALE = 1e-4
#: Times to expiry that one row of parameters may hold, since it goes along with every row.
MOST_PARAMETERS = 10_000
FOURIER = [0.0, 0.01, -0.005, 0.002, 0.001]


def jsu_table(spark) -> DataFrame:
    return spark.createDataFrame([(float(t), a, b, c, d) for t, a, b, c, d in JSU], "tte_ms double, a double, b double, loc double, scale double")


def nearest_parameters(rows: DataFrame, params: DataFrame, tte_ms: str = "tte_ms") -> DataFrame:
    """Each row with the parameters of the nearest time to expiry, the lower of two as near; degenerate ones left out.
    The parameters are one row of sorted arrays, searched in the expression; a table of over MOST_PARAMETERS is an error."""
    if params.limit(MOST_PARAMETERS + 1).count() > MOST_PARAMETERS:
        raise ValueError(f"more than {MOST_PARAMETERS} times to expiry")
    sorted_ = F.sort_array(F.collect_list(F.struct(F.col("tte_ms").alias("t"), "a", "b", "loc", "scale")))
    one = params.filter(F.col("scale") >= LEAST_SCALE).agg(sorted_.alias("_params"))
    near = F.array_min(F.transform("_params", lambda x: F.struct(F.abs(x["t"] - F.col(tte_ms)).alias("d"), x["t"].alias("t"), x["a"].alias("a"), x["b"].alias("b"), x["loc"].alias("loc"), x["scale"].alias("scale"))))
    met = rows.crossJoin(F.broadcast(one)).withColumn("_near", near)
    return met.select(*rows.columns, *(F.col("_near")[c].alias(n) for c, n in (("t", "param_tte"), ("a", "a"), ("b", "b"), ("loc", "loc"), ("scale", "scale"))))


def spline_coefficients(x: list[float], y: list[float]):
    """Cubic pieces (knot, c0..c3) through the points, third derivative continuous at the second and last but one."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (d[i] - d[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    return [(float(x[i]), float(y[i]), float(d[i] - h[i] * (2 * m[i] + m[i + 1]) / 6), float(m[i] / 2), float((m[i + 1] - m[i]) / (6 * h[i]))) for i in range(n - 1)]


def interpolated(x, pieces, low: float, high: float):
    """A column of the spline at x, which is cut to low..high."""
    x = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    out = None
    for k, c0, c1, c2, c3 in reversed(pieces):
        t = x - k
        value = c0 + t * (c1 + t * (c2 + t * c3))
        out = value if out is None else F.when(x >= _next, out).otherwise(value)  # noqa: F821
        _next = k
    return out


STRATEGIES = ("clamp", "intrinsic")


def by_parameters(rows: DataFrame, params: DataFrame, strategy: str = "clamp", spot: str = "s_mid", strike: str = "s_micro", tte_ms: str = "tte_ms", to: str = "p") -> DataFrame:
    """rows with a probability from the parameters of the nearest valid time to expiry, and `below`, whether the row's own time
    is shorter than all valid ones, where fits are degenerate: such a row is priced by the shortest valid time (clamp), or
    is worth 1 or 0 by where the spot stands (intrinsic; at the strike 1)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"not a strategy: {strategy!r}")
    least = params.filter(F.col("scale") >= LEAST_SCALE).agg(F.min("tte_ms").alias("_least"))
    near = nearest_parameters(rows, params, tte_ms).crossJoin(F.broadcast(least))  # one row
    below = F.col(tte_ms) < F.col("_least")
    p = X.jsu_probability(F.col(spot), F.col(strike), F.col("a"), F.col("b"), F.col("loc"), F.col("scale"))
    if strategy == "intrinsic":
        p = F.when(below, (F.col(spot) >= F.col(strike)).cast("double")).otherwise(p)
    return near.select(*rows.columns, below.alias("below"), p.alias(to))
