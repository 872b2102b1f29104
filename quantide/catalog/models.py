"""Registered queries of seasonality, regressions, tree models and evaluations (M), and of curves they need (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import features, linear, pricing, rolling as R, scoring, seasonality
from ..plans import series
from . import twin as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FEATURES = ("f1", "f2", "f3")
HORIZONS = (60, 300, 900)


def add(name: str, run, sql: str | None = None, *more: str) -> None:
    for n in (name, *more):
        QUERIES[n] = lambda spark, sf_dir, run=run: S.rounded(run(spark, sf_dir))
        if sql:
            ORACLES[n] = sql


def design(spark, sf_dir):
    """Log variance sums of one, five and fifteen minutes as regressors; the log variance ahead as targets. A variance that isn't
    finite, as prices of zero give it, is missing."""

    def make(df):
        df = df.withColumn("s_rv", X.finite("s_rv"))
        df = R.sums(df, {"v60": (F.col("s_rv"), 60), "v300": (F.col("s_rv"), 300), "v900": (F.col("s_rv"), 900)})
        return features.forward_targets(df, "s", HORIZONS)

    df = series.with_features(series.price_table(spark, sf_dir), make, 910, 901)
    logs = [F.ln(F.when(F.col(f"v{w}").isNotNull(), F.greatest(F.col(f"v{w}"), F.lit(0.0))) + X.EPS).alias(f) for w, f in zip((60, 300, 900), FEATURES)]
    return df.select("rn", "n", "sec", *logs, *(F.col(f"s_fwd_log_rv_{h}").alias(f"y{h}") for h in HORIZONS))


def train(df):
    return df.filter(F.col("rn") < F.floor(F.col("n") * 0.7))


_DESIGN = f"WITH {S.BASE}, g AS (SELECT rn, n, sec, " + ", ".join(f"ln({S.full(w, f'greatest({S.rs("s_rv", w)}, 0)')} + 1e-12) AS {f}" for w, f in zip((60, 300, 900), FEATURES)) + ", ln(CASE WHEN count(s_rv) OVER (ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) = 60 THEN sum(s_rv) OVER (ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) END + 1e-12) AS y60 FROM base)"


def _ols1(spark, sf_dir):
    m = linear.ols(train(design(spark, sf_dir)).select("f1", "y60"), ["f1"], ["y60"])["y60"]
    return spark.createDataFrame([(m.intercept, m.beta[0], m.sigma2, m.n)], "intercept double, slope double, sigma2 double, n bigint")


_T = "FROM g WHERE rn < floor(n * 0.7::DOUBLE) AND f1 IS NOT NULL AND y60 IS NOT NULL"
add("M04_least_squares", _ols1, _DESIGN + f" SELECT round(regr_intercept(y60, f1), 8) AS intercept, round(regr_slope(y60, f1), 8) AS slope, round((regr_syy(y60, f1) - regr_slope(y60, f1) * regr_sxy(y60, f1)) / (count(*) - 2), 8) AS sigma2, count(*) AS n {_T}")


def _ridge1(spark, sf_dir):
    m = linear.ridge(train(design(spark, sf_dir)).select("f1", "y60"), ["f1"], ["y60"], 10.0)["y60"]
    return spark.createDataFrame([(m.intercept, m.beta[0], m.n)], "intercept double, slope double, n bigint")


# With one standardised regressor the ridge slope is sxy / (n + alpha) / sd^2 * ... in closed form.
add("M05_ridge", _ridge1, _DESIGN + f", r AS (SELECT count(*) AS n, regr_sxy(y60, f1) AS sxy, var_pop(f1) AS v, avg(f1) AS mx, avg(y60) AS my {_T}) SELECT round(my - mx * (sxy / v / (n + 10)), 8) AS intercept, round(sxy / v / (n + 10), 8) AS slope, n FROM r")


def _predict(spark, sf_dir):
    df = design(spark, sf_dir)
    m = linear.ols(train(df).select("f1", "y60"), ["f1"], ["y60"])["y60"]
    return df.select("rn", m.predict().alias("f"))


add("M06_predict", _predict, _DESIGN + f", r AS (SELECT regr_intercept(y60, f1) AS a, regr_slope(y60, f1) AS b {_T}) SELECT rn, round(a + b * f1, 8) AS f FROM g, r")


add("M01_weekly_curve", lambda s, d: seasonality.weekly_factors(series.base_table(s, d)), None, "F36_wavelet_low_pass")
_CURVE = f"WITH {S.BASE}, c AS (SELECT m::INT AS mow, mean FROM range(10080) r(m) LEFT JOIN (SELECT (isodow(sec) - 1) * 1440 + hour(sec) * 60 + minute(sec) AS k, avg(s_rv) AS mean FROM base GROUP BY 1) x ON m = x.k), z AS (SELECT mow, mean, last_value(CASE WHEN mean IS NOT NULL THEN mow END IGNORE NULLS) OVER (ORDER BY mow) AS a, last_value(mean IGNORE NULLS) OVER (ORDER BY mow) AS av, first_value(CASE WHEN mean IS NOT NULL THEN mow END IGNORE NULLS) OVER (ORDER BY mow ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, first_value(mean IGNORE NULLS) OVER (ORDER BY mow ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bv FROM c)"
add("F35_interpolated_curve", lambda s, d: seasonality.interpolated(seasonality.minute_means(series.base_table(s, d))), _CURVE + " SELECT mow, round(CASE WHEN a = b THEN av ELSE coalesce(av + (bv - av) * (mow - a) / (b - a), av, bv) END, 8) AS mean FROM z")


def _fourier(spark, sf_dir):
    df = series.base_table(spark, sf_dir)
    model, mean, basis = seasonality.fourier_fit(train(df))
    return df.select("rn", "sec", *basis).select("rn", (F.exp(model.predict()) / mean).alias("factor"))


add("M02_fourier_seasonality", _fourier, None, "M03_fourier_predict")


def evaluation(spark, sf_dir, least: int = 3):
    """Prices of every row of well-filled periods from the variance that came, and their scores' inputs. Rows stand for
    seconds, so the variance is that of as many rows as the period still has."""
    base = R.prefix_sums(series.base_table(spark, sf_dir), {"prefix": F.col("s_rv")})
    return pricing.priced(pricing.with_future_variance(pricing.labelled(base, least)))


def _cdf(x: str) -> str:
    from .calendar import _cdf as c

    return c(x)


_V = "greatest(greatest((q2.prefix - q1.prefix)::DOUBLE, 0), (900 - x.into_) * 1e-10)"
_EVAL = f"""WITH {S.BASE}, q AS (SELECT rn, sum(coalesce(s_rv, 0)::DECIMAL(38, 18)) OVER (ORDER BY rn) AS prefix FROM base),
per AS (SELECT time_bucket(INTERVAL 15 MINUTE, sec) AS ps, arg_min(s_mid, sec) AS strike, arg_max(s_mid, sec) AS end_price, count(s_mid) AS k, max(rn) AS last FROM base GROUP BY 1),
x AS (SELECT base.rn, s_mid, ps, strike, CASE WHEN end_price > strike THEN 1.0 ELSE 0.0 END::DOUBLE AS y, last, (epoch_us(sec) - epoch_us(ps)) // 1000000 AS into_ FROM base JOIN per ON time_bucket(INTERVAL 15 MINUTE, sec) = ps WHERE k >= 3 AND last > base.rn),
v AS (SELECT x.*, {_V} AS v FROM x JOIN q q1 ON q1.rn = x.rn JOIN q q2 ON q2.rn = x.last),
e AS (SELECT *, {_cdf("((ln(s_mid / strike) - v / 2) / sqrt(greatest(v, 1e-12)))")} AS p FROM v)"""
add("M17_realised_variance_prices", lambda s, d: evaluation(s, d).select("rn", "strike", "label", "p"), _EVAL + " SELECT rn, round(strike, 8) AS strike, y AS label, round(p, 8) AS p FROM e")
add("M16_pricer_evaluation", lambda s, d: evaluation(s, d).agg(scoring.brier(F.col("p"), F.col("label")).alias("brier"), F.var_pop("label").alias("naive"), scoring.log_loss(F.col("p"), F.col("label")).alias("loss"), F.count("*").alias("n"), F.countDistinct("period_start").alias("periods")),
    _EVAL + " SELECT round(avg((p - y) * (p - y)), 8) AS brier, round(var_pop(y), 8) AS naive, round(avg(-(y * ln(least(greatest(p, 1e-8), 1 - 1e-8)) + (1 - y) * ln(1 - least(greatest(p, 1e-8), 1 - 1e-8)))), 8) AS loss, count(*) AS n, count(DISTINCT ps) AS periods FROM e")


def _pooled(spark, sf_dir, kernel: int = 4):
    """Max-pooled and patched series: tumbling buckets of rows."""
    df = series.price_table(spark, sf_dir)
    return df.groupBy(F.floor(F.col("rn") / kernel).alias("bucket")).agg(F.max("s_mid").alias("pooled"), F.count("*").alias("size"))


add("M13_pooling", _pooled, f"WITH {S.PRICES} SELECT rn // 4 AS bucket, round(max(s_mid), 8) AS pooled, count(*) AS size FROM prices GROUP BY 1")
add("M14_logit_head", lambda s, d: series.price_table(s, d).select("rn", (1 / (1 + F.exp(-(0.1 + 2 * F.col("s_obi") - 0.5 * F.col("p_obi"))))).alias("p")), f"WITH {S.PRICES} SELECT rn, round(1 / (1 + exp(-(0.1 + 2 * s_obi - 0.5 * p_obi))), 8) AS p FROM prices")
