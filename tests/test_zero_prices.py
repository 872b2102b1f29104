"""Registered queries on events some of whose values are zero, which makes mids and strikes zero, against their SQL twins."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantide import catalog
from quantide.operators import rolling as R, scoring

from conftest import SF
from twins import assert_same, value


@pytest.fixture(scope="module")
def zero_sf(tmp_path_factory):
    """The smallest tables with values of zero: of s alone, of two events in a row, and at the start of its quarter of an hour."""
    to = tmp_path_factory.mktemp("zero")
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", to / name)
    con = duckdb.connect()
    con.sql(f"CREATE TABLE e AS SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) AS period, event_type IN ('click', 'view') AS s FROM read_parquet('{SF}/events.parquet')")
    starts = "SELECT min(event_id) FROM e GROUP BY period HAVING count(*) >= 3 AND arg_min(s, ts) ORDER BY 1 LIMIT 2"
    con.sql(f"COPY (SELECT * EXCLUDE (period, s) REPLACE (CASE WHEN event_id IN (200, 201, 480, 481) OR event_id IN ({starts}) THEN 0.0 ELSE value END AS value) FROM e) TO '{to}/events.parquet'")
    return str(to)


@pytest.mark.parametrize("name", ["F07_binary_probability", "F10_raw_probability", "F12_price_rows", "F09_fourier_calibration"])
def test_probabilities(spark, zero_sf, name):
    assert_same(df := catalog.queries()[name](spark, zero_sf), catalog.oracles()[name], zero_sf)
    assert df.filter("isnan(p)").count() + df.filter("p = 1").count() > 0 and df.filter("p is null").count() == 0


def test_market_features(spark, zero_sf):
    assert_same(df := catalog.queries()["F32_market_features"](spark, zero_sf), catalog.oracles()["F32_market_features"], zero_sf)
    assert df.filter("isnan(moneyness)").count() > 0 and df.filter("moneyness is null or d2 is null").count() == 0


def test_evaluation(spark, zero_sf):
    """Every row of a well-filled period has a probability, also where its strike is zero, and is scored."""
    rows = catalog.queries()["M17_realised_variance_prices"](spark, zero_sf).toPandas()
    zero = rows[rows.strike == 0]
    assert len(zero) > 0 and rows.p.between(0, 1).all() and (zero.label == 1).any()
    r = catalog.queries()["M16_pricer_evaluation"](spark, zero_sf).first()
    assert r.n == len(rows) and abs(r.brier - ((rows.p - rows.label) ** 2).mean()) < 1e-6
    spots = catalog.queries()["P06_midprice"](spark, zero_sf).filter("s_mid = 0").toPandas().rn
    assert spots.isin(rows.rn).any()
    for name in ("M14_fitted_head", "S16_checkpoints"):
        heads = catalog.queries()[name](spark, zero_sf).toPandas()
        assert set(heads.rn) == set(rows.rn) and heads.p.between(0, 1).all()
    assert 0 <= catalog.queries()["M10_tree_pricer"](spark, zero_sf).first().brier_price <= 1


def test_period_variance(spark, zero_sf):
    for name in ("A03_period_variance", "A04_conditional_sums", "A05_period_bipower", "A06_last_mid"):
        assert_same(df := catalog.queries()[name](spark, zero_sf), catalog.oracles()[name], zero_sf)
    assert df.filter("isnan(rv)").count() > 0 and df.filter("mid = 0").count() > 0


def test_minutes_of_the_week(spark, zero_sf):
    assert_same(df := catalog.queries()["A07_mean_by_minute_of_week"](spark, zero_sf), catalog.oracles()["A07_mean_by_minute_of_week"], zero_sf)
    assert df.filter("abs(mean) = double('inf')").count() > 0


@pytest.mark.parametrize("name", ["A21_r_squared", "A22_mse_mae", "A23_streaming_r2"])
def test_forecast_scores(spark, zero_sf, name):
    assert_same(catalog.queries()[name](spark, zero_sf), catalog.oracles()[name], zero_sf)


@pytest.mark.parametrize("name", ["A24_r2_by_horizon", "A25_r2_summary", "A26_target_stats", "A27_clip_rates", "A28_percentiles", "A29_variance_reduction"])
def test_scores_by_horizon(spark, zero_sf, name):
    assert_same(catalog.queries()[name](spark, zero_sf), catalog.oracles()[name], zero_sf)


@pytest.mark.parametrize("most", [1, 40, 100_000])
def test_percentiles_with_infinite_values(spark, most):
    """Infinite values and NaN have their ranks; NaN, the largest, only where it is asked for."""
    inf, nan = float("inf"), float("nan")
    groups = {"a": [-inf, -inf, *map(float, range(60)), inf, inf, inf], "b": [inf, inf], "c": [-inf, 1.0, 1.0, inf]}
    df = spark.createDataFrame([(k, v) for k, x in groups.items() for v in [*x, nan, nan, None]], "g string, y double").repartition(3)
    shares = {f"q{k}": k / 10 for k in range(11)}
    con = duckdb.connect()
    for asked in (False, True):
        out = {r.g: r for r in scoring.percentiles(df, ["g"], "y", shares, bins=8, most=most, nan=asked).collect()}
        assert out.keys() == groups.keys()
        for g, x in groups.items():
            for k, q in shares.items():
                want = con.execute(f"SELECT quantile_cont(v, {q}) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [[*x, *([nan] * 2 * asked)]]).fetchone()[0]
                assert value(out[g][k]) == value(want), (g, k)


def test_rolling_sums_past_infinite_values(spark):
    """Long and short windows of running sums give what a sum of their rows gives, before, in and after infinite values."""
    rng = np.random.default_rng(5)
    x = rng.integers(-4, 5, 400).astype(float)
    x[[40, 250]], x[[120, 122]], x[[200, 330]] = np.inf, (np.inf, -np.inf), (np.nan, -np.inf)
    df = spark.createDataFrame([(k, float(v) if k % 17 else None) for k, v in enumerate(x)], "rn bigint, x double")
    x[::17] = 0.0
    lengths = (3, 20, 70)

    def make(d):
        d = R.sums(d, {f"s{w}": (F.col("x"), w) for w in lengths}, direct=8)
        d = R.strict_sums(d.withColumn("z", F.coalesce("x", F.lit(0.0))), {f"t{w}": ("z", w) for w in lengths})
        return R.forward_sums(d, {f"f{w}": (F.col("z"), w) for w in lengths})

    rows = R.windowed(df, make, 80, 80, 128).orderBy("rn").collect()
    for k, r in enumerate(rows):
        for w in lengths:
            back, ahead = (x[k - w + 1 : k + 1].sum() if k >= w - 1 else None), (x[k + 1 : k + 1 + w].sum() if k + w < len(x) else None)
            for got, want in ((r[f"s{w}"], back), (r[f"t{w}"], back), (r[f"f{w}"], ahead)):
                assert (got is None) == (want is None) and (want is None or value(got) == value(float(want))), (k, w)
