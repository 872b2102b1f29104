"""Edges of the quote operators on small tables made by hand, and properties of the row windows."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantide.functions import scalars as X
from quantide.operators import bars, features, linear, pricing, rolling as R, scoring, seasonality
from quantide.sources import io
from quantide.streaming import live

T0 = dt.datetime(2024, 1, 5, 7, 59, 0)
QUOTE = "inst string, received_time timestamp_ntz, event_id long, bid double, ask double, bid_size double, ask_size double"


def quotes(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), e, b, b + 1.0, 1.0, 2.0) for i, s, e, b in rows], QUOTE)


def series(spark, values):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(values)], "rn long, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("rn").collect()]


def test_ties_within_a_second(spark):
    out = bars.last_per_second(quotes(spark, [("s", 0.2, 1, 10.0), ("s", 0.2, 2, 11.0), ("s", 0.1, 3, 12.0)])).collect()
    assert [(r.bid, r.n_ticks) for r in out] == [(11.0, 3)]


def test_gap_is_strict(spark):
    q = quotes(spark, [("s", 0, 1, 1.0), ("s", 1800, 2, 1.0), ("s", 3600.000001, 3, 1.0)])
    assert [r.seg_id for r in bars.segmented(q).orderBy("event_id").collect()] == [0, 0, 1]


def test_gap_over_days(spark):
    q = quotes(spark, [("s", 0, 1, 1.0), ("s", 86400 * 3, 2, 1.0), ("p", 10, 3, 1.0)])
    assert [(r.inst, r.gap_seconds) for r in bars.gaps(q).collect()] == [("s", 86400.0 * 3)]


def test_asof_takes_the_quote_at_its_time(spark):
    q = quotes(spark, [("s", 0.5, 1, 10.0), ("s", 2.0, 2, 11.0), ("s", 2.0, 3, 12.0), ("s", 2.5, 4, 13.0)])
    out = bars.resampled(q).orderBy("grid_time").collect()
    assert [r.bid for r in out] == [10.0, 12.0, 13.0]


def test_fill_over_days_and_head(spark):
    rows = [(T0, None), (T0 + dt.timedelta(days=1), 2.0), (T0 + dt.timedelta(days=2), None)]
    out = bars.filled(spark.createDataFrame(rows, "sec timestamp_ntz, v double"), ["v"]).orderBy("sec").collect()
    assert [r.v for r in out] == [2.0, 2.0, 2.0]


def test_row_numbers_over_days(spark):
    df = spark.range(500).select((F.lit(T0) + F.make_interval(hours=F.col("id").cast("int"))).cast("timestamp_ntz").alias("sec"), "id")
    assert all(r.rn == r.id and r.n == 500 for r in bars.indexed(df).collect())


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100)), min_size=1, max_size=60), st.integers(1, 12), st.integers(3, 20))
def test_chunks_and_running_sums_change_nothing(spark, values, w, chunk):
    df = series(spark, values)
    got = column(R.windowed(df, lambda d: R.sums(d, {"s": (F.col("x"), w)}, direct=0), w, 0, chunk), "s")
    x = [v or 0.0 for v in values]
    want = [sum(x[i - w + 1 : i + 1]) if i >= w - 1 else None for i in range(len(x))]
    assert all(a == b or abs(a - b) < 1e-8 for a, b in zip(got, want))


def test_long_maxima_equal_short_ones(spark):
    x = np.random.default_rng(1).normal(size=120)
    df = series(spark, x)
    got = column(R.windowed(df, lambda d: R.maxima(d, {"m": (F.col("x"), 13)}, direct=0), 26, 0, 32), "m")
    assert got[:12] == [None] * 12 and np.allclose(got[12:], [x[i - 12 : i + 1].max() for i in range(12, 120)])


def test_constant_series(spark):
    df = R.windowed(series(spark, [5.0] * 20), lambda d: R.moments(R.autocorrelations(d, {"ac": (F.col("x"), 8)}), {"m": (F.col("x"), 8)}), 10)
    last = df.filter("rn = 19").first()
    assert last.ac is None and last.m_skew == 0 and last.m_kurt == 0


def test_windows_longer_than_the_series_are_null(spark):
    assert column(R.windowed(series(spark, [1.0] * 5), lambda d: R.sums(d, {"s": (F.col("x"), 100)}), 100), "s") == [None] * 5


def test_empty_series(spark):
    assert R.windowed(series(spark, [1.0]).filter("rn < 0"), lambda d: R.sums(d, {"s": (F.col("x"), 3)}), 3).count() == 0


def test_ewma_over_chunks(spark):
    x = np.random.default_rng(2).normal(size=100)
    got = column(R.ewma(series(spark, x), {"e": ("x", 5.0)}, chunk=16), "e")
    a, y, want = 1 - math.exp(-math.log(2) / 5), None, []
    for v in x:
        y = v if y is None else y + a * (v - y)
        want.append(y)
    assert np.allclose(got, want)


def test_realized_kernel_and_two_scale(spark):
    r = np.random.default_rng(3).normal(size=150) * 0.01
    df = series(spark, r).withColumnRenamed("x", "s_ret")
    w, k = 40, 5
    got = column(features.realized_kernels(df, ("s",), (w,), chunk=50), f"s_rk_w{w}")
    lags = math.ceil(w ** (2 / 3))
    for t in range(w - 1, 150):
        v = r[t - w + 1 : t + 1]
        total = (v * v).sum()
        for h in range(1, lags + 1):
            x = h / lags
            total += 2 * (1 - 6 * x**2 + 6 * x**3 if x <= 0.5 else 2 * (1 - x) ** 3) * (v[h:] * v[:-h]).sum()
        assert math.isclose(got[t], max(total, 0.1 * (v * v).sum()), rel_tol=1e-9)
    out = column(R.windowed(df, lambda d: features.two_scale(d, "s", (w,), k), w + k, 0, 50), f"s_tsrv_w{w}")
    c = np.cumsum(r)
    kk = np.array([(c[i] - (c[i - k] if i >= k else 0)) ** 2 if i >= k - 1 else 0 for i in range(150)])
    for t in range(w - 1, 150):
        v = (r[t - w + 1 : t + 1] ** 2).sum()
        assert math.isclose(out[t], max(kk[t - w + 1 : t + 1].sum() / k - v / k, 0.1 * v), rel_tol=1e-8)


def test_expiries(spark):
    rows = [(dt.datetime(2024, 1, 5, 7, 59),), (dt.datetime(2024, 1, 5, 8, 0),), (dt.datetime(2024, 12, 31, 0, 0),), (dt.datetime(2024, 3, 29, 9, 0),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz").select("t", X.hours_to_weekly(F.col("t")).alias("w"), X.next_monthly(F.to_date("t")).alias("m"), X.next_quarterly(F.to_date("t")).alias("q"))
    found = {r.t: r for r in df.collect()}
    assert math.isclose(found[rows[0][0]].w, 1 / 60) and found[rows[1][0]].w == 168.0
    assert found[rows[2][0]].m == dt.date(2025, 1, 31) and found[rows[2][0]].q == dt.date(2025, 3, 28)
    assert found[rows[3][0]].m == dt.date(2024, 3, 29)


def test_prices(spark):
    df = spark.range(1).select(X.normal_cdf(F.lit(1.0)).alias("c"), X.total_variance(F.lit(0.6), F.lit(450.0)).alias("v"), X.binary_probability(F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("p"))
    r = df.first()
    assert math.isclose(r.c, 0.5 * (1 + math.erf(1 / math.sqrt(2))), abs_tol=2e-7)
    assert math.isclose(r.v, 0.36 * 450 / 31557600) and math.isclose(r.p, 0.5, abs_tol=1e-6)


def test_nearest_parameters_prefer_the_lower(spark):
    rows = spark.createDataFrame([(38_000.0,), (500.0,), (1e9,)], "tte_ms double")
    out = {r.tte_ms: r.param_tte for r in pricing.nearest_parameters(rows, pricing.jsu_table(spark)).collect()}
    assert out == {38_000.0: 16_000.0, 500.0: 16_000.0, 1e9: 900_000.0}


def test_price_of_a_zero_spot_is_no_number(spark):
    p = X.jsu_probability(F.col("spot"), F.col("strike"), F.lit(0.02), F.lit(1.3), F.lit(0.0), F.lit(4e-3))
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (2.0, 2.0)], "spot double, strike double").select("spot", p.alias("p")).collect()
    assert [math.isnan(r.p) for r in rows] == [True, True, False]


def test_spline_meets_its_points(spark):
    x, y = [0.0, 1.0, 3.0, 4.0, 6.0], [1.0, 2.0, 0.0, 5.0, 1.0]
    p = pricing.spline_coefficients(x, y)
    df = spark.createDataFrame([(v,) for v in (*x, 9.0)], "v double").select("v", pricing.interpolated(F.col("v"), p, 0.0, 6.0).alias("s"))
    assert np.allclose([r.s for r in df.orderBy("v").collect()], [*y, 1.0])


def test_regressions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(a), float(v)) for (a, b), v in zip(x, y)], "a double, b double, dup double, y double")
    m = linear.ols(df, ["a", "b"], ["y"])["y"]
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert np.allclose([m.intercept, *m.beta], want)
    dependent = linear.ols(df, ["a", "dup", "b"], ["y"])["y"]  # least norm shares the weight
    assert np.allclose(dependent.beta, [want[1] / 2, want[1] / 2, want[2]], atol=1e-6)
    assert linear.ols(df.limit(2), ["a", "b"], ["y"])["y"] is None
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + 3 * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(linear.ridge(df, ["a", "b"], ["y"], 3.0)["y"].beta, beta)


def test_wavelet_smoothing_keeps_a_constant():
    f = seasonality.smooth(np.full(10080, 3.0))
    assert len(f) == 10080 and np.allclose(f, 1.0)
    noisy = np.exp(np.sin(np.arange(10080) / 1600) + np.random.default_rng(0).normal(size=10080) * 0.5)
    assert np.abs(np.diff(np.log(seasonality.smooth(noisy)))).max() < 0.05


def test_fourier_fit_with_dependent_columns(spark):
    rows = [(T0 + dt.timedelta(hours=h), float(np.exp(np.sin(2 * np.pi * h / 24)))) for h in range(24 * 40)]
    model, mean, basis = seasonality.fourier_fit(spark.createDataFrame(rows, "sec timestamp_ntz, s_rv double"))
    assert mean > 0 and len(basis) == 90
    df = spark.createDataFrame(rows, "sec timestamp_ntz, s_rv double")
    out = df.select("s_rv", *basis).select(F.corr(F.ln("s_rv"), model.predict()).alias("c")).first()
    assert out.c > 0.999


def test_sources(spark):
    with pytest.raises(ValueError, match="b, c"):
        io.required(spark.range(1).toDF("a"), ["a", "b", "c"])
    with pytest.raises(ValueError):
        io.instruments(spark, {"s": "x"})
    assert io.horizon_seconds("15m") == 900


def test_streams_equal_batches(spark, tmp_path):
    q = quotes(spark, [("s", k * 0.4, k, 10.0 + k) for k in range(50)]).withColumn("received_time", F.col("received_time").cast("timestamp"))
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    job = live.second_bars(stream).writeStream.format("memory").queryName("bars_now").outputMode("complete").trigger(availableNow=True).start()
    job.awaitTermination(120)
    got = {(r.inst, r.bid, r.n_ticks) for r in spark.table("bars_now").collect()}
    assert got == {(r.inst, r.bid, r.n_ticks) for r in bars.last_per_second(q).collect()}
    assert live.sessions(q).count() == 1 and live.period_prices(q).count() == 1


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_shifted_rows(spark, chunk):
    """Short shifts by halo, long ones by copies to the chunk that needs them."""
    df = spark.range(0, 137).select(F.col("id").alias("rn"), (F.col("id") * 3).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") / 7).alias("b"), F.lit("x").alias("other")).repartition(4)
    shifts = [1, 2, 15, 40, 100, 500]
    rows = R.shifted(df, ["a", "b"], shifts, chunk).orderBy("rn").collect()
    assert [r.rn for r in rows] == list(range(137)) and {r.other for r in rows} == {"x"}
    for r in rows:
        for k in shifts:
            was = r.rn - k
            assert r[f"a_{k}"] == (was * 3 if was >= 0 else None) and r[f"b_{k}"] == (was / 7 if was >= 0 and was % 5 else None)


def seasonal_rows(spark, n=700):
    rng = np.random.default_rng(6)
    v = {i: rng.gamma(0.5, 1e-6, n) for i in "sp"}
    v["p"][[3, 50]] = np.nan
    rows = [(k, *(None if np.isnan(v[i][k]) else float(v[i][k]) for i in "sp")) for k in range(n)]
    return spark.createDataFrame(rows, "rn long, s_rv double, p_rv double").repartition(3), v


def test_wavelet_details_by_definition(spark):
    """Haar energies of the log variance: differences of neighbouring rolling means, from row 2^scale on."""
    df, v = seasonal_rows(spark)
    rows = features.wavelet_details(df, scales=(1, 3, 6, 8, 9), chunk=64).orderBy("rn").toPandas()
    for i in "sp":
        x = np.log(np.nan_to_num(v[i]) + 1e-12)
        for scale in (1, 3, 6, 8, 9):
            half = 2 ** (scale - 1)
            mean = np.array([x[t - half + 1 : t + 1].mean() if t >= half - 1 else np.nan for t in range(len(x))])
            for t in range(0, len(x), 11):
                own = rows[f"{i}_modwt_d{scale}"][t]
                assert np.isnan(own) if t < 2 * half else np.isclose(own, np.log((mean[t] - mean[t - half]) ** 2 + 1e-12), atol=1e-6)


def test_long_periods_by_definition(spark):
    """Magnitudes at window ends every eighth of a window, carried forward."""
    df, v = seasonal_rows(spark)
    rows = features.dft_magnitudes(df, 700, periods={"a": 120, "b": 1000, "c": 90}, chunk=64).orderBy("rn").toPandas()
    for i in "sp":
        x = np.nan_to_num(v[i])
        for name, period in (("a", 120), ("b", 1000)):
            w = min(period, 350)
            wave = np.exp(-2j * np.pi * np.arange(w) / period)
            want, last = np.full(700, np.nan), np.nan
            for t in range(700):
                if t >= w - 1 and (t - (w - 1)) % (w // 8) == 0:
                    last = abs(x[t - w + 1 : t + 1] @ wave) / w
                want[t] = last
            assert np.allclose(rows[f"{i}_fourier_mag_{name}"], want, atol=1e-12, equal_nan=True)
        assert rows[f"{i}_fourier_mag_c"].isna().all()


def test_seasonal_factor_comes_out_first(spark):
    """A fitted model and its factors against NumPy, the variances divided in place, and the season restored ahead."""
    n = 3000
    rng = np.random.default_rng(8)
    hour = np.arange(n) * 0.05
    rv = np.exp(0.5 * np.sin(2 * np.pi * hour / 8) - 0.3 * np.cos(2 * np.pi * hour / 24) + rng.normal(size=n) * 0.1) * 1e-3
    rows = [(k, float(r), float(r) / 2, float(r) / 3, None if k < 2 else float(r) / 4) for k, r in enumerate(rv)]
    df = spark.createDataFrame(rows, "rn long, s_rv double, s_rsv_pos double, s_rsv_neg double, s_bpv double")
    df = df.withColumn("sec", F.timestamp_seconds(F.col("rn") * 180))
    model = seasonality.fitted_fourier(df, "s_rv", (8, 24), (2, 1))
    basis = [f(2 * np.pi * k * hour / t) for t, ks in ((8, 2), (24, 1)) for k in range(1, ks + 1) for f in (np.sin, np.cos)]
    a = np.column_stack([np.ones(n), *basis])
    beta = np.linalg.lstsq(a, np.log(rv + 1e-12), rcond=None)[0]
    factor = np.exp(a @ beta) / np.exp(a @ beta).mean()
    assert np.allclose(model.coefficients, beta, atol=1e-6) and np.isclose(model.mean, np.exp(a @ beta).mean())
    made = features.deseasonalised(df, {"s": model.factor()})
    got = R.windowed(made, lambda d: features.seasonal_targets(d, ("s",), (60,)), 1, 60, 256).orderBy("rn").toPandas()
    assert np.allclose(got.s_seas_factor, factor) and np.allclose(got.s_rv, rv / factor) and np.allclose(got.s_bpv[2:], rv[2:] / 4 / factor[2:]) and got.s_bpv[:2].isna().all()
    ahead, season = np.array([(rv / factor)[t + 1 : t + 61].sum() for t in range(n - 60)]), np.array([factor[t + 1 : t + 61].sum() for t in range(n - 60)])
    assert np.allclose(got.s_fwd_log_rv_60[: n - 60], np.log(ahead + 1e-12), atol=1e-9) and np.allclose(got.s_fwd_seas_60[: n - 60], season) and got.s_fwd_rv_60[n - 60 :].isna().all()


@pytest.mark.parametrize("most", [1, 40, 100_000])
def test_exact_percentiles(spark, most):
    """Heavy ties, far outliers, a group of one value, null keys and missing values, against NumPy."""
    rng = np.random.default_rng(3)
    groups = {"a": np.concatenate([rng.normal(size=900), [1e9, -1e9], np.full(300, 0.25)]), "b": np.full(500, 7.0), "c": np.array([3.5]), None: np.exp(rng.normal(size=400) * 9)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("b", float("nan")), ("gone", None)]
    df = spark.createDataFrame(rows, "g string, y double").repartition(5)
    shares = {"q0": 0.0, "q1": 0.001, "q2": 0.25, "q3": 0.5, "q4": 0.987, "q5": 1.0}
    out = {r.g: r for r in scoring.percentiles(df, ["g"], "y", shares, bins=8, most=most).collect()}
    assert out.keys() == groups.keys()
    for g, x in groups.items():
        assert np.allclose([out[g][k] for k in shares], np.quantile(x, list(shares.values())), rtol=1e-12)
    assert scoring.percentiles(df.filter("y > 1e30"), ["g"], "y", shares).collect() == []


@pytest.mark.parametrize("chunk", [8, 1 << 16])
def test_gathered_rows(spark, chunk):
    df = spark.range(0, 60).select(F.col("id").alias("rn"), (F.col("id") * 2).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("w")).repartition(3)
    to = F.when(F.col("rn") % 7 > 0, F.pmod(F.col("rn") * 37, F.lit(80)))
    rows = R.gathered(df, to, ["v", "w"], chunk).orderBy("rn").collect()
    assert [r.rn for r in rows] == list(range(60))
    for r in rows:
        t = r.rn * 37 % 80 if r.rn % 7 else None
        assert (r.v_at, r.w_at) == ((t * 2, t if t % 3 else None) if t is not None and t < 60 else (None, None)) and r.v == r.rn * 2


def test_pull_goes_on_after_errors(spark, tmp_path):
    good, bad, other = (str(tmp_path / n) for n in ("good", "bad", "other"))
    quotes(spark, [("s", k, k, 1.0) for k in range(5)]).drop("inst").write.parquet(good)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"PAR1 not a table")
    spark.range(3).write.parquet(other)
    rows = {r.inst: r for r in io.pull(spark, {"s": good, "m": str(tmp_path / "missing"), "b": bad, "o": other}, str(tmp_path / "out")).collect()}
    assert rows["s"].rows == 5 and rows["s"].error is None
    assert all(rows[k].rows is None and rows[k].error for k in "mbo") and "missing columns" in rows["o"].error


def test_stream_of_filled_seconds(spark, tmp_path):
    """Several batches with late and silent seconds, against a fill of the finished table."""
    rows = [("a", 0.2, 1, 10.0), ("a", 0.7, 2, 11.0), ("b", 1.0, 3, 20.0), ("a", 5.5, 4, 12.0), ("a", 3.1, 5, 11.5), ("b", 9.0, 6, 21.0), ("b", 9.0, 7, 22.0), ("a", 5.1, 8, 12.5), ("b", 40.0, 9, 23.0), ("b", 41.0, 10, 24.0), ("b", 90.0, 11, 25.0)]
    for k in range(0, len(rows), 2):
        made = quotes(spark, []).schema
        spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), e, b, b + 1.0, 1.0, 2.0) for i, s, e, b in rows[k : k + 2]], made).withColumn("received_time", F.col("received_time").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k:02d}"))
    schema = spark.read.parquet(str(tmp_path / "in")).drop("part").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    job = live.filled_seconds(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert job.exception() is None
    got = {(r.inst, r.sec): (r.bid, r.n_ticks) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    done = 80  # the watermark: ten seconds before the last quote
    want = {}
    for i in "ab":
        own = sorted((s, e, b) for j, s, e, b in rows if j == i)
        for second in range(int(own[0][0]), done):
            before = [r for r in own if r[0] < second + 1]
            want[i, T0 + dt.timedelta(seconds=second)] = (before[-1][2], sum(second <= r[0] for r in before))
    assert got == want


def test_columns_are_discovered(spark):
    df = spark.createDataFrame([(1.0, 3.0, 9.0)], "BEST_BID_PRICE double, best_ask_price double, ask_price_2 double")
    assert io.found_mid(df).first().mid_price == 2.0
    assert io.found_mid(df.toDF("x", "my ask Price", "Price of bid")).first().mid_price == 6.0
    with pytest.raises(ValueError):
        io.found_mid(df.select("BEST_BID_PRICE"))


def test_strategies_below_the_valid_times(spark):
    rows = spark.createDataFrame([(0, 10.0, 10.0, 500.0), (1, 9.0, 10.0, 500.0), (2, 9.0, 10.0, 60_000.0)], "rn long, s_mid double, s_micro double, tte_ms double")
    clamp, intrinsic = ({r.rn: r for r in pricing.by_parameters(rows, pricing.jsu_table(spark), s).collect()} for s in ("clamp", "intrinsic"))
    assert [clamp[k].below for k in range(3)] == [True, True, False]
    assert intrinsic[0].p == 1.0 and intrinsic[1].p == 0.0 and intrinsic[2].p == clamp[2].p and 0 < clamp[0].p < 1
    with pytest.raises(ValueError):
        pricing.by_parameters(rows, pricing.jsu_table(spark), "guess")


def test_histograms(spark):
    x = np.random.default_rng(1).normal(size=500)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 2.0)] * 3 + [("b", None)], "g string, v double")
    rows = scoring.histogram(df, ["g"], "v", 20).collect()
    n, edges = np.histogram(x, 20)
    assert {r.bin: r.n for r in rows if r.g == "a"} == {k: c for k, c in enumerate(n.tolist()) if c}
    assert all(np.isclose(r.low, edges[r.bin]) for r in rows if r.g == "a") and np.isclose(sum(r.density for r in rows if r.g == "a") * (edges[1] - edges[0]), 1)
    assert [(r.n, r.bin) for r in rows if r.g == "b"] == [(3, 10 * 2 // 2)]
