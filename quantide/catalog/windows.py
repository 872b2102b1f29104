"""Registered queries of row windows, the per-second base, and window features (W, B, T)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import bars, features as X, rolling as R, seasonality
from ..plans import series
from ..sources import io
from . import twin as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, make, before: int, columns: dict[str, str], steps: list[dict[str, str]] | None = None, after: int = 0, sql: bool = True) -> None:
    """A query of the columns that make(df) gives over the base, and its twin."""

    def run(spark, sf_dir: str):
        df = series.with_features(series.price_table(spark, sf_dir), make, before, after)
        return S.rounded(df.select("rn", *columns))

    QUERIES[name] = run
    if sql:
        ORACLES[name] = S.query(columns, steps=steps)


def _named(**cols):
    return lambda df: df.withColumns(cols)


# W: primitives on s's returns and mids --------------------------------------------------------------------------------

for w in (5, 60, 1440):
    register(f"W01_rolling_sum_w{w}", lambda df, w=w: R.sums(df, {"x": (F.col("s_ret"), w)}), w, {"x": S.rs("s_ret", w)})
register("W02_rolling_mean", lambda df: R.sums(df, {"a": (F.col("s_spread"), 60), "b": (F.col("s_mid"), 300)}).withColumns({"mean_60": F.col("a") / 60, "mean_300": F.col("b") / 300}), 300, {"mean_60": S.rmean("s_spread", 60), "mean_300": S.rmean("s_mid", 300)})
register(
    "W03_rolling_std",
    lambda df: R.sums(df, {"a": (F.col("s_ret"), 60), "b": (F.col("s_ret") * F.col("s_ret"), 60), "c": (F.col("s_ret"), 300), "d": (F.col("s_ret") * F.col("s_ret"), 300)}).withColumns(
        {"std_60": R.std(F.col("a"), F.col("b"), 60), "std_300": R.std(F.col("c"), F.col("d"), 300)}
    ),
    300, {"std_60": S.rstd("s_ret", 60), "std_300": S.rstd("s_ret", 300)},
)
register("W05_rolling_max", lambda df: R.maxima(df, {"max_30": (F.col("s_mid"), 30), "max_300": (F.col("s_mid"), 300)}), 600, {f"max_{w}": S.full(w, f"max(s_mid) OVER {S.frame(w)}") for w in (30, 300)})
register("W06_rolling_min", lambda df: R.maxima(df, {"a": (-F.col("s_mid"), 30), "b": (-F.col("s_mid"), 300)}).withColumns({"min_30": -F.col("a"), "min_300": -F.col("b")}), 600, {f"min_{w}": S.full(w, f"min(s_mid) OVER {S.frame(w)}") for w in (30, 300)})
register("W07_rolling_corr", lambda df: R.correlations(df, {"corr_60": (F.col("s_ret"), F.col("p_ret"), 60)}), 60, {"corr_60": S.corr("s_ret", "p_ret", 60)})
register("W08_rolling_autocorr", lambda df: R.autocorrelations(df, {"ac_60": (F.col("s_ret"), 60)}), 61, {"ac_60": S.corr("s_ret", "lr", 59, 60)}, [{"lr": S.lag("s_ret", 1)}])


def _moments_sql(x: str, w: int) -> tuple[str, str]:
    e1, e2, e3, e4 = (f"({S.rs('*'.join([f'coalesce({x},0)'] * p), w)} / {w})" for p in (1, 2, 3, 4))
    var = f"({e2} - {e1} * {e1})"
    m3, m4 = f"({e3} - 3 * {e1} * {e2} + 2 * {e1} * {e1} * {e1})", f"({e4} - 4 * {e1} * {e3} + 6 * {e1} * {e1} * {e2} - 3 * {e1} * {e1} * {e1} * {e1})"
    a, b = (w + 1) * w / ((w - 1) * (w - 2) * (w - 3)), 3 * (w - 1) ** 2 / ((w - 2) * (w - 3))
    skew = S.full(w, f"CASE WHEN {var} > 0 THEN {m3} / pow({var}, 1.5) * {w * w / ((w - 1) * (w - 2))} ELSE 0 END")
    return skew, S.full(w, f"CASE WHEN {var} > 0 THEN {a} * {w - 1} * {m4} / ({var} * {var}) - {b} ELSE 0 END")


register("W09_rolling_skew", lambda df: R.moments(df, {"x": (F.col("s_ret"), 60)}), 60, {"x_skew": _moments_sql("s_ret", 60)[0]})
register("W10_rolling_kurt", lambda df: R.moments(df, {"x": (F.col("s_ret"), 60)}), 60, {"x_kurt": _moments_sql("s_ret", 60)[1]})
register("W12_lag_difference", lambda df: df.withColumn("d5", F.col("s_mid") - X.lag("s_mid", 5)), 5, {"d5": f"s_mid - {S.lag('s_mid', 5)}"})
register("W13_log_return", lambda df: df, 4, {"s_ret": "s_ret", "p_ret": "p_ret", "c_ret": "c_ret"})
register("W14_lead", lambda df: df.withColumn("next5", F.lead("s_mid", 5).over(R.order())), 4, {"next5": "lead(s_mid, 5) OVER (ORDER BY rn)"}, after=5)
register("W17_forward_sum", lambda df: df.withColumn("fwd", R.forward_sum(F.col("s_rv"), 60)), 4, {"fwd": "CASE WHEN count(s_rv) OVER (ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) = 60 THEN sum(s_rv) OVER (ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) END"}, after=60)


def prefixes(spark, sf_dir):
    """rn and the running sum of s's variance, not rounded."""
    return R.prefix_sums(series.base_table(spark, sf_dir), {"prefix": F.col("s_rv")}, 1024).select("rn", "prefix")


def w04(spark, sf_dir):
    return S.rounded(prefixes(spark, sf_dir).withColumn("prefix", F.col("prefix").cast("double")))


QUERIES["W04_prefix_sum"] = w04
ORACLES["W04_prefix_sum"] = S.query({"prefix": "sum(coalesce(s_rv, 0)) OVER (ORDER BY rn)"})


def w11(spark, sf_dir):
    return S.rounded(R.ewma(series.base_table(spark, sf_dir), {"ewma_5": ("s_rv", 5.0), "ewma_30": ("s_rv", 30.0)}, 2048))


_EWMA = ", ".join(f"{1 - math.exp(-math.log(2) / h)!r} * d.v + {math.exp(-math.log(2) / h)!r} * e.ewma_{h}" for h in (5, 30))
QUERIES["W11_ewma"] = QUERIES["T38_ewma_variance"] = w11
# A recursive query of as many steps as rows is out of reach for large tables; weights below 1e-17 are left out instead.
ORACLES["W11_ewma"] = ORACLES["T38_ewma_variance"] = (
    f"WITH {S.BASE}, v AS (SELECT rn, coalesce(s_rv, 0) AS v FROM base) SELECT t.rn, "
    + ", ".join(
        f"round(sum(CASE WHEN t.rn - u.rn <= {h * 60} THEN u.v * pow({math.exp(-math.log(2) / h)!r}, t.rn - u.rn) * (CASE WHEN u.rn = 0 THEN 1 ELSE {1 - math.exp(-math.log(2) / h)!r} END) END), {S.PLACES}) AS ewma_{h}"
        for h in (5, 30)
    )
    + " FROM v t JOIN v u ON u.rn BETWEEN t.rn - 1800 AND t.rn GROUP BY t.rn"
)


def w15(spark, sf_dir):
    df = bars.merged(bars.last_per_second(bars.quotes(spark, sf_dir)))
    return S.rounded(bars.filled(df, ["s_bid", "p_bid", "c_bid"]).select("sec", "s_bid", "p_bid", "c_bid"))


QUERIES["W15_fill_forward_backward"] = w15
ORACLES["W15_fill_forward_backward"] = f"WITH {S.BARS} SELECT sec, round(s_bid, 8) AS s_bid, round(p_bid, 8) AS p_bid, round(c_bid, 8) AS c_bid FROM bars"


def w16(spark, sf_dir):
    df = bars.merged(bars.last_per_second(bars.quotes(spark, sf_dir)))
    return S.rounded(bars.filled(df, ["c_bid"], backward=False).select("sec", "c_bid"))


QUERIES["W16_carry_forward"] = w16
ORACLES["W16_carry_forward"] = f"WITH {S.BARS} SELECT sec, round(c_bid, 8) AS c_bid FROM forward"


def w18(spark, sf_dir):
    df = series.bar_table(spark, sf_dir)
    cut = lambda f: F.floor(F.col("n") * f)
    return df.select("rn", F.when(F.col("rn") < cut(0.7), "train").when(F.col("rn") < cut(0.85), "val").otherwise("test").alias("split"))


QUERIES["W18_position_split"] = w18
ORACLES["W18_position_split"] = f"WITH {S.BARS} SELECT rn, CASE WHEN rn < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM bars"


def w19(spark, sf_dir, lookback: int = 60, stride: int = 30):
    df = series.base_table(spark, sf_dir)
    return S.rounded(df.filter((F.col("rn") >= lookback) & (F.pmod(F.col("rn") - lookback, F.lit(stride)) == 0)).select("rn", "s_mid"))


QUERIES["W19_strided_rows"] = w19
ORACLES["W19_strided_rows"] = S.query({"s_mid": "s_mid"}, tail="WHERE rn >= 60 AND (rn - 60) % 30 = 0")


def w21(spark, sf_dir, lookback: int = 8):
    """Lookback windows as arrays, the rows before each row; as text of whole ten-thousandths."""
    o = R.order().rowsBetween(-lookback, -1)
    units = F.floor(F.col("s_mid") * 10_000 + 1e-6).cast("long").cast("string")
    df = R.windowed(series.price_table(spark, sf_dir), lambda d: d.withColumn("w", F.collect_list(units).over(o)), lookback)
    return df.filter(F.col("rn") >= lookback).select("rn", F.array_join("w", "|").alias("window"))


QUERIES["W21_lookback_windows"] = w21
ORACLES["W21_lookback_windows"] = f"WITH {S.PRICES}, w AS (SELECT rn, list(floor(s_mid * 10000 + 1e-6)::BIGINT::VARCHAR) OVER (ORDER BY rn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS w FROM prices) SELECT rn, array_to_string(w, '|') AS window FROM w WHERE rn >= 8"
register("W22_decimated_carry", lambda df: X.dft_magnitude(df, "s", 240), 600, {"s_fourier_mag": "last_value(mag IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN 30 PRECEDING AND CURRENT ROW)"}, [
    {"re": S.rs(f"coalesce(s_rv, 0) * cos(rn * {2 * math.pi / 240!r})", 240), "im": S.rs(f"coalesce(s_rv, 0) * sin(rn * {2 * math.pi / 240!r})", 240)},
    {"mag": "CASE WHEN rn >= 239 AND (rn - 239) % 30 = 0 THEN sqrt(re * re + im * im) / 240 END"},
])

# B: base ---------------------------------------------------------------------------------------------------------------

register("B01_log_returns", lambda df: df, 4, {f"{i}_ret": f"{i}_ret" for i in "spc"})
register("B02_realised_variance", lambda df: df, 4, {f"{i}_rv": f"{i}_rv" for i in "spc"})
register("B03_signed_variance", lambda df: df, 4, {f"{i}_{k}": f"{i}_{k}" for i in "spc" for k in ("rsv_pos", "rsv_neg")})
register("B04_bipower", lambda df: df, 4, {f"{i}_bpv": f"{i}_bpv" for i in "spc"})
register("B05_update_flag", lambda df: df, 4, {"c_has_update": "c_has_update"})
_AVAIL = "CASE WHEN count(c_has_update) OVER (ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 10 THEN CASE WHEN sum(c_has_update) OVER (ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) > 0 THEN 1.0 ELSE 0.0 END END"
register("B06_availability", X.availability, 10, {"c_avail": _AVAIL})
register("P12_stale_substitution", lambda df: X.stale_replaced(X.availability(df)), 10, {"c_mid": "CASE WHEN av = 0 THEN s_mid ELSE c_mid END", "c_obi": "CASE WHEN av = 0 THEN s_obi ELSE c_obi END"}, [{"av": _AVAIL}])
_XMID = "(s_mid * s_n_ticks + p_mid * p_n_ticks + c_mid * c_n_ticks) / (s_n_ticks + p_n_ticks + c_n_ticks)"


def _composite(df):
    df = X.composite(df).withColumn("x_ret", F.ln("x_mid") - X.lag(F.ln("x_mid"), 1))
    x = F.col("x_ret")
    return df.withColumns({"x_rv": x * x, "x_rsv_pos": F.when(x > 0, x * x).otherwise(0.0), "x_rsv_neg": F.when(x < 0, x * x).otherwise(0.0), "x_bpv": F.abs(x) * X.lag(F.abs(x), 1) * X.HALF_PI})


register("B07_composite", _composite, 6, {"x_mid": "x_mid", "x_ret": "x_ret", "x_rv": "x_ret * x_ret", "x_rsv_pos": "CASE WHEN x_ret > 0 THEN x_ret * x_ret ELSE 0 END", "x_rsv_neg": "CASE WHEN x_ret < 0 THEN x_ret * x_ret ELSE 0 END", "x_bpv": "abs(x_ret) * lag(abs(x_ret)) OVER (ORDER BY rn) * (pi() / 2)"}, [{"x_mid": _XMID}, {"x_ret": "ln(x_mid) - lag(ln(x_mid)) OVER (ORDER BY rn)"}])

# T: features -----------------------------------------------------------------------------------------------------------

_b = [{"b": "ln(p_mid / greatest(s_mid, 1e-12))"}]
register("T01_basis_level", X.basis, 8192, {f"basis_level_w{w}": S.rmean("b", w) for w in (5, 60, 1440, 8192)}, _b)
register("T02_basis_vol", X.basis, 8192, {f"basis_vol_w{w}": S.rstd("b", w) for w in (60, 1440, 8192)}, _b)
register("T03_basis_change", X.basis, 8192, {f"basis_change_{k}s": f"b - {S.lag('b', k)}" for k in (60, 300)}, _b)
register("T04_basis_zscore", X.basis, 8192, {"basis_zscore_1h": S.div(f"b - {S.rmean('b', 3600)}", S.rstd("b", 3600))}, _b)
register("T05_spread_levels", X.spreads, 1440, {f"{i}_spread_w{w}": S.rmean(f"{i}_spread", w) for i in "sp" for w in (5, 60, 1440)})
register("T06_spread_zscore", X.spreads, 1440, {"s_spread_zscore_5m": S.div(f"s_spread - {S.rmean('s_spread', 300)}", S.rstd("s_spread", 300))})
_j = [{f"la_{i}": S.lag(f"abs({i}_ret)", 1) for i in "sp"}]


def _rv(w, i="s"):
    return S.rs(f"{i}_ret * {i}_ret", w)


def _jump(w, i="s"):
    bp = S.rs(f"abs({i}_ret) * la_{i}", w)
    return S.full(w, f"greatest({_rv(w, i)} - {X.HALF_PI!r} * {bp} / {w - 1}, 0)")


def _settled(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 1e-9 THEN 0 ELSE {x} END)"


def _up(i):
    return f"CASE WHEN {i}_ret > 0 THEN {i}_ret * {i}_ret ELSE 0 END"


def _dn(i):
    return f"CASE WHEN {i}_ret <= 0 THEN {i}_ret * {i}_ret ELSE 0 END"


W3 = (60, 900, 1440, 3600, 8192)
_jumps, _trend = X.both(X.jumps), X.both(X.trend)
register("T07_jump_ratio", _jumps, 8192, {f"{i}_jump_ratio_w{w}": S.div(_jump(w, i), _rv(w, i)) for i in "sp" for w in W3}, _j)
register("T08_asym_impact", _jumps, 8192, {f"{i}_asym_impact_w{w}": f"{S.rs(_dn(i), w)} - {S.rs(_up(i), w)}" for i in "sp" for w in W3}, _j)
register("T09_downside_share", _jumps, 8192, {f"{i}_downside_share_w{w}": S.div(S.rs(_dn(i), w), _rv(w, i)) for i in "sp" for w in W3}, _j)
register("T10_signed_jump", _jumps, 8192, {f"{i}_signed_jump_w{w}": f"{_jump(w, i)} * sign({_settled(S.rs(f'{i}_ret', w))})" for i in "sp" for w in W3}, _j)
register("T11_jump_variation", _jumps, 8192, {f"{i}_rj_w{w}": _jump(w, i) for i in "sp" for w in W3}, _j)
register("T12_signed_return", _trend, 32768, {f"{i}_signed_ret_w{w}": S.rs(f"{i}_ret", w) for i in "sp" for w in (30, 60, 1440)})
register("T13_drawdown", _trend, 32768, {f"{i}_drawdown_w{w}": S.full(w, f"ln({i}_mid + 1e-12) - max(ln({i}_mid + 1e-12)) OVER {S.frame(w)}") for i in "sp" for w in (1440, 8192, 16384)})
register("T14_variance_term_structure", _trend, 32768, {k: v for i in "sp" for k, v in ((f"{i}_rv_term_slope", f"{S.div(_rv(60, i), _rv(900, i))} * 15"), (f"{i}_rv_term_curvature", f"{_rv(60, i)} / 60 - 2 * {_rv(300, i)} / 300 + {_rv(900, i)} / 900"))})
register("T15_microprice_returns", X.microprice_returns, 300, {f"microprice_ret_{k}s": f"s_micro / {S.lag('s_micro', k)} - 1" for k in (1, 5, 10, 30, 60, 300)})
_acc = lambda a, b: f"CASE WHEN rn >= {b} THEN (ln(s_mid) - {S.lag('ln(s_mid)', a)}) / {a} - (ln(s_mid) - {S.lag('ln(s_mid)', b)}) / {b} END"
register("T16_return_acceleration", X.acceleration, 300, {f"ret_accel_{a}s_{b}s": _acc(a, b) for a, b in ((1, 5), (5, 30), (30, 300))})
_d = [{"d": f"coalesce(s_mid - {S.lag('s_mid', 1)}, 0)"}]
register("T17_vpin", X.flow, 900, {"vpin_5m": f"abs({S.div(S.rs('greatest(d, 0)', 300), S.rs('abs(d)', 300), 0.5)} - 0.5) * 2"}, _d)
register("T18_tick_intensity", X.flow, 900, {"tick_intensity_ratio": f"{S.div(S.rs('s_n_ticks', 10), S.rs('s_n_ticks', 60), 1.0)} * 6"})
_book = X.both(X.book)
register("T19_obi_delta", _book, 61, {f"{i}_obi_delta_5s": f"{i}_obi - {S.lag(f'{i}_obi', 5)}" for i in "sp"})
register("T20_obi_autocorr", _book, 61, {f"{i}_obi_autocorr_1m": S.corr(f"{i}_obi", f"lo_{i}", 59, 60) for i in "sp"}, [{f"lo_{i}": S.lag(f"{i}_obi", 1) for i in "sp"}])
register("T21_obi_divergence", X.book, 61, {"obi_divergence": "s_obi - p_obi"})
register("T22_spread_obi", _book, 61, {f"{i}_spread_obi_interaction": f"{i}_obi / greatest({i}_spread, 0.1)" for i in "sp"})
register("T23_realised_covariance", X.covariation, 300, {f"sp_rcov_{k}": S.rs("s_ret * p_ret", w) for k, w in (("1m", 60), ("5m", 300))} | {f"sp_rcov_corr_ratio_{k}": f"{S.rs('s_ret * p_ret', w)} / sqrt(greatest({_rv(w)} * {S.rs('p_ret * p_ret', w)}, 1e-12))" for k, w in (("1m", 60), ("5m", 300))})
register("T24_signed_volume_imbalance", X.both(X.signed_volume), 900, {f"{i}_signed_vol_imbalance_w{w}": S.div(S.rs(f"sign(coalesce({i}_ret, 0)) * {i}_n_ticks", w), S.rs(f"{i}_n_ticks", w)) for i in "sp" for w in (60, 300, 900)})
register("T25_cumulative_returns", X.covariation, 300, {f"{i}_cum_ret_{w}s": S.rs(f"{i}_ret", w) for i in "sp" for w in (10, 60)} | {f"ps_cum_ret_ratio_{w}s": S.div(S.rs("p_ret", w), _settled(S.rs("s_ret", w))) for w in (10, 60)})
_v = [{"md": "(s_mid - c_mid) / s_mid", "od": "s_obi - c_obi", "sr": "s_spread / c_spread", "vd": "s_micro - c_micro", "vr": "s_micro / c_micro"}]
register("T26_venue_mid_delta", X.venues, 3600, {"sc_mid_delta": "md"} | {f"sc_mid_delta_mean_w{w}": S.rmean("md", w) for w in (5, 30, 60, 300)} | {f"sc_mid_delta_std_w{w}": S.rstd("md", w) for w in (60, 300)}, _v)
register("T27_venue_obi", X.venues, 3600, {"sc_obi_imbalance": "od"} | {f"sc_obi_imbalance_w{w}": S.rmean("od", w) for w in (60, 300)}, _v)
register("T28_venue_spread_ratio", X.venues, 3600, {"sc_spread_ratio": "sr"} | {f"sc_spread_ratio_w{w}": S.rmean("sr", w) for w in (60, 300)}, _v)
register("T29_venue_variance_spread", X.venues, 3600, {f"sc_rv_spread_w{w}": f"ln({_rv(w)} + 1e-12) - ln({S.rs('c_ret * c_ret', w)} + 1e-12)" for w in (60, 300, 900, 3600)}, _v)
register("T30_venue_vwap", X.venues, 3600, {"sc_vwap_delta": "vd"} | {f"sc_vwap_ratio_w{w}": S.rmean("vr", w) for w in (60, 300)} | {f"sc_vwap_delta_w{w}": S.rmean("vd", w) for w in (60, 300)}, _v)
#: A seasonal model of the log variance, as a fit would give it; invented. Both engines can apply it, while only one fits it.
SEASON = seasonality.Fourier((8, 24, 168), (2, 2, 1), (-0.05, 0.2, -0.1, 0.05, 0.08, 0.4, 0.15, -0.12, 0.06, 0.1, -0.2), 1.03)
_AT = "(epoch_us(sec) / 3600000000)"
_WAVES = [(t, k) for t, ks in zip(SEASON.periods, SEASON.harmonics) for k in range(1, ks + 1)]
_FACTOR = f"exp({SEASON.coefficients[0]} + " + " + ".join(f"{SEASON.coefficients[1 + 2 * j]} * sin({_AT} * {2 * math.pi * k / t!r}) + {SEASON.coefficients[2 + 2 * j]} * cos({_AT} * {2 * math.pi * k / t!r})" for j, (t, k) in enumerate(_WAVES)) + f") / {SEASON.mean}"
#: The base with the variances of both main instruments divided by the seasonal factor in place.
SEASONAL = S.BASE + f", factored AS (SELECT *, greatest({_FACTOR}, 1e-12) AS s_seas_factor FROM base), seasonal AS (SELECT * REPLACE (" + ", ".join(f"{i}_{c} / s_seas_factor AS {i}_{c}" for i in "sp" for c in X.SEASONAL) + "), s_seas_factor AS p_seas_factor FROM factored)"


def seasonal_base(spark, sf_dir):
    """The base table, deseasonalised; written once."""
    factor = SEASON.factor()
    return io.stored(X.deseasonalised(series.base_table(spark, sf_dir), {i: factor for i in "sp"}))


def register_seasonal(name: str, make, before: int, columns: dict[str, str], after: int = 0) -> None:
    """A query of columns that make(df) gives over the deseasonalised base, and its twin."""

    def run(spark, sf_dir: str):
        return S.rounded(R.windowed(seasonal_base(spark, sf_dir), make, before, after).select("rn", *columns))

    QUERIES[name] = run
    ORACLES[name] = S.query(columns, base=SEASONAL, source="seasonal")


register_seasonal("B08_deseasonalised_base", lambda df: df, 1, {f"{i}_{c}": f"{i}_{c}" for i in "sp" for c in (*X.SEASONAL, "seas_factor")})


def b09(spark, sf_dir):
    """The same with a seasonal model of each main instrument that is fitted on the training rows."""
    base = io.stored(series.base_table(spark, sf_dir))
    train = base.filter(F.col("rn") < F.floor(F.col("n") * 0.7))
    models = {i: seasonality.fitted_fourier(train, f"{i}_rv") for i in "sp"}
    made = X.deseasonalised(base, {i: m.factor() for i, m in models.items()})
    return S.rounded(made.select("rn", *(f"{i}_{c}" for i in "sp" for c in (*X.SEASONAL, "seas_factor"))))


QUERIES["B09_fitted_deseasonalised_base"] = b09


def t31(spark, sf_dir):
    return S.rounded(X.wavelet_details(seasonal_base(spark, sf_dir)))


QUERIES["T31_wavelet_detail"] = t31
# Running sums of the logs, as far as the scale's windows reach.
ORACLES["T31_wavelet_detail"] = (
    f"WITH {SEASONAL}, q AS (SELECT rn, " + ", ".join(f"sum(ln(coalesce({i}_rv, 0) + 1e-12)) OVER (ORDER BY rn) AS q{i}" for i in "sp") + " FROM seasonal) SELECT rn, "
    + ", ".join(f"round(ln(pow(CASE WHEN rn >= {2**k} THEN (q{i} - 2 * {S.lag(f'q{i}', 2 ** (k - 1))} + {S.lag(f'q{i}', 2**k)}) / {2 ** (k - 1)} END, 2) + 1e-12), 8) AS {i}_modwt_d{k}" for i in "sp" for k in X.SCALES) + " FROM q"
)
register("T32_return_correlation", X.pair_correlation, 8192, {f"sp_corr_w{w}": S.corr("s_ret", "p_ret", w) for w in (60, 300, 1440, 8192)})
_vv = [{f"v0_{i}": S.rs(f"{i}_rv", 60) for i in "sp"}, {k: v for i in "sp" for k, v in ((f"v_{i}", f"coalesce(v0_{i}, 0)"), (f"l_{i}", f"ln(v0_{i} + 1e-12)"))}]
_vov = X.both(X.variance_of_variance)
register("T33_vol_of_vol", _vov, 1500, {f"{i}_vol_of_vol_w{w}": S.rstd(f"v_{i}", w) for i in "sp" for w in (60, 1440)}, _vv)
register("T47_spread_variance_correlation", X.variance_of_variance, 1500, {"spread_rv_corr_15m": S.corr("s_spread", "v_s", 900)}, _vv)
register("T48_vol_phase", _vov, 1500, {f"{i}_vol_phase_{k}": f"(l_{i} - {S.rmean(f'coalesce(l_{i}, 0)', w)}) / greatest({S.rstd(f'coalesce(l_{i}, 0)', w)}, 1e-12)" for i in "sp" for k, w in (("5m", 300), ("15m", 900))}, _vv)
_ts = [{f"k5_{i}": S.rs(f"{i}_ret", 5) for i in "sp"}, {f"kk_{i}": f"coalesce(k5_{i} * k5_{i}, 0)" for i in "sp"}]


def _tsrv(w, i):
    return S.full(w, f"greatest({S.rs(f'kk_{i}', w)} / 5 - {_rv(w, i)} / 5, 0.1 * {_rv(w, i)})")


_two = X.both(X.two_scale)
register("T34_two_scale_variance", _two, 14410, {f"{i}_tsrv_w{w}": _tsrv(w, i) for i in "sp" for w in (60, 300, 900, 3600, 14400)}, _ts)
register("T35_two_scale_ratio", _two, 14410, {f"{i}_tsrv_rv_ratio_w{w}": f"ln(({_tsrv(w, i)} + 1e-12) / ({_rv(w, i)} + 1e-12))" for i in "sp" for w in (60, 300, 900)}, _ts)


def _rq(w, i):
    return f"{S.rs(f'{i}_ret * {i}_ret * {i}_ret * {i}_ret', w)} * {w / 3!r}"


RQ = (60, 300, 900, 3600)
register("T37_quarticity", X.both(X.quarticity), 3600, {f"{i}_rq_w{w}": _rq(w, i) for i in "sp" for w in RQ})
_rl = [{f"lr_{i}": f"coalesce({S.lag(f'coalesce({i}_ret, 0)', 1)}, 0)" for i in "sp"}]


def _roll(w, i):
    return S.full(w, f"2 * sqrt(greatest(-({S.rs(f'{i}_ret * lr_{i}', w - 1)} / {w - 1} - {S.rs(f'{i}_ret', w - 1)} / {w - 1} * {S.rs(f'lr_{i}', w - 1)} / {w - 1}), 0))")


def _park(w, i):
    return S.full(w, f"pow(ln(max({i}_micro) OVER {S.frame(w)} / min({i}_micro) OVER {S.frame(w)}), 2) / (4 * ln(2))")


register("T39_roll_measure", X.both(X.roll_measure), 310, {f"{i}_roll_measure_w{w}": _roll(w, i) for i in "sp" for w in (60, 300)}, _rl)
register("T40_parkinson", X.both(X.parkinson), 120, {f"{i}_parkinson_{w}s": _park(w, i) for i in "sp" for w in (30, 60)})
register("T41_perp_lead", X.lead_correlation, 300, {"perp_lead_1s": S.corr("p_ret", "nx", 300)}, [{"nx": "coalesce(lead(s_ret) OVER (ORDER BY rn), 0)"}], after=2)
_x = [{f"x_{i}": f"ln(coalesce({i}_rv, 0) + 1e-12)" for i in "sp"}]
register("T42_roughness", X.both(X.roughness), 300, {f"{i}_roughness_{k}s": f"x_{i} - {S.lag(f'x_{i}', k)}" for i in "sp" for k in (5, 30, 60, 300)} | {f"{i}_vol_accel_5s": f"CASE WHEN rn >= 10 THEN x_{i} - 2 * {S.lag(f'x_{i}', 5)} + {S.lag(f'x_{i}', 10)} END" for i in "sp"}, _x)


def t44(spark, sf_dir):
    base = seasonal_base(spark, sf_dir)
    return S.rounded(X.dft_magnitudes(base, base.count()))  # of the written table


def _t44_sql() -> str:
    parts, outs = [], []
    for name, period in X.PERIODS.items():
        w = f"least({period}, n // 2)"
        a = f"rn * {2 * math.pi / period!r}"
        waves = ", ".join(f"sum(coalesce({i}_rv, 0) * {f}({a})) OVER (ORDER BY rn) AS {f}_{i}" for i in "sp" for f in ("cos", "sin"))
        mag = ", ".join(f"sqrt(pow(p.cos_{i} - coalesce(q.cos_{i}, 0), 2) + pow(p.sin_{i} - coalesce(q.sin_{i}, 0), 2)) / p.w AS mag_{i}" for i in "sp")
        parts.append(
            f"p{name} AS (SELECT rn, {w} AS w, greatest({w} // 8, 1) AS step, {waves} FROM seasonal), "
            f"e{name} AS (SELECT p.rn, {mag} FROM p{name} p LEFT JOIN p{name} q ON q.rn = p.rn - p.w WHERE p.w > {X.LEAST_WINDOW} AND p.rn >= p.w - 1 AND (p.rn - (p.w - 1)) % p.step = 0)"
        )
        outs += [f"round(last_value(e{name}.mag_{i} IGNORE NULLS) OVER (ORDER BY seasonal.rn), 8) AS {i}_fourier_mag_{name}" for i in "sp"]
    joins = " ".join(f"LEFT JOIN e{k} ON e{k}.rn = seasonal.rn" for k in X.PERIODS)
    return f"WITH {SEASONAL}, {', '.join(parts)} SELECT seasonal.rn, {', '.join(outs)} FROM seasonal {joins}"


QUERIES["T44_dft_magnitude"] = t44
ORACLES["T44_dft_magnitude"] = _t44_sql()
_shape = X.both(X.shape)
register("T45_return_autocorr", _shape, 910, {f"{i}_ret_autocorr_{k}": S.corr(f"coalesce({i}_ret, 0)", f"lr_{i}", w - 1, w) for i in "sp" for k, w in (("5m", 300), ("15m", 900))}, [{f"lr_{i}": S.lag(f"coalesce({i}_ret, 0)", 1) for i in "sp"}])
register("T46_return_shape", _shape, 910, {f"{i}_{k}_{q}": _moments_sql(f"{i}_ret", w)[j] for i in "sp" for k, w in (("5m", 300), ("15m", 900)) for j, q in enumerate(("skew", "kurt"))})
register_seasonal("T49_har_windows", X.both(X.har), 16384, {f"{i}_{n}_w{w}": f"ln(sqrt({S.full(w, f'greatest({S.rs(f'{i}_{n}', w)}, 0)')} + 1e-12) + 1e-12)" for i in "sp" for n in X.SEASONAL for w in X.HAR_WINDOWS})
#: Windows of the first version, in rows.
HAR_V1 = (5, 30, 60, 1440, 2048, 4096, 8192, 16384)


def _har_v1(df):
    names = {f"{i}_{n}_h{w}": (f"{i}_{n}", w) for i in "sp" for n in X.SEASONAL for w in HAR_V1}
    return R.strict_sums(df, names).withColumns({k: 0.5 * F.ln(X.floored(F.col(k), 0.0) + X.EPS) for k in names})


register_seasonal("T50_har_v1", _har_v1, 16384, {f"{i}_{n}_h{w}": f"0.5 * ln(CASE WHEN count({i}_{n}) OVER {S.frame(w)} = {w} THEN sum({i}_{n}) OVER {S.frame(w)} END + 1e-12)" for i in "sp" for n in X.SEASONAL for w in HAR_V1})


def _estimators(df):
    """Quarticity, two-scale variance, Roll's measure and Parkinson's range of both instruments, and their logs."""
    for make in (X.quarticity, X.two_scale, X.roll_measure, X.parkinson):
        df = X.both(make)(df)
    return X.log_transformed(df, [c for c in df.columns if any(k in c for k in ("_rq_w", "_tsrv_w", "_roll_measure_w", "_parkinson_"))])


_logged = {f"{i}_rq_w{w}": _rq(w, i) for i in "sp" for w in RQ} | {f"{i}_tsrv_w{w}": _tsrv(w, i) for i in "sp" for w in (60, 300, 900, 3600, 14400)} | {f"{i}_roll_measure_w{w}": _roll(w, i) for i in "sp" for w in (60, 300)} | {f"{i}_parkinson_{w}s": _park(w, i) for i in "sp" for w in (30, 60)}
register("T51_log_transforms", _estimators, 14410, {f"{k}_log": f"CASE WHEN {v} IS NOT NULL THEN ln(greatest({v}, 1e-12)) END" for k, v in _logged.items()}, [_ts[0], _ts[1] | _rl[0]])


def _ahead(x, h):
    o = f"(ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"CASE WHEN count({x}) OVER {o} = {h} THEN sum({x}) OVER {o} END"


FORWARD = (60, 300, 900)
register_seasonal(
    "T52_forward_variance", X.seasonal_targets, 4,
    {f"{i}_fwd_{n}_{h}": _ahead(f"{i}_{c}", h) for i in "sp" for h in FORWARD for n, c in (("rv", "rv"), ("seas", "seas_factor"))} | {f"{i}_fwd_log_rv_{h}": f"ln({_ahead(f'{i}_rv', h)} + 1e-12)" for i in "sp" for h in FORWARD}, 901,
)
register_seasonal("P23_reseasonalise", lambda df: (lambda d: d.withColumns({f"{i}_v_{h}": X.restored(F.col(f"{i}_fwd_log_rv_{h}"), F.col(f"{i}_fwd_seas_{h}"), h) for i in "sp" for h in FORWARD}))(X.seasonal_targets(df)), 4, {f"{i}_v_{h}": f"({_ahead(f'{i}_rv', h)} + 1e-12) * ({_ahead(f'{i}_seas_factor', h)} / {h})" for i in "sp" for h in FORWARD}, 901)


def t36(spark, sf_dir):
    return S.rounded(X.realized_kernels(series.base_table(spark, sf_dir)))


QUERIES["T36_realized_kernel"] = t36
RK = (300, 900)


def _rk(w, i):
    weights = X.kernel_weights(w).tolist()
    terms = " + ".join(f"{(1 if h == 0 else 2) * k!r} * sum({i}{h}) OVER (ORDER BY rn ROWS BETWEEN {w - 1 - h} PRECEDING AND CURRENT ROW)" for h, k in enumerate(weights) if k > 0)
    return S.full(w, f"greatest({terms}, 0.1 * sum({i}0) OVER {S.frame(w)})")


# Each lag's products are a column, so that its window is a direct frame of the pairs inside the window.
ORACLES["T36_realized_kernel"] = S.query(
    {f"{i}_rk_w{w}": _rk(w, i) for i in "sp" for w in RK},
    steps=[{f"r_{i}": f"coalesce({i}_ret, 0)" for i in "sp"}, {f"{i}{h}": f"r_{i} * r_{i}" if h == 0 else f"r_{i} * coalesce({S.lag(f'r_{i}', h)}, 0)" for i in "sp" for h in range(math.ceil(max(RK) ** (2 / 3)))}],
)


def t43(spark, sf_dir):
    return S.rounded(X.spectral_bands(seasonal_base(spark, sf_dir)))


def _t43_sql() -> str:
    """The few low frequencies and the highest by a direct transform; the band above them by the sum of squares."""
    ctes, outs, joins = [], [], []
    for i in "sp":
        for suffix, w in X.SPECTRA.items():
            k = f"{i}{suffix}"
            of = {j: next((b for b, (lo, hi) in X.BANDS.items() if lo <= j / w < hi), "none") for j in [*range(w // 300 + 2), w // 2]}
            low = [j for j, b in of.items() if b != "hf" or j == w // 2]
            power = lambda b: " + ".join([f"coalesce(sum(p) FILTER (j IN ({', '.join(str(j) for j in low if of[j] == b)})), 0)"])
            ctes.append(
                f"ends{k} AS (SELECT rn AS e FROM seasonal WHERE rn >= {w - 1} AND (rn - {w - 1}) % {w // 4} = 0), "
                f"rows{k} AS (SELECT e, rn - e + {w - 1} AS t, coalesce({i}_rv, 0) AS x FROM ends{k} JOIN seasonal ON rn BETWEEN e - {w - 1} AND e), "
                f"f{k} AS (SELECT e, j, pow(sum(x * cos({2 * math.pi / w!r} * ((j * t) % {w}))), 2) + pow(sum(x * sin({2 * math.pi / w!r} * ((j * t) % {w}))), 2) AS p FROM rows{k}, (SELECT unnest({low}) AS j) GROUP BY e, j), "
                f"b{k} AS (SELECT e, {power('mf')} AS mf, {power('lf')} AS lf, {power('trend')} AS trend, sum(CASE WHEN j IN (0, {w // 2}) THEN p ELSE 2 * p END) AS taken FROM f{k} GROUP BY e), "
                f"s{k} AS (SELECT e, mf + 1e-12 AS mf, lf + 1e-12 AS lf, trend + 1e-12 AS trend, ({w} * q - taken) / 2 + 1e-12 AS hf FROM b{k} JOIN (SELECT e, sum(x * x) AS q FROM rows{k} GROUP BY e) USING (e))"
            )
            each = {"hf_lf": "ln(hf / lf)", "mf_lf": "ln(mf / lf)", "hf_mf": "ln(hf / mf)", "trend_share": "trend / (hf + mf + lf + trend)"}
            ctes.append(f"r{k} AS (SELECT e, {', '.join(f'{x} AS {n}' for n, x in each.items())} FROM s{k})")
            outs += [f"round(last_value(r{k}.{n} IGNORE NULLS) OVER (ORDER BY seasonal.rn), 8) AS {i}_spec_{n}{suffix}" for n in each]
            joins.append(f"LEFT JOIN r{k} ON r{k}.e = seasonal.rn")
    return f"WITH {SEASONAL}, {', '.join(ctes)} SELECT seasonal.rn, {', '.join(outs)} FROM seasonal {' '.join(joins)}"


QUERIES["T43_spectral_bands"] = t43
ORACLES["T43_spectral_bands"] = _t43_sql()


def t53(spark, sf_dir):
    """Targets at a horizon that each row has for itself, as a difference of running sums: the later one is asked of its chunk."""
    h = (F.pmod(F.col("rn") * 7919, F.lit(900)) + 1).cast("long")
    df = R.gathered(prefixes(spark, sf_dir).withColumn("h", h), F.col("rn") + F.col("h"), ["prefix"])
    target = F.ln(F.greatest((F.col("prefix_at") - F.col("prefix")).cast("double"), F.lit(0.0)) + X.EPS)
    return S.rounded(df.filter(F.col("prefix_at").isNotNull()).select("rn", "h", target.alias("target")))


QUERIES["T53_horizon_target"] = QUERIES["J13_prefix_difference_join"] = t53
_T53 = f"WITH {S.BASE}, q AS (SELECT rn, sum(coalesce(s_rv, 0)::DECIMAL(38, 18)) OVER (ORDER BY rn) AS prefix FROM base) SELECT a.rn, (a.rn * 7919) % 900 + 1 AS h, round(ln(greatest((b.prefix - a.prefix)::DOUBLE, 0) + 1e-12), 8) AS target FROM q a JOIN q b ON b.rn = a.rn + (a.rn * 7919) % 900 + 1"
ORACLES["T53_horizon_target"] = ORACLES["J13_prefix_difference_join"] = _T53


def t54(spark, sf_dir, lookback: int = 16):
    """Positional features of lookback windows at a stride: k/L, what is left, its root, log1p, and the variance so far, from the
    running sums of the rows before, a frame within chunks with a halo."""
    before = F.collect_list("prefix").over(R.order().rowsBetween(-lookback, -1))
    at = (F.col("rn") >= lookback) & (F.pmod("rn", F.lit(64)) == 0)
    ends = R.windowed(prefixes(spark, sf_dir), lambda d: d.withColumn("w", before), lookback).filter(at)
    rows = ends.select(F.col("rn").alias("t"), F.col("w")[0].alias("p0"), F.posexplode("w").alias("k", "prefix"))
    left = (F.lit(float(lookback)) - F.col("k")) / lookback
    return S.rounded(rows.select("t", "k", (F.col("k") / lookback).alias("pos"), left.alias("left"), F.sqrt(left).alias("root"), F.log1p(left).alias("log1p"), F.ln(F.greatest((F.col("prefix") - F.col("p0")).cast("double"), F.lit(0.0)) + X.EPS).alias("log_cum_rv")))


QUERIES["T54_positional_features"] = QUERIES["T55_lookback_cumulative"] = t54
ORACLES["T54_positional_features"] = ORACLES["T55_lookback_cumulative"] = f"""WITH {S.BASE}, q AS (SELECT rn, sum(coalesce(s_rv, 0)::DECIMAL(38, 18)) OVER (ORDER BY rn) AS prefix FROM base),
e AS (SELECT rn AS t, unnest(range(0, 16)) AS k FROM q WHERE rn >= 16 AND rn % 64 = 0)
SELECT t, k::INT AS k, k / 16 AS pos, (16.0 - k) / 16 AS left, round(sqrt((16.0 - k) / 16), 8) AS root, round(ln(1 + (16.0 - k) / 16), 8) AS log1p, round(ln(greatest((a.prefix - b.prefix)::DOUBLE, 0) + 1e-12), 8) AS log_cum_rv
FROM e JOIN q a ON a.rn = t - 16 + k JOIN q b ON b.rn = t - 16"""
