"""Registered queries of scalar functions: calendar features and option prices (F), and parameter sweeps (O)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import bars, pricing
from ..plans import series
from . import twin as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, columns: dict, sql: dict[str, str] | None, key: str = "rn", base: str = S.PRICES, source: str = "prices") -> None:
    """A query of columns (functions of no argument) over the price table, and its twin."""

    def run(spark, sf_dir):
        df = series.price_table(spark, sf_dir)
        return S.rounded(df.select(key, *(c().alias(n) for n, c in columns.items())))

    QUERIES[name] = run
    if sql:
        ORACLES[name] = S.query(sql, keys=key, base=base, source=source, exact=tuple(n for n in sql if n.startswith(("day_", "mow", "minute_in", "int_", "ts_"))))


def ts():
    return F.col("sec")


def day():
    return F.to_date("sec")


T2 = repr(2 * math.pi)
_SOD = "(hour(sec) * 3600 + minute(sec) * 60 + second(sec))"
_DOW = "(isodow(sec) - 1)"

add("F01_safe_division", {"v": lambda: X.safe_div(F.col("s_mid"), F.col("s_obi"), 0.5)}, {"v": "coalesce(s_mid / nullif(s_obi, 0), 0.5)"})
add(
    "F02_math",
    {"a": lambda: F.ln("s_mid"), "b": lambda: F.exp(-F.col("s_mid") / 100), "c": lambda: F.sqrt("s_mid"), "d": lambda: F.signum("s_obi"), "e": lambda: F.pow("s_obi", F.lit(2.0)), "f": lambda: F.sin("s_mid"), "g": lambda: F.log1p("s_mid"), "h": lambda: F.abs("s_obi")},
    {"a": "ln(s_mid)", "b": "exp(-s_mid / 100)", "c": "sqrt(s_mid)", "d": "sign(s_obi)", "e": "pow(s_obi, 2)", "f": "sin(s_mid)", "g": "ln(1 + s_mid)", "h": "abs(s_obi)"},
)
ORACLES["F02_math"] = ORACLES["F02_math"].replace("round(sign(s_obi), 8)", "round(sign(s_obi)::DOUBLE, 8)")
add("F03_clip_chain", {"v": lambda: X.clip(F.col("s_obi"), -0.5, 0.5)}, {"v": "least(greatest(s_obi, -0.5), 0.5)"})
add("F04_bankers_rounding", {"v": lambda: F.rint(F.col("s_bid_size") / 2)}, {"v": "round_even(s_bid_size / 2, 0)"})


def _parzen(x):
    return F.when(x <= 0.5, 1 - 6 * x * x + 6 * x * x * x).when(x <= 1, 2 * (1 - x) * (1 - x) * (1 - x)).otherwise(0.0)


_PX = "(s_bid_size / 100)"
add("F05_parzen", {"v": lambda: _parzen(F.col("s_bid_size") / 100)}, {"v": f"CASE WHEN {_PX} <= 0.5 THEN 1 - 6 * {_PX} * {_PX} + 6 * {_PX} * {_PX} * {_PX} WHEN {_PX} <= 1 THEN 2 * (1 - {_PX}) * (1 - {_PX}) * (1 - {_PX}) ELSE 0 END"})

# Calendar --------------------------------------------------------------------------------------------------------------

_PARTS = {"month": ("month", 12), "weekday": (None, 7), "day": ("day", 31), "hour": ("hour", 24), "minute": ("minute", 60), "second": ("second", 60)}


def _part(k):
    return F.weekday("sec") + 1 if k == "weekday" else {"month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}[k]("sec")


add(
    "F19_cyclical_time",
    {f"{k}_{f}": (lambda k=k, p=p, j=j: X.cyclic(_part(k), p, k)[j]) for k, (_, p) in _PARTS.items() for j, f in enumerate(("sin", "cos"))},
    {f"{k}_{f}": f"{f}({'isodow(sec)' if k == 'weekday' else f'{n}(sec)'} * ({T2} / {p}))" for k, (n, p) in _PARTS.items() for f in ("sin", "cos")},
)
add("F20_minute_of_week", {"mow": lambda: X.minute_of_week(ts()).cast("long")}, {"mow": f"{_DOW} * 1440 + hour(sec) * 60 + minute(sec)"})


def _lf(month: str) -> str:
    """SQL: the last Friday of the month of a date."""
    end = f"last_day({month})"
    return f"({end} - ((isodow({end}) + 2) % 7)::INT)"


_D = "sec::DATE"
add("F21_last_friday", {"day_v": lambda: X.last_friday(day())}, {"day_v": f"{_lf(_D)}::DATE"})
_NM = f"CASE WHEN {_D} <= {_lf(_D)} THEN {_lf(_D)} ELSE {_lf(f'(date_trunc(chr(109) || chr(111) || chr(110) || chr(116) || chr(104), {_D}) + INTERVAL 1 MONTH)::DATE')} END".replace("chr(109) || chr(111) || chr(110) || chr(116) || chr(104)", "'month'")
_Q0 = f"date_trunc('quarter', {_D})"
_NQ = f"CASE WHEN {_D} <= {_lf(f'({_Q0} + INTERVAL 2 MONTH)::DATE')} THEN {_lf(f'({_Q0} + INTERVAL 2 MONTH)::DATE')} ELSE {_lf(f'({_Q0} + INTERVAL 5 MONTH)::DATE')} END"
add("F22_days_to_expiry", {"int_m": lambda: F.datediff(X.next_monthly(day()), day()).cast("long"), "int_q": lambda: F.datediff(X.next_quarterly(day()), day()).cast("long")}, {"int_m": f"(({_NM})::DATE - {_D})::BIGINT", "int_q": f"(({_NQ})::DATE - {_D})::BIGINT"})
_NEXT = f"(date_trunc('month', {_D}) + INTERVAL 1 MONTH)::DATE"
_HM = f"greatest((CASE WHEN {_D} < {_lf(_D)} THEN {_lf(_D)} ELSE {_lf(_NEXT)} END - {_D}) * 24 + 8 - {_SOD} / 3600, 0)"
_WK = f"(4 * 86400 + 8 * 3600 - ({_DOW} * 86400 + {_SOD}))"
_HW = f"(CASE WHEN (({_WK} % 604800) + 604800) % 604800 = 0 THEN 604800 ELSE (({_WK} % 604800) + 604800) % 604800 END / 3600)"
_LN2 = repr(math.log(2))
add(
    "F23_option_expiries",
    {"weekly": lambda: X.hours_to_weekly(ts()), "monthly": lambda: X.hours_to_monthly(ts()), "near_weekly": lambda: X.half_life(X.hours_to_weekly(ts()), 4), "near_monthly": lambda: X.half_life(X.hours_to_monthly(ts()), 4)},
    {"weekly": _HW, "monthly": _HM, "near_weekly": f"exp({_HW} * (-{_LN2} / 4))", "near_monthly": f"exp({_HM} * (-{_LN2} / 4))"},
)
_EP = "(epoch_us(sec) / 1000000)"


def _epoch():
    return bars.micros("sec") / 1e6


def _cycle(seconds):
    return F.pmod(_epoch(), F.lit(float(seconds))) / seconds


add(
    "F24_funding_phases",
    {"f_sin": lambda: F.sin(X.TAU * _cycle(28800)), "f_cos": lambda: F.cos(X.TAU * _cycle(28800)), "h4_sin": lambda: F.sin(X.TAU * _cycle(14400)), "near": lambda: X.half_life((1 - _cycle(28800)) * 8, 1)},
    {"f_sin": f"sin({T2} * (({_EP} % 28800) / 28800))", "f_cos": f"cos({T2} * (({_EP} % 28800) / 28800))", "h4_sin": f"sin({T2} * (({_EP} % 14400) / 14400))", "near": f"exp((1 - ({_EP} % 28800) / 28800) * 8 * (-{_LN2}))"},
)
_HOW = f"({_DOW} * 24 + {_SOD} / 3600)"
add("F25_weekend_proximity", {"v": lambda: X.weekend_proximity(ts())}, {"v": f"CASE WHEN {_HOW} >= 120 THEN 1.0 WHEN {_HOW} >= 108 THEN ({_HOW} - 108) / 12 WHEN {_HOW} < 12 THEN 1 - {_HOW} / 12 ELSE 0.0 END::DOUBLE"})
add(
    "F26_phases",
    {"day_sin": lambda: F.sin(X.second_of_day(ts()) * (X.TAU / 86400)), "week_cos": lambda: F.cos((F.weekday("sec") * 86400 + X.second_of_day(ts())) * (X.TAU / 604800)), "hour_sin": lambda: F.sin((F.minute("sec") * 60 + F.second("sec")) * (X.TAU / 3600))},
    {"day_sin": f"sin({_SOD} * ({T2} / 86400))", "week_cos": f"cos(({_DOW} * 86400 + {_SOD}) * ({T2} / 604800))", "hour_sin": f"sin((minute(sec) * 60 + second(sec)) * ({T2} / 3600))"},
)
ORACLES["F26_phases"] = ORACLES["F26_phases"].replace(f"sin({_SOD} * ({T2} / 86400)) AS day_sin", f"round(sin({_SOD} * ({T2} / 86400)), 8) AS day_sin")
SESSIONS = {"tokyo": 0, "hong_kong": 5400, "frankfurt": 25200, "london": 28800, "new_york": 52200, "chicago": 48600, "frankfurt_end": 55800, "london_end": 59400, "new_york_end": 72000, "tokyo_end": 21600}


def _near(at: int) -> str:
    d = f"({_SOD} - {at})"
    return f"exp(abs({d} - 86400 * round_even({d} / 86400, 0)) * (-{_LN2} / 1800))"


add("F27_session_proximity", {k: (lambda v=v: X.session_proximity(ts(), v)) for k, v in SESSIONS.items()}, {k: _near(v) for k, v in SESSIONS.items()})
_HRS = "(epoch_us(sec) / 3600000000)"


def _basis_names():
    return [(t, k, f) for t, ks in zip((8, 24, 168, 720), (4, 12, 25, 4)) for k in range(1, ks + 1) for f in ("sin", "cos")]


def f28(spark, sf_dir):
    df = series.price_table(spark, sf_dir)
    return S.rounded(df.select("rn", *X.fourier_basis(bars.micros("sec") / 3_600_000_000)))


QUERIES["F28_fourier_basis"] = f28
ORACLES["F28_fourier_basis"] = S.query({f"f{t}_{k}_{f}": f"{f}({_HRS} * {2 * math.pi * k / t!r})" for t, k, f in _basis_names()}, base=S.PRICES, source="prices")
add("F29_truncate", {"ts_s": lambda: bars.second("sec"), "ts_15": lambda: bars.truncated("sec", 900)}, {"ts_s": "date_trunc('second', sec)", "ts_15": "time_bucket(INTERVAL 15 MINUTE, sec)"})
add("F30_minute_in_period", {"minute_in": lambda: F.pmod(F.minute("sec"), F.lit(15)).cast("long")}, {"minute_in": "minute(sec) % 15"})
add("F31_horizon", {"int_h": lambda: F.least(F.greatest((15 - F.pmod(F.minute("sec"), F.lit(15))) * 60, F.lit(1)), F.lit(600)).cast("long")}, {"int_h": "least(greatest((15 - minute(sec) % 15) * 60, 1), 600)::BIGINT"})
_TV = "(0.36 * (s_bid_size + 1) / 31557600)"


def _tv():
    return X.total_variance(F.lit(0.6), F.col("s_bid_size") + 1)


def _moneyness():
    return X.ln(X.ratio(F.col("s_mid"), F.col("s_micro")))


add(
    "F32_market_features",
    {"moneyness": _moneyness, "fvar": _tv, "root": lambda: F.sqrt(_tv()), "d2": lambda: (_moneyness() - _tv() / 2) / F.sqrt(F.greatest(_tv(), F.lit(1e-12))), "tte": lambda: F.ln(F.col("s_bid_size") + 1) / math.log(901)},
    {"moneyness": "ln(s_mid / s_micro)", "fvar": _TV, "root": f"sqrt({_TV})", "d2": f"(ln(s_mid / s_micro) - {_TV} / 2) / sqrt(greatest({_TV}, 1e-12))", "tte": f"ln(s_bid_size + 1) / {math.log(901)!r}"},
)

# Prices ------------------------------------------------------------------------------------------------------------------


def _cdf(x: str) -> str:
    z = f"(abs({x}) / {math.sqrt(2)!r})"
    t = f"(1 / (1 + {X._P} * {z}))"
    poly = "0"
    for a in reversed(X._A):
        poly = f"(({poly} + {a}) * {t})"
    erf = f"(1 - {poly} * exp(-{z} * {z}))"
    return f"CASE WHEN {x} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END"


_FV = f"greatest({_TV}, (s_bid_size + 1) * 1e-10)"
_D2 = f"((ln(s_mid / s_micro) - {_FV} / 2) / sqrt(greatest({_FV}, 1e-12)))"


def _p():
    v = X.floored_variance(_tv(), F.col("s_bid_size") + 1)
    return X.binary_probability(F.col("s_mid"), F.col("s_micro"), v)


def _cal(p: str) -> str:
    c = pricing.FOURIER
    terms = " + ".join(f"{c[2 * k - 1]} * sin({2 * math.pi * k!r} * {p}) + {c[2 * k]} * cos({2 * math.pi * k!r} * {p})" for k in (1, 2))
    return f"least(greatest({p} + {c[0]} + {terms}, 0), 1)"


add("F06_normal_cdf", {"v": lambda: X.normal_cdf(F.col("s_obi") * 3)}, {"v": _cdf("(s_obi * 3)")})
for _n in ("F07_binary_probability", "F10_raw_probability", "F12_price_rows"):
    add(_n, {"p": _p}, {"p": _cdf(_D2)})
add("F08_variance_floor", {"v": lambda: X.floored_variance(_tv(), F.col("s_bid_size") + 1) * 1e6}, {"v": f"{_FV} * 1e6"})
add("F09_fourier_calibration", {"p": lambda: X.fourier_calibrated(_p(), pricing.FOURIER)}, {"p": _cal(f"({_cdf(_D2)})")})
add("F11_variance_and_vol", {"tv": lambda: _tv() * 1e6, "vol": lambda: X.annual_vol(_tv(), F.col("s_bid_size") + 1)}, {"tv": f"{_TV} * 1e6", "vol": f"sqrt({_TV} * 31557600 / (s_bid_size + 1))"})


def jsu(spark, sf_dir):
    rows = series.price_table(spark, sf_dir).withColumn("tte_ms", F.col("s_bid_size") * 10_000)
    near = pricing.nearest_parameters(rows.select("rn", "s_mid", "s_micro", "tte_ms"), pricing.jsu_table(spark))
    p = X.jsu_probability(F.col("s_mid"), F.col("s_micro"), F.col("a"), F.col("b"), F.col("loc"), F.col("scale"))
    return S.rounded(near.select("rn", "param_tte", p.alias("p")))


_PARAMS = "params(t, a, b, l, s) AS (VALUES " + ", ".join(f"({float(t)}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for t, a, b, c, d in pricing.JSU) + ")"
_JX = "(a + b * asinh((ln(s_micro / s_mid) - l) / s))"
for _n in ("F13_jsu_probability", "J11_nearest_parameters"):
    QUERIES[_n] = jsu
    ORACLES[_n] = f"WITH {S.PRICES}, {_PARAMS}, m AS (SELECT rn, s_mid, s_micro, t, a, b, l, s, row_number() OVER (PARTITION BY rn ORDER BY abs(t - s_bid_size * 10000), t) AS k FROM prices, params WHERE s >= 0.0001) SELECT rn, t AS param_tte, round(1 - ({_cdf(_JX)}), 8) AS p FROM m WHERE k = 1"


def jsu_scale(spark, sf_dir):
    """The scale taken from a forecast variance where there is one."""
    rows = series.price_table(spark, sf_dir).withColumn("tte_ms", F.col("s_bid_size") * 10_000)
    near = pricing.nearest_parameters(rows.select("rn", "s_mid", "s_micro", "s_bid_size", "tte_ms"), pricing.jsu_table(spark))
    scale = F.coalesce(F.sqrt(F.greatest(F.when(F.col("rn") % 2 == 0, _tv()), F.when(F.col("rn") % 2 == 0, F.lit(1e-12)))), "scale")
    return S.rounded(near.select("rn", X.jsu_probability(F.col("s_mid"), F.col("s_micro"), F.col("a"), F.col("b"), F.col("loc"), scale).alias("p")))


QUERIES["F14_jsu_scale_override"] = jsu_scale
_JS = _JX.replace("/ s))", f"/ (CASE WHEN rn % 2 = 0 THEN sqrt(greatest({_TV}, 1e-12)) ELSE s END)))")
ORACLES["F14_jsu_scale_override"] = f"WITH {S.PRICES}, {_PARAMS}, m AS (SELECT rn, s_mid, s_micro, s_bid_size, t, a, b, l, s, row_number() OVER (PARTITION BY rn ORDER BY abs(t - s_bid_size * 10000), t) AS k FROM prices, params WHERE s >= 0.0001) SELECT rn, round(1 - ({_cdf(_JS)}), 8) AS p FROM m WHERE k = 1"


def jsu_spline(spark, sf_dir):
    """Parameters on cubic splines over the valid times to expiry; the scale as its ratio to the root of the time."""
    valid = [r for r in pricing.JSU if r[4] >= pricing.LEAST_SCALE]
    t = [r[0] for r in valid]
    x = F.col("s_bid_size") * 10_000
    cut = F.least(F.greatest(x, F.lit(float(t[0]))), F.lit(float(t[-1])))
    at = [pricing.interpolated(x, pricing.spline_coefficients(t, [r[k] for r in valid]), t[0], t[-1]) for k in (1, 2, 3)]
    ratio = pricing.interpolated(x, pricing.spline_coefficients(t, [r[4] / math.sqrt(r[0]) for r in valid]), t[0], t[-1])
    p = X.jsu_probability(F.col("s_mid"), F.col("s_micro"), at[0], F.greatest(at[1], F.lit(0.01)), at[2], F.greatest(ratio * F.sqrt(cut), F.lit(pricing.LEAST_SCALE)))
    return S.rounded(series.price_table(spark, sf_dir).select("rn", p.alias("p")))


QUERIES["F16_jsu_spline"] = jsu_spline


def sweep(spark, sf_dir):
    """Probabilities over moneyness and time for each instrument's mean mid."""
    mids = bars.last_per_second(bars.quotes(spark, sf_dir)).groupBy("inst").agg(F.avg((F.col("bid") + F.col("ask")) / 2).alias("spot"))
    m = F.explode(F.array(*(F.lit(k / 1000) for k in range(-5, 6)))).alias("m")
    rows = mids.select("*", m).select("*", F.explode(F.array(*(F.lit(float(t)) for t in (60, 300, 900)))).alias("tte"))
    strike = F.col("spot") * (1 + F.col("m"))
    return S.rounded(rows.select("inst", "m", "tte", X.binary_probability(F.col("spot"), strike, X.total_variance(F.lit(0.6), F.col("tte"))).alias("p")))


QUERIES["O12_parameter_sweep"] = sweep
_SV = "(0.36 * tte / 31557600)"
ORACLES["O12_parameter_sweep"] = f"WITH {S.LAST}, g AS (SELECT inst, avg((bid + ask) / 2) AS spot FROM bars1 GROUP BY inst), x AS (SELECT *, k / 1000::DOUBLE AS m FROM g, range(-5, 6) r(k)), z AS (SELECT *, unnest([60.0, 300.0, 900.0])::DOUBLE AS tte FROM x) SELECT inst, m, tte, round({_cdf(f'((ln(spot / (spot * (1 + m))) - {_SV} / 2) / sqrt(greatest({_SV}, 1e-12)))')}, 8) AS p FROM z"


def losses(spark, sf_dir):
    from .relational import variance_forecast

    e = F.col("y") - F.col("f")
    huber = F.when(F.abs(e) <= 1, 0.5 * e * e).otherwise(F.abs(e) - 0.5)
    level = F.exp("y") - F.exp("f")
    return S.rounded(variance_forecast(spark, sf_dir).agg(F.avg(e * e).alias("mse"), F.avg(huber).alias("huber"), F.sqrt(F.avg(e * e)).alias("rmse"), (0.5 * F.avg(e * e) + 0.5 * F.avg(level * level)).alias("mixed")))


QUERIES["F37_losses"] = losses


def _loss_sql() -> str:
    from .relational import _FC

    return _FC + " SELECT round(avg((y - f) * (y - f)), 8) AS mse, round(avg(CASE WHEN abs(y - f) <= 1 THEN 0.5 * (y - f) * (y - f) ELSE abs(y - f) - 0.5 END), 8) AS huber, round(sqrt(avg((y - f) * (y - f))), 8) AS rmse, round(0.5 * avg((y - f) * (y - f)) + 0.5 * avg((exp(y) - exp(f)) * (exp(y) - exp(f))), 8) AS mixed FROM z"


ORACLES["F37_losses"] = _loss_sql()
