"""Registered queries that share an operator with others but ask something else of it: strategies, splits, labels, smearing, skills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import bars, linear, pricing, scoring, seasonality
from ..plans import series
from ..sources import io
from . import twin as S
from .calendar import _JX, _PARAMS, _cdf
from .models import _DESIGN, _EVAL, design, evaluation, train
from .relational import _PR, forecasts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: S.rounded(run(spark, sf_dir))
    if sql:
        ORACLES[name] = sql


# Prices by parameter ---------------------------------------------------------------------------------------------------------

LEAST = min(t for t, *_, scale in pricing.JSU if scale >= pricing.LEAST_SCALE)
#: Nearest valid parameters of each row; its time is between 2 s and 970 s, so some rows lie below all valid ones.
_NEAR = f"WITH {S.PRICES}, {_PARAMS}, m AS (SELECT rn, s_mid, s_micro, s_bid_size * 10000 AS tte_ms, t, a, b, l, s, row_number() OVER (PARTITION BY rn ORDER BY abs(t - s_bid_size * 10000), t) AS k FROM prices, params WHERE s >= 0.0001)"
_P = f"(1 - ({_cdf(_JX)}))"


def timed(spark, sf_dir):
    return series.price_table(spark, sf_dir).select("rn", "s_mid", "s_micro", (F.col("s_bid_size") * 10_000).alias("tte_ms"))


def _strategies(spark, sf_dir):
    rows, params = timed(spark, sf_dir), pricing.jsu_table(spark)
    out = pricing.by_parameters(rows, params, "clamp", to="p_clamp")
    return pricing.by_parameters(out.withColumnRenamed("below", "was"), params, "intrinsic", to="p_intrinsic").select("rn", "below", "p_clamp", "p_intrinsic")


add("F15_degenerate_rows", _strategies, _NEAR + f" SELECT rn, tte_ms < {LEAST} AS below, round({_P}, 8) AS p_clamp, round(CASE WHEN tte_ms < {LEAST} THEN CASE WHEN s_mid >= s_micro THEN 1.0 ELSE 0.0 END ELSE {_P} END, 8) AS p_intrinsic FROM m WHERE k = 1")


def _inspected(spark, sf_dir):
    """The parameters that each row is priced with, whether its own time has valid ones, what is done if not, and the price."""
    near = pricing.nearest_parameters(timed(spark, sf_dir), pricing.jsu_table(spark))
    p = X.jsu_probability(F.col("s_mid"), F.col("s_micro"), F.col("a"), F.col("b"), F.col("loc"), F.col("scale"))
    valid = F.col("tte_ms") >= LEAST
    return near.select("rn", "tte_ms", "param_tte", "a", "b", "loc", "scale", valid.alias("valid"), F.when(valid, "direct").otherwise("clamp").alias("strategy"), p.alias("p"))


add("F17_parameters_at", _inspected, _NEAR + f" SELECT rn, tte_ms, t AS param_tte, round(a, 8) AS a, round(b, 8) AS b, round(l, 8) AS loc, round(s, 8) AS scale, tte_ms >= {LEAST} AS valid, CASE WHEN tte_ms >= {LEAST} THEN 'direct' ELSE 'clamp' END AS strategy, round({_P}, 8) AS p FROM m WHERE k = 1")


def _one_shot(spark, sf_dir):
    """Prices from a parameter file, read and used in one call."""
    pricing.jsu_table(spark).coalesce(1).write.csv(path := io.scratch(spark), header=True)
    return pricing.by_parameters(timed(spark, sf_dir), io.read_jsu(spark, path), "clamp").select("rn", "p")


add("F18_one_shot_price", _one_shot, _NEAR + f" SELECT rn, round({_P}, 8) AS p FROM m WHERE k = 1")

# Splits, labels, columns -----------------------------------------------------------------------------------------------------


def _splits(spark, sf_dir):
    """Three ways to train and validate: fractions in a row, all rows with the first part again, all rows with another table (here
    the ticks of another instrument); the ends of each range."""
    df = series.bar_table(spark, sf_dir)
    cut = lambda f: F.floor(F.col("n") * f)
    sides = {"fractions": {"train": F.col("rn") < cut(0.7), "val": (F.col("rn") >= cut(0.7)) & (F.col("rn") < cut(0.85)), "test": F.col("rn") >= cut(0.85)}, "val_on_train": {"train": F.lit(True), "val": F.col("rn") < cut(0.7)}, "external": {"train": F.lit(True)}}
    each = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(k).alias("split"), c.alias("has")) for m, parts in sides.items() for k, c in parts.items()))
    own = df.select("rn", F.explode(each).alias("x")).filter("x.has").select("rn", "x.mode", "x.split")
    other = bars.indexed(bars.merged(bars.last_per_second(bars.quotes(spark, sf_dir).filter("inst = 'c'")))).select("rn", F.lit("external").alias("mode"), F.lit("val").alias("split"))
    return own.unionByName(other).groupBy("mode", "split").agg(F.count("*").alias("n"), F.min("rn").alias("first"), F.max("rn").alias("last"))


add("O06_split_ranges", _splits, f"""WITH {S.BARS}, x AS (
  SELECT 'fractions' AS mode, CASE WHEN rn < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split, rn FROM bars
  UNION ALL SELECT 'val_on_train', 'train', rn FROM bars UNION ALL SELECT 'val_on_train', 'val', rn FROM bars WHERE rn < floor(n * 0.7::DOUBLE)
  UNION ALL SELECT 'external', 'train', rn FROM bars UNION ALL SELECT 'external', 'val', row_number() OVER (ORDER BY sec) - 1 FROM bars1 WHERE inst = 'c')
SELECT mode, split, count(*) AS n, min(rn) AS first, max(rn) AS last FROM x GROUP BY 1, 2""")


def _last_index(spark, sf_dir):
    """The number of the last row up to each one in which c had a quote."""
    df = bars.indexed(bars.merged(bars.last_per_second(bars.quotes(spark, sf_dir))))
    had = df.withColumn("last_index", F.when(F.col("c_bid").isNotNull(), F.col("rn")))
    return bars.filled(had, ["last_index"], backward=False).select("rn", "last_index")


add("W20_running_last_index", _last_index, f"WITH {S.WIDE}, x AS (SELECT row_number() OVER (ORDER BY sec) - 1 AS rn, c_bid FROM wide) SELECT rn, max(CASE WHEN c_bid IS NOT NULL THEN rn END) OVER (ORDER BY rn) AS last_index FROM x")


def _week_curve(spark, sf_dir):
    """Mean variance and its rows by minute of the week, on all rows and on the training rows, for each of the 10,080 minutes."""
    df = series.base_table(spark, sf_dir)
    train = F.when(F.col("rn") < F.floor(F.col("n") * 0.7), F.col("s_rv"))
    means = df.groupBy(X.minute_of_week(F.col("sec")).alias("mow")).agg(F.avg("s_rv").alias("mean"), F.count("s_rv").alias("n"), F.avg(train).alias("train_mean"), F.count(train).alias("train_n"))
    return spark.range(seasonality.WEEK).select(F.col("id").cast("int").alias("mow")).join(means, "mow", "left").fillna(0, ["n", "train_n"])


add("A07_mean_by_minute_of_week", _week_curve, f"""WITH {S.BASE}, x AS (
  SELECT (isodow(sec) - 1) * 1440 + hour(sec) * 60 + minute(sec) AS mow, avg(s_rv) AS mean, count(s_rv) AS n, avg(s_rv) FILTER (rn < floor(n * 0.7::DOUBLE)) AS train_mean, count(s_rv) FILTER (rn < floor(n * 0.7::DOUBLE)) AS train_n FROM base GROUP BY 1)
SELECT m::INT AS mow, round(mean, 8) AS mean, coalesce(n, 0) AS n, round(train_mean, 8) AS train_mean, coalesce(train_n, 0) AS train_n FROM range(10080) r(m) LEFT JOIN x ON m = x.mow""")


def _discovered(spark, sf_dir):
    """Mids of quotes whose columns have another vendor's names."""
    q = bars.quotes(spark, sf_dir).select("event_id", F.col("bid_size").alias("L0_Bid_Qty"), F.col("bid").alias("L0.Bid.Price"), F.col("ask").alias("L0.Ask.Price"), F.col("ask_size").alias("L0_Ask_Qty"))
    return io.found_mid(q).select("event_id", "mid_price")


add("P10_column_discovery", _discovered, f"WITH {S.QUOTES} SELECT event_id, round((bid + ask) / 2, 8) AS mid_price FROM quotes")


def _guarded(spark, sf_dir):
    """What of a list of columns the bars have, and what they lack."""
    df, wanted = series.bar_table(spark, sf_dir), ["s_bid", "s_ask", "x_mid", "s_funding"]
    missing = [c for c in wanted if c not in df.columns]
    return io.required(df, ["rn", "s_bid"]).select("rn", *(c for c in wanted if c in df.columns), F.lit(",".join(missing)).alias("missing"))


add("P18_column_guard", _guarded, f"WITH {S.BARS} SELECT rn, round(s_bid, 8) AS s_bid, round(s_ask, 8) AS s_ask, 'x_mid,s_funding' AS missing FROM bars")
LABELS = ("30s", "1m", "15m", "2h", "1d", "m", "5x", "-1m")


def _labels(spark, sf_dir):
    """For each row and horizon label the second that the horizon ends in; labels that are none give null."""
    rows = series.bar_table(spark, sf_dir).select("rn", "sec", F.explode(F.array(*(F.lit(x) for x in LABELS))).alias("label"))
    h = X.horizon_seconds(F.col("label"))
    return rows.select("rn", "label", h.alias("seconds"), (bars.micros("sec") / 1_000_000 + h).cast("long").alias("ends"))


_SECONDS = "CASE WHEN regexp_matches(label, '^[0-9]+[smhd]$') THEN regexp_extract(label, '^([0-9]+)', 1)::BIGINT * CASE right(label, 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END END"
add("F33_horizon_labels", _labels, f"WITH {S.BARS}, l AS (SELECT rn, sec, unnest({list(LABELS)}) AS label FROM bars) SELECT rn, label, ({_SECONDS})::BIGINT AS seconds, (epoch_us(sec) // 1000000 + {_SECONDS})::BIGINT AS ends FROM l")

# Smearing, skills, histograms ------------------------------------------------------------------------------------------------


def _smeared(spark, sf_dir):
    """Forecasts of the level: the exponential alone, with half the residual variance, and with Duan's factor, both from the
    training residuals."""
    df = io.stored(design(spark, sf_dir))
    m = linear.ols(train(df).select("f1", "y60"), ["f1"], ["y60"])["y60"]
    if m is None:
        return df.select("rn", *(F.lit(None).cast("double").alias(c) for c in ("none", "lognormal", "duan")))
    factor = train(df).filter(F.col("f1").isNotNull() & F.col("y60").isNotNull()).agg(linear.smearing_factor(F.col("y60") - m.predict(), F.lit(m.sigma2))).first()[0]
    return df.select("rn", F.exp(m.predict()).alias("none"), F.exp(m.predict() + m.sigma2 / 2).alias("lognormal"), (F.exp(m.predict()) * factor).alias("duan"))


add("P25_smearing", _smeared, _DESIGN + """, t AS (SELECT * FROM g WHERE rn < floor(n * 0.7::DOUBLE) AND f1 IS NOT NULL AND y60 IS NOT NULL),
r AS (SELECT regr_intercept(y60, f1) AS a, regr_slope(y60, f1) AS b, (regr_syy(y60, f1) - regr_slope(y60, f1) * regr_sxy(y60, f1)) / (count(*) - 2) AS v FROM t),
d AS (SELECT avg(exp(least(greatest(y60 - a - b * f1, -3 * sqrt(v)), 3 * sqrt(v)))) AS duan FROM t, r)
SELECT rn, round(exp(a + b * f1), 8) AS "none", round(exp(a + b * f1 + v / 2), 8) AS lognormal, round(exp(a + b * f1) * duan, 8) AS duan FROM g, r, d""")


def _skills(spark, sf_dir):
    """Brier by minute of at least ten rows against both naive forecasts: the mean outcome of all rows, and of the minute's own."""
    rows = io.stored(forecasts(spark, sf_dir))
    by = rows.groupBy(F.col("m").cast("long").alias("m")).agg(scoring.brier(F.col("p"), F.col("y")).alias("brier"), F.var_pop("y").alias("own"), F.avg("y").alias("rate"), F.count("*").alias("n")).filter("n >= 10")
    every = rows.agg(F.avg("y").alias("mean"))
    met = by.crossJoin(F.broadcast(every))  # one row
    return met.select("m", "n", scoring.skill(F.col("brier"), F.col("own")).alias("skill_own"), scoring.skill(F.col("brier"), F.col("own") + F.pow(F.col("rate") - F.col("mean"), 2)).alias("skill_all"))


add("A12_brier_skill_by_minute", _skills, _PR + ", e AS (SELECT avg(y) AS mean FROM f) SELECT m, count(*) AS n, round(1 - avg((p - y) * (p - y)) / nullif(var_pop(y), 0), 8) AS skill_own, round(1 - avg((p - y) * (p - y)) / nullif(avg((mean - y) * (mean - y)), 0), 8) AS skill_all FROM f, e GROUP BY m HAVING count(*) >= 10")


def _variance_histogram(spark, sf_dir):
    """Densities of the log variance ahead, by outcome."""
    rows = evaluation(spark, sf_dir).select(F.col("label").alias("y"), F.log10(F.col("variance") + 1e-20).alias("v"))
    return scoring.histogram(io.stored(rows), ["y"], "v").select("y", "bin", "n", "density")


add("A20_variance_histograms", _variance_histogram, _EVAL.replace(", e AS (", ", unused AS (") + """, h AS (SELECT y, log10(v0 + 1e-20) AS x FROM (SELECT y, greatest((q2.prefix - q1.prefix)::DOUBLE, 0) AS v0 FROM x JOIN q q1 ON q1.rn = x.rn JOIN q q2 ON q2.rn = x.last)),
w AS (SELECT y, min(x) AS lo, max(x) AS hi, count(*) AS n FROM h GROUP BY y), z AS (SELECT *, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS f, CASE WHEN lo = hi THEN 1.0 / 50 ELSE (hi - lo) / 50 END AS d FROM w)
SELECT h.y, least(floor((x - f) / d), 49)::INT AS bin, count(*) AS n, round(count(*) / (any_value(z.n) * any_value(d)), 8) AS density FROM h JOIN z ON z.y = h.y GROUP BY 1, 2""")
