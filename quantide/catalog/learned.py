"""Registered queries of fitted models: grids of regressions, boosted trees, heads, gates, recurrent networks, and their files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import boosting, gating, heads, linear, recurrent, rolling as R, scoring
from ..plans import series
from ..sources import io, models as files
from . import twin as S
from .models import evaluation

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

INSTS = ("s", "p")
WINDOWS = (60, 300, 900)
HORIZONS = tuple(range(60, 901, 60))


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: S.rounded(run(spark, sf_dir))
    if sql:
        ORACLES[name] = sql


def design(spark, sf_dir):
    """For each instrument i the log variance sums {i}_f60, {i}_f300, {i}_f900 and, ahead, {i}_y60 ... {i}_y900. A variance that
    isn't finite, as prices of zero give it, is missing."""

    def make(df):
        df = R.sums(df, {f"_{i}{w}": (X.finite(f"{i}_rv"), w) for i in INSTS for w in WINDOWS})
        return R.forward_sums(df, {f"_{i}y{h}": (X.finite(f"{i}_rv"), h) for i in INSTS for h in HORIZONS})

    df = series.with_features(series.price_table(spark, sf_dir), make, 910, 901)
    log = lambda c: F.ln(F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0))) + X.EPS)
    return df.select("rn", "n", "sec", *(log(f"_{i}{w}").alias(f"{i}_f{w}") for i in INSTS for w in WINDOWS), *(log(f"_{i}y{h}").alias(f"{i}_y{h}") for i in INSTS for h in HORIZONS))


def train(df):
    return df.filter(F.col("rn") < F.floor(F.col("n") * 0.7))


def _names(i):
    return [f"{i}_f{w}" for w in WINDOWS]


def grid(df):
    """The model of each instrument and horizon, fitted on the training rows in one pass."""
    found = linear.ridge_each(train(df), {(i, h): (_names(i), f"{i}_y{h}") for i in INSTS for h in HORIZONS})
    return linear.model_table(df.sparkSession, found, "inst string, horizon_s int")


def by_instrument(df, *more):
    """A row for each instrument: its regressors as an array."""
    each = F.array(*(F.struct(F.lit(i).alias("inst"), F.array(*_names(i)).alias("features"), *(m(i) for m in more)) for i in INSTS))
    return df.select("rn", "n", "sec", F.explode(each).alias("x")).select("rn", "n", "sec", "x.*")


def by_horizon(df):
    """A row for each instrument and horizon, with its target y."""
    targets = lambda i: F.array(*(F.struct(F.lit(h).alias("horizon_s"), F.col(f"{i}_y{h}").alias("y")) for h in HORIZONS)).alias("targets")
    return by_instrument(df, targets).withColumn("t", F.explode("targets")).select("rn", "n", "inst", "features", "t.*")


add("M07_model_grid", lambda s, d: grid(io.stored(design(s, d))).select("inst", "horizon_s", "intercept", *(F.col("beta")[k].alias(f"b{w}") for k, w in enumerate(WINDOWS)), "sigma2", "n_train"))


def _smeared(df):
    """Forecasts of every model on all rows, with the smearing of its own training residuals: none, lognormal, and Duan's."""
    models = grid(df)
    rows = linear.looked_up(by_horizon(df), models, ["inst", "horizon_s"])
    factor = linear.smearing_factor(F.col("y") - F.col("forecast"), F.col("sigma2"))
    fitted = F.col("rn") < F.floor(F.col("n") * 0.7)
    duan = rows.filter(fitted & F.col("y").isNotNull() & F.col("forecast").isNotNull()).groupBy("inst", "horizon_s").agg(factor.alias("duan"))
    return rows.join(F.broadcast(duan), ["inst", "horizon_s"], "left")  # a row for each model


def _evaluated(spark, sf_dir):
    df = io.stored(design(spark, sf_dir))
    rows = _smeared(df)
    fitted, test = F.col("rn") < F.floor(F.col("n") * 0.7), F.col("rn") >= F.floor(F.col("n") * 0.85)
    y, f = F.col("y"), F.col("forecast")
    level = {"none": F.exp(f), "lognormal": F.exp(f + F.col("sigma2") / 2), "duan": F.exp(f) * F.col("duan")}
    return rows.groupBy("inst", "horizon_s").agg(
        scoring.r2(F.when(fitted, y), f).alias("r2_train"), scoring.r2(F.when(test, y), f).alias("r2_test"), *(scoring.r2(F.when(test, F.exp(y)), x).alias(f"r2_level_{k}") for k, x in level.items()),
        F.first("sigma2").alias("sigma2"), F.first("duan").alias("duan"), F.count(F.when(test, y)).alias("n_test"),
    )


add("M08_fit_and_evaluate", _evaluated)

# Least squares on one regressor for each instrument and horizon: both engines can fit it, so the look-up has a twin.
_SLOPES = f"""WITH {S.BASE}, l AS (
  {" UNION ALL ".join(f"SELECT rn, n, sec, '{i}' AS inst, {i}_rv AS v FROM base" for i in INSTS)}),
r AS (SELECT *, sum(coalesce(v, 0)) OVER (PARTITION BY inst ORDER BY rn) AS run, count(v) OVER (PARTITION BY inst ORDER BY rn) AS c FROM l),
f AS (SELECT rn, n, sec, inst, run, c, CASE WHEN rn >= 299 THEN ln(greatest(sum(coalesce(v, 0)) OVER (PARTITION BY inst ORDER BY rn ROWS BETWEEN 299 PRECEDING AND CURRENT ROW), 0) + 1e-12) END AS x FROM r),
g AS (SELECT a.*, h::INT AS horizon_s, CASE WHEN b.c - a.c = h THEN ln(greatest(b.run - a.run, 0) + 1e-12) END AS y FROM f a, range(60, 901, 60) t(h) LEFT JOIN f b ON b.inst = a.inst AND b.rn = a.rn + h),
m AS (SELECT inst, horizon_s, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM g WHERE rn < floor(n * 0.7::DOUBLE) AND x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)"""


def _looked_up(spark, sf_dir):
    """Each row meets the model of its instrument and of the minutes that its quarter of an hour still has."""
    df = io.stored(design(spark, sf_dir))
    found = linear.ols_each(train(df), {(i, h): ([f"{i}_f300"], f"{i}_y{h}") for i in INSTS for h in HORIZONS})
    models = linear.model_table(spark, found, "inst string, horizon_s int")
    horizon = ((F.lit(15) - F.pmod(F.minute("sec"), F.lit(15))) * 60).alias("horizon_s")
    rows = by_instrument(df).select("rn", "inst", horizon, F.array(F.col("features")[1]).alias("features"))
    return linear.looked_up(rows, models, ["inst", "horizon_s"]).select("rn", "inst", "horizon_s", "forecast")


add("J10_model_lookup", _looked_up, _SLOPES + " SELECT f.rn, f.inst, ((15 - minute(f.sec) % 15) * 60)::INT AS horizon_s, round(m.a + m.b * f.x, 8) AS forecast FROM f LEFT JOIN m ON m.inst = f.inst AND m.horizon_s = (15 - minute(f.sec) % 15) * 60")

# Boosted trees -------------------------------------------------------------------------------------------------------------

REGRESSORS = [n for i in INSTS for n in _names(i)]
TARGET = "s_y60"
TREES = boosting.Settings(rounds=12, leaves=8, depth=4, rate=0.2, patience=3, bins=32)
#: Trainings whose models are stored side by side.
VERSIONS = (boosting.Settings(rounds=2, leaves=4, rate=0.1, bins=16), TREES)
#: Edges of the histogram that both engines make, the same for all regressors.
EDGES = [k / 2 for k in range(-20, 13)]


def part():
    """0 for the training rows, 1 for those watched, 2 for the test rows."""
    return F.when(F.col("rn") < F.floor(F.col("n") * 0.7), 0).when(F.col("rn") < F.floor(F.col("n") * 0.85), 1).otherwise(2)


def parted(spark, sf_dir):
    return io.stored(design(spark, sf_dir).withColumn("part", part()))


def _boosted(spark, sf_dir):
    df = parted(spark, sf_dir)
    return df, boosting.fit(df, REGRESSORS, TARGET, "part", TREES)


def _tree_metric(spark, sf_dir):
    df, model = _boosted(spark, sf_dir)
    y, f = F.col(TARGET), F.col("f")
    of = lambda k: F.when(F.col("part") == k, y)
    scored = df.withColumn("f", model.predict())
    return scored.agg(*(scoring.r2(of(k), f).alias(f"r2_{n}") for k, n in enumerate(("train", "val", "test"))), F.lit(model.best).alias("best_round"), F.lit(len(model.trees)).alias("rounds"), F.count(TARGET).alias("n"))


add("M09_boosted_trees", _tree_metric)


def _histogram(spark, sf_dir):
    """The root's histogram of the first tree: rows and gradients by feature and bin."""
    df = parted(spark, sf_dir)
    row = train(df).agg(F.avg(TARGET).alias("m"), F.max(TARGET).alias("hi"), F.min(TARGET).alias("lo")).first()
    if row["m"] is None:
        return spark.createDataFrame([], "feature int, bin int, n bigint, g double")
    unit = (max(row["hi"] - row["m"], row["m"] - row["lo"]) or 1.0) / boosting.SCALE
    rows = boosting.coded_rows(df, REGRESSORS, TARGET, "part", [EDGES] * len(REGRESSORS), row["m"])
    sums = boosting.histogram_sums(rows, len(REGRESSORS), [], boosting.Tree(), [0], list(range(len(REGRESSORS))), unit, False)
    return sums.select("feature", "bin", "n", F.round(F.col("g") * unit, 4).alias("g"))


_FEATURES_SQL = ", ".join(f"ln({S.full(w, f'greatest({S.rs(f"{i}_rv", w)}, 0)')} + 1e-12) AS {i}_f{w}" for i in INSTS for w in WINDOWS)
add("M09_tree_histogram", _histogram, f"""WITH {S.BASE}, g AS (SELECT rn, n, {_FEATURES_SQL}, ln(CASE WHEN count(s_rv) OVER w = 60 THEN greatest(sum(s_rv) OVER w, 0) END + 1e-12) AS y FROM base WINDOW w AS (ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING)),
t AS (SELECT *, y - avg(y) OVER () AS left_ FROM g WHERE y IS NOT NULL AND rn < floor(n * 0.7::DOUBLE)),
x AS ({" UNION ALL ".join(f"SELECT {k} AS feature, {c} AS v, left_ FROM t" for k, c in enumerate(REGRESSORS))})
SELECT feature::INT AS feature, CASE WHEN v IS NULL THEN {len(EDGES)} ELSE len(list_filter({EDGES}::DOUBLE[], lambda e: e < v)) END::INT AS bin, count(*) AS n, round(round(sum(left_), 4), 8) AS g FROM x GROUP BY 1, 2""")  # fmt: skip


def _importance(spark, sf_dir):
    _, model = _boosted(spark, sf_dir)
    return spark.createDataFrame(list(zip(REGRESSORS, model.gains())), "feature string, gain double").orderBy(F.desc("gain"), "feature").limit(5)


add("A31_feature_importance", _importance)


def _from_file(spark, sf_dir):
    """Trainings stored as versions with their errors on the watched rows, the best one read back and used."""
    df = parted(spark, sf_dir)
    path, watched = io.scratch(spark), lambda m: m.history[m.best].get(1, 0.0)
    for k, s in enumerate(VERSIONS):
        own = boosting.fit(df, REGRESSORS, TARGET, "part", s)
        files.append(spark, path, "trees", [(k, watched(own), own.to_json())])
    version, _, text = files.best(spark, path, "trees")
    return df.select("rn", F.lit(version).alias("version"), boosting.Model.from_json(text).predict().alias("forecast"))


add("S17_tree_file", _from_file)

# Pricers and heads -----------------------------------------------------------------------------------------------------------

MARKET = ["moneyness", "variance_ahead", "root", "d2", "tte"]


def market(spark, sf_dir):
    """Rows of well-filled periods with the five market features, the price p, the label, and the part."""
    rows = evaluation(spark, sf_dir)
    made = heads.market_features(F.col("s_mid"), F.col("strike"), F.col("variance"), F.col("seconds_left").cast("double"))
    return io.stored(rows.withColumns({**made, "part": part()}).select("rn", "period_start", "label", "p", "part", *MARKET))


HIDDEN, LOOKBACK = 8, 60
INPUTS = ["s_ret", "p_ret", "s_obi", "p_obi"]


def network(spark, features: int = len(INPUTS)):
    """The network's weights, written as a table and read back."""
    path = io.scratch(spark)
    recurrent.to_table(spark, recurrent.initial_weights(features, HIDDEN)).coalesce(1).write.parquet(path)
    return recurrent.from_table(spark.read.schema(recurrent.WEIGHTS_DDL).parquet(path))


def states(spark, sf_dir, stride: int = 1):
    df = io.stored(series.base_table(spark, sf_dir).select("rn", *(X.finite(c).alias(c) for c in INPUTS)))
    return recurrent.windowed_forecasts(df, INPUTS, network(spark), LOOKBACK, stride)


add("M11_gru_forecast", lambda s, d: states(s, d, 30).select("rn", F.round("forecast", 5).alias("forecast"), *(F.round(F.col("state")[k], 5).alias(f"h{k}") for k in range(HIDDEN))))


def _tensor(spark, sf_dir):
    """The same network over windows that are a tensor column already, in batches."""
    o = R.order().rowsBetween(-LOOKBACK, -1)
    steps = F.flatten(F.collect_list(F.array(*(F.coalesce(X.finite(F.col(c).cast("double")), F.lit(0.0)) for c in INPUTS))).over(o))
    at = (F.col("rn") >= LOOKBACK) & (F.pmod(F.col("rn") - LOOKBACK, F.lit(30)) == 0)
    df = R.windowed(series.base_table(spark, sf_dir), lambda d: d.withColumn("tensor", steps), LOOKBACK).filter(at).select("rn", "tensor")
    return recurrent.tensor_forecasts(df, "tensor", network(spark), LOOKBACK, len(INPUTS)).select("rn", F.round(F.col("forecast").cast("double"), 5).alias("forecast"))


add("M11_gru_tensor_forecast", _tensor)


def _pricers(spark, sf_dir):
    """Boosted trees on the market features, and on the network's state, those and the price, against the price itself."""
    rows = market(spark, sf_dir)
    hidden = states(spark, sf_dir).select("rn", *(F.col("state")[k].alias(f"h{k}") for k in range(HIDDEN)))
    both = io.stored(rows.join(hidden, "rn"))
    s = boosting.Settings(rounds=8, leaves=8, depth=4, rate=0.2, least_rows=50, features=0.8, patience=3, bins=32)
    made = {n: boosting.fit(both, c, "label", "part", s) for n, c in (("trees", MARKET), ("embedded", [*(f"h{k}" for k in range(HIDDEN)), *MARKET, "p"]))}
    test = both.withColumns({n: X.clip(m.predict(), 0, 1) for n, m in made.items()}).filter("part = 2")
    naive = both.filter("part = 0").agg(F.avg("label")).first()[0]
    y = F.col("label")
    return test.agg(scoring.brier(F.col("p"), y).alias("brier_price"), *(scoring.brier(F.col(n), y).alias(f"brier_{n}") for n in made), scoring.brier(F.lit(naive), y).alias("brier_naive"), F.count("*").alias("n"))


add("M10_tree_pricer", _pricers)


def _head(spark, sf_dir):
    """Every step of the fitted head is a version with its loss on the watched rows; the best one is read back and used."""
    rows = market(spark, sf_dir)
    steps = heads.logistic(rows.filter("part = 0"), MARKET, "label")
    if not steps:
        return rows.select("rn", F.lit(None).cast("int").alias("version"), F.lit(None).cast("double").alias("p"))
    own = rows.filter("part = 1").agg(*(scoring.log_loss(h.probability(), F.col("label")).alias(str(h.steps)) for h in steps)).first()
    path = io.scratch(spark)
    files.append(spark, path, "head", [(h.steps, own[str(h.steps)] if own[str(h.steps)] is not None else h.loss, json.dumps([h.intercept, h.weights])) for h in steps])
    version, loss, text = files.best(spark, path, "head")
    intercept, weights = json.loads(text)
    best = heads.Head(MARKET, intercept, weights, version, loss)
    return rows.select("rn", F.lit(version).alias("version"), best.probability().alias("p"))


add("S16_checkpoints", _head)


def _fitted_head(spark, sf_dir):
    rows = market(spark, sf_dir)
    steps = heads.logistic(rows.filter("part = 0"), MARKET, "label")
    if not steps:
        return rows.select("rn", F.lit(None).cast("double").alias("p"))
    return rows.select("rn", steps[-1].probability().alias("p"))


add("M14_fitted_head", _fitted_head)

# Gates -----------------------------------------------------------------------------------------------------------------------

EXPERTS, ROUTES = 4, 2
#: Weights of a gate over the two imbalances and the spread; invented.
GATE = [(0, 0.1, [1.0, -0.5, 0.02]), (1, -0.2, [-1.0, 0.75, 0.01]), (2, 0.0, [0.25, 0.25, 0.03]), (3, 0.1, [1.0, -0.5, 0.02])]


def _gated(spark, sf_dir):
    gate = spark.createDataFrame(GATE, "expert int, bias double, weights array<double>")
    df = gating.logits(series.price_table(spark, sf_dir), gate, [F.col("s_obi"), F.col("p_obi"), F.col("s_spread")])
    return gating.gated(df, ROUTES)


def _routes(spark, sf_dir):
    """The chosen experts and weights, and the mixture of four simple forecasts of the mid."""
    outputs = F.array("s_mid", "p_mid", "c_mid", "s_micro")
    return _gated(spark, sf_dir).select("rn", *(c for k in range(ROUTES) for c in (F.col("routes")[k]["expert"].cast("long").alias(f"int_e{k}"), F.col("routes")[k]["weight"].alias(f"w{k}"))), gating.mixed(F.col("routes"), outputs).alias("mixture"))


_LOGITS = "[" + ", ".join(f"({b} + {w[0]} * s_obi + {w[1]} * p_obi + {w[2]} * s_spread)" for _, b, w in GATE) + "]"
_GATED = f"""WITH {S.PRICES}, z AS (SELECT *, {_LOGITS} AS z FROM prices),
c AS (SELECT *, list_sort([{', '.join(f"{{'low': -z[{k + 1}], 'e': {k}}}" for k in range(EXPERTS))}]) AS o FROM z),
t AS (SELECT *, 1 / (1 + exp(o[1].low - o[2].low)) AS w0, [{', '.join(f'exp(z[{k + 1}] - list_max(z))' for k in range(EXPERTS))}] AS e FROM c)"""
add("M12_expert_gating", _routes, _GATED + " SELECT rn, o[1].e::BIGINT AS int_e0, round(w0, 8) AS w0, o[2].e::BIGINT AS int_e1, round(1 - w0, 8) AS w1, round(w0 * [s_mid, p_mid, c_mid, s_micro][o[1].e + 1] + (1 - w0) * [s_mid, p_mid, c_mid, s_micro][o[2].e + 1], 8) AS mixture FROM t")


def _balance(spark, sf_dir):
    one = gating.load_balance(_gated(spark, sf_dir), EXPERTS, ROUTES)
    return one.select(*(F.col(c)[k].alias(f"{n}{k}") for c, n in (("shares", "f"), ("means", "p")) for k in range(EXPERTS)), "loss")


_SHARE = [f"sum(CASE WHEN o[1].e = {k} OR o[2].e = {k} THEN 1 ELSE 0 END)::DOUBLE / ({ROUTES} * count(*))" for k in range(EXPERTS)]
_MEAN = [f"avg(e[{k + 1}] / list_sum(e))" for k in range(EXPERTS)]
add("M12_load_balance", _balance, _GATED + " SELECT " + ", ".join(f"round({x}, 8) AS {n}{k}" for n, l in (("f", _SHARE), ("p", _MEAN)) for k, x in enumerate(l)) + f", round(0.01 * {EXPERTS} * (" + " + ".join(f"{a} * {b}" for a, b in zip(_SHARE, _MEAN)) + "), 8) AS loss FROM t")
