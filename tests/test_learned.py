"""Boosted trees, model grids, gates, heads and recurrent networks against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantide import catalog
from quantide.catalog import learned
from quantide.operators import boosting, gating, heads, linear, recurrent
from quantide.sources import models as files


def sample(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    x[rng.random((n, 4)) < 0.05] = np.nan
    y = np.nan_to_num(x[:, 0]) * 2 + np.where(np.nan_to_num(x[:, 1]) > 0.3, 1.5, -0.5) * np.nan_to_num(x[:, 2]) + rng.normal(size=n) * 0.1
    return x, y, (np.arange(n) % 10 >= 7).astype(int)


def frame(spark, x, y, part, parts=3):
    rows = [(int(k), *(None if math.isnan(v) else float(v) for v in r), float(t), int(p)) for k, (r, t, p) in enumerate(zip(x, y, part))]
    return spark.createDataFrame(rows, "k int, a double, b double, c double, d double, y double, part int").repartition(parts)


def grown_trees(x, y, part, edges, s, used):
    """Leaf-wise boosting, row by row of the definition: nodes are sets of rows, histograms are masks."""
    coded = np.stack([np.where(np.isnan(x[:, k]), len(e), np.searchsorted(e, x[:, k])) for k, e in enumerate(edges)], 1)
    train = part == 0
    score = np.full(len(y), y[train].mean())
    held = lambda g: np.sign(g) * max(abs(g) - s.l1, 0)
    value = lambda rows, left: held(left[rows & train].sum()) ** 2 / ((rows & train).sum() + s.l2)
    trees, errors = [], []
    for k in range(s.rounds):
        errors.append(((y - score)[part == 1] ** 2).mean())
        left = y - score
        leaves = [(np.ones(len(y), bool), 0)]
        splits = []
        while len(leaves) < s.leaves:
            best = None
            for j, (rows, depth) in enumerate(leaves):
                if depth >= s.depth:
                    continue
                for f in used[k]:
                    for at in range(len(edges[f])):
                        go = rows & (coded[:, f] <= at)
                        stay = rows & ~go
                        if min((go & train).sum(), (stay & train).sum()) < s.least_rows:
                            continue
                        gain = value(go, left) + value(stay, left) - value(rows, left)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, j, f, at, go, stay)
            if best is None:
                break
            gain, j, f, at, go, stay = best
            depth = leaves.pop(j)[1]
            leaves += [(go, depth + 1), (stay, depth + 1)]
            splits.append((f, at, gain))
        if not splits:
            break
        for rows, _ in leaves:
            g, n = left[rows & train].sum(), (rows & train).sum()
            score[rows] += s.rate * held(g) / (n + s.l2)
        trees.append(sorted(splits))
    errors.append(((y - score)[part == 1] ** 2).mean())
    return trees, errors, score


@pytest.mark.parametrize("leaves, depth, share", [(6, 6, 1.0), (12, 3, 0.5)])
def test_boosting(spark, leaves, depth, share, monkeypatch):
    monkeypatch.setattr(boosting, "REBASED", 3)
    x, y, part = sample()
    s = boosting.Settings(rounds=5, leaves=leaves, depth=depth, rate=0.3, least_rows=10, features=share, patience=50, bins=12)
    df = frame(spark, x, y, part)
    model = boosting.fit(df, list("abcd"), "y", "part", s)
    rng = np.random.default_rng(s.seed)
    used = [sorted(rng.choice(4, max(1, round(share * 4)), replace=False).tolist()) for _ in range(6)]
    trees, errors, score = grown_trees(x, y, part, model.edges, s, used)
    assert [sorted((f, b) for f, b, a in zip(t.feature, t.bin, t.left) if a >= 0) for t in model.trees] == [[(f, b) for f, b, _ in t] for t in trees]
    assert np.allclose([h[1] for h in model.history], errors, rtol=1e-5)
    assert np.allclose(model.gains(), [sum(g for t in trees for f, _, g in t if f == k) for k in range(4)], rtol=1e-4)
    rows = {r.k: r.p for r in df.select("k", model.predict().alias("p")).collect()}
    assert np.allclose([rows[k] for k in range(len(y))], score, atol=1e-5)
    # Other partitions, the same model to the last bit; and through its file.
    again = boosting.fit(frame(spark, x, y, part, 7), list("abcd"), "y", "part", s, model.edges)
    assert again.trees == model.trees and boosting.Model.from_json(model.to_json()) == model


def test_boosting_stops_early(spark):
    x, y, part = sample(300)
    y = np.where(part == 0, y, np.random.default_rng(1).normal(size=len(y)))  # nothing to learn for the watched rows
    model = boosting.fit(frame(spark, x, y, part), list("abcd"), "y", "part", boosting.Settings(rounds=30, leaves=4, rate=0.5, patience=3))
    watched = [h[1] for h in model.history]
    assert model.best == int(np.argmin(watched)) and len(model.trees) == model.best + 3 < 30


def test_boosting_edges(spark):
    df = frame(spark, *sample(50))
    none = boosting.fit(df.filter("k < 0"), list("abcd"), "y", "part")
    assert none.trees == [] and none.base == 0.0
    flat = boosting.fit(df.withColumn("y", F.lit(2.0)), list("abcd"), "y", "part")
    assert flat.trees == [] and {r.p for r in df.select(flat.predict().alias("p")).collect()} == {2.0}
    gone = boosting.fit(df.withColumn("a", F.lit(None).cast("double")), list("abcd"), "y", "part", boosting.Settings(rounds=2, least_rows=5))
    assert len(gone.trees) == 2 and gone.gains()[0] == 0


# Grids and look-ups --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def designed(spark, sf):
    return learned.design(spark, sf).toPandas().sort_values("rn").reset_index(drop=True)


def ridged(x, y, alpha=1.0):
    mean, sd = x.mean(0), x.std(0)
    z = np.where(sd < 1e-9, 0, (x - mean) / np.maximum(sd, 1e-9))
    sd = np.where(sd < 1e-9, 1, sd)
    b = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return y.mean() - mean @ b, b


def test_design_targets(spark, sf, designed):
    """Sums ahead as differences of a running sum, against sums of the rows."""
    from quantide.plans import series

    rv = series.base_table(spark, sf).select("rn", "p_rv").toPandas().sort_values("rn").p_rv.to_numpy()
    for h in (60, 900):
        own = designed[f"p_y{h}"].to_numpy()
        for t in range(0, len(rv), 37):
            ahead = rv[t + 1 : t + 1 + h]
            assert np.isnan(own[t]) if len(ahead) < h or np.isnan(ahead).any() else np.isclose(own[t], np.log(ahead.sum() + 1e-12), atol=1e-9)


def test_model_grid(spark, sf, designed):
    """Both instruments, all horizons, each on the rows that it can use."""
    rows = {(r.inst, r.horizon_s): r for r in catalog.queries()["M07_model_grid"](spark, sf).collect()}
    train = designed[designed.rn < int(designed.n.iloc[0] * 0.7)]
    for i in "sp":
        for h in learned.HORIZONS:
            own = train[[*(f"{i}_f{w}" for w in learned.WINDOWS), f"{i}_y{h}"]].dropna().to_numpy()
            if len(own) < 4:
                assert (i, h) not in rows
                continue
            r, (a, b) = rows[i, h], ridged(own[:, :-1], own[:, -1])
            assert r.n_train == len(own) and np.allclose([r.b60, r.b300, r.b900], b, atol=1e-6) and np.isclose(r.intercept, a, atol=1e-5)


def test_fit_and_evaluate(spark, sf, designed):
    rows = catalog.queries()["M08_fit_and_evaluate"](spark, sf).collect()
    grid = {(r.inst, r.horizon_s): r for r in catalog.queries()["M07_model_grid"](spark, sf).collect()}
    n = designed.n.iloc[0]
    assert {(r.inst, r.horizon_s) for r in rows} >= set(grid)
    for r in rows:
        if (r.inst, r.horizon_s) not in grid:
            assert r.duan is None and r.r2_train is None
            continue
        m = grid[r.inst, r.horizon_s]
        y = designed[f"{r.inst}_y{r.horizon_s}"].to_numpy()
        f = m.intercept + designed[[f"{r.inst}_f{w}" for w in learned.WINDOWS]].to_numpy() @ [m.b60, m.b300, m.b900]
        fit = (designed.rn < int(n * 0.7)).to_numpy() & np.isfinite(y) & np.isfinite(f)
        e = np.clip(y - f, -3 * math.sqrt(m.sigma2), 3 * math.sqrt(m.sigma2))
        assert np.isclose(r.duan, np.exp(e[fit]).mean(), rtol=1e-4)
        assert np.isclose(r.r2_train, 1 - ((y - f)[fit] ** 2).sum() / ((y[fit] - y[fit].mean()) ** 2).sum(), atol=1e-4)


def test_look_up_without_a_model(spark, monkeypatch):
    rows = spark.createDataFrame([("s", 60, [1.0, 2.0]), ("s", 120, [1.0, 2.0]), ("x", 60, [None, 2.0]), (None, 60, [1.0, 1.0])], "inst string, h int, features array<double>")
    models = spark.createDataFrame([("s", 60, 0.5, [2.0, 3.0]), ("x", 60, 0.0, [1.0, 1.0])], "inst string, h int, intercept double, beta array<double>")
    for most in (10, 1):  # the second is joined by shuffling
        monkeypatch.setattr(linear, "BROADCAST_MODELS", most)
        out = linear.looked_up(rows, models, ["inst", "h"])
        assert sorted(((r.inst, r.h, r.forecast) for r in out.collect()), key=str) == sorted([("s", 60, 8.5), ("s", 120, None), ("x", 60, None), (None, 60, None)], key=str)
        assert ("BroadcastHashJoin" in out._jdf.queryExecution().sparkPlan().toString()) == (most == 10)


# Heads, gates, networks ------------------------------------------------------------------------------------------------------


def test_logistic_head(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1] + [0, 2, 1]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -0.3, 2.0] - 1)))).astype(float)
    rows = [(*map(float, r), 7.0, float(t)) for r, t in zip(x, y)] + [(None, 0.0, 0.0, 7.0, 1.0), (0.0, 0.0, 0.0, 7.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double, y double")
    found = heads.logistic(df.repartition(5), ["a", "b", "c", "flat"], "y")
    z = (x - x.mean(0)) / x.std(0)
    z = np.column_stack([np.ones(400), z])
    w = np.zeros(4)
    ridge = np.diag([0, 1, 1, 1]) * 1e-3 * 400
    for _ in range(50):
        q = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + ridge, z.T @ (q - y) + ridge @ w)
    own = w[1:] / x.std(0)
    assert np.allclose(found[-1].weights, [*own, 0], atol=1e-6) and np.isclose(found[-1].intercept, w[0] - own @ x.mean(0), atol=1e-6)
    losses = [h.loss for h in found]
    assert losses == sorted(losses, reverse=True) or len(found) < 25
    again = heads.logistic(df.repartition(2), ["a", "b", "c", "flat"], "y")
    assert np.allclose(again[-1].weights, found[-1].weights, atol=1e-9)
    assert heads.logistic(df.filter("a > 1e9"), ["a", "b"], "y") == []
    apart = heads.logistic(df.withColumn("y", (F.col("a") > 0).cast("double")), ["a"], "y")
    assert math.isfinite(apart[-1].intercept) and apart[-1].steps < 25


def test_gate_with_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.0],), ([2.0, 2.0, 2.0, 2.0],)], "logits array<double>")
    a, b = gating.gated(df, 2).select("routes").collect()
    assert [r.expert for r in a.routes] == [1, 2] and [r.expert for r in b.routes] == [0, 1]
    assert all(math.isclose(r.weight, 0.5) for x in (a, b) for r in x.routes)
    one = gating.load_balance(gating.gated(df, 2), 4, 2, 1.0).first()
    p = np.mean([np.exp(v) / np.exp(v).sum() for v in (np.array([1.0, 3, 3, 0]), np.full(4, 2.0))], axis=0)
    assert one.shares == [0.25, 0.5, 0.25, 0] and np.allclose(one.means, p) and np.isclose(one.loss, 4 * (np.array(one.shares) * p).sum())
    assert gating.load_balance(gating.gated(df.limit(0), 2), 4, 2).count() == 1


def plain_gru(w, x):
    """One window, one step, one unit at a time."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    layer = 0
    while f"wx{layer}" in w:
        wx, wh, bx, bh = (w[f"{n}{layer}"].astype(float) for n in ("wx", "wh", "bx", "bh"))
        d = wh.shape[1]
        h, out = np.zeros(d), []
        for row in x:
            new = np.zeros(d)
            for j in range(d):
                r = sig(wx[j] @ row + bx[j] + wh[j] @ h + bh[j])
                u = sig(wx[d + j] @ row + bx[d + j] + wh[d + j] @ h + bh[d + j])
                c = math.tanh(wx[2 * d + j] @ row + bx[2 * d + j] + r * (wh[2 * d + j] @ h + bh[2 * d + j]))
                new[j] = (1 - u) * c + u * h[j]
            h = new
            out.append(h)
        x, layer = np.array(out), layer + 1
    return float(w["w2"][0] @ np.maximum(w["w1"] @ h + w["b1"], 0) + w["b2"][0]), h


def test_recurrent_network(spark):
    """Windows across chunks, in batches, against a plain loop; tensors give the same."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 2))
    x[5, 0] = np.nan
    weights = recurrent.from_table(recurrent.to_table(spark, recurrent.initial_weights(2, 3, 2, 4, seed=9)).repartition(3))
    df = spark.createDataFrame([(k, None if math.isnan(a) else float(a), float(b)) for k, (a, b) in enumerate(x)], "rn long, a double, b double").repartition(4)
    x = np.nan_to_num(x)
    rows = recurrent.windowed_forecasts(df, ["a", "b"], weights, 7, 3, batch=4, chunk=16).orderBy("rn").collect()
    assert [r.rn for r in rows] == list(range(7, 90, 3))
    for r in rows:
        f, h = plain_gru(weights, x[r.rn - 7 : r.rn])
        assert math.isclose(r.forecast, f, abs_tol=1e-5) and np.allclose(r.state, h, atol=1e-5)
    tensors = spark.createDataFrame([(int(r.rn), x[r.rn - 7 : r.rn].ravel().tolist()) for r in rows], "rn long, x array<double>")
    assert np.allclose([r.forecast for r in recurrent.tensor_forecasts(tensors, "x", weights, 7, 2, 5).orderBy("rn").collect()], [r.forecast for r in rows], atol=1e-6)
    assert recurrent.windowed_forecasts(df.filter("rn < 5"), ["a", "b"], weights, 7).collect() == []


def test_recurrent_query(spark, sf):
    rows = {r.rn: r for r in catalog.queries()["M11_gru_forecast"](spark, sf).collect()}
    tensors = {r.rn: r.forecast for r in catalog.queries()["M11_gru_tensor_forecast"](spark, sf).collect()}
    assert rows.keys() == tensors.keys() and rows and all(abs(rows[k].forecast - tensors[k]) < 2e-5 for k in rows)


# Queries without a twin ------------------------------------------------------------------------------------------------------


def test_tree_queries(spark, sf, designed):
    """The registered trees are those of NumPy; their file gives the same forecasts, and gains are theirs."""
    df = learned.parted(spark, sf)
    model = boosting.fit(df, learned.REGRESSORS, learned.TARGET, "part", learned.TREES)
    rows = df.toPandas().sort_values("rn")
    rows = rows[rows[learned.TARGET].notna()]
    if not len(rows):
        assert model.trees == []
        return
    row = catalog.queries()["M09_boosted_trees"](spark, sf).first()
    assert row.best_round == model.best and row.n == len(rows)
    stored = catalog.queries()["S17_tree_file"](spark, sf).collect()
    own = {r.rn: r.forecast for r in stored}
    every = [boosting.fit(df, learned.REGRESSORS, learned.TARGET, "part", s) for s in learned.VERSIONS]
    errors = [m.history[m.best].get(1, 0.0) for m in every]
    assert {r.version for r in stored} == {int(np.argmin(errors))}
    model = every[int(np.argmin(errors))]
    memory = {r.rn: r.p for r in df.select("rn", model.predict().alias("p")).collect()}
    assert own.keys() == memory.keys() and all(abs(own[k] - memory[k]) < 1e-7 for k in own)
    model = every[1]
    top = catalog.queries()["A31_feature_importance"](spark, sf).collect()
    assert [r.feature for r in top] == [f for f, _ in sorted(zip(learned.REGRESSORS, model.gains()), key=lambda x: (-x[1], x[0]))[:5]]


def test_pricer_and_head_queries(spark, sf):
    r = catalog.queries()["M10_tree_pricer"](spark, sf).first()
    assert r.n > 0 and all(0 <= r[c] <= 1 for c in ("brier_price", "brier_trees", "brier_embedded", "brier_naive"))
    fitted = {x.rn: x.p for x in catalog.queries()["M14_fitted_head"](spark, sf).collect()}
    stored = catalog.queries()["S16_checkpoints"](spark, sf).collect()
    assert fitted.keys() == {x.rn for x in stored} and all(0 <= x.p <= 1 for x in stored)


def test_model_files(spark, tmp_path):
    path = str(tmp_path / "models")
    files.append(spark, path, "a", [(1, 0.5, "x"), (2, 0.25, "y")])
    files.append(spark, path, "a", [(3, 0.25, "z"), (4, float("nan"), "w")])
    files.append(spark, path, "b", [(1, 0.1, "other")])
    assert files.best(spark, path, "a") == (2, 0.25, "y") and files.latest(spark, path, "a")[0] == 4 and files.best(spark, path, "b")[2] == "other"
    with pytest.raises(ValueError):
        files.best(spark, path, "c")
