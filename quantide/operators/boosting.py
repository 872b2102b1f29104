"""Leaf-wise boosting of regression trees over histograms, as Spark jobs.

Regressors are coded once: a byte a value tells its bin between edges (quantiles of the training rows), and the coded
table is written to the shared folder. A tree grows by the leaf whose best split gains most. What a split gains follows
from sums of gradients by (node, feature, bin): one pass over the coded rows adds them up in each task, Spark sums them,
runs along the bins by window, and gives the best split of each node; the driver sees one row a node. A pass covers all
leaves that have none yet and, ahead of need, the children of those that have, so a tree takes as many passes as it is
deep, not as many as it has leaves. Gradients are added as whole numbers (SCALE to the largest deviation of a label), so
trees don't depend on how rows are dealt.

The root's pass also adds up the squared errors of all parts, so watching the validation rows costs no pass of its own;
training ends when they haven't improved for `patience` trees, and prediction uses the trees up to the best.
Every REBASED trees the running prediction is written with the rows, so a pass evaluates few trees and lineage stays short.

Missing values lie above all edges, so they go right.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import io

SCALE = 1 << 24
REBASED = 16
#: Bins of a feature at most, so that one is a byte.
BINS = 255


@dataclass(frozen=True)
class Settings:
    rounds: int = 500
    leaves: int = 31
    depth: int = 6
    rate: float = 0.05
    least_rows: int = 20
    l1: float = 0.1
    l2: float = 1.0
    features: float = 1.0
    patience: int = 50
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number, the root 0. An inner node sends bins up to its own left; a leaf has left -1."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, gain: float) -> tuple[int, int]:
        a = len(self.left)
        self.feature[node], self.bin[node], self.gain[node], self.left[node], self.right[node] = feature, at, gain, a, a + 1
        for column, new in ((self.feature, 0), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.gain, 0.0)):
            column += [new, new]
        return a, a + 1

    def nodes(self, coded: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, at, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node = np.zeros(len(coded), np.int64)
        row = np.arange(len(coded))
        while len(row := row[left[node[row]] >= 0]):
            own = node[row]
            node[row] = np.where(coded[row, feature[own]] <= at[own], left[own], right[own])
        return node

    def predict(self, coded: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(coded)]


@dataclass
class Model:
    """base and the trees up to `best`; gains: the summed gain of each feature; history: squared error by part after each tree."""

    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]
    best: int
    history: list[dict[int, float]]

    def gains(self) -> list[float]:
        out = [0.0] * len(self.features)
        for tree in self.trees[: self.best]:
            for f, g, a in zip(tree.feature, tree.gain, tree.left):
                if a >= 0:
                    out[f] += g
        return out

    def predict(self) -> Column:
        """The prediction from the columns of the regressors."""
        edges, trees, base = [np.array(e) for e in self.edges], self.trees[: self.best], self.base

        def own(*columns: pa.Array) -> pa.Array:
            coded = _coded([c.to_numpy(zero_copy_only=False) for c in columns], edges)
            return pa.array(base + sum((t.predict(coded) for t in trees), np.zeros(len(coded))))

        return F.arrow_udf(own, "double")(*(F.col(c).cast("double") for c in self.features))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        return Model(**{**d, "trees": [Tree(**t) for t in d["trees"]], "history": [{int(k): v for k, v in h.items()} for h in d["history"]]})


def quantile_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """For each feature at most bins - 1 rising edges, approximate quantiles of its values; one aggregate for all."""
    shares = [k / bins for k in range(1, bins)]
    row = df.agg(*(F.percentile_approx(F.when(~F.isnan(c), F.col(c).cast("double")), shares, 10_000).alias(f"e{k}") for k, c in enumerate(features))).first()
    return [sorted({float(x) for x in row[f"e{k}"] or []}) for k in range(len(features))]


def _coded(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Bins by row and feature: how many edges lie below the value; missing values lie above all."""
    values = [np.asarray(c, np.float64) for c in columns]
    return np.stack([np.where(np.isnan(v), len(e), np.searchsorted(e, v, "left")) for v, e in zip(values, edges)], 1).astype(np.uint8)


def coded_rows(df: DataFrame, features: list[str], label: str, part: str, edges: list[list[float]], base: float) -> DataFrame:
    """bins (a byte a feature), y, part and the running prediction `score` of each row that has a label."""
    own_edges = [np.array(e) for e in edges]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = _coded([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]], own_edges)
            flat = pa.Array.from_buffers(pa.binary(len(features)), len(b), [None, pa.py_buffer(np.ascontiguousarray(coded))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([flat, b.column(0), b.column(1), pa.array(np.full(len(b), base))], ["bins", "y", "part", "score"])

    rows = df.filter(F.col(label).isNotNull() & ~F.isnan(label)).select(F.col(label).cast("double"), F.col(part).cast("int"), *(F.col(c).cast("double") for c in features))
    return rows.mapInArrow(own, "bins binary, y double, part int, score double")


def _matrix(bins: pa.Array, width: int) -> np.ndarray:
    size = len(bins) * width
    held = bins.cast(pa.binary(width))
    return np.frombuffer(held.buffers()[1], np.uint8, size, held.offset * width).reshape(-1, width)


SUMS_DDL = "node int, feature int, bin int, n long, g long"


def histogram_sums(rows: DataFrame, width: int, trees: list[Tree], growing: Tree, wanted: list[int], used: list[int], unit: float, errors: bool) -> DataFrame:
    """(node, feature, bin, n, g): rows and gradients (in units) of part 0 in the growing tree's nodes. errors: also rows of
    node -1, with the part as the feature, and the squared error there in place of the gradient."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(len(growing.left), -1)
        slot[wanted] = np.arange(len(wanted))
        n = np.zeros((len(wanted), len(used), BINS + 1), np.int64)
        g = np.zeros_like(n)
        wrong: dict[int, list[int]] = {}
        for b in batches:
            if not len(b):
                continue
            coded = _matrix(b.column(0), width)
            y, part, score = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            left = y - score - sum((t.predict(coded) for t in trees), np.zeros(len(y)))
            if errors:
                for p in np.unique(part):
                    own_errors = wrong.setdefault(int(p), [0, 0])
                    own_errors[0] += int((part == p).sum())
                    own_errors[1] += int(np.rint((left[part == p] / unit / SCALE) ** 2 * SCALE).astype(np.int64).sum())
            train = part == 0
            coded, left = coded[train], np.rint(left[train] / unit).astype(np.int64)
            at = slot[growing.nodes(coded)]
            met = at >= 0
            coded, left, at = coded[met], left[met], at[met]
            for k, f in enumerate(used):
                key = at * (BINS + 1) + coded[:, f]
                n[:, k] += np.bincount(key, minlength=n[:, k].size).reshape(len(wanted), -1)
                # Two halves, so that sums of doubles stay exact.
                low = np.bincount(key, left & 0xFFFFF, n[:, k].size).astype(np.int64)
                high = np.bincount(key, left >> 20, n[:, k].size).astype(np.int64)
                g[:, k] += ((high << 20) + low).reshape(len(wanted), -1)
        s, k, b_ = np.nonzero(n)
        out = [np.array(wanted)[s] if len(s) else s, np.array(used)[k] if len(k) else k, b_, n[s, k, b_], g[s, k, b_]]
        extra = list(zip(*((-1, p, 0, c, e) for p, (c, e) in sorted(wrong.items())))) or [()] * 5
        types = [pa.int32()] * 3 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, np.array(m, np.int64)]).astype(np.int64)).cast(t) for x, m, t in zip(out, extra, types)], ["node", "feature", "bin", "n", "g"])

    return rows.mapInArrow(own, SUMS_DDL).groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))


def _held(g: Column, l1: float) -> Column:
    return F.signum(g) * F.greatest(F.abs(g) - l1, F.lit(0.0))


def best_splits(sums: DataFrame, unit: float, s: Settings) -> DataFrame:
    """For each node its rows and gradient, and its best split: feature, bin, gain and what goes left (null without a gain). Of equal
    gains the first feature and bin."""
    along = Window.partitionBy("node", "feature").orderBy("bin")
    whole = Window.partitionBy("node", "feature")
    run = sums.select("node", "feature", "bin", F.sum("n").over(along).alias("nl"), (F.sum("g").over(along) * unit).alias("gl"), F.sum("n").over(whole).alias("n"), (F.sum("g").over(whole) * unit).alias("g"))
    score = lambda g, n: _held(g, s.l1) * _held(g, s.l1) / (n + s.l2)
    nr, gr = F.col("n") - F.col("nl"), F.col("g") - F.col("gl")
    fits = (F.col("nl") >= s.least_rows) & (nr >= s.least_rows)
    gain = score(F.col("gl"), F.col("nl")) + score(gr, nr) - score(F.col("g"), F.col("n"))
    order = F.when(fits & (gain > 1e-12), F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "nl", "gl"))
    return run.groupBy("node").agg(F.max("n").alias("n"), F.max_by("g", "feature").alias("g"), F.max(order).alias("best"), F.collect_list(F.when(F.col("node") < 0, F.struct("feature", "n", "g"))).alias("errors"))


def _leaf(g: float, n: float, s: Settings) -> float:
    return float(s.rate * np.sign(g) * max(abs(g) - s.l1, 0.0) / (n + s.l2))


def fit(df: DataFrame, features: list[str], label: str, part: str, settings: Settings = Settings(), edges: list[list[float]] | None = None) -> Model:
    """Boost on the rows of part 0, watch those of part 1. Rows without a label are left out; edges: given bins instead of quantiles."""
    s = settings
    known = df.filter(F.col(label).isNotNull() & ~F.isnan(label))
    own = known.filter(F.col(part) == 0)
    row = own.agg(F.avg(label).alias("mean"), F.count("*").alias("n"), F.max(label).alias("hi"), F.min(label).alias("lo")).first()
    base = float(row["mean"] or 0.0)
    edges = edges or quantile_edges(own, features, min(s.bins, BINS))
    model = Model(list(features), edges, base, [], 0, [])
    if not row["n"]:
        return model
    unit = (max(row["hi"] - base, base - row["lo"]) or 1.0) / SCALE
    rows, path = io.written(coded_rows(df, features, label, part, edges, base))
    rng = np.random.default_rng(s.seed)
    best = None
    since: list[Tree] = []  # trees that the stored running prediction doesn't have
    for k in range(s.rounds + 1):
        used = sorted(rng.choice(len(features), max(1, round(s.features * len(features))), replace=False).tolist())
        tree, errors = _grown(rows, len(features), since, used, unit, s)
        model.history.append(errors)
        watched = errors.get(1, errors.get(0, 0.0))
        if best is None or watched < best:
            best, model.best = watched, k
        if k == s.rounds or k - model.best >= s.patience or len(tree.left) == 1:
            break
        model.trees.append(tree)
        since = since + [tree]
        if len(since) == REBASED:
            old = path
            rows, path = io.written(_rebased(rows, len(features), since))
            io.discard(df.sparkSession, old)
            since = []
    io.discard(df.sparkSession, path)
    return model


def _rebased(rows: DataFrame, width: int, trees: list[Tree]) -> DataFrame:
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = _matrix(b.column(0), width)
            score = b.column(3).to_numpy(zero_copy_only=False) + sum((t.predict(coded) for t in trees), np.zeros(len(b)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(score)], ["bins", "y", "part", "score"])

    return rows.mapInArrow(own, rows.schema)


def _grown(rows: DataFrame, width: int, trees: list[Tree], used: list[int], unit: float, s: Settings) -> tuple[Tree, dict[int, float]]:
    """The next tree, and the mean squared errors by part of the trees before it."""
    ahead = Tree()  # with all known splits, also of leaves that may never be split
    depth, stats = {0: 0}, {}
    splits: dict[int, tuple | None] = {}  # node -> gain, feature, bin
    leaves, errors = {0}, {}
    chosen: set[int] = set()
    while len(leaves) < s.leaves:
        if any(x not in splits for x in leaves):
            wanted = [x for x, a in enumerate(ahead.left) if a < 0 and x not in splits]
            sums = histogram_sums(rows, width, trees, ahead, wanted, used, unit, not splits)
            for r in best_splits(sums, unit, s).collect():
                if r["node"] < 0:
                    errors = {e["feature"]: e["g"] / SCALE * (SCALE * unit) ** 2 / (e["n"] * unit) for e in r["errors"]}
                    continue
                b = r["best"]
                stats[r["node"]] = (r["n"], r["g"])
                splits[r["node"]] = (b["gain"], -b["f"], -b["b"], b["nl"], b["gl"]) if b else None
            for x in wanted:
                best = splits.setdefault(x, None)
                if best:
                    a, b = ahead.split(x, best[1], best[2], best[0])
                    n, g = stats[x]
                    for child, own in ((a, (best[3], best[4])), (b, (n - best[3], g - best[4]))):
                        depth[child], stats[child] = depth[x] + 1, own
                        if depth[child] >= s.depth or own[0] < 2 * s.least_rows:
                            splits[child] = None
            continue
        gains = [(-splits[x][0], x) for x in leaves if splits[x]]
        if not gains:
            break
        x = min(gains)[1]
        chosen.add(x)
        leaves = leaves - {x} | {ahead.left[x], ahead.right[x]}
    tree = Tree()
    if not chosen:
        return tree, errors
    todo = [(0, 0)]
    while todo:
        x, to = todo.pop()
        if x in chosen:
            a, b = tree.split(to, ahead.feature[x], ahead.bin[x], ahead.gain[x])
            todo += [(ahead.right[x], b), (ahead.left[x], a)]
        else:
            tree.value[to] = _leaf(stats[x][1], stats[x][0], s)
    return tree, errors
