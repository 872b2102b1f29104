"""Forward passes of a gated recurrent network over lookback windows, batch by batch in NumPy.

Windows are made and consumed inside a task: a chunk of rows with a halo of the lookback is one group, its windows are
views of one array, and only a batch of them is copied at a time. Weights are a small table (name, shape, values), written
and read with Spark; a row of them is an array, so they hold whatever a trained network of that shape has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling as R

WEIGHTS_DDL = "name string, shape array<int>, values array<float>"


def initial_weights(features: int, hidden: int, layers: int = 2, head: int = 32, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights as they are before training: uniform by the width. Gates are stacked as reset, update, new."""
    rng = np.random.default_rng(seed)
    draw = lambda width, *shape: rng.uniform(-1, 1, shape).astype(np.float32) / np.float32(np.sqrt(width))
    out = {}
    for k in range(layers):
        out |= {f"wx{k}": draw(hidden, 3 * hidden, features if k == 0 else hidden), f"wh{k}": draw(hidden, 3 * hidden, hidden), f"bx{k}": draw(hidden, 3 * hidden), f"bh{k}": draw(hidden, 3 * hidden)}
    return out | {"w1": draw(hidden, head, hidden), "b1": draw(hidden, head), "w2": draw(head, 1, head), "b2": draw(head, 1)}


def to_table(spark: SparkSession, weights: dict[str, np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(k, list(w.shape), w.ravel().tolist()) for k, w in weights.items()], WEIGHTS_DDL)


def from_table(table: DataFrame) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["values"], np.float32).reshape(r["shape"]) for r in table.collect()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def forward(weights: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x: (batch, steps, features). The prediction, and the last layer's last state."""
    layer = 0
    while f"wx{layer}" in weights:
        wx, wh, bx, bh = (weights[f"{n}{layer}"] for n in ("wx", "wh", "bx", "bh"))
        width = wh.shape[1]
        h = np.zeros((len(x), width), np.float32)
        every = x @ wx.T + bx
        out = np.empty((len(x), x.shape[1], width), np.float32)
        for t in range(x.shape[1]):
            own = h @ wh.T + bh
            r, u = np.split(_sigmoid(every[:, t, : 2 * width] + own[:, : 2 * width]), 2, axis=1)
            new = np.tanh(every[:, t, 2 * width :] + r * own[:, 2 * width :])
            h = (1 - u) * new + u * h
            out[:, t] = h
        x, layer = out, layer + 1
    return (np.maximum(h @ weights["w1"].T + weights["b1"], 0) @ weights["w2"].T + weights["b2"])[:, 0], h


def windowed_forecasts(df: DataFrame, features: list[str], weights: dict[str, np.ndarray], lookback: int, stride: int = 1, batch: int = 4096, chunk: int = R.CHUNK) -> DataFrame:
    """(rn, forecast, state) for every stride-th row from row `lookback` on: the network over the `lookback` rows before it.
    Missing inputs count as 0."""

    def run(table: pa.Table) -> pa.Table:
        rn = table["rn"].to_numpy()
        order = np.argsort(rn, kind="stable")
        rn = rn[order]
        x = np.nan_to_num(np.column_stack([table[c].to_numpy() for c in features]).astype(np.float32)[order])
        own = table["_chunk"][0].as_py()
        ends = np.flatnonzero((rn // chunk == own) & (rn >= lookback) & ((rn - lookback) % stride == 0))
        views = np.lib.stride_tricks.sliding_window_view(x, lookback, axis=0) if len(x) >= lookback else None
        out, states = np.zeros(len(ends), np.float32), []
        for lo in range(0, len(ends), batch):
            at = ends[lo : lo + batch] - lookback
            out[lo : lo + batch], state = forward(weights, np.ascontiguousarray(views[at].transpose(0, 2, 1)))
            states.append(state)
        state = np.concatenate(states) if states else np.zeros((0, 1), np.float32)
        offsets = np.arange(len(ends) + 1, dtype=np.int32) * (state.shape[1] if len(ends) else 0)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(state.ravel().astype(np.float64)))
        return pa.table({"rn": rn[ends], "forecast": out.astype(np.float64), "state": lists})

    cut = R.haloed(df.select("rn", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features)), lookback, 0, chunk)
    return cut.groupBy("_chunk").applyInArrow(run, "rn bigint, forecast double, state array<double>")


def tensor_forecasts(df: DataFrame, column: str, weights: dict[str, np.ndarray], steps: int, width: int, batch: int = 1024, to: str = "forecast") -> DataFrame:
    """df with the forecast of tensors that are a column already: an array of steps * width numbers, step by step."""

    def make():
        return lambda x: forward(weights, x)[0]

    predict = predict_batch_udf(make, return_type=T.FloatType(), batch_size=batch, input_tensor_shapes=[[steps, width]])
    return df.withColumn(to, predict(F.col(column).cast("array<float>")))
