"""Gates of a mixture of experts: which experts a row goes to, with what weights, and how evenly rows are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logits(df: DataFrame, gate: DataFrame, features: list[Column], to: str = "logits") -> DataFrame:
    """df with an array of a logit for each expert. gate: expert, bias, weights (an array, one for each feature); a row for each
    expert, so it goes along with every row as one array."""
    one = gate.agg(F.sort_array(F.collect_list(F.struct("expert", "bias", "weights"))).alias("_gate"))
    x = F.array(*features)
    dot = lambda e: e["bias"] + F.aggregate(F.zip_with(e["weights"], x, lambda w, v: w * v), F.lit(0.0), lambda a, v: a + v)
    return df.crossJoin(F.broadcast(one)).withColumn(to, F.transform("_gate", dot)).drop("_gate")


def softmax(x: Column) -> Column:
    """Of an array; the largest is taken off first."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def top(x: Column, k: int) -> Column:
    """The k experts of the largest logits, from 0, as structs (expert, logit) in that order; of equal logits the first."""
    numbered = F.transform(x, lambda v, i: F.struct((-v).alias("low"), i.alias("expert")))
    return F.transform(F.slice(F.array_sort(numbered), 1, k), lambda s: F.struct(s["expert"].alias("expert"), (-s["low"]).alias("logit")))


def gated(df: DataFrame, k: int, x: str = "logits", to: str = "routes") -> DataFrame:
    """df with its k routes: structs (expert, weight), the weights a softmax over the chosen logits alone."""
    df = df.withColumn("_top", top(F.col(x), k))
    weight = softmax(F.transform("_top", lambda s: s["logit"]))
    return df.withColumn("_weight", weight).withColumn(to, F.zip_with("_top", "_weight", lambda s, w: F.struct(s["expert"].alias("expert"), w.alias("weight")))).drop("_top", "_weight")


def mixed(routes: Column, outputs: Column) -> Column:
    """The experts' outputs (an array, by expert) weighted by the routes."""
    return F.aggregate(routes, F.lit(0.0), lambda a, r: a + r["weight"] * F.get(outputs, r["expert"]))


def load_balance(df: DataFrame, experts: int, k: int, weight: float = 0.01, x: str = "logits", routes: str = "routes") -> DataFrame:
    """One row: shares (of all routes that go to each expert), means (of each expert's probability in the softmax over all
    logits), and loss, weight * experts * the sum of their products. Sums and counts, so it is a partial aggregate."""
    rows = df.select(softmax(F.col(x)).alias("_p"), F.transform(routes, lambda r: r["expert"]).alias("_to"))
    of = [F.sum(F.when(F.array_contains("_to", e), 1).otherwise(0)) / (F.count("*") * k) for e in range(experts)]
    mean = [F.avg(F.get("_p", F.lit(e))) for e in range(experts)]
    one = rows.agg(F.array(*of).alias("shares"), F.array(*mean).alias("means"))
    return one.withColumn("loss", weight * experts * F.aggregate(F.zip_with("shares", "means", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
