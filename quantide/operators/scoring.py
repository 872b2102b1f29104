"""Aggregates that score forecasts and probabilities; every one is a partial aggregate of sums and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..sources import io


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column, eps: float = 1e-8) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))


def skill(score: Column, naive: Column) -> Column:
    return 1 - F.try_divide(score, naive)


def r2(y: Column, f: Column) -> Column:
    """1 - residual over total sum of squares of the pairs that have both; null without variance."""
    ok = y.isNotNull() & f.isNotNull()
    a = F.when(ok, y)
    res, total = F.sum(F.when(ok, (y - f) * (y - f))), F.sum(a * a) - F.sum(a) * F.sum(a) / F.count(a)
    return F.when((F.count(a) > 1) & (total > 0), 1 - F.try_divide(res, total))


def by_group(df: DataFrame, keys: list[str], p: str, y: str, least: int) -> DataFrame:
    """Brier by group, for groups of at least `least` rows."""
    return df.groupBy(*keys).agg(brier(F.col(p), F.col(y)).alias("brier"), F.count("*").alias("n")).filter(F.col("n") >= least)


def bins(p: Column, n: int = 20) -> Column:
    """Equal bins of 0..1, the ends within."""
    return F.least(F.greatest(F.floor(p * n), F.lit(0)), F.lit(n - 1)).cast("int")


def calibration(df: DataFrame, p: str, y: str, n: int = 20) -> DataFrame:
    return df.groupBy(bins(F.col(p), n).alias("bin")).agg(F.avg(y).alias("outcome"), F.avg(p).alias("mean_p"), F.count("*").alias("n"))


def best_and_worst(groups: DataFrame, key: str) -> DataFrame:
    return groups.agg(F.min_by(key, F.struct("brier", key)).alias("best"), F.max_by(key, F.struct("brier", key)).alias("worst"), F.avg("brier").alias("mean"))


def histogram(df: DataFrame, keys: list[str], value: str, n: int = 50) -> DataFrame:
    """(*keys, bin, low, n, density): equal bins between a group's least and largest value, the last one closed; only bins that
    have rows. The density's integral over a group is 1; a group of one value has one bin of width 1 around it."""
    own = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    ends = own.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_all"))
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.withColumns({"_from": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")), "_width": F.when(flat, F.lit(1.0 / n)).otherwise((F.col("_hi") - F.col("_lo")) / n)})
    bin_ = F.least(F.floor((F.col(value) - F.col("_from")) / F.col("_width")), F.lit(n - 1)).cast("int")
    counted = own.join(ends, keys).groupBy(*keys, "_from", "_width", "_all", bin_.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select(*keys, "bin", (F.col("_from") + F.col("bin") * F.col("_width")).alias("low"), "n", (F.col("n") / (F.col("_all") * F.col("_width"))).alias("density"))


#: Rows of a range table up to which it is broadcast.
SMALL = 100_000


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = 1024, most: int = 4096, nan: bool = False) -> DataFrame:
    """(*keys, a column for each share): exact percentiles with linear interpolation between the two nearest ranks, by group.

    A histogram between a group's ends tells the bin that a rank falls into; that bin is cut again until it holds few values, and
    only those are told apart. So no task holds a group, state is a row for each group and rank, and equal values,
    however many, are one row with a count. Infinite values have their ranks, which counts tell. Missing values don't count, nor
    does NaN, but with nan=True, when it is the largest value; keys are matched null-safe."""
    known = F.col(value).isNotNull() if nan else F.col(value).isNotNull() & ~F.isnan(value)
    own = io.stored(df.filter(known).select(*keys, F.col(value).cast("double").alias("_v")))
    rank = {k: F.lit(q) * (F.col("_n") - 1) for k, q in shares.items()}
    every = F.array_distinct(F.array(*(f(x).cast("long") for x in rank.values() for f in (F.floor, F.ceil))))
    # The values that aren't finite come before and after the others.
    v, among = finite("_v"), F.col("_rank") - F.col("_under")
    under, over = (F.count(F.when(F.col("_v") == float(x), 1)) for x in ("-inf", "inf"))
    stat = own.groupBy(*keys).agg(F.min(v).alias("_low"), F.max(v).alias("_high"), F.count("*").alias("_n"), F.count(v).alias("_inside"), under.alias("_under"), over.alias("_over"))
    ranks = stat.withColumn("_rank", F.explode(every))
    inside = (among >= 0) & (among < F.col("_inside"))
    beyond = F.when(among < 0, float("-inf")).when(among < F.col("_inside") + F.col("_over"), float("inf")).otherwise(float("nan"))
    outer = ranks.filter(~inside).select(*keys, "_n", "_rank", beyond.alias("_v"))
    state = io.stored(ranks.filter(inside).select(*keys, "_low", "_high", "_n", "_rank", F.col("_under").alias("_below"), "_inside"))

    def same(a: DataFrame, b: DataFrame, more: list[str] = []) -> Column:
        return reduce(Column.__and__, (a[k].eqNullSafe(b[f"_k_{k}"]) for k in [*keys, *more]), F.lit(True))

    def within(ranges: DataFrame) -> DataFrame:
        """Values with each range of their group that holds them."""
        named = ranges.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        held = F.broadcast(named) if named.limit(SMALL + 1).count() <= SMALL else named
        return own.join(held, same(own, named) & own["_v"].between(named["_low"], named["_high"]))

    def large() -> Column:
        return (F.col("_inside") > most) & (F.col("_low") < F.col("_high"))

    while not state.filter(large()).isEmpty():
        ranges = state.filter(large()).select(*keys, "_low", "_high").distinct()
        at = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1))
        group = [F.col(f"_k_{k}") for k in keys]
        told = within(ranges).groupBy(*group, F.col("_low").alias("_k__low"), F.col("_high").alias("_k__high"), at.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_to_low"), F.max("_v").alias("_to_high"))
        along = Window.partitionBy(*(f"_k_{k}" for k in keys), "_k__low", "_k__high").orderBy("_bin")
        told = told.withColumn("_upto", F.sum("_c").over(along))
        now = state.filter(large())
        left = F.col("_rank") - F.col("_below")
        met = now.join(told, same(now, told, ["_low", "_high"]) & (left >= F.col("_upto") - F.col("_c")) & (left < F.col("_upto")))
        cut = met.select(*keys, F.col("_to_low").alias("_low"), F.col("_to_high").alias("_high"), "_n", "_rank", (F.col("_below") + F.col("_upto") - F.col("_c")).alias("_below"), F.col("_c").alias("_inside"))
        state = io.stored(state.filter(~large()).unionByName(cut))
    last = [f"_k_{k}" for k in keys]
    counted = within(state).groupBy(*last, "_rank", "_below", "_n", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*last, "_rank").orderBy("_v"))
    left = F.col("_rank") - F.col("_below")
    found = counted.withColumn("_upto", upto).filter((left >= F.col("_upto") - F.col("_c")) & (left < F.col("_upto")))
    told = found.select(*(F.col(f"_k_{k}").alias(k) for k in keys), "_n", "_rank", "_v").unionByName(outer)
    by = told.groupBy(*keys).agg(F.first("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def value_at(x: Column) -> Column:
        low, high = (F.element_at("_at", f(x).cast("long")) for f in (F.floor, F.ceil))
        lower = (x == F.floor(x)) | (low == high) | (low == float("-inf")) & (high < float("inf"))
        return F.when(lower, low).otherwise(low + (high - low) * (x - F.floor(x)))

    return by.select(*keys, *(value_at(x).alias(k) for k, x in rank.items()))
