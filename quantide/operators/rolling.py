"""Row windows over a numbered series, at any length and any number of rows.

A series is cut into chunks of CHUNK rows, each with a halo of the rows before (and after) that its windows reach, so
windows are partitioned by chunk and a row is copied to the few chunks that need it. Sums over long windows are
differences of running sums within a chunk, which cost the same for any length and stay small numbers; short windows
are summed directly. Missing inputs count as 0; windows not yet full give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..sources import io

CHUNK = 1 << 16
EXACT = "decimal(28,18)"
DIRECT = 64


def haloed(df: DataFrame, before: int, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """df with _chunk; a row is in every chunk that starts at most `before` rows after it or ended `after` rows before."""
    first = F.greatest(F.floor((F.col("rn") - after) / chunk), F.lit(0))
    return df.withColumn("_chunk", F.explode(F.sequence(first.cast("long"), F.floor((F.col("rn") + before) / chunk).cast("long"))))


def trimmed(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    return df.filter(F.col("_chunk") == F.floor(F.col("rn") / chunk)).drop("_chunk")


def order() -> Window:
    return Window.partitionBy("_chunk").orderBy("rn")


def windowed(df: DataFrame, make: Callable[[DataFrame], DataFrame], before: int, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """make over df in chunks with halos; make may use order(), sums() and the like."""
    return trimmed(make(haloed(df, before, after, chunk)), chunk)


def full(w: int, value: Column) -> Column:
    return F.when(F.col("rn") >= w - 1, value)


#: Running counts of infinite and missing numbers share a long: so many bits for each of inf, -inf and NaN.
BITS = 20


def _running(x: Column, name: str) -> dict[str, Column]:
    """_r_{name}, the running sum of the finite values within a chunk, and _o_{name}, the counts of the others in one number."""
    up = order().rowsBetween(Window.unboundedPreceding, 0)
    odd = F.when(F.isnan(x), 1 << 2 * BITS).when(x == float("inf"), 1).when(x == float("-inf"), 1 << BITS).otherwise(0)
    return {f"_r_{name}": F.sum(F.coalesce(finite(x), F.lit(0.0))).over(up), f"_o_{name}": F.sum(odd.cast("long")).over(up)}


def _between(later: tuple[Column, Column], earlier: tuple[Column, Column]) -> Column:
    """What was added between two running sums with their counts: of what isn't finite, that is infinite or NaN."""
    odd = later[1] - earlier[1]
    many = (1 << BITS) - 1
    up, down = odd.bitwiseAND(many) > 0, F.shiftright(odd, BITS).bitwiseAND(many) > 0
    value = F.when((odd >= 1 << 2 * BITS) | (up & down), float("nan")).when(up, float("inf")).otherwise(float("-inf"))
    return F.when(odd == 0, later[0] - earlier[0]).when(odd > 0, value)


def sums(df: DataFrame, wanted: dict[str, tuple[Column, int]], direct: int = DIRECT) -> DataFrame:
    """df with a rolling sum for each name: (expression, window); one running sum of an expression serves all long windows."""
    o = order()
    now = {k: full(w, F.sum(F.coalesce(x, F.lit(0.0))).over(o.rowsBetween(-(w - 1), 0))) for k, (x, w) in wanted.items() if w <= direct}
    large = {k: v for k, v in wanted.items() if v[1] > direct}
    runs = {}
    for x, _ in large.values():
        name, _ = runs.setdefault(str(x), (f"s{len(runs)}", x))
        now |= _running(x, name)
    df = df.withColumns(now)
    if large:
        past = lambda c, w: F.coalesce(F.lag(c, w).over(o), F.lit(0))
        made = {}
        for k, (x, w) in large.items():
            r, odd = (f"_{p}_{runs[str(x)][0]}" for p in "ro")
            made[k] = full(w, _between((F.col(r), F.col(odd)), (past(r, w), past(odd, w))))
        df = df.withColumns(made).drop(*(f"_{p}_{n}" for p in "ro" for n, _ in runs.values()))
    return df


def strict_sum(x: Column, w: int) -> Column:
    """A rolling sum that is null if any row of the window is missing."""
    o = order().rowsBetween(-(w - 1), 0)
    return F.when(F.count(x).over(o) == w, F.sum(x).over(o))


def strict_sums(df: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """df with a rolling sum of a column for each name, null if any row of the window is missing; one running sum and count for
    each column serve all lengths."""
    o, up = order(), order().rowsBetween(Window.unboundedPreceding, 0)
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    df = df.withColumns({n: x for c in columns for n, x in _running(F.col(c), c).items()} | {f"_n_{c}": F.count(c).over(up) for c in columns})
    past = lambda c, w: F.coalesce(F.lag(c, w).over(o), F.lit(0))
    sum_ = lambda c, w: _between((F.col(f"_r_{c}"), F.col(f"_o_{c}")), (past(f"_r_{c}", w), past(f"_o_{c}", w)))
    made = {k: full(w, F.when(F.col(f"_n_{c}") - past(f"_n_{c}", w) == w, sum_(c, w))) for k, (c, w) in wanted.items()}
    return df.withColumns(made).drop(*(f"_{p}_{c}" for p in "rno" for c in columns))


def forward_sum(x: Column, h: int) -> Column:
    """The sum over the next h rows, null if fewer or any is missing."""
    o = order().rowsBetween(1, h)
    return F.when(F.count(x).over(o) == h, F.sum(x).over(o))


def forward_sums(df: DataFrame, wanted: dict[str, tuple[Column, int]]) -> DataFrame:
    """df with the sum over the next h rows for each name: (expression, h); null if fewer or any is missing. Differences of
    one running sum for each expression serve all lengths."""
    o, up = order(), order().rowsBetween(Window.unboundedPreceding, 0)
    runs = {}
    for x, _ in wanted.values():
        runs.setdefault(str(x), (len(runs), x))
    df = df.withColumns({n: c for k, x in runs.values() for n, c in (_running(x, f"f{k}") | {f"_c{k}": F.count(x).over(up)}).items()})
    made = {}
    for name, (x, h) in wanted.items():
        k = runs[str(x)][0]
        run, odd = F.col(f"_r_f{k}"), F.col(f"_o_f{k}")
        ahead = _between((F.lead(run, h).over(o), F.lead(odd, h).over(o)), (run, odd))
        made[name] = F.when(F.lead(f"_c{k}", h).over(o) - F.col(f"_c{k}") == h, ahead)
    return df.withColumns(made).drop(*(n for k, _ in runs.values() for n in (f"_r_f{k}", f"_o_f{k}", f"_c{k}")))


def std(s1: Column, s2: Column, w: int) -> Column:
    """Population standard deviation from a window's sum and sum of squares."""
    m = s1 / w
    return F.when(s1.isNotNull(), F.sqrt(F.greatest(s2 / w - m * m, F.lit(0.0))))


def correlation(n: int, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    vx, vy, c = sxx / n - (sx / n) * (sx / n), syy / n - (sy / n) * (sy / n), sxy / n - (sx / n) * (sy / n)
    return F.when((vx > 0) & (vy > 0), F.try_divide(c, F.sqrt(F.when(vx * vy > 0, vx * vy))))


def correlations(df: DataFrame, wanted: dict[str, tuple[Column, Column, int]]) -> DataFrame:
    """Rolling Pearson correlations: name -> (x, y, window)."""
    parts = {}
    for k, (x, y, w) in wanted.items():
        x, y = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))
        parts |= {f"_{k}_x": (x, w), f"_{k}_y": (y, w), f"_{k}_xx": (x * x, w), f"_{k}_yy": (y * y, w), f"_{k}_xy": (x * y, w)}
    df = sums(df, parts)
    made = {k: correlation(w, *(F.col(f"_{k}_{p}") for p in ("x", "y", "xx", "yy", "xy"))) for k, (_, _, w) in wanted.items()}
    return df.withColumns(made).drop(*parts)


def autocorrelations(df: DataFrame, wanted: dict[str, tuple[Column, int]]) -> DataFrame:
    """Rolling lag-1 autocorrelations over the w - 1 pairs of a window."""
    df = df.withColumns({f"_lag_{k}": F.lag(x).over(order()) for k, (x, _) in wanted.items()})
    df = correlations(df, {k: (x, F.col(f"_lag_{k}"), w - 1) for k, (x, w) in wanted.items()})
    return df.withColumns({k: full(w, F.col(k)) for k, (_, w) in wanted.items()}).drop(*(f"_lag_{k}" for k in wanted))


def moments(df: DataFrame, wanted: dict[str, tuple[Column, int]]) -> DataFrame:
    """{name}_skew and {name}_kurt of rolling windows, with the small-sample factors; 0 without variance."""
    parts = {f"_{k}_{p}": (x if p == 1 else F.pow(x, F.lit(float(p))), w) for k, (x, w) in wanted.items() for p in (1, 2, 3, 4)}
    df = sums(df, parts)
    made = {}
    for k, (_, w) in wanted.items():
        m = F.col(f"_{k}_1") / w
        e2, e3, e4 = (F.col(f"_{k}_{p}") / w for p in (2, 3, 4))
        var = e2 - m * m
        m3 = e3 - 3 * m * e2 + 2 * m * m * m
        m4 = e4 - 4 * m * e3 + 6 * m * m * e2 - 3 * m * m * m * m
        a = (w + 1) * w / ((w - 1) * (w - 2) * (w - 3))
        b = 3 * (w - 1) ** 2 / ((w - 2) * (w - 3))
        made[f"{k}_skew"] = full(w, F.when(var > 0, F.try_divide(m3, F.pow(var, F.lit(1.5))) * (w * w / ((w - 1) * (w - 2)))).otherwise(0.0))
        made[f"{k}_kurt"] = full(w, F.when(var > 0, a * (w - 1) * F.try_divide(m4, var * var) - b).otherwise(0.0))
    return df.withColumns(made).drop(*parts)


def maxima(df: DataFrame, wanted: dict[str, tuple[Column, int]], direct: int = DIRECT) -> DataFrame:
    """Rolling maxima. Long windows: a window spans two blocks of its own length, so it is the larger of the block's
    maximum from the window's first row on, and the next block's up to its last."""
    o = order()
    short = {k: full(w, F.max(x).over(o.rowsBetween(-(w - 1), 0))) for k, (x, w) in wanted.items() if w <= direct}
    df = df.withColumns(short) if short else df
    for k, (x, w) in wanted.items():
        if w > direct:
            block = Window.partitionBy("_chunk", F.floor(F.col("rn") / w)).orderBy("rn")
            df = df.withColumns({
                "_up": F.max(x).over(block.rowsBetween(Window.unboundedPreceding, 0)), "_down": F.max(x).over(block.rowsBetween(0, Window.unboundedFollowing)),
            })
            df = df.withColumn(k, full(w, F.greatest("_up", F.lag("_down", w - 1).over(o)))).drop("_up", "_down")
    return df


def prefix_sums(df: DataFrame, wanted: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """df with the running sum of each expression (missing or not finite as 0) from the first row on, as decimals: differences of them
    are as exact as their inputs, however long the series. Sums of chunks are carried in two levels, so that the one task
    that sees the upper one gets a row for each chunk squared rows."""
    own = df.withColumn("_chunk", F.floor(F.col("rn") / chunk)).withColumns({f"_v_{k}": F.coalesce(finite(x), F.lit(0.0)).cast(EXACT) for k, x in wanted.items()})
    upper = F.floor(F.col("_chunk") / chunk).alias("_upper")
    totals = own.groupBy(upper, "_chunk").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in wanted))

    def earlier(w: Window) -> list[Column]:
        return [F.coalesce(F.sum(f"_t_{k}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(EXACT)).alias(f"_b_{k}") for k in wanted]

    tops = totals.groupBy("_upper").agg(*(F.sum(f"_t_{k}").alias(f"_t_{k}") for k in wanted)).select(F.col("_upper").alias("_top"), *(c.alias(f"_a_{k}") for c, k in zip(earlier(Window.orderBy("_upper")), wanted)))
    lower = totals.select("_upper", "_chunk", *earlier(Window.partitionBy("_upper").orderBy("_chunk")))
    base = lower.join(tops, F.col("_upper") == F.col("_top")).select("_chunk", *((F.col(f"_a_{k}") + F.col(f"_b_{k}")).alias(f"_b_{k}") for k in wanted))
    run = order().rowsBetween(Window.unboundedPreceding, 0)
    met = own.join(base, "_chunk")
    return met.withColumns({k: F.col(f"_b_{k}") + F.sum(f"_v_{k}").over(run) for k in wanted}).drop("_chunk", *(f"_{p}_{k}" for p in "vb" for k in wanted))


def shifted(df: DataFrame, columns: list[str], shifts: list[int], chunk: int = CHUNK) -> DataFrame:
    """df with {c}_{k}: column c as it was k rows ago, for each shift; null before the first row.

    Shifts up to an eighth of a chunk are lags within chunks with a halo. For each longer one a row goes once more, alone, to
    the chunk of the row that needs it, and stands beside that row there: one narrow copy, however far the shift reaches,
    and one exchange for all of them."""
    near, far = [k for k in shifts if 8 * k <= chunk], [k for k in shifts if 8 * k > chunk]
    if near:
        lags = {f"{c}_{k}": F.lag(c, k).over(order()) for c in columns for k in near}
        df = windowed(df, lambda d: d.withColumns(lags), max(near), 0, chunk)
    if not far:
        return df
    kept = [F.col(c) if c in ("rn", *columns) else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]
    copies = df.select(*kept, F.explode(F.array(*(F.lit(k) for k in far))).alias("_k")).withColumn("rn", F.col("rn") + F.col("_k"))
    every = df.withColumn("_k", F.lit(0)).unionByName(copies).withColumn("_chunk", F.floor(F.col("rn") / chunk))
    # Rows of one number stand together: first the copies, then the row itself.
    beside = Window.partitionBy("_chunk").orderBy("rn", F.desc("_k")).rowsBetween(-len(far), 0)
    met = every.withColumn("_met", F.collect_list(F.when(F.col("_k") > 0, F.struct("rn", "_k", *columns))).over(beside)).filter("_k = 0")

    def at(c: str, k: int) -> Column:
        return F.get(F.filter("_met", lambda m: (m["rn"] == F.col("rn")) & (m["_k"] == k)), F.lit(0))[c]

    return met.select(*df.columns, *(at(c, k).alias(f"{c}_{k}") for c in columns for k in far))


def gathered(df: DataFrame, to: Column, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """df with {c}_at: column c of the row whose number is `to`, which each row has for itself; null where there is none.

    A row is sent to the chunk of the row that it asks for, where requests stand behind the values in one sorted run: one exchange,
    no join. Rows without a `to` get nulls."""
    asked = df.withColumns({"_to": to.cast("long"), "_asks": F.lit(1)})
    null = {f.name: F.lit(None).cast(f.dataType) for f in df.schema}
    held = df.select(*(F.col(c) if c in columns else null[c].alias(c) for c in df.columns), F.col("rn").cast("long").alias("_to"), F.lit(0).alias("_asks"))
    every = asked.unionByName(held).withColumn("_chunk", F.floor(F.col("_to") / chunk))
    run = Window.partitionBy("_chunk").orderBy("_to", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    met = every.withColumn("_held", F.last(F.when(F.col("_asks") == 0, F.struct("_to", *columns)), True).over(run)).filter("_asks = 1")
    own = F.col("_held._to") == F.col("_to")
    return met.select(*df.columns, *(F.when(own, F.col(f"_held.{c}")).alias(f"{c}_at") for c in columns))


def ewma(df: DataFrame, wanted: dict[str, tuple[str, float]], chunk: int = CHUNK, group: int = 4096) -> DataFrame:
    """Exponentially weighted means by half-life in rows, y0 = x0, of whole columns, what isn't finite as 0. The recursion is linear: a chunk of rows
    gives its own response from zero and what it leaves of the state before it. Chunks are composed the same way within
    groups, and groups within one last task, which gets a row for each group times chunk rows."""
    import numpy as np
    import pandas as pd

    names = list(wanted)
    alpha = {k: 1 - np.exp(-np.log(2) / h) for k, (_, h) in wanted.items()}
    cut = df.withColumn("_chunk", F.floor(F.col("rn") / chunk).cast("long"))
    schema = ", ".join(["rn bigint", "_chunk bigint"] + [f"{k} double" for k in names])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        out = pdf[["rn", "_chunk"]].copy()
        for k, (c, _) in wanted.items():
            x = pdf[c].fillna(0.0).astype(float)
            start = x.iloc[0] if pdf["rn"].iloc[0] == 0 else 0.0  # a chunk starts from state 0 but for the first
            out[k] = pd.concat([pd.Series([start]), x * 1.0]).ewm(alpha=alpha[k], adjust=False).mean().iloc[1:].to_numpy()
        return out

    states = ", ".join(f"_s_{k} double, _d_{k} double" for k in names)

    def composed(key: str):
        """(key, state and rest before it, from a state of zero) and, as a row of key -1 - group, those at the end."""

        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(key)
            out = {key: pdf[key].tolist() + [-1 - int(pdf["_group"].iloc[0])]}
            for k in names:
                s, d, before = 0.0, 1.0, []
                for e, rest in zip(pdf[f"_s_{k}"], pdf[f"_d_{k}"]):
                    before.append((s, d))
                    s, d = s * rest + e, d * rest
                out[f"_s_{k}"], out[f"_d_{k}"] = zip(*before, (s, d))
            return pd.DataFrame(out)

        return fold

    own = io.stored(cut.select("rn", "_chunk", *(finite(c).alias(c) for c in {c for c, _ in wanted.values()})).groupBy("_chunk").applyInPandas(run, schema))
    ends = own.groupBy("_chunk").agg(*(c for k in names for c in (F.max_by(k, "rn").alias(f"_s_{k}"), F.pow(F.lit(1 - alpha[k]), F.count("*")).alias(f"_d_{k}"))))
    lower = ends.withColumn("_group", F.floor(F.col("_chunk") / group)).groupBy("_group").applyInPandas(composed("_chunk"), f"_chunk bigint, {states}")
    tops = lower.filter("_chunk < 0").withColumn("_chunk", -1 - F.col("_chunk")).withColumn("_group", F.lit(0)).groupBy("_group").applyInPandas(composed("_chunk"), f"_chunk bigint, {states}")
    tops = tops.filter("_chunk >= 0").select(F.col("_chunk").alias("_group"), *(F.col(f"_s_{k}").alias(f"_u_{k}") for k in names))
    state = lower.filter("_chunk >= 0").withColumn("_group", F.floor(F.col("_chunk") / group)).join(tops, "_group")
    state = state.select("_chunk", *((F.col(f"_s_{k}") + F.col(f"_d_{k}") * F.col(f"_u_{k}")).alias(f"_s_{k}") for k in names))
    steps = F.col("rn") - F.col("_chunk") * chunk + 1
    return own.join(state, "_chunk").select("rn", *((F.col(k) + F.col(f"_s_{k}") * F.pow(F.lit(1 - alpha[k]), steps)).alias(k) for k in names))
