"""Quotes to bars: last quote of each second, merge of instruments, fills, gaps, grids and as-of joins.

Time order never meets one task: fills and row numbers work day by day, and only a row for each day is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import io

FIELDS = ("bid", "bid_size", "ask", "ask_size")
GAP_SECONDS = 1800


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long quotes (inst, received_time, event_id, bid, ask, bid_size, ask_size) that the events table stands for."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    inst = F.when(F.col("event_type").isin("click", "view"), "s").when(F.col("event_type").isin("purchase", "signup"), "p").otherwise("c")
    return e.select(
        inst.alias("inst"), F.col("ts").cast("timestamp_ntz").alias("received_time"), "event_id", F.col("value").alias("bid"),
        (F.col("value") * (1.001 + (F.col("event_id") % 7).cast("double") * 0.0001)).alias("ask"),
        (1.0 + F.col("event_id") % 97).alias("bid_size"), (1.0 + F.col("user_id") % 53).alias("ask_size"),
    )


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a time without zone, read as UTC."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def second(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc("second", ts).cast("timestamp_ntz")


def truncated(ts: Column | str, seconds: int) -> Column:
    """The start of the period of so many seconds since the epoch."""
    m = micros(ts)
    return F.timestamp_micros(m - F.pmod(m, F.lit(seconds * 1_000_000))).cast("timestamp_ntz")


def last_per_second(q: DataFrame) -> DataFrame:
    """inst, sec, the fields of the last quote in that second (whole row, nulls kept), n_ticks."""
    last = F.max_by(F.struct(*FIELDS), F.struct("received_time", "event_id"))
    return q.groupBy("inst", second("received_time").alias("sec")).agg(last.alias("l"), F.count("*").alias("n_ticks")).select("inst", "sec", "l.*", "n_ticks")


def merged(bars: DataFrame, insts: tuple[str, ...] = ("s", "p", "c"), fields: tuple[str, ...] = (*FIELDS, "n_ticks")) -> DataFrame:
    """One row for each second that any instrument has, columns {inst}_{field}: one aggregate instead of a chain of full
    outer joins on the second."""
    pick = [F.max(F.when(F.col("inst") == i, F.col(f))).alias(f"{i}_{f}") for i in insts for f in fields]
    return bars.groupBy("sec").agg(*pick)


def merged_quotes(q: DataFrame, insts: tuple[str, ...] = ("s", "p", "c")) -> DataFrame:
    """merged(last_per_second(q)) in one shuffle."""
    order, value = F.struct("received_time", "event_id"), F.struct(*FIELDS)
    last = [F.max_by(value, F.when(F.col("inst") == i, order)).alias(f"_{i}") for i in insts]
    count = [F.count(F.when(F.col("inst") == i, 1)).alias(f"_{i}_n") for i in insts]
    wide = q.groupBy(second("received_time").alias("sec")).agg(*last, *count)
    fields = [c for i in insts for c in (*(F.col(f"_{i}")[f].alias(f"{i}_{f}") for f in FIELDS), F.when(F.col(f"_{i}_n") > 0, F.col(f"_{i}_n")).alias(f"{i}_n_ticks"))]
    return wide.select("sec", *fields)


def outer_merged(left: DataFrame, right: DataFrame, key: str = "sec") -> DataFrame:
    """Full outer join with the key coalesced."""
    return left.join(right, key, "full_outer")


def filled(df: DataFrame, columns: list[str], order: str = "sec", backward: bool = True) -> DataFrame:
    """Each column's last value carried forward, and the head filled backward."""
    day = F.to_date(F.col(order))
    w = Window.partitionBy("_day").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("_day", day)
    # A row for each day: the last value of each column there, carried over the days, and the first of all.
    last = own.groupBy("_day").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))
    days = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_day", *(F.last(c, True).over(days).alias(f"_{c}") for c in columns))
    first = df.agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_first_{c}") for c in columns))
    met = own.join(carried, "_day", "left")
    value = {c: F.coalesce(F.last(c, True).over(w), F.col(f"_{c}")) for c in columns}
    out = met.withColumns(value).drop("_day", *(f"_{c}" for c in columns))
    if backward:
        out = out.crossJoin(F.broadcast(first)).withColumns({c: F.coalesce(c, f"_first_{c}") for c in columns}).drop(*first.columns)
    return out


def indexed(df: DataFrame, order: str = "sec") -> DataFrame:
    """df with rn, the row's number from 0 in time order, and n, the number of rows."""
    own = df.withColumn("_day", F.to_date(F.col(order)))
    sizes = own.groupBy("_day").agg(F.count("*").alias("_size"))
    days = Window.orderBy("_day")
    base = sizes.select("_day", (F.sum("_size").over(days) - F.col("_size")).alias("_base"), F.sum("_size").over(Window.partitionBy()).alias("n"))
    number = F.row_number().over(Window.partitionBy("_day").orderBy(order)) - 1
    return own.join(base, "_day").withColumn("rn", number + F.col("_base")).drop("_day", "_base")


# --- gaps, grids, as-of ---------------------------------------------------------------------------------------------


def _before(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with _prev, the time of the row before within `by`; only a row for each day crosses days."""
    own = df.withColumn("_day", F.to_date(F.col(order[0])))
    ends = own.groupBy(*by, "_day").agg(F.max(order[0]).alias("_end"))
    w = Window.partitionBy(*by).orderBy("_day")
    ends = ends.select(*by, "_day", F.lag("_end").over(w).alias("_carried"))
    lag = F.lag(order[0]).over(Window.partitionBy(*by, "_day").orderBy(*order))
    return own.join(ends, [*by, "_day"]).withColumn("_prev", F.coalesce(lag, "_carried")).drop("_carried", "_day")


def gaps(q: DataFrame, seconds: int = GAP_SECONDS) -> DataFrame:
    """inst, gap_start, gap_end, gap_seconds wherever two quotes are more than `seconds` apart."""
    found = _before(q, ["inst"], ["received_time", "event_id"])
    size = (micros("received_time") - micros("_prev")) / 1e6
    return found.filter(size > seconds).select("inst", F.col("_prev").alias("gap_start"), F.col("received_time").alias("gap_end"), size.alias("gap_seconds"))


def segmented(q: DataFrame, seconds: int = GAP_SECONDS) -> DataFrame:
    """q with seg_id: how many gaps (strictly longer) its instrument had before. Gaps are few: quotes meet them by day."""
    found = _before(q, ["inst"], ["received_time", "event_id"])
    jump = F.coalesce((micros("received_time") - micros("_prev")) > seconds * 1_000_000, F.lit(False)).cast("long")
    own = found.withColumn("_jump", jump).withColumn("_day", F.to_date("received_time"))
    per_day = own.groupBy("inst", "_day").agg(F.sum("_jump").alias("_n"))
    w = Window.partitionBy("inst").orderBy("_day")
    base = per_day.select("inst", "_day", (F.sum("_n").over(w) - F.col("_n")).alias("_base"))
    inner = F.sum("_jump").over(Window.partitionBy("inst", "_day").orderBy("received_time", "event_id"))
    return own.join(base, ["inst", "_day"]).withColumn("seg_id", F.col("_base") + inner).drop("_prev", "_jump", "_day", "_base")


def grid(q: DataFrame, step: int = 1) -> DataFrame:
    """inst, seg_id, grid_time: every `step` seconds from each segment's first to its last time, both rounded up."""
    unit = step * 1_000_000
    ends = q.groupBy("inst", "seg_id").agg(F.min(micros("received_time")).alias("a"), F.max(micros("received_time")).alias("b"))
    up = lambda c: (F.ceil(F.col(c) / unit) * unit).cast("long")
    # Days first, in any task, then the steps of a day: no array is longer than a day.
    day = 86_400_000_000
    days = ends.select("inst", "seg_id", up("a").alias("a"), up("b").alias("b")).withColumn("d", F.explode(F.sequence(F.floor(F.col("a") / day), F.floor(F.col("b") / day))))
    dealt = days.repartition("inst", "d")
    first = F.greatest("a", (F.ceil(F.col("d") * day / unit) * unit).cast("long"))
    last = F.least("b", (F.col("d") + 1) * day - 1)
    steps = dealt.withColumn("_a", first).withColumn("_b", last).filter("_a <= _b").select("inst", "seg_id", F.explode(F.sequence("_a", "_b", F.lit(unit))).alias("m"))
    return steps.select("inst", "seg_id", F.timestamp_micros("m").cast("timestamp_ntz").alias("grid_time"))


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, tie: str, fields: list[str]) -> DataFrame:
    """left with the fields of the last right row at or before its time: both sides in one sorted run for each key and
    day, and each day's last right row carried to the days after."""
    a = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.lit(None).cast(right.select(F.struct(*fields)).schema[0].dataType).alias("_r"))
    b = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), F.struct(*fields).alias("_r"))
    both = a.unionByName(b).withColumn("_day", F.to_date("_t"))
    w = Window.partitionBy(*by, "_day").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy(*by, "_day").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_tie"))).alias("_end"))
    days = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_day", F.last("_end", True).over(days).alias("_carried"))
    met = both.join(ends, [*by, "_day"]).withColumn("_found", F.coalesce(F.last("_r", True).over(w), "_carried"))
    return met.filter("_side = 1").select(*by, F.col("_t").alias(left_time), *(F.col("_found")[f].alias(f) for f in fields))


def resampled(q: DataFrame, step: int = 1, gap: int = GAP_SECONDS) -> DataFrame:
    """Segments of each instrument on a grid, each grid row with the last quote and the mid. The segmented quotes are written once,
    for the grid and the search both start from them."""
    seg = io.stored(segmented(q, gap))
    found = asof(grid(seg, step), seg, ["inst", "seg_id"], "grid_time", "received_time", "event_id", list(FIELDS))
    return found.withColumn("mid_price", (F.col("bid") + F.col("ask")) / 2)


# --- per-second base ------------------------------------------------------------------------------------------------


def bars(q: DataFrame) -> DataFrame:
    """The merged, filled table of all seconds with rn; c_has_update is 1 where instrument c had a quote."""
    wide = merged_quotes(q).withColumn("c_has_update", F.col("c_bid").isNotNull().cast("double")).withColumn("_day", F.to_date("sec"))
    fields = [f"{i}_{f}" for i in ("s", "p", "c") for f in (*FIELDS, "n_ticks")]
    # A row for each day: its size, and each column's first and last value; what comes before and after days is carried.
    at = {c: F.when(F.col(c).isNotNull(), F.col("sec")) for c in fields}
    ends = wide.groupBy("_day").agg(
        F.count("*").alias("_size"), *(F.max_by(c, at[c]).alias(f"_last_{c}") for c in fields), *(F.min_by(c, at[c]).alias(f"_first_{c}") for c in fields)
    )
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select(
        "_day", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"), F.sum("_size").over(every).alias("n"),
        *(F.coalesce(F.last(f"_last_{c}", True).over(before), F.first(f"_first_{c}", True).over(every)).alias(f"_{c}") for c in fields),
    )
    day = Window.partitionBy("_day").orderBy("sec")
    met = wide.join(carried, "_day")
    value = {c: F.coalesce(F.last(c, True).over(day.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"_{c}")) for c in fields}
    return met.withColumns(value | {"rn": F.row_number().over(day) - 1 + F.col("_base")}).drop("_day", "_base", *(f"_{c}" for c in fields))


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def microprice(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    return F.try_divide(ask * bid_size + bid * ask_size, bid_size + ask_size)


def spread_bps(bid: Column, ask: Column) -> Column:
    return F.try_divide(ask - bid, mid(bid, ask)) * 1e4


def imbalance(bid_size: Column, ask_size: Column) -> Column:
    return F.try_divide(bid_size - ask_size, bid_size + ask_size)


def prices(df: DataFrame, insts: tuple[str, ...] = ("s", "p", "c")) -> DataFrame:
    new = {}
    for i in insts:
        b, a, bs, as_ = (F.col(f"{i}_{f}") for f in ("bid", "ask", "bid_size", "ask_size"))
        new |= {f"{i}_mid": mid(b, a), f"{i}_micro": microprice(b, a, bs, as_), f"{i}_spread": spread_bps(b, a), f"{i}_obi": imbalance(bs, as_)}
    return df.withColumns(new)
