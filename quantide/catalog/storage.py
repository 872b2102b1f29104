"""Registered queries of sources and sinks (S): each writes derived data and returns what it reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars, pricing
from ..plans import series
from ..sources import io
from . import twin as S
from .relational import _PER, _r, per

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, run, sql: str | None = None, *more: str) -> None:
    for n in (name, *more):
        QUERIES[n] = lambda spark, sf_dir, run=run: S.rounded(run(spark, sf_dir))
        if sql:
            ORACLES[n] = sql


def level1(spark, sf_dir):
    io.write_level1(bars.quotes(spark, sf_dir), path := io.scratch(spark))
    return io.read_level1(spark, path, "2024-01-05 00:00:00", "2024-01-12 00:00:00", ["s", "p"]).select("inst", "received_time", "event_id", "p_bid_0_price")


add("S01_level1_loader", level1, f"WITH {S.QUOTES} SELECT inst, received_time, event_id, round(bid, 8) AS p_bid_0_price FROM quotes WHERE inst IN ('s', 'p') AND received_time BETWEEN '2024-01-05' AND '2024-01-12'")


def sink(spark, sf_dir):
    """Everything that the sink by instrument and day holds, with the folders' day."""
    io.write_level1(bars.quotes(spark, sf_dir), path := io.scratch(spark))
    return spark.read.parquet(path).select("inst", F.col("day").cast("date").alias("day"), "event_id", *io.LEVEL1.values())


_L1 = _r(**{v: k for k, v in io.LEVEL1.items()})
add("S03_sink_by_instrument", sink, f"WITH {S.QUOTES} SELECT inst, received_time::DATE AS day, event_id, {_L1} FROM quotes")


def pulled(spark, sf_dir):
    """All instruments over the whole time, counted by instrument and day: one scan, pruned to what the counts need."""
    io.write_level1(bars.quotes(spark, sf_dir), path := io.scratch(spark))
    df = io.read_level1(spark, path, "1970-01-01 00:00:00", "2100-01-01 00:00:00", ["s", "p", "c"])
    return df.groupBy("inst", F.to_date("received_time").alias("day")).agg(F.count("*").alias("n"), F.min("received_time").alias("first"), F.sum("p_bid_0_size").alias("size"))


add("S04_many_instruments", pulled, f"WITH {S.QUOTES} SELECT inst, received_time::DATE AS day, count(*) AS n, min(received_time) AS first, {_r(size='sum(bid_size)')} FROM quotes GROUP BY 1, 2")


def reported(spark, sf_dir):
    """Three inputs pulled on their own, one of which is not there."""
    q, paths = bars.quotes(spark, sf_dir), {"x": io.scratch(spark)}
    for i in ("s", "p"):
        q.filter(F.col("inst") == i).drop("inst").write.parquet(path := io.scratch(spark))
        paths[i] = path
    return io.pull(spark, paths, io.scratch(spark)).select("inst", "rows", F.col("error").isNotNull().alias("failed"))


add("S04_pull_report", reported, f"WITH {S.QUOTES} SELECT inst, count(*) AS rows, false AS failed FROM quotes WHERE inst IN ('s', 'p') GROUP BY 1 UNION ALL SELECT 'x', NULL, true")


def mapped(spark, sf_dir):
    """One input for each instrument, by prefix, as one long table."""
    q, paths = bars.quotes(spark, sf_dir), {}
    for i in ("s", "p"):
        q.filter(F.col("inst") == i).drop("inst").write.parquet(path := io.scratch(spark))
        paths[i] = path
    return io.instruments(spark, paths).select("inst", "event_id", "bid")


add("S20_input_map", mapped, f"WITH {S.QUOTES} SELECT inst, event_id, {_r(bid='bid')} FROM quotes WHERE inst IN ('s', 'p')")


def parquet(spark, sf_dir):
    df = series.price_table(spark, sf_dir).select("rn", "s_mid")
    df.write.parquet(path := io.scratch(spark))
    return spark.read.parquet(path)


add("S10_parquet_sink", parquet, f"WITH {S.PRICES} SELECT rn, {_r(s_mid='s_mid')} FROM prices")


def csv(spark, sf_dir):
    per(spark, sf_dir).select(F.date_format("period_start", "yyyy-MM-dd HH:mm").alias("period"), "strike", "n").write.csv(path := io.scratch(spark), header=True)
    return spark.read.csv(path, header=True, schema="period string, strike double, n bigint")


add("S11_csv_sink", csv, _PER + f" SELECT strftime(period_start, '%Y-%m-%d %H:%M') AS period, {_r(strike='strike')}, n FROM per")


def json(spark, sf_dir):
    """Nested metrics as JSON and back."""
    df = per(spark, sf_dir).groupBy(F.to_date("period_start").cast("string").alias("day")).agg(F.count("*").alias("n"), F.avg("strike").alias("mean"))
    df.select("day", F.struct("n", "mean").alias("metrics")).write.json(path := io.scratch(spark))
    return spark.read.json(path, schema="day string, metrics struct<n: bigint, mean: double>").select("day", "metrics.n", "metrics.mean")


add("S14_json_sink", json, _PER + f" SELECT period_start::DATE::VARCHAR AS day, count(*) AS n, {_r(mean='avg(strike)')} FROM per GROUP BY 1")


def parameters(spark, sf_dir):
    """Option parameters through CSV, met by the periods' rows."""
    pricing.jsu_table(spark).coalesce(1).write.csv(path := io.scratch(spark), header=True)
    rows = series.price_table(spark, sf_dir).select("rn", (F.col("s_bid_size") * 10_000).alias("tte_ms"))
    return pricing.nearest_parameters(rows, io.read_jsu(spark, path)).select("rn", "param_tte", "scale")


def _sql() -> str:
    from .calendar import _PARAMS

    return f"WITH {S.PRICES}, {_PARAMS}, m AS (SELECT rn, t, s, row_number() OVER (PARTITION BY rn ORDER BY abs(t - s_bid_size * 10000), t) AS k FROM prices, params WHERE s >= 0.0001) SELECT rn, t AS param_tte, s AS scale FROM m WHERE k = 1"


add("S12_csv_parameters", parameters, _sql())


def curve(spark, sf_dir):
    """A seasonal curve by instrument and hour, written as a table and joined back to the rows that it came from."""
    base = series.base_table(spark, sf_dir).select("rn", F.hour("sec").alias("h"), "s_rv", "p_rv")
    long = base.select("rn", "h", F.explode(F.array(*(F.struct(F.lit(i).alias("inst"), F.col(f"{i}_rv").alias("rv")) for i in "sp"))).alias("x")).select("rn", "h", "x.*")
    long.groupBy("inst", "h").agg(F.avg("rv").alias("factor")).write.partitionBy("inst").parquet(path := io.scratch(spark))
    factors = F.broadcast(spark.read.parquet(path).select("inst", "h", "factor"))  # 24 rows for each instrument
    return long.join(factors, ["inst", "h"]).select("rn", "inst", (F.col("rv") / F.greatest("factor", F.lit(1e-12))).alias("v"))


add("S15_parameter_tables", curve, f"WITH {S.BASE}, l AS (SELECT rn, hour(sec) AS h, unnest(['s', 'p']) AS inst, unnest([s_rv, p_rv]) AS rv FROM base), f AS (SELECT inst, h, avg(rv) AS factor FROM l GROUP BY ALL) SELECT rn, inst, round(rv / greatest(factor, 1e-12), 8) AS v FROM l JOIN f USING (inst, h)")


def sorted_parameters(spark, sf_dir):
    """Each period's count of quotes as a time to expiry, in order with the parameters: place, and how many are at or below."""
    pricing.jsu_table(spark).coalesce(1).write.csv(path := io.scratch(spark), header=True)
    times = F.broadcast(io.read_jsu(spark, path).agg(F.array_sort(F.collect_list("tte_ms")).alias("t")))  # one row of five
    rows = per(spark, sf_dir).select("period_start", (F.col("n") * 20_000.0).alias("tte"))
    return rows.crossJoin(times).select("period_start", F.size(F.filter("t", lambda x: x <= F.col("tte"))).cast("long").alias("below"))


add("O02_sorted_parameters", sorted_parameters, _PER + f" SELECT period_start, len(list_filter({[float(t[0]) for t in pricing.JSU]}, lambda t: t <= n * 20000.0)) AS below FROM per")


def fourier(spark, sf_dir):
    """Calibration coefficients through JSON, applied to every price row."""
    one = spark.createDataFrame([(2, pricing.FOURIER)], io.FOURIER_SCHEMA)
    one.coalesce(1).write.json(path := io.scratch(spark))
    coef = F.broadcast(io.read_fourier(spark, path).select("coef"))
    p = F.col("s_obi") / 2 + 0.5
    terms = sum((F.col("coef")[2 * k - 1] * F.sin(p * (6.283185307179586 * k)) + F.col("coef")[2 * k] * F.cos(p * (6.283185307179586 * k)) for k in (1, 2)), p + F.col("coef")[0])
    return series.price_table(spark, sf_dir).crossJoin(coef).select("rn", F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)).alias("p"))


def _fourier_sql() -> str:
    from .calendar import _cal

    return f"WITH {S.PRICES} SELECT rn, round({_cal('(s_obi / 2 + 0.5)')}, 8) AS p FROM prices"


add("S13_json_parameters", fourier, _fourier_sql())
