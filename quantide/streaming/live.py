"""The bar operators on streams, with watermarks for late quotes; the same functions take a finished table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import bars

LATE = "10 seconds"


def second_bars(quotes: DataFrame, late: str = LATE) -> DataFrame:
    """Last quote and tick count of each second and instrument; received_time is a timestamp."""
    last = F.max_by(F.struct(*bars.FIELDS), F.struct("received_time", "event_id"))
    own = quotes.withWatermark("received_time", late).groupBy(F.window("received_time", "1 second"), "inst")
    return own.agg(last.alias("l"), F.count("*").alias("n_ticks")).select(F.col("window.start").alias("sec"), "inst", "l.*", "n_ticks")


def period_prices(quotes: DataFrame, period: str = "15 minutes", late: str = LATE) -> DataFrame:
    """First and last mid and the number of quotes of each period and instrument."""
    mid = (F.col("bid") + F.col("ask")) / 2
    order = F.struct("received_time", "event_id")
    own = quotes.withWatermark("received_time", late).groupBy(F.window("received_time", period), "inst")
    out = own.agg(F.min_by(mid, order).alias("strike"), F.max_by(mid, order).alias("end_price"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("period_start"), "inst", "strike", "end_price", "n")


def sessions(quotes: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Quote sessions of each instrument; a quote exactly one gap after the last opens a new one."""
    own = quotes.withWatermark("received_time", late).groupBy(F.session_window("received_time", gap).alias("s"), "inst")
    return own.agg(F.count("*").alias("n")).select("inst", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


FILLED_DDL = "inst string, sec timestamp, bid double, bid_size double, ask double, ask_size double, n_ticks bigint"
#: The next second to give out, the values carried, and quotes of seconds that may still change.
_STATE_DDL = "next bigint, carried array<double>, at array<bigint>, id array<bigint>, held array<array<double>>"


def _filled(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    nxt, carried, rows = None, [], []
    if state.exists:
        nxt, carried, at, ids, held = state.get
        rows = list(zip(at, ids, map(list, held)))
    for part in parts:
        micros = part["received_time"].astype("datetime64[us]").astype("int64")
        rows += zip(micros.tolist(), part["event_id"].tolist(), part[list(bars.FIELDS)].astype(float).to_numpy().tolist())
    done = state.getCurrentWatermarkMs() // 1000  # seconds before this one don't change any more
    rows.sort(key=lambda r: r[:2])
    if nxt is None and rows:
        nxt = rows[0][0] // 1_000_000
    if nxt is not None and rows and rows[0][0] // 1_000_000 < nxt and not carried:
        nxt = rows[0][0] // 1_000_000  # nothing given out yet, and an earlier quote came
    out, k = [], 0
    while nxt is not None and nxt < done:
        first = k
        while k < len(rows) and rows[k][0] // 1_000_000 <= nxt:
            k += 1
        if k > first:
            carried = rows[k - 1][2]
        out.append((key[0], nxt, *carried, k - first))
        nxt += 1
    rows = rows[k:]
    if nxt is not None:
        state.update((nxt, [float(v) for v in carried], [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (nxt + 1) * 1000))
    if out:
        made = pd.DataFrame(out, columns=["inst", "sec", *bars.FIELDS, "n_ticks"])
        made["sec"] = pd.to_datetime(made["sec"], unit="s", utc=True)
        yield made


def filled_seconds(quotes: DataFrame, late: str = LATE) -> DataFrame:
    """A bar for every second of each instrument from its first quote on, silent seconds with the values carried forward: what the
    forward fill gives on a finished table, as far as the watermark is. State holds the carried values and the quotes that
    the watermark hasn't passed; a timer gives out silent seconds when only other instruments move it. Null prices are
    carried as they are; quotes behind the watermark are dropped, as everywhere."""
    own = quotes.select("inst", "received_time", "event_id", *bars.FIELDS).withWatermark("received_time", late).groupBy("inst")
    return own.applyInPandasWithState(_filled, FILLED_DDL, _STATE_DDL, "append", GroupStateTimeout.EventTimeTimeout)
