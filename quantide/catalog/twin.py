"""Pieces of SQL for the twins of registered queries: the base tables, and rolling windows as direct frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSTS = ("s", "p", "c")
FIELDS = ("bid", "bid_size", "ask", "ask_size", "n_ticks")
#: Decimal places to which both sides round doubles; sums in another order differ far behind them.
PLACES = 8


def _each(template: str, sep: str = ", ") -> str:
    return sep.join(template.format(i=i, f=f) for i in INSTS for f in FIELDS)


def _inst(template: str) -> str:
    return ", ".join(template.format(i=i) for i in INSTS)


QUOTES = """quotes AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 's' WHEN event_type IN ('purchase', 'signup') THEN 'p' ELSE 'c' END AS inst,
  ts AS received_time, event_id, value AS bid, value * (1.001::DOUBLE + (event_id % 7)::DOUBLE * 0.0001::DOUBLE) AS ask, 1.0::DOUBLE + event_id % 97 AS bid_size, 1.0::DOUBLE + user_id % 53 AS ask_size FROM events)"""

LAST = (
    QUOTES
    + """, ticks AS (SELECT *, date_trunc('second', received_time) AS sec FROM quotes),
lasts AS (SELECT *, row_number() OVER (PARTITION BY inst, sec ORDER BY received_time DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY inst, sec) AS n_ticks FROM ticks),
bars1 AS (SELECT inst, sec, bid, bid_size, ask, ask_size, n_ticks FROM lasts WHERE k = 1)"""
)

WIDE = LAST + f", wide AS (SELECT sec, {_each("max({f}) FILTER (inst = '{i}') AS {i}_{f}")} FROM bars1 GROUP BY sec)"

BARS = (
    WIDE
    + f""", forward AS (SELECT sec, CASE WHEN c_bid IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS c_has_update, {_each("last_value({i}_{f} IGNORE NULLS) OVER w AS {i}_{f}")}
  FROM wide WINDOW w AS (ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
bars AS (SELECT sec, row_number() OVER (ORDER BY sec) - 1 AS rn, count(*) OVER () AS n, c_has_update, {_each("coalesce({i}_{f}, first_value({i}_{f} IGNORE NULLS) OVER w) AS {i}_{f}")}
  FROM forward WINDOW w AS (ORDER BY sec ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
)

PRICES = (
    BARS
    + f""", prices AS (SELECT *, {_inst("({i}_bid + {i}_ask) / 2 AS {i}_mid, ({i}_ask * {i}_bid_size + {i}_bid * {i}_ask_size) / ({i}_bid_size + {i}_ask_size) AS {i}_micro")},
  {_inst("({i}_ask - {i}_bid) / (({i}_bid + {i}_ask) / 2) * 1e4 AS {i}_spread, ({i}_bid_size - {i}_ask_size) / ({i}_bid_size + {i}_ask_size) AS {i}_obi")} FROM bars)"""
)

BASE = (
    PRICES
    + f""", rets AS (SELECT *, {_inst("ln({i}_mid) - lag(ln({i}_mid)) OVER (ORDER BY rn) AS {i}_ret")} FROM prices),
base AS (SELECT *, {_inst("{i}_ret * {i}_ret AS {i}_rv, CASE WHEN {i}_ret > 0 THEN {i}_ret * {i}_ret ELSE 0 END AS {i}_rsv_pos, CASE WHEN {i}_ret < 0 THEN {i}_ret * {i}_ret ELSE 0 END AS {i}_rsv_neg")},
  {_inst("abs({i}_ret) * lag(abs({i}_ret)) OVER (ORDER BY rn) * (pi() / 2) AS {i}_bpv")} FROM rets)"""
)


def frame(w: int) -> str:
    return f"(ORDER BY rn ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def full(w: int, x: str) -> str:
    return f"(CASE WHEN rn >= {w - 1} THEN {x} END)"


def rs(x: str, w: int) -> str:
    """Rolling sum, missing as 0, null until the window is full."""
    return full(w, f"sum(coalesce({x}, 0)) OVER {frame(w)}")


def rmean(x: str, w: int) -> str:
    return f"({rs(x, w)} / {w})"


def rstd(x: str, w: int) -> str:
    a, b = rs(x, w), rs(f"({x}) * ({x})", w)
    return full(w, f"sqrt(greatest({b} / {w} - ({a} / {w}) * ({a} / {w}), 0))")


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER (ORDER BY rn)"


def div(a: str, b: str, fill: float = 0.0) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), {fill})"


def corr(x: str, y: str, n: int, guard: int | None = None) -> str:
    x, y = f"coalesce({x}, 0)", f"coalesce({y}, 0)"
    sx, sy, sxx, syy, sxy = (rs(e, n) for e in (x, y, f"{x} * {x}", f"{y} * {y}", f"{x} * {y}"))
    vx, vy = f"({sxx} / {n} - ({sx} / {n}) * ({sx} / {n}))", f"({syy} / {n} - ({sy} / {n}) * ({sy} / {n}))"
    out = f"CASE WHEN {vx} > 0 AND {vy} > 0 THEN ({sxy} / {n} - ({sx} / {n}) * ({sy} / {n})) / sqrt({vx} * {vy}) END"
    return full(guard, out) if guard else out


def query(columns: dict[str, str], keys: str = "rn", steps: list[dict[str, str]] | None = None, base: str = BASE, source: str = "base", tail: str = "", exact: tuple[str, ...] = ()) -> str:
    """Rounded columns over the base, after steps that each add columns. exact: columns that aren't doubles."""
    ctes, now = base, source
    for k, step in enumerate(steps or []):
        ctes += f", step{k} AS (SELECT *, " + ", ".join(f"{x} AS {n}" for n, x in step.items()) + f" FROM {now})"
        now = f"step{k}"
    out = ", ".join(f"{x} AS {n}" if n in exact else f"round({x}, {PLACES}) AS {n}" for n, x in columns.items())
    return f"WITH {ctes} SELECT {keys + ', ' if keys else ''}{out} FROM {now} {tail}"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to PLACES, minus zero as zero."""
    return df.select(*(
        (F.round(F.col(f.name), PLACES) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema
    ))
