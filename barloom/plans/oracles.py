"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

HOURLY = """
raw AS MATERIALIZED (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
  FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2
)"""
ALIGNED = (
    HOURLY
    + """, grid AS (
  SELECT s.symbol, c.ts, open, high, low, close, volume, row_number() OVER (PARTITION BY s.symbol ORDER BY c.ts) - 1 AS bar_idx
  FROM (SELECT DISTINCT ts FROM raw) c CROSS JOIN (SELECT DISTINCT symbol FROM raw) s LEFT JOIN raw ON raw.symbol = s.symbol AND raw.ts = c.ts
), filled AS (
  SELECT symbol, ts, bar_idx, coalesce(volume, 0) AS volume,
    coalesce(last_value(open IGNORE NULLS) OVER u, lead(open) OVER o) AS open, coalesce(last_value(high IGNORE NULLS) OVER u, lead(high) OVER o) AS high,
    coalesce(last_value(low IGNORE NULLS) OVER u, lead(low) OVER o) AS low, coalesce(last_value(close IGNORE NULLS) OVER u, lead(close) OVER o) AS close
  FROM grid WINDOW o AS (PARTITION BY symbol ORDER BY bar_idx), u AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), started AS (
  SELECT *, min(CASE WHEN close IS NOT NULL THEN bar_idx END) OVER (PARTITION BY symbol) AS first_idx FROM filled
), bars AS MATERIALIZED (
  SELECT s.symbol, s.ts, s.bar_idx::INTEGER AS bar_idx, coalesce(s.open, f.open) AS open, coalesce(s.high, f.high) AS high, coalesce(s.low, f.low) AS low, coalesce(s.close, f.close) AS close,
    CASE WHEN s.bar_idx < s.first_idx THEN f.volume ELSE s.volume END AS volume
  FROM started s JOIN started f ON f.symbol = s.symbol AND f.bar_idx = s.first_idx
)"""
)
W = "PARTITION BY symbol ORDER BY bar_idx"


def r(expression: str, name: str) -> str:
    """A double, rounded as the queries do."""
    return f"floor(({expression}) * 1000000 + 0.5) / 1000000 AS {name}"


def over_bars(select: str, *ctes: str, recursive: bool = False, base: str = ALIGNED) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([base, *ctes])} {select}"


def rows(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def smoothed(name: str, source: str, column: str, weight: str) -> str:
    """An average that starts with the first value."""
    return (
        f"{name} AS MATERIALIZED (SELECT symbol, bar_idx, {column}::DOUBLE AS v FROM {source} WHERE bar_idx = 0 UNION ALL "
        f"SELECT b.symbol, b.bar_idx, b.{column} * ({weight}) + e.v * (1 - ({weight})) FROM {name} e JOIN {source} b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx + 1)"
    )


def summed(name: str, source: str, column: str, window: int) -> str:
    """A sum that keeps 1 - 1 / window of itself."""
    return (
        f"{name} AS MATERIALIZED (SELECT symbol, bar_idx, {column}::DOUBLE AS v FROM {source} WHERE bar_idx = 0 UNION ALL "
        f"SELECT b.symbol, b.bar_idx, b.{column} + e.v * (1 - 1.0::DOUBLE / {window}) FROM {name} e JOIN {source} b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx + 1)"
    )


PRICE_COLUMNS = ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume"))
BAR_ROW = f"symbol, epoch(ts)::BIGINT AS at, {PRICE_COLUMNS}"
CHANGES = f"changes AS MATERIALIZED (SELECT *, greatest(close - coalesce(lag(close) OVER ({W}), close), 0) AS gain, greatest(coalesce(lag(close) OVER ({W}), close) - close, 0) AS loss FROM bars)"
RANGES = (
    f"ranges AS MATERIALIZED (SELECT *, CASE WHEN bar_idx = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) END AS tr, "
    f"coalesce(high - lag(high) OVER ({W}), 0) AS up, coalesce(lag(low) OVER ({W}) - low, 0) AS dn FROM bars)"
)
SMA_SIGNAL = (
    f"means AS (SELECT *, CASE WHEN bar_idx >= 9 THEN avg(close) OVER {rows(10)} END AS fast, CASE WHEN bar_idx >= 29 THEN avg(close) OVER {rows(30)} END AS slow FROM bars), "
    "signals AS MATERIALIZED (SELECT *, CASE WHEN fast > slow THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS signal FROM means)"
)


def held(source: str = "signals", key: str = "symbol", rate: str = "0.0001", fee: str = "0.0002") -> str:
    """Positions, fills and cash of each bar."""
    w = f"(PARTITION BY {key} ORDER BY bar_idx)"
    return (
        f"lagged AS (SELECT *, coalesce(lag(signal) OVER {w}, 0)::DOUBLE AS position, coalesce(lag(signal, 2) OVER {w}, 0)::DOUBLE AS prev_position, lag(close) OVER {w} AS close_before FROM {source}), "
        f"filled_at AS (SELECT *, position - prev_position AS delta, open * (1 + CASE WHEN position - prev_position >= 0 THEN {rate}::DOUBLE ELSE -{rate}::DOUBLE END) AS fill_price FROM lagged), "
        f"held AS MATERIALIZED (SELECT *, CASE WHEN close_before IS NULL THEN 0 ELSE abs(fill_price - open) * abs(delta) END AS slippage_cash, CASE WHEN close_before IS NULL THEN 0 ELSE greatest(abs(fill_price) * abs(delta), 0) * {fee}::DOUBLE END AS commission_cash, "
        "CASE WHEN close_before IS NULL THEN 0 ELSE prev_position * (open - close_before) + position * (close - open) END AS pnl FROM filled_at)"
    )


def equity(keys: str = "", source: str = "held", cash: str = "1000000.0") -> str:
    """Equity by bar; keys: further columns to group by, each with a comma behind."""
    part = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    return (
        f"per_bar AS (SELECT {keys}bar_idx, sum(pnl - slippage_cash - commission_cash) AS gain, sum(abs(delta)) AS turnover FROM {source} GROUP BY {keys}bar_idx), "
        f"path AS (SELECT *, sum(gain) OVER ({part} ORDER BY bar_idx) + {cash} AS path FROM per_bar), "
        f"floored AS (SELECT *, path - least(coalesce(min(CASE WHEN bar_idx > 0 THEN path END) OVER ({part} ORDER BY bar_idx), 0), 0) AS equity FROM path), "
        f"curve AS MATERIALIZED (SELECT *, coalesce((equity - lag(equity) OVER ({part} ORDER BY bar_idx)) / CASE WHEN lag(equity) OVER ({part} ORDER BY bar_idx) > 1 THEN lag(equity) OVER ({part} ORDER BY bar_idx) ELSE 1 END, 0) AS ret FROM floored)"
    )


MARKET = f"market AS MATERIALIZED (SELECT bar_idx, avg(coalesce((close - p) / CASE WHEN p <> 0 THEN p ELSE 1 END, 0)) AS market FROM (SELECT *, lag(close) OVER ({W}) AS p FROM bars) GROUP BY bar_idx)"


def performance(keys: str, curve: str = "curve", periods: float = 6048.0, rf: float = 0.02) -> str:
    """The nine measures, rounded."""
    part = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    return f"""
peaks AS (SELECT *, (equity - max(equity) OVER ({part} ORDER BY bar_idx)) / greatest(max(equity) OVER ({part} ORDER BY bar_idx), 1e-12) AS dd FROM {curve} LEFT JOIN market USING (bar_idx)),
sums AS (
  SELECT {keys}count(*) AS n, avg(ret - {rf / periods!r}::DOUBLE) AS mean, stddev_samp(ret) AS spread,
    stddev_samp(CASE WHEN ret - {rf / periods!r}::DOUBLE < 0 THEN ret - {rf / periods!r}::DOUBLE END) AS down, count(CASE WHEN ret - {rf / periods!r}::DOUBLE < 0 THEN 1 END) AS n_down,
    min(dd) AS max_drawdown, arg_min(equity, bar_idx) AS first_equity, arg_max(equity, bar_idx) AS last_equity,
    count(CASE WHEN bar_idx > 0 AND ret > 0 THEN 1 END) AS wins, count(CASE WHEN bar_idx > 0 AND ret <> 0 THEN 1 END) AS moves, covar_pop(ret, market) AS cov, var_pop(market) AS var
  FROM peaks {group}
), measures AS (
  SELECT {keys}CASE WHEN spread > 1e-12 THEN mean * sqrt({periods}::DOUBLE) / spread ELSE 0 END AS sharpe,
    CASE WHEN n_down >= 2 AND down > 1e-12 THEN mean * sqrt({periods}::DOUBLE) / down ELSE 0 END AS sortino, max_drawdown, last_equity / first_equity - 1 AS total_return,
    pow(last_equity / first_equity, 1 / greatest((n - 1) / {periods}::DOUBLE, 1e-9)) - 1 AS annualized_return, spread * sqrt({periods}::DOUBLE) AS volatility,
    CASE WHEN moves > 0 THEN wins::DOUBLE / moves ELSE 0 END AS win_rate, CASE WHEN var > 1e-12 THEN cov / var ELSE 0 END AS beta
  FROM sums
), scored AS MATERIALIZED (SELECT *, CASE WHEN abs(max_drawdown) > 1e-12 THEN annualized_return / abs(max_drawdown) ELSE 0 END AS calmar FROM measures)"""


MEASURES = ", ".join(r(c, c) for c in ("sharpe", "sortino", "max_drawdown", "total_return", "annualized_return", "volatility", "calmar", "win_rate", "beta"))
