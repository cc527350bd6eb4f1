"""Indicators and strategies as table functions of Spark SQL, and views of a run.

    SELECT symbol, bar_idx, signal FROM sma_cross(TABLE(bars) PARTITION BY symbol ORDER BY (bar_idx), 10, 30)

Each takes a table with symbol, bar_idx and close, in partitions of one series in order of bars, and its parameters. Rows stream through a step that
holds a window or an average, so a series may be longer than memory; it is one task. DataFrame functions of operators.indicators cut long series.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from barloom.plans.backtest import Report

#: A step: from a close to the values of a row.
Step = Callable[[float], tuple]


def mean_of(window: int) -> Callable[[float], float | None]:
    """The mean of the last `window` values, None before."""
    held: deque = deque(maxlen=_positive(window))

    def step(x: float) -> float | None:
        held.append(x)
        total = 0.0
        for v in held:  # in order, as a window of rows adds up
            total += v
        return total / window if len(held) == window else None

    return step


def average_of(weight: float) -> Callable[[float], float]:
    """The exponential average that starts with the first value."""
    value: float | None = None

    def step(x: float) -> float:
        nonlocal value
        value = x if value is None else value * (1 - weight) + x * weight
        return value

    return step


def strength_of(window: int) -> Callable[[float], float]:
    up, down, last = average_of(1 / _positive(window)), average_of(1 / window), None

    def step(x: float) -> float:
        nonlocal last
        change = 0.0 if last is None else x - last
        last = x
        return 100 - 100 / (1 + up(max(change, 0.0)) / (down(max(-change, 0.0)) + 1e-12))

    return step


def _positive(n: int) -> int:
    if n <= 0:
        raise ValueError("windows must be positive")
    return n


def _one(make: Callable) -> Callable[..., Step]:
    def begin(*args) -> Step:
        step = make(*args)
        return lambda x: (step(x),)

    return begin


def _macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Step:
    quick, calm, smooth = (average_of(2 / (_positive(n) + 1)) for n in (fast, slow, signal))

    def step(x: float) -> tuple:
        line = quick(x) - calm(x)
        mean = smooth(line)
        return line, mean, line - mean

    return step


def _sma_cross(fast: int, slow: int) -> Step:
    if fast >= slow:
        raise ValueError("fast must be below slow")
    quick, calm = mean_of(fast), mean_of(slow)

    def step(x: float) -> tuple:
        a, b = quick(x), calm(x)
        return (1.0 if a is not None and b is not None and a > b else -1.0,)

    return step


def _rsi_mean_reversion(window: int, lower: float, upper: float) -> Step:
    strength = strength_of(window)

    def step(x: float) -> tuple:
        value = strength(x)
        return (1.0 if value < lower else -1.0 if value > upper else 0.0,)

    return step


#: By name: what begins a series, from the parameters, and the columns of its values.
FUNCTIONS: dict[str, tuple[Callable[..., Step], str]] = {
    "sma": (_one(mean_of), "sma double"),
    "ema": (_one(lambda span: average_of(2 / (_positive(span) + 1))), "ema double"),
    "wilder": (_one(lambda window: average_of(1 / _positive(window))), "wilder double"),
    "rsi": (_one(lambda window=14: strength_of(window)), "rsi double"),
    "macd": (_macd, "macd double, macd_signal double, macd_hist double"),
    "sma_cross": (_sma_cross, "signal double"),
    "rsi_mean_reversion": (_rsi_mean_reversion, "signal double"),
}


def _table_function(begin: Callable[..., Step]):
    """A class that Spark makes for each partition of the table, one series."""

    class Stepped:
        def __init__(self):
            self.step: Step | None = None

        def eval(self, row, *args):
            if self.step is None:
                self.step = begin(*(float(a) if not isinstance(a, int | float) else a for a in args))
            yield row["symbol"], row["bar_idx"], *self.step(row["close"])

    return Stepped


def register(spark: SparkSession) -> None:
    """FUNCTIONS as table functions of the session, by their names."""
    for name, (begin, columns) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(_table_function(begin), returnType=f"symbol string, bar_idx int, {columns}"))


def views(run: Report, prefix: str = "") -> list[str]:
    """Temporary views bars, signals, equity, trades and risk_events of a run; their names."""
    frames = {"bars": run.bars, "signals": run.signals, "equity": run.equity, "trades": run.trades, "risk_events": run.risk_events}
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in frames]
