"""Technical indicators as added columns of bars.

Each function takes bars with a counted order (bar_idx within the keys, by default symbol) and names of
input columns, and returns bars with its outputs. Values that a window isn't filled for are null. added() computes
several in one pass over stretches of the series.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import series, so_far
from barloom.operators.scan import in_parts, linear, reach, running, sliding_median, speculative

SYMBOL = ["symbol"]


def _window(keys: list[str], n: int):
    return series(keys).rowsBetween(-(n - 1), 0)


def _full(keys: list[str], n: int, value: Column, *inputs: str) -> Column:
    """value once n rows have been seen; null while the window holds an empty input."""
    have = F.row_number().over(series(keys)) >= n
    for c in inputs:
        have = have & (F.count(c).over(_window(keys, n)) == n)
    return F.when(have, value)


def _positive(**sizes: int) -> None:
    for name, n in sizes.items():
        if n <= 0:
            raise ValueError(f"{name} must be positive")


def sma(bars: DataFrame, window: int, column: str = "close", out: str = "sma", keys: list[str] = SYMBOL) -> DataFrame:
    _positive(window=window)
    return bars.withColumn(out, _full(keys, window, F.avg(column).over(_window(keys, window)), column))


def _smooth(x: Column, r: float, keys: list[str]) -> tuple[Column, float]:
    """The term of a moving average that starts with x itself."""
    first = F.row_number().over(series(keys)) == 1
    return F.when(first, x).otherwise(x * (1 - r)), r


def ema_term(column: str, span: int, keys: list[str] = SYMBOL) -> tuple[Column, float]:
    _positive(span=span)
    return _smooth(F.col(column), 1 - 2 / (span + 1), keys)


def wilder_term(column: str, window: int, keys: list[str] = SYMBOL) -> tuple[Column, float]:
    _positive(window=window)
    return _smooth(F.col(column), 1 - 1 / window, keys)


def ema(bars: DataFrame, span: int, column: str = "close", out: str = "ema", keys: list[str] = SYMBOL) -> DataFrame:
    """Exponential average with weight 2 / (span + 1), from the first value on."""
    return linear(bars, {out: ema_term(column, span, keys)}, keys)


def wilder(bars: DataFrame, window: int, column: str = "close", out: str = "wilder", keys: list[str] = SYMBOL) -> DataFrame:
    """Exponential average with weight 1 / window, from the first value on."""
    return linear(bars, {out: wilder_term(column, window, keys)}, keys)


def rsi(bars: DataFrame, window: int = 14, column: str = "close", out: str = "rsi", keys: list[str] = SYMBOL) -> DataFrame:
    """Relative strength; 0 in the first row, which has no gain."""
    change = F.col(column) - F.coalesce(F.lag(column).over(series(keys)), F.col(column))
    moved = bars.withColumn("_gain", F.greatest(change, F.lit(0.0))).withColumn("_loss", F.greatest(-change, F.lit(0.0)))
    smooth = linear(moved, {"_up": wilder_term("_gain", window, keys), "_down": wilder_term("_loss", window, keys)}, keys)
    return smooth.withColumn(out, 100 - 100 / (1 + F.col("_up") / (F.col("_down") + 1e-12))).drop("_gain", "_loss", "_up", "_down")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close", keys: list[str] = SYMBOL) -> DataFrame:
    """macd, macd_signal, macd_hist."""
    both = linear(bars, {"_fast": ema_term(column, fast, keys), "_slow": ema_term(column, slow, keys)}, keys)
    line = both.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return ema(line, signal, "macd", "macd_signal", keys).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def true_range(keys: list[str] = SYMBOL) -> Column:
    before = F.coalesce(F.lag("close").over(series(keys)), F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(bars: DataFrame, window: int = 14, out: str = "atr", keys: list[str] = SYMBOL) -> DataFrame:
    """Exponential average (weight 2 / (window + 1)) of the true range."""
    ranged = bars.withColumn("_tr", F.when(F.row_number().over(series(keys)) == 1, F.col("high") - F.col("low")).otherwise(true_range(keys)))
    return ema(ranged, window, "_tr", out, keys).drop("_tr")


def adx(bars: DataFrame, window: int = 14, keys: list[str] = SYMBOL) -> DataFrame:
    """adx, plus_di, minus_di: directional movement, from the second row on; 0 in the first."""
    _positive(window=window)
    w = series(keys)
    first = F.row_number().over(w) == 1
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    moves = {
        "_pdm": F.when(first, 0.0).when((up > down) & (up > 0), up).otherwise(0.0),
        "_mdm": F.when(first, 0.0).when((down > up) & (down > 0), down).otherwise(0.0),
        "_tr": F.when(first, 0.0).otherwise(true_range(keys)),
    }
    rows = bars
    for name, value in moves.items():
        rows = rows.withColumn(name, value)
    r = 1 - 1 / window
    sums = linear(rows, {f"{c}_sum": (F.col(c), r) for c in moves}, keys)
    share = lambda c: F.when(F.col("_tr_sum") > 0, F.col(c) * 100 / F.when(F.col("_tr_sum") > 0, F.col("_tr_sum"))).otherwise(0.0)
    di = sums.withColumn("plus_di", share("_pdm_sum")).withColumn("minus_di", share("_mdm_sum"))
    total = F.col("plus_di") + F.col("minus_di")
    di = di.withColumn("_dx", F.when(total > 0, F.abs(F.col("plus_di") - F.col("minus_di")) * 100 / F.when(total > 0, total)).otherwise(0.0))
    nth = F.row_number().over(w)
    term = F.when(nth == 1, 0.0).when(nth == 2, F.col("_dx")).otherwise(F.col("_dx") / window)
    return linear(di, {"adx": (term, r)}, keys).drop("_dx", *moves, *[f"{c}_sum" for c in moves])


def bollinger(bars: DataFrame, period: int = 20, width: float = 2.0, column: str = "close", keys: list[str] = SYMBOL) -> DataFrame:
    """bb_upper, bb_middle, bb_lower, by the population deviation."""
    _positive(period=period)
    w = _window(keys, period)
    mean, spread = F.avg(column).over(w), F.stddev_pop(column).over(w)
    return bars.withColumns({n: _full(keys, period, v, column) for n, v in (("bb_upper", mean + spread * width), ("bb_middle", mean), ("bb_lower", mean - spread * width))})


def stochastic(bars: DataFrame, k_period: int = 14, d_period: int = 3, keys: list[str] = SYMBOL) -> DataFrame:
    """stoch_k (50 until its window is full) and stoch_d, its average."""
    _positive(k_period=k_period, d_period=d_period)
    w = _window(keys, k_period)
    top, bottom = F.max("high").over(w), F.min("low").over(w)
    spread = F.when(top - bottom != 0, top - bottom).otherwise(1.0)
    k = F.coalesce(_full(keys, k_period, (F.col("close") - bottom) * 100 / spread), F.lit(50.0))
    return sma(bars.withColumn("stoch_k", k), d_period, "stoch_k", "stoch_d", keys)


def donchian(bars: DataFrame, period: int = 20, keys: list[str] = SYMBOL) -> DataFrame:
    """donchian_upper, donchian_lower."""
    _positive(period=period)
    w = _window(keys, period)
    return bars.withColumn("donchian_upper", _full(keys, period, F.max("high").over(w))).withColumn("donchian_lower", _full(keys, period, F.min("low").over(w)))


def cci(bars: DataFrame, period: int = 14, out: str = "cci", keys: list[str] = SYMBOL) -> DataFrame:
    """Typical price's distance from its average in mean absolute deviations of the window, over 0.015."""
    _positive(period=period)
    w = _window(keys, period)
    typical = bars.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    held = typical.withColumn("_mean", F.avg("_tp").over(w))
    if period <= SORTED:  # earlier values by name: no array is made for a row
        earlier = [F.lag("_tp", k).over(series(keys)) for k in range(period)]
        deviation = sum((F.abs(x - F.col("_mean")) for x in reversed(earlier)), F.lit(0.0)) / period
    else:
        held = held.withColumn("_held", F.collect_list("_tp").over(w))
        deviation = F.aggregate(F.transform("_held", lambda x: F.abs(x - F.col("_mean"))), F.lit(0.0), lambda a, x: a + x) / period
    value = (F.col("_tp") - F.col("_mean")) / (0.015 * F.when(deviation > 0, deviation).otherwise(1e-12))
    return held.withColumn(out, _full(keys, period, value)).drop("_tp", "_mean", "_held")


#: Rows of a window up to which each frame is sorted anew.
SORTED = 100


def rolling_median(bars: DataFrame, window: int, column: str = "close", out: str = "median", keys: list[str] = SYMBOL) -> DataFrame:
    """Median of the last `window` values; the value itself for windows of one or less. Windows of more than SORTED rows slide over values kept in order."""
    if window <= 1:
        return bars.withColumn(out, F.col(column))
    if window > SORTED:
        held = sliding_median(bars, keys, "bar_idx", column, window, "_slid")
        return held.withColumn(out, _full(keys, window, F.col("_slid"))).drop("_slid")
    return bars.withColumn(out, _full(keys, window, F.percentile(column, F.lit(0.5)).over(_window(keys, window))))


def atr_ratio(bars: DataFrame, window: int = 100, column: str = "atr", out: str = "atr_ratio", keys: list[str] = SYMBOL) -> DataFrame:
    """column over its rolling median; 1 where that is empty or not positive."""
    rows = rolling_median(bars, window, column, "_median", keys)
    return rows.withColumn(out, F.when(F.col("_median") > 0, F.col(column) / F.when(F.col("_median") > 0, F.col("_median"))).otherwise(1.0)).drop("_median")


def shift(column: str, periods: int, fill: float = 0.0, keys: list[str] = SYMBOL) -> Column:
    return F.lag(column, periods, fill).over(series(keys)) if periods > 0 else F.col(column)


def last_nonzero(column: str, keys: list[str] = SYMBOL) -> Column:
    """The last value other than 0 so far; 0 before any."""
    return F.coalesce(F.last(F.when(F.col(column) != 0, F.col(column)), ignorenulls=True).over(so_far(keys)), F.lit(0.0))


def drawdown(column: str, keys: list[str], order: str = "bar_idx") -> Column:
    """Share below the highest value so far."""
    peak = F.max(column).over(so_far(keys, order))
    return (F.col(column) - peak) / F.greatest(peak, F.lit(1e-12))


def drawdowns(rows: DataFrame, wanted: dict[str, str], keys: list[str] = SYMBOL) -> DataFrame:
    """rows with, for each name: column, drawdown() of it, of series of any length."""
    peaks = running(rows, keys, {f"_peak_{n}": ("max", F.col(c)) for n, c in wanted.items()})
    shares = {n: (F.col(c) - F.col(f"_peak_{n}")) / F.greatest(F.col(f"_peak_{n}"), F.lit(1e-12)) for n, c in wanted.items()}
    return peaks.withColumns(shares).drop(*[f"_peak_{n}" for n in wanted])


def last_values(rows: DataFrame, wanted: dict[str, str], keys: list[str] = SYMBOL) -> DataFrame:
    """rows with, for each name: column, last_nonzero() of it, of series of any length."""
    held = running(rows, keys, {n: ("last", F.when(F.col(c) != 0, F.col(c))) for n, c in wanted.items()})
    return held.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in wanted})


def simple_return(column: str = "close", keys: list[str] = SYMBOL) -> Column:
    before = F.lag(column).over(series(keys))
    return F.when(before.isNotNull(), (F.col(column) - before) / F.when(before != 0, before).otherwise(1.0)).otherwise(0.0)


def log_return(column: str = "close", keys: list[str] = SYMBOL) -> Column:
    before = F.lag(column).over(series(keys))
    return F.when((before > 0) & (F.col(column) > 0), F.ln(column) - F.ln(before)).otherwise(0.0)


def _next_sar(state: tuple | None, row: tuple, step: float, maximum: float) -> tuple[tuple | None, float]:
    """(state, level) after a bar; the state is direction, speed, extreme and level."""
    high, low, close, following, l1, l2, h1, h2 = row
    if state is None:
        if following is None:
            return (True, 0.0, 0.0, 0.0), 0.0
        up = following > close
        level = low if up else high
        return (up, step, high if up else low, level), level
    up, speed, extreme, level = state
    level += speed * (extreme - level)
    if up:
        level = min(x for x in (level, l1, l2) if x is not None)
        if level > low:
            return (False, step, low, extreme), extreme
        if high > extreme:
            extreme, speed = high, min(speed + step, maximum)
    else:
        level = max(x for x in (level, h1, h2) if x is not None)
        if level < high:
            return (True, step, high, extreme), extreme
        if low < extreme:
            extreme, speed = low, min(speed + step, maximum)
    return (up, speed, extreme, level), level


def parabolic_sars(bars: DataFrame, paces: dict[str, tuple[float, float]], keys: list[str] = SYMBOL) -> DataFrame:
    """Stop-and-reverse levels for each name, step and largest step of paces, in one pass; 0 for a series of one row.

    The level moves towards the extreme of the present direction, never past the last two bars; where price
    crosses it, the direction turns and the level starts at the extreme. Long series are worked through in stretches (see scan.speculative).
    """
    before = ["_next", "_l1", "_l2", "_h1", "_h2"]

    def lagged(part: DataFrame, own: list[str]) -> DataFrame:
        w = series(own)  # the next close counts at a series' first row alone
        return part.withColumns(dict(zip(before, (F.lead("close").over(w), F.lag("low", 1).over(w), F.lag("low", 2).over(w), F.lag("high", 1).over(w), F.lag("high", 2).over(w)), strict=True)))

    steps = list(paces.values())

    def move(states, row):
        moved = [_next_sar(s, row, step, maximum) for s, (step, maximum) in zip(states, steps, strict=True)]
        return [m[0] for m in moved], tuple(m[1] for m in moved)

    added = ", ".join(f"{name} double" for name in paces)
    return speculative(in_parts(bars, 2, lagged, keys), keys, "bar_idx", ["high", "low", "close", *before], lambda: [None] * len(steps), move, added).drop(*before)


def parabolic_sar(bars: DataFrame, step: float = 0.02, maximum: float = 0.2, out: str = "sar", keys: list[str] = SYMBOL) -> DataFrame:
    return parabolic_sars(bars, {out: (step, maximum)}, keys)


class Registry:
    """Functions by name and semantic version; without a version, the highest."""

    def __init__(self) -> None:
        self._found: dict[str, dict[tuple[int, int, int], Callable]] = {}

    def register(self, name: str, function: Callable, version: str = "1.0.0") -> None:
        if not re.fullmatch(r"\d+\.\d+\.\d+", version):
            raise ValueError(f"not a semantic version: {version}")
        self._found.setdefault(name.lower(), {})[tuple(map(int, version.split(".")))] = function

    def get(self, name: str, version: str | None = None) -> Callable:
        versions = self._found.get(name.lower())
        if not versions:
            raise KeyError(name)
        key = max(versions) if version is None else tuple(map(int, version.split(".")))
        if key not in versions:
            raise KeyError(f"{name}@{version}")
        return versions[key]

    def names(self) -> list[str]:
        return sorted(self._found)

    def versions(self, name: str) -> list[str]:
        return [".".join(map(str, v)) for v in sorted(self._found.get(name.lower(), {}))]


REGISTRY = Registry()
for _function in (sma, ema, rsi, macd, atr, parabolic_sar, adx, bollinger, stochastic, donchian, cci):
    REGISTRY.register(_function.__name__, _function)


def _fades(span: float) -> int:
    return reach(1 - 2 / (span + 1))


#: Rows before a row that an indicator's value depends on, by its arguments.
MEMORY: dict[str, Callable[..., int]] = {
    "sma": lambda window, **_: window,
    "ema": lambda span, **_: _fades(span),
    "wilder": lambda window, **_: reach(1 - 1 / window),
    "rsi": lambda window=14, **_: reach(1 - 1 / window) + 1,
    "macd": lambda fast=12, slow=26, signal=9, **_: max(_fades(fast), _fades(slow)) + _fades(signal),
    "atr": lambda window=14, **_: _fades(window) + 1,
    "adx": lambda window=14, **_: 2 * reach(1 - 1 / window) + 2,
    "bollinger": lambda period=20, **_: period,
    "stochastic": lambda k_period=14, d_period=3, **_: k_period + d_period,
    "donchian": lambda period=20, **_: period,
    "cci": lambda period=14, **_: period,
    "rolling_median": lambda window, **_: window,
    "atr_ratio": lambda window=100, **_: window,
}


def added(bars: DataFrame, wanted: list[tuple[str, dict]], keys: list[str] = SYMBOL, rows: int | None = None) -> DataFrame:
    """bars with the outputs of indicators (name, arguments), in order, so that later ones may use earlier ones' columns.

    Series are cut into stretches of `rows` rows, each with the rows before it that the indicators depend on: a long
    history of one symbol is many tasks, and all indicators share one exchange. Prices hold no nulls (see bars.align).
    """

    def work(part: DataFrame, own: list[str]) -> DataFrame:
        for name, arguments in wanted:
            part = globals()[name](part, keys=own, **arguments)
        return part

    return in_parts(bars, sum(MEMORY[name](**arguments) for name, arguments in wanted), work, keys, rows=rows)
