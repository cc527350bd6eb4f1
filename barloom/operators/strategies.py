"""Strategies: signals in [-1, 1] from aligned bars, for one or many sets of parameters in one job.

A strategy's signals() takes bars and a list of parameter sets and returns rows (combo_id, symbol, ts, bar_idx,
and prices, signal); combo_id is the place in the list. Indicators that several sets share are computed once.
"""

from __future__ import annotations

import random
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import clipped, series, truth
from barloom.operators import indicators
from barloom.operators.scan import in_parts

KEEP = ["symbol", "ts", "bar_idx", "open", "high", "low", "close", "volume"]


@dataclass(frozen=True)
class Axis:
    """The values one parameter may take: int or float from low to high by step, or choices."""

    kind: str
    low: float = 0.0
    high: float = 0.0
    step: float = 1.0
    choices: tuple = ()

    def values(self) -> list:
        if self.kind == "choice":
            return list(self.choices)
        if self.step <= 0 or self.high < self.low:
            raise ValueError(f"bad axis: {self}")
        if self.kind == "int":
            return list(range(int(self.low), int(self.high) + 1, int(self.step)))
        n = int((self.high - self.low + self.step / 2) / self.step)
        return [self.low + k * self.step for k in range(n + 1) if self.low + k * self.step < self.high + self.step / 2]

    def draw(self, rng: random.Random):
        if self.kind == "choice":
            return rng.choice(self.choices)
        if self.kind == "int":
            return rng.randrange(int(self.low), int(self.high) + 1, int(self.step))
        return rng.uniform(self.low, self.high)


class Strategy(ABC):
    name = ""
    axes: dict[str, Axis] = {}
    defaults: dict = {}

    def begin(self, config) -> None:
        """Called once before a run, with its configuration."""

    @abstractmethod
    def signals(self, bars: DataFrame, sets: list[dict]) -> DataFrame: ...

    def check(self, params: dict) -> None:
        """Raises ValueError where params can't be used."""

    def usable(self, sets: list[dict]) -> list[dict]:
        """The sets that check() accepts, completed by defaults."""
        out = []
        for params in sets:
            try:
                self.check(self.defaults | params)
            except ValueError:
                continue
            out.append(self.defaults | params)
        return out


STRATEGIES: dict[str, type[Strategy]] = {}


def registered(cls: type[Strategy]) -> type[Strategy]:
    STRATEGIES[cls.name.lower()] = cls
    return cls


def strategy(name: str) -> Strategy:
    """The registered strategy of that name, in any case; KeyError without one."""
    return STRATEGIES[name.strip().lower()]()


def _per_set(rows: DataFrame, sets: list[dict], signal) -> DataFrame:
    """A row of rows for each set; signal(set as a column of structs) gives its signal."""
    names = list(sets[0])
    given = F.array(*[F.struct(F.lit(k).cast("long").alias("combo_id"), *[F.lit(s[n]).alias(n) for n in names]) for k, s in enumerate(sets)])
    each = rows.withColumn("_set", F.explode(given))
    return each.select(F.col("_set.combo_id").alias("combo_id"), *KEEP, signal(F.col("_set")).cast("double").alias("signal"))


@registered
class SmaCross(Strategy):
    """Long while the fast average is above the slow one, else short; also while they aren't filled yet."""

    name = "sma_cross"
    axes = {"fast": Axis("int", 5, 30, 1), "slow": Axis("int", 20, 120, 5)}
    defaults = {"fast": 10, "slow": 30}

    def check(self, params):
        if params["fast"] <= 0 or params["slow"] <= 0 or params["fast"] >= params["slow"]:
            raise ValueError("0 < fast < slow is needed")

    def signals(self, bars, sets):
        for s in sets:
            self.check(s)
        windows = sorted({int(s[k]) for s in sets for k in ("fast", "slow")})
        rows = indicators.added(bars.select(*KEEP), [("sma", {"window": w, "out": f"_sma{w}"}) for w in windows])
        means = F.create_map(*[x for w in windows for x in (F.lit(w), F.col(f"_sma{w}"))])
        return _per_set(rows, [{"fast": int(s["fast"]), "slow": int(s["slow"])} for s in sets], lambda s: F.when(means[s["fast"]] > means[s["slow"]], 1.0).otherwise(-1.0))


@registered
class RsiMeanReversion(Strategy):
    """Long below `lower`, short above `upper`, else out."""

    name = "rsi_mean_reversion"
    axes = {"window": Axis("int", 6, 30, 1), "lower": Axis("float", 10, 40, 5), "upper": Axis("float", 60, 90, 5)}
    defaults = {"window": 14, "lower": 30.0, "upper": 70.0}

    def check(self, params):
        if params["window"] <= 0 or params["lower"] >= params["upper"]:
            raise ValueError("window > 0 and lower < upper are needed")

    def signals(self, bars, sets):
        for s in sets:
            self.check(s)
        windows = sorted({int(s["window"]) for s in sets})
        rows = indicators.added(bars.select(*KEEP), [("rsi", {"window": w, "out": f"_rsi{w}"}) for w in windows])
        values = F.create_map(*[x for w in windows for x in (F.lit(w), F.col(f"_rsi{w}"))])
        given = [{"window": int(s["window"]), "lower": float(s["lower"]), "upper": float(s["upper"])} for s in sets]
        return _per_set(rows, given, lambda s: F.when(values[s["window"]] < s["lower"], 1.0).when(values[s["window"]] > s["upper"], -1.0).otherwise(0.0))


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: What both assistants share: parameters, their defaults and axes (fixed names and values).
ASSIST_DEFAULTS = {
    "enable_adaptive_step": 1, "require_adx_slope": 1, "atr_period": 14, "atr_ratio_window": 100, "atr_ratio_low": 0.70, "atr_ratio_high": 1.50, "psar_step_low": 0.015, "psar_step_mid": 0.025, "psar_step_high": 0.040, "psar_max": 0.20,
    "adx_period": 14, "adx_threshold": 20.0, "ma_fast": 20, "ma_slow": 50, "rsi_period": 14, "rsi_upper": 75.0, "rsi_lower": 25.0, "body_atr_mult": 2.5,
}
SWITCH = Axis("choice", choices=(0, 1))
ASSIST_AXES = {
    "enable_adaptive_step": SWITCH, "require_adx_slope": SWITCH, "atr_period": Axis("int", 10, 20, 2), "atr_ratio_window": Axis("int", 50, 150, 25), "atr_ratio_low": Axis("float", 0.5, 0.9, 0.1), "atr_ratio_high": Axis("float", 1.2, 2.0, 0.1),
    "psar_step_low": Axis("float", 0.010, 0.020, 0.005), "psar_step_mid": Axis("float", 0.020, 0.035, 0.005), "psar_step_high": Axis("float", 0.035, 0.050, 0.005), "psar_max": Axis("float", 0.15, 0.25, 0.05), "adx_period": Axis("int", 10, 20, 2),
    "adx_threshold": Axis("float", 15, 25, 2.5), "ma_fast": Axis("int", 10, 30, 5), "ma_slow": Axis("int", 30, 90, 10), "rsi_period": Axis("int", 10, 20, 2), "rsi_upper": Axis("float", 70, 85, 5), "rsi_lower": Axis("float", 15, 35, 5),
    "body_atr_mult": Axis("float", 2.0, 3.5, 0.5),
}


#: The columns of indicators that add more than one.
SEVERAL = {"adx": ["adx", "plus_di", "minus_di"], "macd": ["macd", "macd_signal", "macd_hist"], "donchian": ["donchian_upper", "donchian_lower"]}
#: Series of the bars of one set of parameters.
OF_SET = ["combo_id", "symbol"]


def before(column: str, k: int = 1) -> Column:
    """The value k bars ago."""
    return F.lag(column, k).over(series(OF_SET))


def _on(switch: str, test: Column) -> Column:
    """test, where the set's switch is on."""
    return (F.col(f"_p.{switch}") == 0) | test


class Assist(Strategy):
    """What the two parabolic-stop assistants share: their indicators and the gates for a turn.

    Each distinct indicator that a batch of sets needs is computed once from the bars; then every set takes its own of
    them, and its gates are columns of its parameters, so a batch is one plan.
    """

    def periods(self, p: dict) -> list[int]:
        return [p["atr_ratio_window"], p["ma_slow"], p["atr_period"], p["adx_period"], p["rsi_period"]]

    def warm_up(self, p: dict) -> int:
        return max(self.periods(p)) + 10

    def signals(self, bars, sets):
        given = [self.resolved(s) for s in sets]
        return self.decided(self.per_set(bars.select(*KEEP), given), given).select("combo_id", *KEEP, "signal")

    def resolved(self, params: dict) -> dict:
        """params completed by defaults; switches (enable_, require_) may be given as words such as yes and off."""
        given = self.defaults | params
        return given | {k: int(truth(v, bool(self.defaults[k]))) for k, v in given.items() if k.startswith(("enable_", "require_")) and k in self.defaults}

    def needed(self, p: dict) -> dict[str, list[tuple[str, dict]]]:
        """For each column of a set, the indicators that it is made by, their last one's output named as the column."""
        atr = ("atr", {"window": int(p["atr_period"])})
        return {
            "atr": [atr],
            "atr_ratio": [atr, ("atr_ratio", {"window": int(p["atr_ratio_window"])})],
            "rsi": [("rsi", {"window": int(p["rsi_period"])})],
            **{c: [("adx", {"window": int(p["adx_period"])})] for c in ("adx", "plus_di", "minus_di")},
            **{f"ma_{which}": [("ema", {"span": int(p[f"ma_{which}"])})] for which in ("fast", "slow")},
        }

    def per_set(self, bars: DataFrame, given: list[dict]) -> DataFrame:
        """A row of bars for each set, with combo_id, its parameters _p and the columns of needed() and stop levels."""
        names: dict[str, tuple[list, str]] = {}  # the column of each distinct way to make one
        paces: dict[tuple[float, float], str] = {}
        chosen: list[dict[str, str]] = []
        for p in given:
            own = {c: f"_{c}_" + "_".join(f"{v}" for _, arguments in steps for v in arguments.values()) for c, steps in self.needed(p).items()}
            names |= {own[c]: (steps, c) for c, steps in self.needed(p).items()}
            for pace in ("low", "mid", "high"):
                found = paces.setdefault((float(p[f"psar_step_{pace}"]), float(p["psar_max"])), f"_sar{len(paces)}")
                own[f"sar_{pace}"] = found
            chosen.append(own)

        def work(rows: DataFrame, keys: list[str]) -> DataFrame:
            for name, (steps, c) in names.items():
                if name in rows.columns:
                    continue
                for step, arguments in steps:
                    rows = getattr(indicators, step)(rows, keys=keys, **arguments)
                suffix = name.removeprefix(f"_{c}")
                rows = rows.withColumnsRenamed({x: name if x in ("ema", "sma") else f"_{x}{suffix}" for x in SEVERAL.get(steps[-1][0], [steps[-1][0]])}).drop(*[s for s, _ in steps[:-1]])
            return rows

        halo = max(sum(indicators.MEMORY[step](**arguments) for step, arguments in steps) for steps, _ in names.values())
        rows = indicators.parabolic_sars(in_parts(bars, halo, work, ["symbol"]), {name: pace for pace, name in paces.items()})
        sets, every = [], sorted({c for own in chosen for c in own})  # a set has null where only others need a column
        for k, (p, own) in enumerate(zip(given, chosen, strict=True)):
            numbers = {n: F.lit(float(v)) for n, v in p.items() if not isinstance(v, str)} | {"warm": F.lit(float(self.warm_up(p)))}
            sets.append(F.struct(F.lit(k).cast("long").alias("combo_id"), F.struct(*[v.alias(n) for n, v in sorted(numbers.items())]).alias("p"), F.struct(*[(F.col(own[c]) if c in own else F.lit(None)).cast("double").alias(c) for c in every]).alias("own")))
        each = rows.select(*KEEP, F.explode(F.array(*sets)).alias("_set"))
        return each.select("_set.combo_id", *KEEP, F.col("_set.p").alias("_p"), "_set.own.*")

    def decided(self, rows: DataFrame, given: list[dict]) -> DataFrame:
        raise NotImplementedError

    @staticmethod
    def chosen(level) -> Column:
        """level(pace) by the volatility of the bar: slow where it is low, fast where it is high."""
        adaptive = F.when(F.col("atr_ratio") < F.col("_p.atr_ratio_low"), level("low")).when(F.col("atr_ratio") > F.col("_p.atr_ratio_high"), level("high")).otherwise(level("mid"))
        return F.when(F.col("_p.enable_adaptive_step") == 0, level("mid")).otherwise(adaptive)

    @staticmethod
    def gates(up: bool) -> Column:
        """Whether the bar before lets a turn pass; ADX, RSI, candle body and averages, as far as they are on."""
        strong = before("plus_di") > before("minus_di") if up else before("minus_di") > before("plus_di")
        above = (before("close") > before("ma_fast")) & (before("ma_fast") >= before("ma_slow"))
        below = (before("close") < before("ma_fast")) & (before("ma_fast") <= before("ma_slow"))
        return (
            _on("enable_adx", (before("adx") >= F.col("_p.adx_threshold")) & strong & _on("require_adx_slope", before("adx") > before("adx", 2)))
            & _on("enable_rsi", (before("rsi") > F.col("_p.rsi_lower")) & (before("rsi") < F.col("_p.rsi_upper")))
            & _on("enable_body", (before("atr") > 0) & (F.abs(before("close") - before("open")) <= before("atr") * F.col("_p.body_atr_mult")))
            & _on("enable_ma", above if up else below)
        )

    @staticmethod
    def turn(sar_1: Column, sar_2: Column, up: bool) -> Column:
        """Whether price crossed the stop level between the two bars before."""
        close_1, close_2 = before("close", 1), before("close", 2)
        return (sar_2 >= close_2) & (sar_1 < close_1) if up else (sar_2 <= close_2) & (sar_1 > close_1)


@registered
class PsarAssistV3(Assist):
    """Turns of the parabolic stop that the gates let pass, held until the next one."""

    name = "psar_trade_assist_v3"
    defaults = {"enable_adx": 1, "enable_rsi": 1, "enable_ma": 1, "enable_body": 1, **ASSIST_DEFAULTS}
    axes = {**{k: SWITCH for k in ("enable_adx", "enable_rsi", "enable_ma", "enable_body")}, **ASSIST_AXES}

    def decided(self, rows, given):
        # both earlier levels are those of the pace that the present bar's volatility chooses
        sar_1, sar_2 = (self.chosen(lambda pace, k=k: before(f"sar_{pace}", k)) for k in (1, 2))
        warm = F.col("bar_idx") >= F.col("_p.warm")
        passed = [F.coalesce(self.turn(sar_1, sar_2, up) & self.gates(up), F.lit(False)) & warm for up in (True, False)]
        rows = rows.withColumn("_turn", F.when(passed[0], 1.0).when(passed[1], -1.0).otherwise(0.0))
        return rows.withColumn("signal", indicators.last_nonzero("_turn", OF_SET))


def combined(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """The mean of several strategies' signals by weight, clipped; weights that sum to nothing count as 1."""
    total = sum(w for _, w in parts)
    total = total if abs(total) > 1e-12 else 1.0
    every = _united([s.where("combo_id = 0").withColumn("_weighted", F.col("signal") * w) for s, w in parts])
    prices = [F.first(c).alias(c) for c in KEEP if c not in ("symbol", "bar_idx")]
    out = every.groupBy("symbol", "bar_idx").agg(*prices, clipped(F.sum("_weighted") / total).alias("signal"))
    return out.select(F.lit(0).cast("long").alias("combo_id"), *KEEP, "signal")
