"""The parabolic-stop assistant with risk management: stops, targets, trailing, partial exits, add-ons.

Which turns may be entered, and their first stop and targets, depends on bars alone and is found by window
functions. What depends on the open trade, its exits, is a small step over the bars in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import series
from barloom.operators.scan import speculative
from barloom.operators.strategies import ASSIST_AXES, ASSIST_DEFAULTS, KEEP, OF_SET, SWITCH, Assist, Axis, _on, before, registered

#: Which gates a framework turns on, and what a way of managing risk does (fixed values).
FRAMEWORKS = {"F1": {}, "F2": {"enable_adx": 1}, "F3": {"enable_ma": 1}, "F4": {"enable_adx": 1, "enable_rsi": 1}, "F5": {"enable_ma": 1, "enable_body": 1}}
_CAUTIOUS = {"enable_atr_sl": 1, "enable_trailing_psar": 1, "enable_tp": 1}
_USUAL = {**_CAUTIOUS, "enable_structure_sl": 1, "enable_partial_close": 1, "enable_breakeven": 1}
RISK_MODES = {"baseline": {}, "conservative": _CAUTIOUS, "standard": _USUAL, "aggressive": {**_USUAL, "enable_addon": 1, "enable_time_stop": 1, "entry_size": 0.6}}
#: Hours (UTC) of the session that may be left out.
ASIA = (0, 8)


@dataclass
class Trade:
    """An open trade."""

    size: float  # with sign
    entry: float
    stop: float  # 0: none
    first_stop: float
    target_1: float
    target_2: float
    best: float
    bars: int = 0
    partly: bool = False
    safe: bool = False
    added: bool = False

    @property
    def way(self) -> float:
        return 1.0 if self.size > 0 else -1.0

    def reached(self, price: float, level: float) -> bool:
        """Whether price is at or beyond level on the good side."""
        return level != 0 and self.way * (price - level) >= 0

    def tighten(self, level: float) -> None:
        if self.stop == 0 or self.way * (level - self.stop) > 0:
            self.stop = level


def manage(t: Trade, bar: dict, p: dict) -> Trade | None:
    """The trade after a bar: stop, second target, first target, trailing, break-even, time, add-on; None if closed."""
    t.bars += 1
    good, bad = (bar["high"], bar["low"]) if t.way > 0 else (bar["low"], bar["high"])
    t.best = max(t.best, good) if t.way > 0 else min(t.best, good)
    if p["guarded"] and t.stop != 0 and t.way * (bad - t.stop) <= 0:
        return None
    if p["enable_tp"] and t.reached(good, t.target_2):
        return None
    if p["enable_partial_close"] and p["enable_tp"] and not t.partly and t.reached(good, t.target_1):
        t.partly = True
        if abs(t.size * (1 - p["partial_ratio"])) < 0.01:
            return None
        t.size *= 1 - p["partial_ratio"]
    close, sar, atr = bar["close"], bar["sar"], bar["atr"]
    if p["enable_trailing_psar"] and sar > 0 and t.way * (close - sar) > 0:
        t.tighten(sar)
    if p["enable_trailing_atr"] and atr > 0:
        t.tighten(t.best - t.way * p["trailing_atr_mult"] * atr)
    risk = abs(t.entry - t.first_stop)
    if p["enable_breakeven"] and not t.safe and t.entry > 0 and t.first_stop != 0 and risk > 0 and t.way * (close - t.entry) >= p["be_trigger_r"] * risk:
        level = t.entry + t.way * p["be_buffer_r"] * risk
        t.stop = max(t.stop, level) if t.way > 0 else min(t.stop, level)
        t.safe = True
    if p["enable_time_stop"] and t.bars >= p["time_stop_bars"]:
        unit = risk if t.first_stop != 0 else atr
        if unit > 0 and t.way * (close - t.entry) / unit < p["no_progress_r"]:
            return None
    if p["enable_addon"] and not t.added and t.partly and t.way * (close - bar["ma_fast"]) > 0 and t.way * (t.target_1 - close) > 0:
        t.added = True
        t.size = t.way * min(abs(t.size) + p["addon_size"], 1.0)
    return t


@registered
class PsarAssistV4(Assist):
    """Turns that pass the gates of a framework and its confirmations, managed by a risk mode."""

    name = "psar_trade_assist_v4"
    # names, defaults and ranges of parameters are fixed values
    defaults = {
        "framework": "F1", "risk_mode": "baseline", "enable_adx": 0, "enable_rsi": 0, "enable_ma": 0, "enable_body": 0, **ASSIST_DEFAULTS, "enable_macd": 0, "macd_fast": 12, "macd_slow": 26, "macd_signal": 9, "enable_vol_filter": 0, "vol_ma_period": 20,
        "vol_ma_mult": 1.5, "enable_session": 0, "enable_momentum": 0, "donchian_period": 20, "cci_period": 14, "cci_threshold": 100.0, "enable_atr_sl": 0, "enable_structure_sl": 0, "enable_tp": 0, "enable_trailing_psar": 0,
        "enable_trailing_atr": 0, "enable_partial_close": 0, "enable_breakeven": 0, "enable_addon": 0, "enable_time_stop": 0, "atr_sl_mult": 1.5, "structure_lookback": 6, "structure_pad": 0.20, "tp1_r": 1.0, "tp2_r": 2.0, "trailing_atr_mult": 2.0,
        "partial_ratio": 0.5, "be_trigger_r": 0.5, "be_buffer_r": 0.1, "addon_size": 0.4, "entry_size": 1.0, "time_stop_bars": 30, "no_progress_r": 0.3,
    }
    axes = {
        "framework": Axis("choice", choices=tuple(FRAMEWORKS)), "risk_mode": Axis("choice", choices=tuple(RISK_MODES)), **ASSIST_AXES, "enable_macd": SWITCH, "macd_fast": Axis("int", 8, 16, 2), "macd_slow": Axis("int", 20, 30, 2),
        "macd_signal": Axis("int", 7, 12, 1), "enable_vol_filter": SWITCH, "vol_ma_period": Axis("int", 10, 30, 5), "vol_ma_mult": Axis("float", 1.0, 2.0, 0.25), "enable_session": SWITCH, "enable_momentum": SWITCH,
        "donchian_period": Axis("int", 10, 30, 5), "cci_period": Axis("int", 10, 20, 2), "cci_threshold": Axis("float", 50, 150, 25), "atr_sl_mult": Axis("float", 1.0, 3.0, 0.25), "structure_lookback": Axis("int", 3, 10, 1),
        "structure_pad": Axis("float", 0.1, 0.5, 0.1), "tp1_r": Axis("float", 0.8, 1.5, 0.1), "tp2_r": Axis("float", 1.5, 3.0, 0.25), "trailing_atr_mult": Axis("float", 1.0, 2.5, 0.25), "partial_ratio": Axis("float", 0.3, 0.6, 0.1),
        "be_trigger_r": Axis("float", 0.3, 0.8, 0.1), "be_buffer_r": Axis("float", 0.05, 0.2, 0.05), "addon_size": Axis("float", 0.3, 0.5, 0.1), "entry_size": Axis("float", 0.5, 1.0, 0.1), "time_stop_bars": Axis("int", 15, 60, 5),
        "no_progress_r": Axis("float", 0.1, 0.5, 0.1),
    }

    def resolved(self, params):
        framework, mode = str(params.get("framework", "F1")).upper(), str(params.get("risk_mode", "baseline")).lower()
        given = super().resolved(params) | FRAMEWORKS.get(framework, {}) | RISK_MODES.get(mode, {})
        given["guarded"] = any(given[k] for k in ("enable_atr_sl", "enable_structure_sl", "enable_tp", "enable_trailing_psar", "enable_trailing_atr"))
        return given

    def periods(self, p):
        return [*super().periods(p), p["donchian_period"], p["cci_period"], p["vol_ma_period"], p["macd_slow"]]

    def needed(self, p):
        own = super().needed(p)
        if p["enable_macd"]:
            own["macd_hist"] = [("macd", {"fast": int(p["macd_fast"]), "slow": int(p["macd_slow"]), "signal": int(p["macd_signal"])})]
        if p["enable_vol_filter"]:
            own["vol_ma"] = [("sma", {"window": int(p["vol_ma_period"]), "column": "volume"})]
        if p["enable_momentum"]:
            own |= {c: [("donchian", {"period": int(p["donchian_period"])})] for c in ("donchian_upper", "donchian_lower")}
            own["cci"] = [("cci", {"period": int(p["cci_period"])})]
        return own

    @staticmethod
    def confirmed(rows: DataFrame, up: bool) -> Column:
        """MACD, volume, session and momentum, as far as they are on in any of the sets, and in the row's own."""
        at = lambda c, k=1: F.coalesce(before(c, k), F.lit(0.0))
        passed = _on("enable_session", ~((F.hour("ts") >= ASIA[0]) & (F.hour("ts") < ASIA[1])))
        if "macd_hist" in rows.columns:
            rising = (at("macd_hist") > 0) & (at("macd_hist") > at("macd_hist", 2))
            falling = (at("macd_hist") < 0) & (at("macd_hist") < at("macd_hist", 2))
            passed = passed & _on("enable_macd", rising if up else falling)
        if "vol_ma" in rows.columns:
            passed = passed & _on("enable_vol_filter", ~((at("vol_ma") > 0) & (at("volume") <= at("vol_ma") * F.col("_p.vol_ma_mult"))))
        if "cci" in rows.columns:
            broke = (at("donchian_upper", 2) > 0) & (at("close") > at("donchian_upper", 2)) if up else (at("donchian_lower", 2) > 0) & (at("close") < at("donchian_lower", 2))
            passed = passed & _on("enable_momentum", broke | (at("cci") > F.col("_p.cci_threshold") if up else at("cci") < -F.col("_p.cci_threshold")))
        return passed

    def decided(self, rows: DataFrame, given: list[dict]) -> DataFrame:
        w = series(OF_SET)
        rows = rows.withColumn("sar", self.chosen(lambda pace: F.col(f"sar_{pace}")))
        sar_1, sar_2 = before("sar", 1), before("sar", 2)
        ready = (F.col("bar_idx") >= F.col("_p.warm")) & (F.count("*").over(Window.partitionBy(*OF_SET)) >= F.col("_p.warm"))
        turned = [F.coalesce(self.turn(sar_1, sar_2, up), F.lit(False)) for up in (True, False)]
        passed = [F.coalesce(self.gates(up) & self.confirmed(rows, up), F.lit(False)) for up in (True, False)]
        way = F.when(turned[0] & passed[0], 1.0).when(~turned[0] & turned[1] & passed[1], -1.0).otherwise(0.0)
        rows = rows.withColumn("_way", F.when(ready, way).otherwise(0.0)).withColumn("_ready", ready)
        entry, atr = before("close"), before("atr")
        unit = F.when(atr > 0, atr).otherwise(1.0)
        by_atr = F.when(F.col("_p.enable_atr_sl") != 0, entry - F.col("_way") * unit * F.col("_p.atr_sl_mult"))
        swing = F.lit(None).cast("double")
        for back in sorted({int(p["structure_lookback"]) for p in given if p["enable_structure_sl"] and p["structure_lookback"] >= 1}):
            near = w.rowsBetween(-back, -1)
            edge = F.when(F.col("_way") > 0, F.min("low").over(near) - unit * F.col("_p.structure_pad")).otherwise(F.max("high").over(near) + unit * F.col("_p.structure_pad"))
            swing = F.when((F.col("_p.enable_structure_sl") != 0) & (F.col("_p.structure_lookback") == back), edge).otherwise(swing)
        stop = F.when(by_atr.isNull() | (by_atr == 0) | (F.col("_way") * (swing - by_atr) < 0), F.coalesce(swing, by_atr)).otherwise(by_atr)
        rows = rows.withColumn("_entry", entry).withColumn("_stop", F.coalesce(stop, F.lit(0.0)))

        def step(trade: Trade | None, row: tuple):
            combo, high, low, close, sar, atr, ma_fast, way, ready, entry, stop = row
            p = given[combo]
            if not ready:
                return None, (0.0,)
            if trade is not None:
                trade = manage(trade, {"high": high, "low": low, "close": close, "sar": sar, "atr": atr, "ma_fast": ma_fast}, p)
                if trade is None:
                    return None, (0.0,)
            if way and (trade is None or trade.way != way):
                risk = abs(entry - stop) if p["enable_tp"] and stop != 0 else 0.0
                targets = [entry + way * p[k] * risk if risk > 0 else 0.0 for k in ("tp1_r", "tp2_r")]
                trade = Trade(p["entry_size"] * way, entry, stop, stop, *targets, high if way > 0 else low)
            return trade, (trade.size if trade else 0.0,)

        inputs = ["combo_id", "high", "low", "close", "sar", "atr", "ma_fast", "_way", "_ready", "_entry", "_stop"]
        light = rows.select("combo_id", *KEEP, *[c for c in inputs if c not in ("combo_id", *KEEP)])
        return speculative(light, OF_SET, "bar_idx", inputs, lambda: None, step, "signal double")
