"""Strategies described by mappings or YAML: name, weight, parameters, framework and risk mode."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from barloom.operators.assist_v4 import FRAMEWORKS, RISK_MODES
from barloom.operators.strategies import Strategy, strategy


@dataclass(frozen=True)
class Described:
    name: str
    params: dict = field(default_factory=dict)
    weight: float = 1.0

    def built(self) -> tuple[Strategy, dict, float]:
        """The registered strategy (KeyError without one), its parameters and weight."""
        return strategy(self.name), dict(self.params), self.weight


def described(source: str | Path | Mapping) -> Described:
    """From a mapping, the path of a YAML file, or YAML text; ValueError says what is wrong."""
    given = source if isinstance(source, Mapping) else _yaml(source)
    root = given.get("strategy", given)
    if not isinstance(root, Mapping):
        raise ValueError("strategy must be a mapping")
    name, params, weight = str(root.get("name") or "").strip().lower(), root.get("params") or {}, float(root.get("weight", 1.0))
    if not name:
        raise ValueError("strategy.name is missing")
    if not isinstance(params, Mapping):
        raise ValueError("strategy.params must be a mapping")
    if weight <= 0:
        raise ValueError("strategy.weight must be positive")
    params = dict(params)
    if root.get("framework") is not None:
        params["framework"] = str(root["framework"]).strip().upper()
    if root.get("risk_mode") is not None:
        params["risk_mode"] = str(root["risk_mode"]).strip().lower()
    if name == "psar_trade_assist_v4":
        for key, known in (("framework", FRAMEWORKS), ("risk_mode", RISK_MODES)):
            if key in params and params[key] not in known:
                raise ValueError(f"unknown {key}: {params[key]}")
    return Described(name, params, weight)


def _yaml(source: str | Path) -> Mapping:
    import yaml

    text = str(source)
    if isinstance(source, Path) or "\n" not in text and text.lower().endswith((".yml", ".yaml")):
        text = Path(source).read_text(encoding="utf-8")
    if not text.strip():
        raise ValueError("the description is empty")
    found = yaml.safe_load(text) or {}
    if not isinstance(found, Mapping):
        raise ValueError("the description must be a mapping")
    return found


def missing_signals(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """combo_id, symbol, bar_idx of bars that a set of signals has no row for; simulations need none missing."""
    sets = signals.select("combo_id").distinct()
    return bars.select("symbol", "bar_idx").join(sets).join(signals.select("combo_id", "symbol", "bar_idx"), ["combo_id", "symbol", "bar_idx"], "left_anti")


def checked_signals(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """signals, or a ValueError that names the first bars that a set has no signal for."""
    gaps = [tuple(r) for r in missing_signals(bars, signals).limit(5).collect()]
    if gaps:
        raise ValueError(f"no signal for (combo_id, symbol, bar_idx) {gaps}")
    return signals
