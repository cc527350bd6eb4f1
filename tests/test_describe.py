"""Descriptions of strategies."""

import pytest
from barloom.operators.assist_v4 import FRAMEWORKS, RISK_MODES
from barloom.plans.describe import described, missing_signals


@pytest.mark.parametrize("framework", FRAMEWORKS)
@pytest.mark.parametrize("mode", RISK_MODES)
def test_all_frameworks_and_modes(framework, mode):
    found, params, weight = described({"strategy": {"name": "PSAR_trade_assist_v4", "framework": framework.lower(), "risk_mode": mode.upper(), "params": {"atr_period": 14}}}).built()
    assert (found.name, params, weight) == ("psar_trade_assist_v4", {"atr_period": 14, "framework": framework, "risk_mode": mode}, 1.0)


def test_yaml(tmp_path):
    text = "strategy:\n  name: sma_cross\n  weight: 0.6\n  params:\n    fast: 10\n    slow: 50\n"
    (tmp_path / "s.yaml").write_text(text)
    assert described(text) == described(tmp_path / "s.yaml") == described(str(tmp_path / "s.yaml"))
    assert described(text).weight == 0.6


@pytest.mark.parametrize("bad", [{"name": ""}, {"name": "x", "weight": 0}, {"name": "x", "params": 3}, {"strategy": 4}, {"name": "psar_trade_assist_v4", "framework": "F9"}, "", "- 1\n- 2\n"])
def test_bad_descriptions(bad):
    with pytest.raises(ValueError):
        described(bad)


def test_missing_signals(spark):
    bars = spark.createDataFrame([("A", 0), ("A", 1), ("B", 0)], "symbol string, bar_idx int")
    signals = spark.createDataFrame([(0, "A", 0), (0, "A", 1), (1, "A", 0), (1, "A", 1), (1, "B", 0)], "combo_id long, symbol string, bar_idx int")
    assert [tuple(r) for r in missing_signals(bars, signals).collect()] == [(0, "B", 0)]
