"""Simulation, measures, search and audit on small data."""

import json
import math

import pytest
from barloom import cli
from barloom.config import Config, config_of, truth
from barloom.functions.costs import FixedCommission, FixedSlippage, PercentCommission, PercentSlippage, Rules
from barloom.operators import indicators, metrics, portfolio, search, stability, walkforward
from barloom.operators.strategies import Axis, strategy
from barloom.plans import audit, backtest, registry, report
from pyspark.sql import functions as F

FREE = FixedSlippage(0.0), FixedCommission(0.0)


def signals(spark, opens, closes, values, day=0):
    rows = [(0, "A", f"2026-03-02 09:{30 + k}:00" if not day else f"2026-03-{2 + k:02d} 09:30:00", k, float(o), float(c), 1000.0, float(s)) for k, (o, c, s) in enumerate(zip(opens, closes, values, strict=True))]
    return spark.createDataFrame(rows, "combo_id long, symbol string, ts string, bar_idx int, open double, close double, volume double, signal double").withColumn("ts", F.col("ts").cast("timestamp"))


def bars_of(spark, closes, symbol="A"):
    rows = [(symbol, f"2026-03-02 {9 + k // 60:02d}:{k % 60:02d}:00", k, c, c + 1, c - 1, c, 100.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts string, bar_idx int, open double, high double, low double, close double, volume double").withColumn("ts", F.col("ts").cast("timestamp"))


def wave(n=120):
    return [100 + 10 * math.sin(k / 7) + k / 10 for k in range(n)]


def test_profit_is_split_at_the_open(spark):
    s = signals(spark, [100, 100, 102], [100, 102, 104], [0, 1, 1])
    assert [r["equity"] for r in portfolio.vector(s, *FREE, cash=1000.0).orderBy("bar_idx").collect()] == [1000.0, 1000.0, 1002.0]
    assert [r["equity"] for r in portfolio.sequential(s, *FREE, cash=1000.0).orderBy("bar_idx").collect()] == [1000.0, 1000.0, 1002.0]


def test_both_simulations_agree(spark):
    s = strategy("sma_cross").signals(bars_of(spark, wave()), [{"fast": 3, "slow": 8}])
    one, two = (f(s, PercentSlippage(0.001), PercentCommission(0.002), cash=500.0).orderBy("bar_idx").collect() for f in (portfolio.vector, portfolio.sequential))
    assert all(abs(a["equity"] - b["equity"]) < 1e-9 and abs(a["turnover"] - b["turnover"]) < 1e-12 for a, b in zip(one, two, strict=True))


def test_equity_does_not_fall_below_zero(spark):
    s = signals(spark, [100, 100, 50, 60], [100, 50, 60, 80], [1, 1, 1, 1])
    assert [r["equity"] for r in portfolio.vector(s, *FREE, cash=10.0).orderBy("bar_idx").collect()] == [10.0, 0.0, 10.0, 30.0]


def test_drawdown_stop_and_daily_stop(spark):
    s = signals(spark, [100] * 6, [100, 90, 80, 80, 80, 80], [1] * 6, day=1)
    out = portfolio.sequential(s, *FREE, Rules(margin_ratio=0.0, max_drawdown=0.05), cash=100.0).orderBy("bar_idx").collect()
    assert [e["type"] for r in out for e in r["events"]].count("drawdown_breach") == 1
    assert [r["positions"] for r in out] == [[0.0], [1.0], [0.0], [0.0], [0.0], [0.0]]
    daily = portfolio.sequential(s, *FREE, Rules(margin_ratio=0.0, max_daily_loss=0.05), cash=100.0).orderBy("bar_idx").collect()
    assert daily[2]["positions"] == [1.0]  # a new day lifts the stop


def test_margin_scales(spark):
    out = portfolio.sequential(signals(spark, [100] * 3, [100] * 3, [1] * 3), *FREE, Rules(margin_ratio=0.5), cash=25.0).orderBy("bar_idx").collect()
    assert abs(out[1]["positions"][0] - 0.5) < 1e-9 and out[1]["events"][0]["type"] == "position_limit"


def test_long_recurrences_equal_a_loop(spark):
    closes = wave(700)
    out = [r["ema"] for r in indicators.ema(bars_of(spark, closes), 200).orderBy("bar_idx").collect()]
    value = closes[0]
    for k, c in enumerate(closes):
        value = c if k == 0 else value + 2 / 201 * (c - value)
        assert abs(value - out[k]) < 1e-9
    gone = [r["e"] for r in indicators.ema(bars_of(spark, closes).withColumn("close", F.when(F.col("bar_idx") != 100, F.col("close"))), 5, out="e").orderBy("bar_idx").collect()]
    assert gone[99] is not None and all(x is None for x in gone[100:])


def test_sma_cross_is_short_at_first_and_rsi_long(spark):
    bars = bars_of(spark, wave())
    assert strategy("SMA_Cross").signals(bars, [{"fast": 3, "slow": 8}]).where("bar_idx = 0").first()["signal"] == -1.0
    assert strategy("rsi_mean_reversion").signals(bars, [{"window": 14, "lower": 30, "upper": 70}]).where("bar_idx = 0").first()["signal"] == 1.0
    with pytest.raises(ValueError):
        strategy("sma_cross").signals(bars, [{"fast": 8, "slow": 8}])


def test_assistants_give_bounded_signals(spark):
    bars = bars_of(spark, wave(200))
    params = {"atr_ratio_window": 20, "ma_slow": 30, "adx_threshold": 5.0, "require_adx_slope": 0}
    for name, more in (("psar_trade_assist_v3", {}), ("psar_trade_assist_v4", {"risk_mode": "aggressive", "framework": "F2", "enable_macd": 1, "enable_momentum": 1, "enable_vol_filter": 1, "enable_session": 1}), ("psar_trade_assist_v4", {})):
        found = {r["signal"] for r in strategy(name).signals(bars, [params | more]).collect()}
        assert found <= {x for x in found if -1 <= x <= 1} and 0.0 in found
    assert len(found) > 1


def test_trades_first_in_first_out(spark):
    rows = [(0, 0, "X", "BUY", 1.0, 100.0), (0, 1, "X", "SELL", 2.0, 105.0), (0, 2, "X", "BUY", 1.0, 101.0), (0, 3, "Y", "BUY", 2.0, 50.0), (0, 4, "Y", "SELL", 2.0, 48.0)]
    trades = spark.createDataFrame(rows, "combo_id long, bar_idx int, symbol string, side string, quantity double, price double").withColumn("cost", F.lit(1.0))
    assert sorted(r["pnl"] for r in metrics.realised(trades).collect()) == [-4.0, 4.0, 5.0]
    row = metrics.trade_metrics(trades).first().asDict()
    assert row["trade_count"] == 3 and row["symbol_count"] == 2 and row["profit_factor"] == 9 / 4 and row["most_active_symbol"] == "X" and row["max_consecutive_losses"] == 1


def test_corrections_and_windows(spark):
    out = stability.benjamini_hochberg(spark.createDataFrame([(0.001,), (0.01,), (0.04,), (0.2,)], "p double")).orderBy("p").collect()
    assert [round(r["adjusted"], 6) for r in out] == [0.004, 0.02, 0.053333, 0.2] and [r["rejected"] for r in out] == [True, True, False, False]
    assert stability.windows(spark, 10, 4, 2, 2).count() == 3 and stability.windows(spark, 5, 4, 2, 2).count() == 0
    with pytest.raises(ValueError):
        stability.windows(spark, 10, 4, 2, 0)
    assert stability.perturbed({"fast": 10.0, "name": "x", "on": True, "zero": 0}) == [{"fast": 10.0, "name": "x", "on": True, "zero": 0}, *[{"fast": f, "name": "x", "on": True, "zero": 0} for f in (9.0, 11.0)], *[{"fast": 10.0, "name": "x", "on": True, "zero": z} for z in (-0.1, 0.1)]]


def test_folds():
    assert [(f.is_start, f.is_end, f.oos_end) for f in walkforward.folds(500)] == [(k * 100, k * 100 + 70, k * 100 + 100) for k in range(5)]
    assert [f.is_end for f in walkforward.folds(500, expanding=True)] == [70, 100, 130, 160, 190]
    assert walkforward.folds(3) == []


def test_searches_find_the_best(spark):
    chosen, axes = strategy("sma_cross"), {"fast": Axis("int", 2, 6, 1), "slow": Axis("int", 5, 20, 5)}
    score = lambda sets: [-abs(s["fast"] - 4) - abs(s["slow"] - 15) for s in sets]
    assert search.grid(chosen, score, "m", axes).best == ({"fast": 4, "slow": 15}, 0)
    for found in (search.randomly(chosen, score, "m", 200, 1, axes), search.bayesian(chosen, score, "m", 100, 1, axes), search.genetic(chosen, score, "m", 8, 20, 1, axes)):
        assert found.best[1] >= -1
    assert search.randomly(chosen, score, "m", 20, 1, axes).trials == search.randomly(chosen, score, "m", 20, 1, axes).trials
    assert search.product_table(spark, axes).count() == len(search.product(axes))
    assert Axis("float", 0.1, 0.5, 0.1).values() == pytest.approx([0.1, 0.2, 0.3, 0.4, 0.5])


def test_bundle_round_trip_replay_and_report(spark, tmp_path):
    bars = bars_of(spark, wave(60))
    run = backtest.backtest(bars, "sma_cross", {"fast": 3, "slow": 8}, Config(period_preset="minute"))
    path = str(tmp_path / "run.zip")
    bundle = audit.bundle_of(run)
    audit.save(bundle, path)
    again = audit.load(path)
    assert again.equity == bundle.equity and again.trades == bundle.trades
    assert audit.verify(again, bars) == {"data": True, "environment": True} and all(audit.replay(again, bars).values())
    with pytest.raises(ValueError):
        audit.verify(again, bars.withColumn("close", F.col("close") + 1), strict=True)
    text = report.backtest_page(run, "zh")
    assert "<svg" in text and "绩效" in text
    assert run.objective("win_rate") == run.measures()["performance"]["win_rate"]
    with pytest.raises(KeyError):
        run.objective("nothing")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "aaa").mkdir()
    lines = ["datetime,open,high,low,close,volume", *[f"2026-03-02T{9 + k // 60:02d}:{k % 60:02d}:00,{c},{c + 1},{c - 1},{c},100" for k, c in enumerate(wave(80))]]
    (tmp_path / "aaa" / "b.csv").write_text("\n".join(lines))
    out = tmp_path / "out.json"
    assert cli.main(["backtest", "--data", str(tmp_path), "--strategy", "sma_cross", "--params", '{"fast":3,"slow":8}', "--output", str(out), "--report", str(tmp_path / "r.html"), "--audit-bundle", str(tmp_path / "a.zip")]) == 0
    assert json.loads(out.read_text())["performance"]["max_drawdown"] <= 0 and (tmp_path / "a.zip").exists()
    assert cli.main(["optimize", "--data", str(tmp_path), "--strategy", "sma_cross", "--method", "grid", "--param-grid", '{"fast":[3,4],"slow":[8]}', "--output", str(out)]) == 0
    assert len(json.loads(out.read_text())["trials"]) == 2
    assert cli.main(["report", "--input", str(out), "--output", str(tmp_path / "o.html")]) == 0
    assert cli.main(["list-strategies"]) == 0 and "sma_cross" in capsys.readouterr().out


def test_settings():
    assert config_of({"period_preset": "daily", "unknown": 1}).periods_per_year == 252 and truth("Yes") and not truth("off", True) and truth(None, True)
    with pytest.raises(ValueError):
        Config(trials=0)


def test_registered_queries_have_unique_columns(spark):
    assert set(registry.ORACLES) <= set(registry.QUERIES)
