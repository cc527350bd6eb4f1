"""Many combinations under rules at once, against a step for each bar of each."""

import math
import random
import time

import numpy as np
import pytest
from barloom.functions.costs import FixedCommission, FixedSlippage, PercentCommission, PercentSlippage, Rules, TieredCommission, VolumeSlippage
from barloom.operators import batch, portfolio
from pyspark.sql import functions as F

COSTS = PercentSlippage(0.001), PercentCommission(0.0005)


def made(spark, combos=7, bars=90, symbols=("A", "B", "C"), seed=1):
    """Random walks and random signals, nulls among them, over several days and weeks."""
    draw, rows = random.Random(seed), []
    prices = {s: [100 * math.exp(sum(draw.gauss(0, 0.02) for _ in range(k))) for k in range(1, 2 * bars + 1)] for s in symbols}
    for c in range(combos):
        for s in symbols:
            for k in range(bars):
                rows.append((c, s, 1_770_000_000 + k * 6 * 3600, k, prices[s][2 * k], prices[s][2 * k + 1], float(draw.choice([0, 50, 5000])), draw.choice([None, -1.0, -0.4, 0.0, 0.3, 0.8, 1.0, 2.0]) if draw.random() < 0.4 else 0.1 * (k % 9)))
    out = spark.createDataFrame(rows, "combo_id long, symbol string, at long, bar_idx int, open double, close double, volume double, signal double")
    return out.withColumn("ts", F.timestamp_seconds("at")).drop("at").cache()


def by_bar(signals, rules, costs=COSTS, cash=500.0, multiplier=1.0):
    """The step of a single run, for each combination."""
    out = portfolio._bar_by_bar(signals, *costs, rules, cash, multiplier)
    return {(r["combo_id"], r["bar_idx"]): r for r in out.collect()}


RULES = {
    "margin": Rules(margin_ratio=0.9),
    "margin binds late": Rules(margin_ratio=0.45),
    "position": Rules(margin_ratio=0.0, max_position=0.5),
    "addons": Rules(margin_ratio=0.0, max_addons=2),
    "risk": Rules(margin_ratio=0.0, max_risk_per_trade=0.1),
    "day": Rules(margin_ratio=0.0, max_daily_loss=0.02),
    "week": Rules(margin_ratio=0.0, max_weekly_loss=0.03),
    "stop": Rules(margin_ratio=0.0, max_drawdown=0.1),
    "reduce": Rules(margin_ratio=0.0, max_drawdown=0.05, drawdown_action="reduce"),
    "alert": Rules(margin_ratio=0.0, max_drawdown=0.05, drawdown_action="alert"),
    "limits": Rules(margin_ratio=0.6, limit_up=0.005, limit_down=0.005),
    "all": Rules(0.5, 0.02, 0.02, 0.7, 3, 0.4, 0.04, 0.06, 0.15, "reduce"),
}


@pytest.mark.parametrize("name", RULES)
def test_stepped_curves_equal_single_steps(spark, name):
    signals, rules = made(spark), RULES[name]
    costs = (VolumeSlippage(0.5, 0.1), TieredCommission(((50.0, 0.01), (100.0, 0.004)))) if name == "all" else COSTS
    expected = by_bar(signals, rules, costs)
    found = portfolio.equity_under(signals, *costs, rules, 500.0).collect()
    assert len(found) == len(expected) == 7 * 90
    for r in found:
        one = expected[(r["combo_id"], r["bar_idx"])]
        assert r["ts"] == one["ts"] and [r[c] for c in ("equity", "ret", "turnover")] == pytest.approx([one[c] for c in ("equity", "ret", "turnover")], rel=1e-9, abs=1e-9)


def test_ruin_and_keys_of_any_kind(spark):
    signals = made(spark, 3).withColumn("combo_id", F.struct(F.col("combo_id").alias("k"), F.lit("x").alias("name")))
    rules = Rules(margin_ratio=0.2)
    expected = by_bar(signals, rules, cash=20.0, multiplier=3.0)
    found = portfolio.equity_under(signals, *COSTS, rules, 20.0, 3.0).collect()
    assert all(r["equity"] == pytest.approx(expected[(r["combo_id"], r["bar_idx"])]["equity"], abs=1e-9) for r in found) and len(found) == 270
    assert portfolio.equity_under(signals.limit(0), *COSTS, rules, 20.0).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_where_no_rule_binds(spark):
    signals = made(spark)
    free = portfolio.equity_under(signals, *COSTS, Rules(), 1e6)
    assert "MapInArrow" not in plan_of(free) and "MapInArrow" in plan_of(portfolio.equity_under(signals, *COSTS, Rules(0.9), 500.0))
    one = signals.where("combo_id = 1")
    run, steps = portfolio.sequential(one, *COSTS, Rules(), 1e6), portfolio._bar_by_bar(one, *COSTS, Rules(), 1e6)
    assert "MapInArrow" not in plan_of(run) and "MapInArrow" in plan_of(portfolio.sequential(one, *COSTS, Rules(0.9), 100.0))
    for a, b in zip(run.orderBy("bar_idx").collect(), steps.orderBy("bar_idx").collect(), strict=True):
        assert a["positions"] == pytest.approx(b["positions"]) and a["events"] == b["events"] == []
        assert [a[c] for c in ("equity", "ret", "turnover")] == pytest.approx([b[c] for c in ("equity", "ret", "turnover")], abs=1e-9)
        assert [(t["symbol"], t["side"]) for t in a["trades"]] == [(t["symbol"], t["side"]) for t in b["trades"]]
        assert [x for t in a["trades"] for x in (t["quantity"], t["price"], t["cost"])] == pytest.approx([x for t in b["trades"] for x in (t["quantity"], t["price"], t["cost"])])


def test_only_combinations_that_bind_are_stepped(spark):
    signals = made(spark, 4).withColumn("signal", F.when(F.col("combo_id") < 3, F.col("signal") / 100).otherwise(F.col("signal")))
    rules = Rules(margin_ratio=0.9)
    held = portfolio._unruled(signals, *COSTS, rules, 1.0)
    assert [r["combo_id"] for r in batch.screen(held, rules, 200.0, 1.0).collect()] == [3]


def test_many_combinations_step_ten_times_faster():
    """128 combinations of 4 symbols under margin: a step in arrays against a step for each."""
    combos, symbols, bars = 128, 4, 60
    draw = np.random.default_rng(3)
    n = combos * symbols
    ids, names = np.repeat(np.arange(combos), symbols), [f"s{k}" for k in range(symbols)] * combos
    price = np.tile(100 + draw.normal(0, 1, (bars, symbols)).cumsum(axis=0), combos)
    targets = draw.uniform(-1, 1, (bars, n))
    rules, costs = Rules(margin_ratio=0.5), (FixedSlippage(0.01), FixedCommission(0.1))
    accounts, began = batch.Accounts(*costs, rules, 1.0), time.perf_counter()
    state = {f"_{c}": np.full(n, 100.0) for c in ("equity", "peak", "day_anchor", "week_anchor")} | {f"_{c}": np.zeros(n, np.int64) for c in ("day", "week")}
    curves = []
    for k in range(1, bars):
        rows = {"open": price[k], "close": price[k] + 0.5, "before": price[k - 1], "volume": np.full(n, 9.0), "target": targets[k], "day": np.full(n, k // 9), "week": np.zeros(n, np.int64), "prev_position": np.zeros(n)} | state
        accounts.find(ids, names, rows)
        curves.append(accounts.step(rows)[0])
    fast, began = time.perf_counter() - began, time.perf_counter()
    for c in range(combos):
        a = portfolio._Account(100.0, symbols)
        a.day, a.week = 0, 0
        for k in range(1, bars):
            own = slice(c * symbols, (c + 1) * symbols)
            assets = [{"symbol": s, "open": o, "close": o + 0.5, "volume": 9.0, "_target": t, "_before": b} for s, o, t, b in zip(names[own], price[k][own].tolist(), targets[k][own].tolist(), price[k - 1][own].tolist(), strict=True)]
            a, out = portfolio._bar(a, assets, k // 9, 0, *costs, rules, 1.0)
            assert out[0] == pytest.approx(curves[k - 1][c], abs=1e-9)
    assert fast < (time.perf_counter() - began) / 10
