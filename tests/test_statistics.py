"""Keyed permutations, exact percentiles, sliding medians, Parzen search and walk-forward measures."""

import math
import random
import statistics
import time

import numpy as np
import pytest
from barloom.config import Config
from barloom.functions.costs import PercentCommission, PercentSlippage
from barloom.operators import indicators, metrics, portfolio, scan, search, stability, walkforward
from barloom.operators.strategies import Axis, Strategy, strategy
from barloom.plans import backtest
from pyspark.sql import functions as F
from tests.test_engine import bars_of, wave


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 719, 5000])
def test_places_are_a_permutation_and_its_inverse(n):
    for order in (1, 2, 3):
        keys = stability.round_keys(42, order)
        put = stability.places(np.arange(n), n, keys)
        assert sorted(put.tolist()) == list(range(n))
        assert (stability.places(put, n, keys, back=True) == np.arange(n)).all()
    if n > 100:
        assert (stability.places(np.arange(n), n, stability.round_keys(42, 1)) != stability.places(np.arange(n), n, stability.round_keys(42, 2))).mean() > 0.9


def test_places_are_spread_evenly():
    n, sums = 50, np.zeros((50, 50))
    for order in range(4000):
        sums[np.arange(n), stability.places(np.arange(n), n, stability.round_keys(1, order))] += 1
    assert abs(sums - 80).max() < 50 and abs(((sums - 80) ** 2).mean() / 80 - 1) < 0.25  # 80 expected, deviation 9


@pytest.mark.parametrize("statistic", ["max_drawdown", "calmar"])
def test_permutations_in_stretches_equal_whole_ones(spark, monkeypatch, statistic):
    bars = bars_of(spark, [100 + 20 * math.sin(k / 6) + (k * 31 % 7) for k in range(130)]).cache()
    curve = portfolio.vector(strategy("sma_cross").signals(bars, [{"fast": 2, "slow": 5}, {"fast": 3, "slow": 9}]), PercentSlippage(0.001), PercentCommission(0.001), cash=500.0).cache()

    def found():
        return sorted(tuple(r) for r in stability.permutation_test(curve, ["combo_id"], 60, periods=1000.0, statistic=statistic).collect())

    whole = found()
    monkeypatch.setattr(stability, "BLOCK", 16)
    assert found() == whole
    monkeypatch.setattr(stability, "MOST_RETURNS", 0)
    assert found() == whole
    rets = [r["ret"] for r in curve.where("combo_id = 0 and bar_idx > 0").orderBy("bar_idx").collect()]
    actual, ties = whole[0][1], 0
    for order in range(1, 61):
        at = stability.places(np.arange(len(rets)), len(rets), stability.round_keys(42, order), back=True)
        level = np.concatenate([[1.0], np.cumprod(1 + np.array(rets)[at])])
        fall = (level / np.maximum.accumulate(level) - 1).min()
        ties += (fall if statistic == "max_drawdown" else (level[-1] ** (1000 / len(rets)) - 1) / abs(fall)) >= actual
    assert whole[0][2] == pytest.approx((ties + 1) / 61)
    assert stability.permutation_test(curve.limit(0), ["combo_id"], 5, statistic=statistic).count() == 0


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_percentiles_equal_numpy(spark, accuracy):
    draw = random.Random(3)
    groups = {"many": [draw.gauss(0, 1) for _ in range(1500)], "ties": [draw.choice([0.0, 0.0, 0.0, 1.5, -2.0]) for _ in range(900)], "few": [3.0, 1.0], "one": [7.0]}
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("many", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    shares = [0.0, 0.05, 1 / 3, 0.5, 0.99, 1.0]
    found = {r["k"]: r["values"] for r in metrics.percentiles(df, ["k"], "x", shares, accuracy).collect()}
    assert set(found) == set(groups)
    for k, xs in groups.items():
        assert found[k] == pytest.approx(np.quantile(xs, shares).tolist(), abs=1e-12)


@pytest.mark.parametrize("window", [2, 5, 101, 150])
def test_sliding_median_equals_sorting(spark, window):
    closes = [round(100 + 10 * math.sin(k / 3) + (k * 7919 % 13), 2) for k in range(400)]
    found = [r["median"] for r in indicators.rolling_median(bars_of(spark, closes), window).orderBy("bar_idx").collect()]
    assert found[: window - 1] == [None] * (window - 1)
    assert found[window - 1 :] == pytest.approx([statistics.median(closes[k - window + 1 : k + 1]) for k in range(window - 1, 400)])
    slid = [r["m"] for r in scan.sliding_median(bars_of(spark, closes), ["symbol"], "bar_idx", "close", window, "m").orderBy("bar_idx").collect()]
    assert slid[window - 1 :] == pytest.approx(found[window - 1 :])


def test_a_wide_window_slides_as_fast_as_a_narrow_one(spark):
    bars = spark.range(60_000).select(F.lit("A").alias("symbol"), F.col("id").cast("int").alias("bar_idx"), F.rand(1).alias("close")).cache()
    bars.count()

    def took(window):
        began = time.monotonic()
        scan.sliding_median(bars, ["symbol"], "bar_idx", "close", window, "m").agg(F.sum("m")).collect()
        return time.monotonic() - began

    took(50)
    assert took(5000) < 3 * took(50) + 1


class Free(Strategy):
    name = "free"

    def signals(self, bars, sets):
        raise NotImplementedError


AXES = {"x": Axis("float", -5.0, 5.0), "y": Axis("float", -5.0, 5.0), "k": Axis("int", 0, 20, 1), "c": Axis("choice", choices=("a", "b", "d"))}
SHAPES = {
    "bowl": lambda s: (s["x"] - 1) ** 2 + (s["y"] + 2) ** 2 + 0.1 * (s["k"] - 7) ** 2 + (s["c"] != "b"),
    "valley": lambda s: 5 * (s["y"] - s["x"] ** 2 / 5) ** 2 + (1 - s["x"]) ** 2 + 0.05 * abs(s["k"] - 3) + 0.5 * (s["c"] != "a"),
    "waves": lambda s: s["x"] ** 2 + s["y"] ** 2 + 6 * (2 - math.cos(2 * s["x"]) - math.cos(2 * s["y"])) + 0.2 * abs(s["k"] - 15) + 2 * (s["c"] != "d"),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_parzen_search_beats_random_search(shape):
    """At 100 trials, over 20 seeds."""
    score = lambda sets: [SHAPES[shape](s) for s in sets]
    chosen = Free()
    one, two = ([f(chosen, score, "m", 100, seed, AXES, maximize=False).best[1] for seed in range(20)] for f in (search.bayesian, search.randomly))
    assert np.mean(one) < 0.7 * np.mean(two) and np.median(one) < np.median(two)
    assert sum(a < b for a, b in zip(one, two, strict=True)) >= 14
    found = search.bayesian(chosen, score, "m", 30, 1, AXES, maximize=False)
    assert len(found.trials) == 30 and all(-5 <= s["x"] <= 5 and 0 <= s["k"] <= 20 for s, _ in found.trials)


SMALL = {"fast": Axis("int", 2, 4, 1), "slow": Axis("int", 5, 9, 2)}


def test_walk_forward_tells_risk_and_trades_and_refuses(spark):
    bars, terms = bars_of(spark, wave(80)).cache(), backtest.terms_of(Config())
    for method in ("bayesian", "genetic"):
        out = walkforward.run(bars, 80, strategy("sma_cross"), terms, method=method, trials=10, splits=2, axes=SMALL)
        assert set(out.means()) == {*metrics.PERFORMANCE, *metrics.RISK} and out.as_dict()["settings"]["method"] == method
        assert all("trade_count" in f[2] and "trade_win_rate" in f[2] for f in out.folds)
    for wrong in ({"splits": 0}, {"share": 1.0}, {"method": "none"}):
        with pytest.raises(ValueError):
            walkforward.run(bars, 80, strategy("sma_cross"), terms, **wrong)
    with pytest.raises(ValueError):
        walkforward.run(bars, 3, strategy("sma_cross"), terms)


def test_beta_of_folds_is_against_their_own_market(spark):
    bars, terms = bars_of(spark, wave(80)).unionByName(bars_of(spark, [50 + math.cos(k / 4) for k in range(80)], "B")).cache(), backtest.terms_of(Config())
    sets = search.product(SMALL)
    cut = walkforward.folds(80, 2)
    rows = walkforward.grid_by_fold(bars, cut, strategy("sma_cross"), sets, "beta", terms).orderBy("fold").collect()
    for r, fold in zip(rows, cut, strict=True):
        inside = walkforward.part(bars, fold.is_start, fold.is_end)
        scores = dict(search.scores(inside, strategy("sma_cross"), sets, "beta", terms).collect())
        assert r["is_score"] == pytest.approx(max(scores.values())) and r["is_score"] == pytest.approx(scores[r["combo_id"]])


def test_searches_take_measures_of_trades(spark):
    bars, terms = bars_of(spark, wave(60)).cache(), backtest.terms_of(Config())
    sets = [{"fast": 2, "slow": 5}, {"fast": 3, "slow": 9}]
    score = search.scorer(bars, strategy("sma_cross"), "avg_profit", terms)(sets)
    for params, found in zip(sets, score, strict=True):
        assert found == pytest.approx(backtest.backtest(bars, "sma_cross", params, Config()).measures()["trade"]["avg_profit"])
    with pytest.raises(KeyError):
        search.scorer(bars, strategy("sma_cross"), "nothing", terms)(sets)
