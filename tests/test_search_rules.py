"""Searches and walk-forward runs under rules, stretches of series, hooks, registries, written runs."""

import dataclasses
import math

import pytest
from barloom.config import Config
from barloom.functions.costs import ContractSpec, FixedCommission, FixedSlippage, Rules, commission_of, contract_of, slippage_of, with_contracts
from barloom.operators import indicators, metrics, portfolio, scan, search, stability, walkforward
from barloom.operators.strategies import STRATEGIES, Axis, SmaCross, strategy
from barloom.plans import audit, backtest, describe, report
from barloom.sources import files
from pyspark.sql import functions as F
from tests.test_engine import bars_of, signals, wave

AXES = {"fast": Axis("choice", choices=(2, 3)), "slow": Axis("choice", choices=(8, 12))}
TIGHT = Config(initial_cash=300.0, contract_multiplier=2.0, rules={"margin_ratio": 0.9, "max_drawdown": 0.02, "drawdown_action": "reduce", "max_position": 0.7})


@pytest.mark.parametrize("config", [Config(), TIGHT, Config(rules={"margin_ratio": 0.0})], ids=["default", "tight", "none"])
def test_the_best_set_is_scored_as_a_single_run(spark, config):
    bars = bars_of(spark, wave(60))
    found = backtest.optimise(bars, "sma_cross", "grid", AXES, config)
    assert len(found.trials) == 4 and not bars.is_cached
    params, score = found.best
    assert score == pytest.approx(backtest.backtest(bars, "sma_cross", params, config).objective("sharpe"), rel=1e-6)
    assert found.as_dict()["best"] == {"params": params, "score": score}


def test_rules_change_what_is_best(spark):
    s = signals(spark, [100] * 6, [100, 90, 80, 80, 80, 80], [1] * 6, day=1)
    free = FixedSlippage(0.0), FixedCommission(0.0)
    rules = Rules(margin_ratio=0.0, max_drawdown=0.05)
    under = [r["equity"] for r in portfolio.equity_under(s, *free, rules, 100.0).orderBy("bar_idx").collect()]
    assert under == [r["equity"] for r in portfolio.sequential(s, *free, rules, 100.0).orderBy("bar_idx").collect()]
    assert under != [r["equity"] for r in portfolio.equity_under(s, *free, Rules(margin_ratio=0.0), 100.0).orderBy("bar_idx").collect()]


def test_walk_forward_by_every_method(spark):
    bars = bars_of(spark, wave(80))
    terms = backtest.terms_of(TIGHT)
    for method in ("grid", "random"):
        out = walkforward.run(bars, 80, strategy("sma_cross"), terms, method=method, trials=3, splits=2, axes=AXES)
        assert [f[0] for f in out.folds] == walkforward.folds(80, 2) and set(out.means()) == {*metrics.PERFORMANCE, *metrics.RISK}
        assert out.as_dict()["folds"][0]["params"] == out.folds[0][1]
        for k, ratio in out.overfitting().items():
            inside = [f[2][k] for f in out.folds]
            assert ratio == pytest.approx(sum(f[3][k] / f[2][k] for f in out.folds if abs(f[2][k]) >= 1e-12) / sum(abs(x) >= 1e-12 for x in inside))
    assert walkforward.Outcome([]).means() == {}


def long_bars(spark, symbol, n):
    price = 100 + 10 * F.sin(F.col("id") / 7) + F.pmod(F.xxhash64("id"), F.lit(100)) / 25
    rows = spark.range(n).select(F.lit(symbol).alias("symbol"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("bar_idx"), price.alias("close"))
    return rows.select("*", F.col("close").alias("open"), (F.col("close") + 1 + F.pmod("bar_idx", F.lit(3))).alias("high"), (F.col("close") - 1 - F.pmod("bar_idx", F.lit(5))).alias("low"), F.lit(1.0).alias("volume"))


@pytest.mark.parametrize("name", ["sma", "ema", "wilder", "rsi", "macd", "atr", "adx", "bollinger", "stochastic", "donchian", "cci", "rolling_median"])
def test_stretches_equal_whole_series(spark, name):
    """Cut into stretches, the indicators of a long series are what they are in one."""
    bars = long_bars(spark, "A", 2500).unionByName(long_bars(spark, "B", 900))
    needs = {"sma": {"window": 20}, "ema": {"span": 12}, "wilder": {"window": 10}, "rolling_median": {"window": 15}, "macd": {"fast": 5, "slow": 9, "signal": 4}}.get(name, {})
    whole = getattr(indicators, name)(bars, **needs)
    parts = indicators.added(bars, [(name, needs)], rows=300)
    names = [c for c in whole.columns if c not in bars.columns]
    one, two = ({(r["symbol"], r["bar_idx"]): [r[c] for c in names] for r in df.collect()} for df in (whole, parts))
    assert set(one) == set(two) and parts.count() == len(one)
    for key, values in one.items():
        assert all(a == b or a is not None and b is not None and abs(a - b) < 1e-9 for a, b in zip(values, two[key], strict=True)), key


def test_a_long_series_is_many_tasks(spark):
    bars = spark.range(40_000).select(F.lit("A").alias("symbol"), F.col("id").alias("bar_idx"), F.sin("id").alias("close"))
    found = scan.in_parts(bars, 10, lambda df, keys: indicators.sma(df, 10, keys=keys).withColumn("task", F.spark_partition_id()), ["symbol"], rows=1000)
    assert found.count() == 40_000 and found.select("task").distinct().count() > 1
    assert found.where("bar_idx >= 9 and sma is null").count() == 0


def test_switches_may_be_words():
    v4, v3 = strategy("psar_trade_assist_v4"), strategy("psar_trade_assist_v3")
    assert v4.resolved({"enable_adx": "off", "enable_rsi": "Yes", "require_adx_slope": "no"})["enable_adx"] == 0
    assert v4.resolved({"enable_rsi": "Yes"})["enable_rsi"] == 1 and v4.resolved({"framework": "f2", "enable_adx": "off"})["enable_adx"] == 1
    assert v3.resolved({"enable_ma": "off"})["enable_ma"] == 0 and v3.resolved({"enable_ma": "what"})["enable_ma"] == 1


def test_sets_of_assistants_are_one_plan(spark):
    bars = bars_of(spark, wave(200))
    sets = [{"atr_ratio_window": 20, "ma_slow": 30, "adx_threshold": 5.0, "require_adx_slope": 0, "risk_mode": mode, "framework": f} for mode in ("baseline", "aggressive") for f in ("F1", "F2")]
    chosen = strategy("psar_trade_assist_v4")
    together = {(r["combo_id"], r["bar_idx"]): r["signal"] for r in chosen.signals(bars, sets).collect()}
    for k, own in enumerate(sets):
        for r in chosen.signals(bars, [own]).collect():
            assert together[k, r["bar_idx"]] == r["signal"]
    assert len(together) == 4 * 200 and any(together.values())


def test_hooks_and_shapes(spark):
    seen = []

    class Watched(SmaCross):
        name = "watched"

        def begin(self, config):
            seen.append(config.initial_cash)

    class Gappy(SmaCross):
        name = "gappy"

        def signals(self, bars, sets):
            return super().signals(bars, sets).where("bar_idx <> 7")

    STRATEGIES.update(watched=Watched, gappy=Gappy)
    try:
        backtest.backtest(bars_of(spark, wave(40)), "watched", {"fast": 2, "slow": 5}, Config(initial_cash=7.0))
        with pytest.raises(ValueError, match="no signal"):
            backtest.backtest(bars_of(spark, wave(40)), "gappy", {"fast": 2, "slow": 5})
    finally:
        del STRATEGIES["watched"], STRATEGIES["gappy"]
    assert seen == [7.0]
    bars = bars_of(spark, wave(10))
    full = strategy("sma_cross").signals(bars, [{"fast": 2, "slow": 5}])
    assert describe.checked_signals(bars, full) is full
    with pytest.raises(ValueError, match="no signal"):
        describe.checked_signals(bars, full.where("bar_idx <> 3"))


def test_registry_of_indicators():
    r = indicators.Registry()
    for version in ("1.2.0", "1.10.0", "0.9.9"):
        r.register("Mean", version, version)
    assert r.get("mean") == "1.10.0" and r.get("MEAN", "0.9.9") == "0.9.9" and r.names() == ["mean"] and r.versions("mean") == ["0.9.9", "1.2.0", "1.10.0"]
    for bad in (lambda: r.get("other"), lambda: r.get("mean", "3.0.0")):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(ValueError):
        r.register("mean", None, "1.0")
    assert "sma" in indicators.REGISTRY.names()


def test_cost_models_by_name(spark):
    assert slippage_of("fixed", 0.5, 0.0) == FixedSlippage(0.5) and commission_of("fixed", 1.5, []) == FixedCommission(1.5)
    for bad in (lambda: slippage_of("what", 1, 1), lambda: commission_of("what", 1, [])):
        with pytest.raises((KeyError, ValueError)):
            bad()
    own = {"xauusd": {"multiplier": 50, "min_tick": 0.05, "sessions": [["01:00", "23:00"]]}}
    assert contract_of(" XAUUSD ", own) == ContractSpec("XAUUSD", 50.0, 0.05, (("01:00", "23:00"),)) and contract_of("xauusd").multiplier == 100.0
    with pytest.raises(ValueError):
        contract_of("A", {"A": {"sessions": [["0100", "23:00"]]}})
    twice = spark.createDataFrame([("A", 2.0, 0.1), ("a ", 3.0, 0.1)], "symbol string, multiplier double, min_tick double")
    assert [r["multiplier"] for r in with_contracts(bars_of(spark, [1.0, 2.0]), twice).collect()] == [3.0, 3.0]


def test_reordering_matters_for_drawdowns(spark):
    falls = [0.0] + [-0.1] * 5 + [0.1] * 5
    level, rows = 100.0, []
    for k, x in enumerate(falls):
        level *= 1 + x
        rows.append((0, k, level, x))
    equity = spark.createDataFrame(rows, "combo_id long, bar_idx int, equity double, ret double")
    worst = stability.permutation_test(equity, ["combo_id"], 100, statistic="max_drawdown").first()
    assert worst["p_value"] > 0.9 and worst["max_drawdown"] == pytest.approx(0.9**5 - 1)
    assert stability.permutation_test(equity, ["combo_id"], 100).first()["p_value"] == 1.0
    assert stability.permutation_test(equity, ["combo_id"], 100, statistic="max_drawdown").first() == worst


def brute_lots(trades):
    """First in, first out, lot by lot."""
    books, out = {}, []
    for nth, (symbol, side, quantity, price) in enumerate(trades):
        book, sign = books.setdefault(symbol, []), 1 if side == "BUY" else -1
        while quantity and book and book[0][0] * sign < 0:
            closed = min(quantity, abs(book[0][0]))
            out.append((symbol, nth, closed * (price - book[0][1]) * -sign))
            quantity -= closed
            book[0][0] += sign * closed
            if not book[0][0]:
                book.pop(0)
        if quantity:
            book.append([sign * quantity, price])
    return out


def test_lots_equal_a_loop(spark):
    import random

    draw = random.Random(4)
    trades = [(draw.choice("XY"), draw.choice(["BUY", "SELL"]), draw.choice([1, 2, 3, 5]) * 0.25, float(draw.randrange(50, 150))) for _ in range(400)]
    rows = spark.createDataFrame([(0, k, *t) for k, t in enumerate(trades)], "combo_id long, bar_idx int, symbol string, side string, quantity double, price double")
    found = sorted((r["symbol"], r["bar_idx"], r["lot"], r["pnl"]) for r in metrics.realised(rows).collect())
    assert [(s, n, round(p, 9)) for s, n, _, p in found] == sorted(((s, n, round(p, 9)) for s, n, p in brute_lots(trades)), key=lambda x: x[:2])


def test_runs_of_any_length_are_written(spark, tmp_path):
    bars = bars_of(spark, wave(60))
    run = backtest.backtest(bars, "sma_cross", {"fast": 3, "slow": 8, "seed": "7"}, Config(period_preset="minute"))
    audit.write(run, str(tmp_path / "run"))
    assert all(audit.replay_written(str(tmp_path / "run"), bars).values())
    assert not audit.replay_written(str(tmp_path / "run"), bars.withColumn("close", F.col("close") * 1.5))["equity"]
    bundle = audit.bundle_of(run)
    assert bundle.seed == 7 and audit.seed_of({"seed": "x", "random_seed": 3}) == 3 and audit.seed_of({}) is None
    audit.save(bundle, str(tmp_path / "b.zip"))
    assert dataclasses.asdict(audit.load(str(tmp_path / "b.zip")))["measures"].keys() == bundle.measures.keys()


def test_pages(spark, tmp_path):
    found = search.Found("grid", "sharpe", True, [({"fast": f, "slow": s}, float(f * s)) for f in (1, 2) for s in (3, 4)])
    text = report.search_page(found)
    assert text.count("<rect") == 4 and "8" in text
    assert report.drawing([(0, 1.0), (1, 0.5), (2, 2.0)]).count("<svg") == 2 and "-50.00%" in report.drawing([(0, 1.0), (1, 0.5), (2, 2.0)])
    assert "1000 / 1200" in report.shown(spark.range(1200))
    assert "<td>" in report.walk_forward_page(walkforward.Outcome([(walkforward.Fold(1, 0, 5, 5, 8), {"a": 1}, {k: 1.0 for k in metrics.PERFORMANCE}, {k: 2.0 for k in metrics.PERFORMANCE})]))
    try:
        import weasyprint  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            report.to_pdf("x", str(tmp_path / "x.pdf"))


def test_parquet_files_are_bars_too(spark, tmp_path):
    rows = bars_of(spark, wave(20)).select(F.col("ts").alias("datetime"), "open", "high", "low", "close", "volume")
    rows.coalesce(1).write.parquet(str(tmp_path / "aaa"))
    assert {r["symbol"] for r in files.load(spark, str(tmp_path)).collect()} == {"AAA"} and files.load(spark, str(tmp_path)).count() == 20
    assert math.isclose(files.load(spark, str(tmp_path)).agg(F.sum("close")).first()[0], sum(wave(20)))


def test_lots_of_tied_trades_do_not_depend_on_how_rows_lie(spark):
    tied = [(0, 5, "X", "SELL", 2.0, 105.0), (0, 5, "X", "BUY", 3.0, 101.0), (0, 5, "X", "BUY", 3.0, 100.0), (0, 5, "X", "BUY", 1.0, 102.0), (0, 5, "X", "SELL", 1.0, 104.0)]
    rows = [*tied, (0, 6, "X", "SELL", 4.0, 110.0), (0, None, "X", "BUY", 9.0, 1.0)]
    kinds = "combo_id long, bar_idx int, symbol string, side string, quantity double, price double"
    # purchases of 1 at 102, 3 at 100, 3 at 101; then sales of 1 at 104, 2 at 105, 4 at 110; without a bar: last
    expected = [(4, 0, 2.0), (5, 0, 10.0), (6, 0, 10.0), (6, 1, 27.0)]
    for each in (rows, rows[::-1], rows[3:] + rows[:3]):
        found = metrics.realised(spark.createDataFrame(each, kinds).coalesce(1))
        assert sorted((r["trade"], r["lot"], r["pnl"]) for r in found.collect()) == expected
