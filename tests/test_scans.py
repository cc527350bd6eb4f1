"""Scans in two levels, merged summaries and speculative stretches against plain windows and loops."""

import math
import random

import pytest
from barloom.functions.costs import PercentCommission, PercentSlippage
from barloom.operators import bars as bar_ops
from barloom.operators import indicators, metrics, portfolio, scan
from barloom.operators.strategies import strategy
from pyspark.sql import functions as F
from tests.test_engine import bars_of, wave


@pytest.fixture()
def uncoalesced(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(spark, n=50, symbols=("A", "B"), seed=1, empty=0.3):
    draw = random.Random(seed)
    rows = [(s, k, None if draw.random() < empty or (s == "B" and k < 17) else round(draw.uniform(-5, 5), 3)) for s in symbols for k in range(n)]
    return rows, spark.createDataFrame(rows, "symbol string, bar_idx int, x double").repartition(3)


@pytest.mark.parametrize(("n", "size"), [(50, 7), (49, 7), (7, 7), (1, 7), (50, 1), (50, 1000)])
def test_running_equals_a_loop(spark, n, size):
    rows, df = rows_of(spark, n)
    wanted = {k: (k, F.col("x")) for k in ("sum", "max", "min", "last", "next")}
    found = {(r["symbol"], r["bar_idx"]): r for r in scan.running(df, ["symbol"], wanted, rows=size).collect()}
    plain = {(r["symbol"], r["bar_idx"]): r for r in scan.running(df, ["symbol"], wanted, long=False).collect()}
    assert len(found) == len(plain) == 2 * n
    for s in "AB":
        seen, own = [], [x for t, _, x in rows if t == s]
        for k, x in enumerate(own):
            seen += [] if x is None else [x]
            r = found[s, k]
            assert (r["max"], r["min"], r["last"], r["next"]) == (max(seen, default=None), min(seen, default=None), seen[-1] if seen else None, own[k + 1] if k + 1 < n else None)
            assert r["sum"] == (pytest.approx(sum(seen), abs=1e-9) if seen else None)
            assert [r[c] for c in ("max", "min", "last", "next")] == [plain[s, k][c] for c in ("max", "min", "last", "next")]


def test_one_series_is_many_tasks(uncoalesced):
    df = uncoalesced.range(40_000).select(F.lit("A").alias("symbol"), F.col("id").cast("int").alias("bar_idx"), F.sin("id").alias("x"))
    found = scan.running(df, ["symbol"], {"sum": ("sum", F.col("x")), "top": ("max", F.col("x"))}, rows=1000).withColumn("task", F.spark_partition_id())
    most = found.groupBy("task").count().agg(F.max("count")).first()[0]
    assert found.count() == 40_000 and most < 30_000
    assert found.where("bar_idx = 39999").first()["sum"] == pytest.approx(sum(math.sin(k) for k in range(40_000)), abs=1e-6)


def gappy(spark):
    rows, draw = [], random.Random(4)
    for s in ("A", "B", "C"):
        for k in range(60):
            if draw.random() < 0.6 and not (s == "B" and k < 20):
                p = None if draw.random() < 0.1 else float("nan") if draw.random() < 0.05 else draw.uniform(1, 9)
                rows.append((s, 1_770_000_000 + 7000 * k, p, p, p, p, None if draw.random() < 0.2 else 5.0))
    return spark.createDataFrame(rows, "symbol string, at long, open double, high double, low double, close double, volume double").select("symbol", F.timestamp_seconds("at").alias("ts"), "open", "high", "low", "close", "volume")


def test_alignment_in_stretches_is_the_same(spark, monkeypatch):
    bars = gappy(spark)
    expected = sorted(map(str, map(tuple, bar_ops.align(bars).select("symbol", "ts", "bar_idx", *bar_ops.FIELDS).collect())))
    monkeypatch.setattr(scan, "PART_ROWS", 7)
    found = bar_ops.align(bars).select("symbol", "ts", "bar_idx", *bar_ops.FIELDS)
    assert sorted(map(str, map(tuple, found.collect()))) == expected and len(expected) > 150
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(symbol" not in "".join(line for line in plan.split("\n") if "_part" not in line and "Window" in line)


def test_curves_and_measures_in_stretches_are_the_same(spark, monkeypatch):
    bars = bars_of(spark, [100 + 30 * math.sin(k / 5) + (k * 37 % 11) for k in range(150)]).cache()
    signals = strategy("sma_cross").signals(bars, [{"fast": 2, "slow": 5}, {"fast": 3, "slow": 9}]).cache()
    market = metrics.market_returns(bars).cache()

    def all_of(cash):
        curve = portfolio.vector(signals, PercentSlippage(0.002), PercentCommission(0.002), cash=cash)
        flat = [r for df in (curve.orderBy("combo_id", "bar_idx"), metrics.performance(curve, ["combo_id"], 1000.0, market=market).orderBy("combo_id"), metrics.risk(curve, ["combo_id"]).orderBy("combo_id")) for r in df.drop("ts").collect()]
        return [x for r in flat for x in r]

    for cash in (1000.0, 60.0):  # in the second, equity touches 0
        monkeypatch.setattr(scan, "PART_ROWS", 1 << 16)
        whole = all_of(cash)
        monkeypatch.setattr(scan, "PART_ROWS", 7)
        assert all_of(cash) == pytest.approx(whole, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("kind", ["random", "trending", "flat"])
def test_stop_levels_in_stretches_are_the_same_to_the_bit(uncoalesced, monkeypatch, kind):
    draw, price, rows = random.Random(6), 100.0, []
    for k in range(900):
        price += draw.gauss(0.5 if kind == "trending" else 0.0, 0.0 if kind == "flat" else 1.0)
        rows.append(("A", k, price + abs(draw.gauss(0, 0.5)) * (kind != "flat"), price - 0.3 * (kind != "flat"), price))
    bars = uncoalesced.createDataFrame(rows, "symbol string, bar_idx int, high double, low double, close double").repartition(3).cache()
    expected = [r["sar"] for r in indicators.parabolic_sar(bars).orderBy("bar_idx").collect()]
    monkeypatch.setattr(scan, "PART_ROWS", 100)
    found = indicators.parabolic_sar(bars).withColumn("task", F.spark_partition_id()).orderBy("bar_idx").collect()
    assert [r["sar"] for r in found] == expected
    assert kind != "random" or len({r["task"] for r in found}) > 1


def test_states_that_never_agree_are_folded(spark):
    df = spark.range(60).select(F.lit("A").alias("symbol"), F.col("id").cast("int").alias("bar_idx"))
    count = lambda s, r: (s + 1, (s,))  # noqa: E731  a state that forgets nothing
    found = scan.speculative(df, ["symbol"], "bar_idx", ["bar_idx"], lambda: 0, count, "n long", rows=5).orderBy("bar_idx").collect()
    assert [r["n"] for r in found] == list(range(60))
    assert scan.speculative(df.limit(0), ["symbol"], "bar_idx", ["bar_idx"], lambda: 0, count, "n long", rows=5).count() == 0
