"""Table functions of Spark SQL against the DataFrame functions."""

import pytest
from barloom.config import Config
from barloom.operators import indicators
from barloom.operators.strategies import strategy
from barloom.plans import backtest, sql_functions
from pyspark.errors import PythonException
from tests.test_engine import bars_of, wave

CALLS = {
    "sma(BARS, 5)": (lambda b: indicators.sma(b, 5), ["sma"]),
    "ema(BARS, 7)": (lambda b: indicators.ema(b, 7), ["ema"]),
    "wilder(BARS, 7)": (lambda b: indicators.wilder(b, 7), ["wilder"]),
    "rsi(BARS, 9)": (lambda b: indicators.rsi(b, 9), ["rsi"]),
    "macd(BARS, 3, 8, 4)": (lambda b: indicators.macd(b, 3, 8, 4), ["macd", "macd_signal", "macd_hist"]),
    "sma_cross(BARS, 3, 8)": (lambda b: strategy("sma_cross").signals(b, [{"fast": 3, "slow": 8}]), ["signal"]),
    "rsi_mean_reversion(BARS, 9, 40.0, 60.0)": (lambda b: strategy("rsi_mean_reversion").signals(b, [{"window": 9, "lower": 40.0, "upper": 60.0}]), ["signal"]),
}


def called(spark, call):
    return spark.sql("SELECT * FROM " + call.replace("BARS", "TABLE(some_bars) PARTITION BY symbol ORDER BY (bar_idx)"))


@pytest.mark.parametrize("call", CALLS)
def test_table_functions_equal_data_frames(spark, call):
    bars = bars_of(spark, wave(70)).unionByName(bars_of(spark, [9.0] * 70, "B")).repartition(5)
    bars.createOrReplaceTempView("some_bars")
    sql_functions.register(spark)
    make, columns = CALLS[call]
    found, expected = ({(r["symbol"], r["bar_idx"]): [r[c] for c in columns] for r in df.collect()} for df in (called(spark, call), make(bars)))
    assert found.keys() == expected.keys() and len(found) == 140
    for key, values in expected.items():
        assert found[key] == pytest.approx(values, abs=1e-9), key


def test_wrong_parameters_and_views(spark):
    bars = bars_of(spark, wave(30))
    bars.createOrReplaceTempView("some_bars")
    sql_functions.register(spark)
    with pytest.raises(PythonException):
        called(spark, "sma_cross(BARS, 8, 3)").collect()
    bars.limit(0).createOrReplaceTempView("some_bars")
    assert called(spark, "ema(BARS, 3)").count() == 0
    run = backtest.backtest(bars, "sma_cross", {"fast": 3, "slow": 8}, Config())
    names = sql_functions.views(run, "run_")
    assert names == ["run_bars", "run_signals", "run_equity", "run_trades", "run_risk_events"]
    row = spark.sql("SELECT count(*) AS n, max(e.equity) AS top FROM run_equity e JOIN run_signals s USING (bar_idx)").first()
    assert row["n"] == 30 and row["top"] > 0
