"""Files, bars, alignment and contracts on small data."""

import pytest
from barloom.functions.costs import ContractSpec, contract_of
from barloom.operators import bars
from barloom.sources import files
from pyspark.sql import functions as F


def make(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts string, open double, high double, low double, close double, volume double").withColumn("ts", F.col("ts").cast("timestamp"))


def test_files_are_read_by_folder_with_bom_bad_times_and_repeats(spark, tmp_path):
    for name, header in (("aaa", "﻿DateTime,Open,HIGH,low,close, Volume"), ("BBB", "date,open,high,low,close,volume")):
        (tmp_path / name).mkdir()
        lines = [header, "2024-01-01T09:30:00,1,2,0.5,1.5,10", "2024-01-01T09:31:00,2,3,1,2,10", "nonsense,1,1,1,1,1", "2024-01-01T09:31:00,4,5,3,4,10"]
        (tmp_path / name / "x.csv").write_text("\n".join(lines), encoding="utf-8")
    out = files.load(spark, str(tmp_path)).orderBy("symbol", "bar_idx").collect()
    assert [(r["symbol"], r["bar_idx"], r["close"]) for r in out] == [("AAA", 0, 1.5), ("AAA", 1, 4.0), ("BBB", 0, 1.5), ("BBB", 1, 4.0)]
    assert files.load(spark, str(tmp_path), ["BBB"]).count() == 2
    cache = str(tmp_path / "cache")
    assert files.load(spark, str(tmp_path / "aaa"), cache=cache).count() == files.load(spark, str(tmp_path / "aaa"), cache=cache).count() == 2
    with pytest.raises(FileNotFoundError):
        files.load(spark, str(tmp_path), ["nobody"])
    (tmp_path / "aaa" / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="empty.csv"):
        files.load(spark, str(tmp_path / "aaa"))


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="volume"):
        bars.normalise(spark.createDataFrame([("2024-01-01", 1.0, 1.0, 1.0, 1.0)], "datetime string, open double, high double, low double, close double"))


def test_alignment_fills_one_row_back_and_repairs_the_start(spark):
    t = [f"2024-01-01 00:0{k}:00" for k in range(5)]
    rows = [("A", x, 1.0 + k, 2.0 + k, 0.5 + k, 1.0 + k, 5.0) for k, x in enumerate(t)] + [("B", t[3], 9.0, 9.0, 9.0, 9.0, 7.0)]
    out = [tuple(r) for r in bars.align(make(spark, rows)).where("symbol = 'B'").orderBy("bar_idx").select("bar_idx", "close", "volume").collect()]
    # one row before takes prices and no volume; those before it are copies of that row; later ones carry prices
    assert out == [(0, 9.0, 0.0), (1, 9.0, 0.0), (2, 9.0, 0.0), (3, 9.0, 7.0), (4, 9.0, 0.0)]


def test_validation_names_the_rule(spark):
    with pytest.raises(ValueError, match="high below low"):
        bars.validate(make(spark, [("A", "2024-01-01 00:00:00", 1.0, 1.0, 2.0, 1.0, 1.0)]))


def test_week_buckets_end_on_sunday(spark):
    out = bars.resample(make(spark, [("A", "2024-01-03 10:00:00", 1.0, 2.0, 0.5, 1.5, 1.0), ("A", "2024-01-06 10:00:00", 2.0, 4.0, 1.5, 3.0, 2.0)]), "week").collect()
    assert [(str(r["ts"]), r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in out] == [("2024-01-07 00:00:00", 1.0, 4.0, 0.5, 3.0, 3.0)]


def test_contracts():
    assert contract_of("xauusd").multiplier == 100.0 and contract_of("else").min_tick == 0.0001
    assert contract_of("XAUUSD", {"xauusd": {"multiplier": 50, "sessions": [["01:00", "23:00"]]}}).sessions == (("01:00", "23:00"),)
    with pytest.raises(ValueError):
        ContractSpec("A", sessions=(("0100", "23:00"),))


def test_empty_bars(spark):
    assert bars.align(make(spark, [])).count() == 0
