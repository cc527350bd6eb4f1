"""Live bars and averages, and orders that reach a gateway."""

import random

import pytest
from barloom.operators import indicators
from barloom.sources import tables
from barloom.streaming import bars as live
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def ticks(spark, folder):
    events = tables.table(spark, DATA, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"))
    for k in range(3):
        events.where(F.dayofmonth("ts").between(10 * k + 1, 10 * k + 10)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)


def test_live_bars_equal_batch_bars(spark, tmp_path):
    out = live.live_bars(ticks(spark, str(tmp_path / "in")), late="30 days").writeStream.format("memory").queryName("live_bars").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    found = {(r["symbol"], r["ts"], r["open"], r["close"], r["volume"]) for r in spark.table("live_bars").collect()}
    batch = {(r["symbol"], r["ts"], r["open"], r["close"], r["volume"]) for r in tables.event_bars(spark, DATA).collect()}
    assert found <= batch


def test_live_average_equals_batch_average(spark, tmp_path):
    bars = tables.aligned_events(spark, DATA).where("symbol = 'click'")
    folder = str(tmp_path / "bars")
    bars.select("symbol", "ts", "close").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("symbol string, ts timestamp, close double").parquet(folder)
    live.live_ema(stream, 12).writeStream.format("memory").queryName("live_ema").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    mine = [r["ema"] for r in spark.table("live_ema").orderBy("ts").collect()]
    theirs = [r["ema"] for r in indicators.ema(bars, 12).orderBy("ts").collect()]
    assert len(mine) == len(theirs) and all(abs(a - b) < 1e-9 for a, b in zip(mine, theirs, strict=True))


def test_orders_reach_the_gateway_once(spark, tmp_path):
    sent = []

    class Book(live.LiveGateway):
        def connect(self): ...

        def disconnect(self): ...

        def submit(self, order):
            sent.append(order["id"])
            return str(order["id"])

        def cancel(self, order_id):
            return True

        def fill_of(self, order_id):
            return None

    folder = str(tmp_path / "orders")
    spark.createDataFrame([(2, "2026-01-02"), (1, "2026-01-01")], "id int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(folder)
    for _ in range(2):
        query = live.send_orders(spark.readStream.schema("id int, ts timestamp").parquet(folder), Book(), str(tmp_path / "check"))
        query.processAllAvailable()
        query.stop()
    assert sent == [1, 2]


def test_late_bars_join_in_order(spark, tmp_path):
    """A stream shuffled within the lateness gives what the batch gives."""
    draw = random.Random(2)
    rows = [(s, 1_770_000_000 + 3600 * k, draw.uniform(1, 9)) for s in ("A", "B") for k in range(60)]
    closes = {(s, at): c for s, at, c in rows}
    mixed = sorted(rows, key=lambda r: r[1] + draw.uniform(0, 6 * 3600))
    mixed += [("A", 1_770_000_000 + 3600 * 500, 1.0)]  # lets the watermark pass all others
    folder, schema = str(tmp_path / "in"), "symbol string, ts timestamp, close double"
    for k in range(0, len(mixed), 30):
        spark.createDataFrame(mixed[k : k + 30], "symbol string, at long, close double").select("symbol", F.timestamp_seconds("at").alias("ts"), "close").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = live.settled_ema(stream, 12, "12 hours").writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {(r["symbol"], int(r["ts"].timestamp())): (r["close"], r["ema"]) for r in spark.table("settled").collect()}
    for s in ("A", "B"):
        value = None
        for at in sorted(t for x, t in closes if x == s):
            value = closes[s, at] if value is None else value + 2 / 13 * (closes[s, at] - value)
            assert found[s, at] == (closes[s, at], pytest.approx(value))
    assert len(found) == 120


class Broker(live.LiveGateway):
    """Keeps orders, and may be killed after some."""

    def __init__(self):
        self.orders, self.kill_after = {}, None

    def connect(self): ...

    def disconnect(self): ...

    def submit(self, order):
        assert order["order_id"] not in self.orders
        self.orders[order["order_id"]] = order["id"]
        if len(self.orders) == self.kill_after:
            raise RuntimeError("killed")
        return order["order_id"]

    def cancel(self, order_id):
        return True

    def fill_of(self, order_id):
        return self.orders.get(order_id)


@pytest.mark.parametrize("kill_after", [1, 2, 3])
def test_a_killed_batch_submits_each_order_once(spark, tmp_path, kill_after):
    folder, broker = str(tmp_path / "orders"), Broker()
    spark.createDataFrame([(k, f"2026-01-0{k}") for k in (1, 2, 3)], "id int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(folder)
    broker.kill_after = kill_after
    for _ in range(3):  # killed after a submission, before the batch is committed; then again, then nothing new
        query = live.send_orders(spark.readStream.schema("id int, ts timestamp").parquet(folder), broker, str(tmp_path / "check"))
        try:
            query.processAllAvailable()
        except Exception:
            broker.kill_after = None
        query.stop()
    assert sorted(broker.orders.values()) == [1, 2, 3]
