"""Bars and averages of live ticks with Structured Streaming."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_bars(ticks: DataFrame, bucket: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars (symbol, ts, prices, volume) of a stream of ticks (symbol, ts, price, size), as buckets close.

    Ticks later than `late` are left out; state is one row for each open bucket and symbol.
    """
    order = F.col("ts")
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", bucket)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume")
    )
    return out.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def live_ema(bars: DataFrame, span: int) -> DataFrame:
    """symbol, ts, close, ema for each bar of a stream, in order of time within a batch.

    The state of a symbol is its last average and the time of its last bar. Bars must come in order from batch to batch, as those of live_bars() do;
    a bar that is not later than the last one has a null average and changes nothing.
    """
    weight = 2 / (span + 1)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        value, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for at, close in zip(rows["ts"].astype("int64"), rows["close"], strict=True):
            if last is not None and at <= last:
                out.append(None)
                continue
            value, last = close if value is None else value + weight * (close - value), at
            out.append(value)
        if value is not None:
            state.update((float(value), int(last)))
        yield rows.assign(ema=pd.Series(out, index=rows.index, dtype="float64"))[["symbol", "ts", "close", "ema"]]

    rows = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close")
    return rows.groupBy("symbol").applyInPandasWithState(update, "symbol string, ts timestamp, close double, ema double", "value double, last long", "append", "NoTimeout")


def settled_ema(bars: DataFrame, span: int, late: str) -> DataFrame:
    """symbol, ts, close, ema of a stream of bars that come in any order, as long as none is later than `late`: what the batch gives.

    Bars wait in the state of their symbol until the watermark says that no earlier one can come, and then join the average in order of time; a
    timer wakes symbols without new bars. Of bars with one time the last to come counts. Later bars than `late` are left out. The state of a symbol is its last average and
    the bars of the last `late`.
    """
    weight = 2 / (span + 1)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        value, last, times, closes = state.get if state.exists else (None, None, [], [])
        waiting = dict(zip(times, closes, strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                waiting |= zip((frame["ts"].astype("datetime64[us]").astype("int64")).tolist(), frame["close"].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs() * 1000
        out = []
        for at in sorted(t for t in waiting if t <= mark):
            close = waiting.pop(at)
            if last is not None and at <= last:
                continue
            value, last = close if value is None else value + weight * (close - value), at
            out.append((key[0], pd.Timestamp(at, unit="us"), close, value))
        times = sorted(waiting)
        state.update((None if value is None else float(value), last, times, [float(waiting[t]) for t in times]))
        if times:
            state.setTimeoutTimestamp(max(times[0] // 1000 + 1, mark // 1000 + 1))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "ema"]).astype({"ts": "datetime64[us]"})

    rows = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close").withWatermark("ts", late)
    return rows.groupBy("symbol").applyInPandasWithState(update, "symbol string, ts timestamp, close double, ema double", "value double, last long, times array<long>, closes array<double>", "append", "EventTimeTimeout")


class LiveGateway(ABC):
    """What a broker must offer. Each order has an order_id, by which the broker tells whether it has it."""

    @abstractmethod
    def connect(self) -> None: ...

    @abstractmethod
    def disconnect(self) -> None: ...

    @abstractmethod
    def submit(self, order: dict) -> str: ...

    @abstractmethod
    def cancel(self, order_id: str) -> bool: ...

    @abstractmethod
    def fill_of(self, order_id: str) -> dict | None:
        """What is known of an order; None of one that never came."""


def send_orders(orders: DataFrame, gateway: LiveGateway, checkpoint: str):
    """Starts a stream that submits each batch of orders, in order of time, each order once.

    An order's id is its batch and its place in it (by time, then a hash of the order). Before a batch is submitted its number is written to a ledger
    beside the checkpoint, and after it again. A batch that failed, or whose query was killed, comes again with the same number: the ledger shows whether it was begun,
    and if so the gateway is asked for each order before it is submitted; one that was finished isn't submitted again at all.
    """
    spark, ledger = orders.sparkSession, f"{checkpoint}/orders-ledger"

    def written(number: int) -> set[str]:
        try:
            return {r.what for r in spark.read.schema("batch long, what string").parquet(ledger).where(F.col("batch") == number).collect()}
        except AnalysisException:  # nothing has been written yet
            return set()

    def note(number: int, what: str) -> None:
        spark.createDataFrame([(number, what)], "batch long, what string").coalesce(1).write.mode("append").parquet(ledger)

    def submit(batch: DataFrame, number: int) -> None:
        earlier = written(number)
        if "done" in earlier:
            return
        note(number, "begun")
        placed = batch.orderBy("ts", F.xxhash64(*batch.columns)).toLocalIterator()
        for k, order in enumerate(placed):
            order_id = f"{number}-{k}"
            if not earlier or gateway.fill_of(order_id) is None:
                gateway.submit({**order.asDict(), "order_id": order_id})
        note(number, "done")

    return orders.writeStream.foreachBatch(submit).option("checkpointLocation", checkpoint).start()
