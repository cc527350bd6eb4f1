"""Bars derived from the tables of events, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import align, of_ticks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Bars of the values of each type of event."""
    return of_ticks(table(spark, sf_dir, "events"), "event_type", "ts", F.col("value"), F.lit(1), unit, ["event_id"])


def aligned_events(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    return align(event_bars(spark, sf_dir, unit))


def order_bars(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataFrame:
    """Bars of order totals by priority."""
    return of_ticks(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", F.col("o_totalprice"), F.lit(1), unit, ["o_orderkey"])


def lineitem_bars(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataFrame:
    """Bars of unit prices by return flag."""
    price = F.col("l_extendedprice") / F.when(F.col("l_quantity") != 0, F.col("l_quantity"))
    return of_ticks(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_shipdate", price, F.col("l_quantity"), unit, ["l_orderkey", "l_linenumber"])


def line_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades of their part's brand of flag: returned ones sell, others buy."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    return rows.select(
        F.lit(0).cast("long").alias("combo_id"), F.concat("l_linestatus", F.lit("-"), (F.col("l_suppkey") % 7).cast("string")).alias("symbol"), F.when(F.col("l_returnflag") == "N", "BUY").otherwise("SELL").alias("side"),
        F.col("l_quantity").alias("quantity"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 0).alias("price"), F.lit(1.0).alias("cost"), "l_shipdate", "l_orderkey", "l_linenumber",
    )
