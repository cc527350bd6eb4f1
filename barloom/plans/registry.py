"""Registered queries and their SQL oracles: one or more for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import columns, costs
from barloom.operators import bars as bar_ops
from barloom.operators import indicators as ind
from barloom.operators import assist_v4, metrics, portfolio, scan, search, stability, strategies, walkforward  # noqa: F401  assist_v4 registers itself
from barloom.plans import oracles as sql
from barloom.plans import sql_functions, state_sql
from barloom.plans.oracles import BAR_ROW, HOURLY, W, over_bars, r, rows, smoothed
from barloom.plans.state_sql import ADX, RSI
from barloom.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
HOURS = 252.0 * 24
SLIPPAGE, COMMISSION = costs.PercentSlippage(0.0001), costs.PercentCommission(0.0002)
TERMS = search.Terms(SLIPPAGE, COMMISSION, periods=HOURS)


def _rounded(c: str) -> Column:
    """To six places by the arithmetic of oracles.r(), so that both engines round alike."""
    return F.when(F.abs(c) < 1e12, F.floor(F.col(c) * 1_000_000 + 0.5) / 1_000_000).otherwise(F.col(c)).alias(c)


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name; doubles are rounded to six places."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.select(*[_rounded(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _stamped(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), *bar_ops.FIELDS)


def _indexed(bars: DataFrame, *names: str) -> DataFrame:
    return bars.select("symbol", F.col("bar_idx").cast("int").alias("bar_idx"), *names)


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.aligned_events(spark, sf_dir)


# Bars


@query(over_bars(f"SELECT {BAR_ROW} FROM raw", base=HOURLY))
def bars_hour(spark, sf_dir):
    return _stamped(tables.event_bars(spark, sf_dir))


@query(f"""SELECT o_orderpriority AS symbol, epoch(date_trunc('day', o_orderdate))::BIGINT AS at, {r("first(o_totalprice ORDER BY o_orderdate, o_orderkey)", "open")}, {r("max(o_totalprice)", "high")},
  {r("min(o_totalprice)", "low")}, {r("last(o_totalprice ORDER BY o_orderdate, o_orderkey)", "close")}, {r("count(*)::DOUBLE", "volume")} FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1, 2""")
def bars_day_orders(spark, sf_dir):
    return _stamped(tables.order_bars(spark, sf_dir))


@query(f"""WITH p AS (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem WHERE l_quantity <> 0 AND l_returnflag IS NOT NULL)
SELECT l_returnflag AS symbol, epoch(date_trunc('day', l_shipdate))::BIGINT AS at, {r("first(price ORDER BY l_shipdate, l_orderkey, l_linenumber)", "open")}, {r("max(price)", "high")}, {r("min(price)", "low")},
  {r("last(price ORDER BY l_shipdate, l_orderkey, l_linenumber)", "close")}, {r("sum(l_quantity)", "volume")} FROM p WHERE price IS NOT NULL GROUP BY 1, 2""")
def bars_day_lineitem(spark, sf_dir):
    return _stamped(tables.lineitem_bars(spark, sf_dir))


def _resampled(bucket: str) -> str:
    return over_bars(
        f"SELECT symbol, epoch({bucket})::BIGINT AS at, {r('first(open ORDER BY ts)', 'open')}, {r('max(high)', 'high')}, {r('min(low)', 'low')}, {r('last(close ORDER BY ts)', 'close')}, {r('sum(volume)', 'volume')} FROM raw GROUP BY 1, 2", base=HOURLY
    )


@query(_resampled("time_bucket(INTERVAL '6 hours', ts)"))
def resample_6h(spark, sf_dir):
    return _stamped(bar_ops.resample(tables.event_bars(spark, sf_dir), "6 hours"))


@query(_resampled("to_timestamp((SELECT min(epoch(date_trunc('day', ts))) FROM raw) + floor((epoch(ts) - (SELECT min(epoch(date_trunc('day', ts))) FROM raw)) / 25200) * 25200)"))
def resample_7h(spark, sf_dir):
    return _stamped(bar_ops.resample(tables.event_bars(spark, sf_dir), "7 hours"))


@query(_resampled("date_trunc('week', ts) + INTERVAL 6 DAYS"))
def resample_week(spark, sf_dir):
    return _stamped(bar_ops.resample(tables.event_bars(spark, sf_dir), "week"))


@query(_resampled("last_day(ts)::TIMESTAMP"))
def resample_month(spark, sf_dir):
    return _stamped(bar_ops.resample(tables.event_bars(spark, sf_dir), "month"))


@query(over_bars(f"SELECT bar_idx, {BAR_ROW} FROM bars"))
def align_fill(spark, sf_dir):
    rows_ = _all(spark, sf_dir)
    return rows_.select(F.col("bar_idx").cast("int").alias("bar_idx"), "symbol", F.unix_timestamp("ts").alias("at"), *bar_ops.FIELDS)


@query(
    over_bars("""SELECT symbol, count(CASE WHEN high < low THEN 1 END) AS high_below_low, count(CASE WHEN open <= 0 OR high <= 0 OR close <= 0 THEN 1 END) AS price_not_positive,
  count(CASE WHEN volume < 0 THEN 1 END) AS volume_negative, count(CASE WHEN close IS NULL THEN 1 END) AS prices_not_finite, count(CASE WHEN volume IS NULL THEN 1 END) AS volume_not_finite FROM grid GROUP BY 1""")
)
def bar_problems(spark, sf_dir):
    return bar_ops.problems(bar_ops.on_calendar(tables.event_bars(spark, sf_dir)))


@query(over_bars(f"SELECT symbol, bar_idx - 24 AS bar_idx, {r('close', 'close')} FROM bars WHERE bar_idx >= 24 AND bar_idx < 240"))
def slice_bars(spark, sf_dir):
    return _indexed(bar_ops.part(_all(spark, sf_dir), 24, 240), "close")


@query("""SELECT o_custkey AS customer, epoch(o_orderdate)::BIGINT AS at, arg_max(o_orderkey, o_orderkey) AS last_order FROM orders GROUP BY 1, 2""")
def dedupe_keep_last(spark, sf_dir):
    rows_ = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at"), F.col("o_orderkey").alias("last_order"))
    return bar_ops.keep_last(rows_, ["last_order"], ["customer", "at"])


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each type of event, those of each ten days' stretch as a contract."""
    bars = tables.event_bars(spark, sf_dir)
    return bars.withColumn("seq", F.floor((F.dayofmonth("ts") - 1) / 10).cast("int")).withColumn("contract", F.concat(F.lit("C"), F.col("seq").cast("string")))


def _continuous(change: str, step: str) -> str:
    return over_bars(
        f"SELECT symbol, epoch(ts)::BIGINT AS at, contract, {r(f'open {change} shift', 'open')}, {r(f'close {change} shift', 'close')}, {r('volume', 'volume')} FROM c JOIN moved USING (symbol, seq)",
        "c AS (SELECT *, ((day(ts) - 1) // 10)::INTEGER AS seq, 'C' || ((day(ts) - 1) // 10)::INTEGER AS contract FROM raw)",
        "edges AS (SELECT symbol, seq, arg_min(close, ts) AS first_close, arg_max(close, ts) AS last_close FROM c GROUP BY symbol, seq)",
        f"moved AS (SELECT symbol, seq, {step} AS shift FROM (SELECT *, lag(last_close) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM edges))",
        base=HOURLY,
    )


@query(_continuous("+", "sum(coalesce(before - first_close, 0)) OVER (PARTITION BY symbol ORDER BY seq)"))
def continuous_difference(spark, sf_dir):
    out = bar_ops.continuous(_contracts(spark, sf_dir), keys=["symbol"])
    return out.select("symbol", F.unix_timestamp("ts").alias("at"), "contract", "open", "close", "volume")


@query(_continuous("*", "exp(sum(ln(coalesce(before / first_close, 1))) OVER (PARTITION BY symbol ORDER BY seq))"))
def continuous_ratio(spark, sf_dir):
    out = bar_ops.continuous(_contracts(spark, sf_dir), method="ratio", keys=["symbol"])
    return out.select("symbol", F.unix_timestamp("ts").alias("at"), "contract", "open", "close", "volume")


# Indicators


def _over(names: list[tuple[str, str]], *ctes: str, source: str = "bars", recursive: bool = False) -> str:
    return over_bars(f"SELECT symbol, bar_idx, {', '.join(r(e, n) for e, n in names)} FROM {source}", *ctes, recursive=recursive)


@query(_over([(f"CASE WHEN bar_idx >= 19 THEN avg(close) OVER {rows(20)} END", "sma")]))
def sma(spark, sf_dir):
    return _indexed(ind.added(_all(spark, sf_dir), [("sma", {"window": 20})]), "sma")


@query(_over([("v", "ema")], smoothed("e", "bars", "close", "2.0::DOUBLE / 13"), source="e", recursive=True))
def ema(spark, sf_dir):
    return _indexed(ind.added(_all(spark, sf_dir), [("ema", {"span": 12})]), "ema")


@query(_over([("v", "wilder")], smoothed("e", "bars", "close", "1.0::DOUBLE / 14"), source="e", recursive=True))
def wilder(spark, sf_dir):
    return _indexed(ind.added(_all(spark, sf_dir), [("wilder", {"window": 14})]), "wilder")


@query(_over([("rsi", "rsi")], *RSI, source="rsis", recursive=True))
def rsi(spark, sf_dir):
    return _indexed(ind.added(_all(spark, sf_dir), [("rsi", {})]), "rsi")


@query(
    _over(
        [("m.macd", "macd"), ("s.v", "macd_signal"), ("m.macd - s.v", "macd_hist")], smoothed("f", "bars", "close", "2.0::DOUBLE / 13"), smoothed("w", "bars", "close", "2.0::DOUBLE / 27"),
        "m AS MATERIALIZED (SELECT symbol, bar_idx, f.v - w.v AS macd FROM f JOIN w USING (symbol, bar_idx))", smoothed("s", "m", "macd", "2.0::DOUBLE / 10"), source="m JOIN s USING (symbol, bar_idx)", recursive=True,
    )
)
def macd(spark, sf_dir):
    return _indexed(ind.added(_all(spark, sf_dir), [("macd", {})]), "macd", "macd_signal", "macd_hist")


@query(_over([("v", "atr")], sql.RANGES, smoothed("e", "ranges", "tr", "2.0::DOUBLE / 15"), source="e", recursive=True))
def atr(spark, sf_dir):
    return _indexed(ind.added(_all(spark, sf_dir), [("atr", {})]), "atr")


@query(_over([("a.v", "adx"), ("plus_di", "plus_di"), ("minus_di", "minus_di")], *ADX, source="a JOIN dx USING (symbol, bar_idx)", recursive=True))
def adx(spark, sf_dir):
    return _indexed(ind.added(_all(spark, sf_dir), [("adx", {})]), "adx", "plus_di", "minus_di")


@query(_over([("sar", "sar")], state_sql.NEAR, state_sql.stop_levels("sar", 0.02), source="sar", recursive=True))
def parabolic_sar(spark, sf_dir):
    return _indexed(ind.parabolic_sar(_all(spark, sf_dir)), "sar")


_M, _S = f"avg(close) OVER {rows(20)}", f"stddev_pop(close) OVER {rows(20)}"


@query(_over([(f"CASE WHEN bar_idx >= 19 THEN {e} END", n) for e, n in ((f"{_M} + 2 * {_S}", "bb_upper"), (_M, "bb_middle"), (f"{_M} - 2 * {_S}", "bb_lower"))]))
def bollinger(spark, sf_dir):
    return _indexed(ind.added(_all(spark, sf_dir), [("bollinger", {})]), "bb_upper", "bb_middle", "bb_lower")


@query(
    _over(
        [("k", "stoch_k"), (f"CASE WHEN bar_idx >= 2 THEN avg(k) OVER {rows(3)} END", "stoch_d")],
        f"hl AS (SELECT *, max(high) OVER {rows(14)} AS hh, min(low) OVER {rows(14)} AS ll FROM bars)",
        "ks AS (SELECT *, CASE WHEN bar_idx >= 13 THEN (close - ll) * 100 / CASE WHEN hh - ll <> 0 THEN hh - ll ELSE 1 END ELSE 50 END AS k FROM hl)",
        source="ks",
    )
)
def stochastic(spark, sf_dir):
    return _indexed(ind.added(_all(spark, sf_dir), [("stochastic", {})]), "stoch_k", "stoch_d")


@query(_over([(f"CASE WHEN bar_idx >= 19 THEN max(high) OVER {rows(20)} END", "donchian_upper"), (f"CASE WHEN bar_idx >= 19 THEN min(low) OVER {rows(20)} END", "donchian_lower")]))
def donchian(spark, sf_dir):
    return _indexed(ind.added(_all(spark, sf_dir), [("donchian", {})]), "donchian_upper", "donchian_lower")


@query(
    _over(
        [("CASE WHEN bar_idx >= 13 THEN (tp - m) / (0.015 * CASE WHEN d > 0 THEN d ELSE 1e-12 END) END", "cci")],
        "typical AS (SELECT *, (high + low + close) / 3 AS tp FROM bars)", f"lists AS (SELECT *, avg(tp) OVER {rows(14)} AS m, list(tp) OVER {rows(14)} AS l FROM typical)",
        "spread AS (SELECT *, list_sum(list_transform(l, lambda x: abs(x - m))) / 14 AS d FROM lists)", source="spread",
    )
)
def cci(spark, sf_dir):
    return _indexed(ind.added(_all(spark, sf_dir), [("cci", {})]), "cci")


@query(
    _over(
        [("m", "median"), ("CASE WHEN m > 0 THEN atr / m ELSE 1 END", "atr_ratio")], sql.RANGES, smoothed("e", "ranges", "tr", "2.0::DOUBLE / 15"),
        f"ms AS (SELECT symbol, bar_idx, v AS atr, CASE WHEN bar_idx >= 49 THEN median(v) OVER {rows(50)} END AS m FROM e)", source="ms", recursive=True,
    )
)
def atr_ratio(spark, sf_dir):
    found = ind.added(_all(spark, sf_dir), [("atr", {}), ("rolling_median", {"window": 50, "column": "atr"}), ("atr_ratio", {"window": 50})])
    return _indexed(found, "median", "atr_ratio")


_P = f"lag(close) OVER ({W})"


@query(
    _over(
        [
            (f"(close - max(close) OVER ({W})) / max(close) OVER ({W})", "drawdown"), (f"coalesce((close - {_P}) / {_P}, 0)", "simple_return"), (f"coalesce(ln(close) - ln({_P}), 0)", "log_return"),
            (f"coalesce(lag(close, 3) OVER ({W}), 0)", "shifted"), (f"coalesce(last_value(CASE WHEN volume <> 0 THEN volume END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)", "last_volume"),
        ]
    )
)
def series_functions(spark, sf_dir):
    lagged = lambda rows_, own: rows_.withColumns({"simple_return": ind.simple_return(keys=own), "log_return": ind.log_return(keys=own), "shifted": ind.shift("close", 3, keys=own)})
    found = ind.drawdowns(ind.last_values(scan.in_parts(_all(spark, sf_dir), 3, lagged, ["symbol"]), {"last_volume": "volume"}), {"drawdown": "close"})
    return _indexed(found, "drawdown", "simple_return", "log_return", "shifted", "last_volume")


@query(over_bars(f"SELECT bar_idx, {r('market', 'market')} FROM market", sql.MARKET))
def market_returns(spark, sf_dir):
    return metrics.market_returns(_all(spark, sf_dir)).select(F.col("bar_idx").cast("int").alias("bar_idx"), "market")


@query("SELECT event_id, (epoch(date_trunc('day', ts))::BIGINT // 86400)::INTEGER AS day_id, (epoch(date_trunc('day', ts))::BIGINT // 604800)::INTEGER AS week_id, hour(ts)::INTEGER AS utc_hour, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, floor(greatest(-1, least(1, value / 100)) * 1000000 + 0.5) / 1000000 AS clipped, sign(value - 50)::DOUBLE AS side FROM events")
def calendar_functions(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return tables.table(spark, sf_dir, "events").select("event_id", columns.day_id(ts).alias("day_id"), columns.week_id(ts).alias("week_id"), F.hour(ts).alias("utc_hour"), columns.iso_text(ts).alias("iso"), columns.clipped(F.col("value") / 100).alias("clipped"), columns.sign_of(F.col("value") - 50).alias("side"))


# Costs


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    return tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", side.alias("side"), F.col("l_extendedprice").alias("price"), (F.col("l_tax") * 1000).alias("volume"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("before"))


LINES = "WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS side, l_extendedprice AS price, l_tax * 1000 AS volume, l_extendedprice * (1 - l_discount) AS before FROM lineitem)"


@query(
    f"{LINES} SELECT l_orderkey, l_linenumber, {r('price + side * 0.5', 'fixed')}, {r('price * (1 + side * 0.001)', 'percent')}, {r('price * (1 + side * least(l_quantity / greatest(volume, 1), 0.05) * 2)', 'by_volume')}, "
    f"{r('greatest(least(price * (1 + side * 0.001), before * 1.02), before * 0.98)', 'limited')}, {r('greatest(price, 0) * 0.1', 'margin')} FROM l"
)
def slippage_models(spark, sf_dir):
    p = [F.col(c) for c in ("price", "side", "l_quantity", "volume")]
    rules = costs.Rules(limit_up=0.02, limit_down=0.02)
    return _lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", costs.FixedSlippage(0.5).price(*p).alias("fixed"), costs.PercentSlippage(0.001).price(*p).alias("percent"), costs.VolumeSlippage(2.0, 0.05).price(*p).alias("by_volume"),
        rules.limited(costs.PercentSlippage(0.001).price(*p), F.col("before")).alias("limited"), rules.margin(F.col("price")).alias("margin"),
    )


@query(f"{LINES} SELECT l_orderkey, l_linenumber, {r('greatest(l_quantity, 0) * 1.5', 'fixed')}, {r('greatest(price, 0) * 0.0002', 'percent')}, {r('price * CASE WHEN price <= 10000 THEN 0.01 WHEN price <= 50000 THEN 0.005 ELSE 0.003 END', 'tiered')} FROM l")
def commission_models(spark, sf_dir):
    n, q = F.col("price"), F.col("l_quantity")
    tiered = costs.commission_of("tiered", 0, [(10_000, 0.01), (50_000, 0.005), (1e9, 0.003)])
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", costs.FixedCommission(1.5).cash(n, q).alias("fixed"), costs.PercentCommission(0.0002).cash(n, q).alias("percent"), tiered.cash(n, q).alias("tiered"))


@query(
    over_bars(
        f"SELECT symbol, bar_idx, kind, filled, {r('CASE WHEN filled THEN base * (1 + s * 0.001) END', 'fill_price')}, CASE WHEN filled THEN '' ELSE 'limit not reached' END AS reason FROM judged",
        f"o AS (SELECT *, CASE WHEN bar_idx % 2 = 0 THEN 'market' ELSE 'limit' END AS kind, CASE WHEN bar_idx % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, lag(close) OVER ({W}) AS before FROM bars)",
        "judged AS (SELECT *, CASE WHEN side = 'BUY' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s, CASE WHEN kind = 'market' THEN open ELSE before END AS base, kind = 'market' OR CASE WHEN side = 'BUY' THEN low <= before ELSE high >= before END AS filled FROM o WHERE before IS NOT NULL)",
    )
)
def order_fills(spark, sf_dir):
    orders = _all(spark, sf_dir).withColumns({
        "kind": F.when(F.col("bar_idx") % 2 == 0, "market").otherwise("limit"), "side": F.when(F.col("bar_idx") % 3 == 0, "SELL").otherwise("BUY"), "quantity": F.lit(1.0),
        "limit_price": F.lag("close").over(columns.series(["symbol"])),
    }).withColumn("close_before", F.col("limit_price")).where("close_before is not null")
    return costs.fill_orders(orders, costs.PercentSlippage(0.001)).select("symbol", F.col("bar_idx").cast("int").alias("bar_idx"), "kind", "filled", "fill_price", "reason")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 50.0 ELSE 1.0 END AS multiplier, CASE WHEN p_partkey % 3 = 0 THEN 0.05 ELSE 0.0001 END AS min_tick FROM part")
def contract_specs(spark, sf_dir):
    parts = tables.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" part"), F.col("p_partkey").cast("string")).alias("symbol"))
    overrides = parts.where("p_partkey % 3 = 0").select(F.upper("symbol").alias("symbol"), F.lit(50.0).alias("multiplier"), F.lit(0.05).alias("min_tick"))
    return costs.with_contracts(parts, overrides).select("p_partkey", "multiplier", "min_tick")


# Signals and simulation


def _sma_signals(spark: SparkSession, sf_dir: str, sets: list[dict] | None = None) -> DataFrame:
    return strategies.strategy("sma_cross").signals(_all(spark, sf_dir), sets or [{"fast": 10, "slow": 30}])


@query(over_bars("SELECT symbol, bar_idx, signal FROM signals", sql.SMA_SIGNAL))
def signal_sma_cross(spark, sf_dir):
    return _indexed(_sma_signals(spark, sf_dir), "signal")


RSI_SIGNAL = "signals AS MATERIALIZED (SELECT b.*, CASE WHEN rsi < 40 THEN 1.0::DOUBLE WHEN rsi > 60 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS signal FROM bars b JOIN rsis USING (symbol, bar_idx))"


@query(over_bars("SELECT symbol, bar_idx, signal FROM signals", *RSI, RSI_SIGNAL, recursive=True))
def signal_rsi_mean_reversion(spark, sf_dir):
    return _indexed(strategies.strategy("rsi_mean_reversion").signals(_all(spark, sf_dir), [{"window": 14, "lower": 40.0, "upper": 60.0}]), "signal")


def _from_sql(spark: SparkSession, sf_dir: str, call: str) -> DataFrame:
    """Rows of a table function over the aligned bars."""
    sql_functions.register(spark)
    _all(spark, sf_dir).createOrReplaceTempView("aligned_bars")
    return spark.sql(f"SELECT * FROM {call.replace('BARS', 'TABLE(aligned_bars) PARTITION BY symbol ORDER BY (bar_idx)')}")


@query(over_bars("SELECT symbol, bar_idx, signal FROM signals", sql.SMA_SIGNAL))
def sql_sma_cross(spark, sf_dir):
    """The crossover as a table function of Spark SQL."""
    return _from_sql(spark, sf_dir, "sma_cross(BARS, 10, 30)")


@query(ORACLES["macd"])
def sql_macd(spark, sf_dir):
    return _from_sql(spark, sf_dir, "macd(BARS, 12, 26, 9)")


@query(ORACLES["rsi"])
def sql_rsi(spark, sf_dir):
    return _from_sql(spark, sf_dir, "rsi(BARS, 14)")


@query(over_bars(f"SELECT symbol, bar_idx, {r('greatest(-1, least(1, (s.signal * 2 + t.signal) / 3))', 'signal')} FROM signals s JOIN turns t USING (symbol, bar_idx)", sql.SMA_SIGNAL, *RSI, RSI_SIGNAL.replace("signals AS", "turns AS"), recursive=True))
def signal_combined(spark, sf_dir):
    bars = _all(spark, sf_dir)
    one = strategies.strategy("sma_cross").signals(bars, [{"fast": 10, "slow": 30}])
    other = strategies.strategy("rsi_mean_reversion").signals(bars, [{"window": 14, "lower": 40.0, "upper": 60.0}])
    return _indexed(strategies.combined([(one, 2.0), (other, 1.0)]), "signal")


@query(over_bars(f"SELECT symbol, bar_idx, {state_sql.V3_SIGNAL}::DOUBLE AS signal FROM turns", *state_sql.SEEN, *state_sql.V3, recursive=True))
def signal_psar_v3(spark, sf_dir):
    return _indexed(strategies.strategy("psar_trade_assist_v3").signals(_all(spark, sf_dir), [{"atr_ratio_window": 30, "adx_threshold": 10.0, "require_adx_slope": 0}]), "signal")


@query(over_bars(f"SELECT symbol, bar_idx, {r('size', 'signal')} FROM trade", *state_sql.SEEN, *state_sql.V4, recursive=True))
def signal_psar_v4(spark, sf_dir):
    params = {"framework": "F2", "risk_mode": "aggressive", "atr_ratio_window": 30, "adx_threshold": 10.0, "require_adx_slope": 0}
    return _indexed(strategies.strategy("psar_trade_assist_v4").signals(_all(spark, sf_dir), [params]), "signal")


CONFIRMED = [{"atr_ratio_window": 30, "enable_atr_sl": 1, "enable_trailing_atr": 1, "vol_ma_mult": 1.1, "cci_threshold": 80.0, switch: 1} for switch in ("enable_macd", "enable_vol_filter", "enable_session", "enable_momentum")]


@query(over_bars(f"SELECT combo_id, symbol, bar_idx, {r('size', 'signal')} FROM trade", *state_sql.SEEN, *state_sql.V4_GATES, recursive=True))
def signal_psar_v4_confirmed(spark, sf_dir):
    """Each confirmation of the fourth assistant in a set of its own, stops trailing by ATR."""
    out = strategies.strategy("psar_trade_assist_v4").signals(_all(spark, sf_dir), CONFIRMED)
    return out.select("combo_id", "symbol", F.col("bar_idx").cast("int").alias("bar_idx"), "signal")


@query(over_bars(f"SELECT symbol, bar_idx, position, {r('fill_price', 'fill_price')}, {r('slippage_cash', 'slippage_cash')}, {r('commission_cash', 'commission_cash')}, {r('pnl', 'pnl')} FROM held", sql.SMA_SIGNAL, sql.held()))
def positions(spark, sf_dir):
    return _indexed(portfolio.positions(_sma_signals(spark, sf_dir), SLIPPAGE, COMMISSION), "position", "fill_price", "slippage_cash", "commission_cash", "pnl")


CURVE = [sql.SMA_SIGNAL, sql.held(), sql.equity()]


@query(over_bars(f"SELECT bar_idx, {r('equity', 'equity')}, {r('ret', 'ret')}, {r('turnover', 'turnover')} FROM curve", *CURVE))
def sim_vector(spark, sf_dir):
    return portfolio.vector(_sma_signals(spark, sf_dir), SLIPPAGE, COMMISSION).select(F.col("bar_idx").cast("int").alias("bar_idx"), "equity", "ret", "turnover")


@query(over_bars(f"SELECT symbol, bar_idx, CASE WHEN delta >= 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(delta) AS quantity, {r('fill_price', 'price')}, {r('slippage_cash + commission_cash', 'cost')} FROM held WHERE abs(delta) >= 1e-12 AND close_before IS NOT NULL", sql.SMA_SIGNAL, sql.held()))
def trade_log(spark, sf_dir):
    trades = portfolio.trades_of(portfolio.positions(_sma_signals(spark, sf_dir), SLIPPAGE, COMMISSION))
    return _indexed(trades, "side", "quantity", "price", "cost")


SCENARIOS = {"low": (costs.PercentSlippage(0.0001), costs.PercentCommission(0.0002)), "high": (costs.PercentSlippage(0.005), costs.PercentCommission(0.002))}


def _scenario(name: str, rate: str, fee: str) -> str:
    return f"SELECT '{name}' AS scenario, * FROM (WITH {sql.held(rate=rate, fee=fee)}, {sql.equity()} SELECT bar_idx, {r('equity', 'equity')}, {r('ret', 'ret')} FROM curve)"


@query(over_bars(f"{_scenario('low', '0.0001', '0.0002')} UNION ALL {_scenario('high', '0.005', '0.002')}", sql.SMA_SIGNAL))
def cost_scenarios(spark, sf_dir):
    out = portfolio.cost_scenarios(_sma_signals(spark, sf_dir), SCENARIOS)
    return out.select("scenario", F.col("bar_idx").cast("int").alias("bar_idx"), "equity", "ret")


@query(over_bars("SELECT count(CASE WHEN equity <= 0 THEN 1 END) > 0 AS bankrupt, min(CASE WHEN equity <= 0 THEN bar_idx END) AS bankrupt_bar FROM curve", sql.SMA_SIGNAL, sql.held(rate="0.05", fee="0.05"), sql.equity(cash="500.0")))
def bankruptcy(spark, sf_dir):
    equity = portfolio.vector(_sma_signals(spark, sf_dir), costs.PercentSlippage(0.05), costs.PercentCommission(0.05), cash=500.0)
    return portfolio.bankruptcy(equity).select("bankrupt", F.col("bankrupt_bar").cast("int").alias("bankrupt_bar"))


@query(over_bars(f"SELECT bar_idx, {r('equity', 'equity')}, {r('turnover', 'turnover')} FROM curve", *CURVE))
def sim_sequential(spark, sf_dir):
    """Without rules that bind, bar by bar gives what windows give."""
    out = portfolio.sequential(_sma_signals(spark, sf_dir), SLIPPAGE, COMMISSION, costs.Rules(margin_ratio=0.0))
    return out.select(F.col("bar_idx").cast("int").alias("bar_idx"), "equity", "turnover")


RULES = costs.Rules(margin_ratio=0.5, max_position=0.8, max_risk_per_trade=0.5, max_daily_loss=0.05, max_weekly_loss=0.1, max_drawdown=0.3, drawdown_action="reduce")


RULED = state_sql.ruled(0.5, 0.8, 0.5, 0.05, 0.1, 0.3, 3000.0)
_ONE = sql.SMA_SIGNAL.replace("SELECT *, CASE WHEN fast", "SELECT 0::BIGINT AS combo_id, *, CASE WHEN fast")


@query(over_bars(f"SELECT bar_idx, {r('equity', 'equity')}, {r('ret', 'ret')}, {r('turnover', 'turnover')}, len(events)::INTEGER AS events, trades::INTEGER AS trades FROM state", _ONE, RULED, recursive=True))
def sim_rules(spark, sf_dir):
    out = portfolio.sequential(_sma_signals(spark, sf_dir), SLIPPAGE, COMMISSION, RULES, cash=3000.0)
    return out.select(F.col("bar_idx").cast("int").alias("bar_idx"), "equity", "ret", "turnover", F.size("events").alias("events"), F.size("trades").alias("trades"))


@query(over_bars("SELECT combo_id, bar_idx AS bar, split_part(event, '|', 1) AS type, split_part(event, '|', 2) AS detail FROM (SELECT *, unnest(events) AS event FROM state)", _ONE, RULED, recursive=True))
def risk_events(spark, sf_dir):
    found = portfolio.events_of(portfolio.sequential(_sma_signals(spark, sf_dir), SLIPPAGE, COMMISSION, RULES, cash=3000.0))
    return found.withColumn("bar", F.col("bar").cast("int"))


# Measures


@query(over_bars(f"SELECT {sql.MEASURES} FROM scored", *CURVE, sql.MARKET, sql.performance("", periods=HOURS)))
def performance_metrics(spark, sf_dir):
    bars = _all(spark, sf_dir)
    equity = portfolio.vector(strategies.strategy("sma_cross").signals(bars, [{"fast": 10, "slow": 30}]), SLIPPAGE, COMMISSION)
    return metrics.performance(equity, ["combo_id"], HOURS, market=metrics.market_returns(bars)).drop("combo_id")


@query(
    over_bars(
        f"""SELECT {r("any_value(var)", "var")}, {r("avg(CASE WHEN ret <= var THEN ret END)", "cvar")}, {r("sqrt(avg(pow(dd * 100, 2)))", "ulcer_index")}, {r("coalesce(stddev_samp(CASE WHEN ret < 0 THEN ret END), 0)", "downside_deviation")}
  FROM (SELECT *, (SELECT quantile_cont(ret, 0.05) FROM curve) AS var, (equity - max(equity) OVER (ORDER BY bar_idx)) / max(equity) OVER (ORDER BY bar_idx) AS dd FROM curve)""",
        *CURVE,
    )
)
def risk_metrics(spark, sf_dir):
    return metrics.risk(portfolio.vector(_sma_signals(spark, sf_dir), SLIPPAGE, COMMISSION), ["combo_id"]).drop("combo_id")


GRID = {"fast": strategies.Axis("int", 5, 25, 5), "slow": strategies.Axis("int", 20, 60, 10)}
SETS = [s for s in search.product(GRID) if s["fast"] < s["slow"]]
_ALL_MEANS = ", ".join(f"CASE WHEN bar_idx >= {w - 1} THEN avg(close) OVER {rows(w)} END AS sma_{w}" for w in sorted({w for s in SETS for w in s.values()}))
_EACH = " UNION ALL ".join(f"SELECT {k}::BIGINT AS combo_id, *, CASE WHEN sma_{s['fast']} > sma_{s['slow']} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS signal FROM means" for k, s in enumerate(SETS))
SCORED = [f"means AS MATERIALIZED (SELECT *, {_ALL_MEANS} FROM bars)", f"signals AS ({_EACH})", sql.held(key="combo_id, symbol"), sql.equity("combo_id, "), sql.MARKET, sql.performance("combo_id, ", periods=HOURS)]


@query(over_bars(f"SELECT combo_id, {sql.MEASURES} FROM scored", *SCORED))
def batch_measures(spark, sf_dir):
    bars = _all(spark, sf_dir)
    equity = portfolio.vector(strategies.strategy("sma_cross").signals(bars, SETS), SLIPPAGE, COMMISSION)
    return metrics.performance(equity, ["combo_id"], HOURS, market=metrics.market_returns(bars))


@query(over_bars(f"SELECT combo_id, {r('sharpe', 'score')} FROM scored ORDER BY sharpe DESC, combo_id LIMIT 20", *SCORED))
def grid_search_top20(spark, sf_dir):
    """The twenty best sets of a grid, all simulated in one job."""
    found = search.scores(_all(spark, sf_dir), strategies.strategy("sma_cross"), SETS, "sharpe", TERMS)
    return found.orderBy(F.desc("score"), "combo_id").limit(20)


_RULED_CURVE = "curve AS MATERIALIZED (SELECT combo_id, bar_idx, equity, ret FROM state)"


@query(over_bars(f"SELECT combo_id, {r('total_return', 'score')} FROM scored", SCORED[0], SCORED[1], RULED, _RULED_CURVE, sql.MARKET, sql.performance("combo_id, ", periods=HOURS), recursive=True))
def grid_search_rules(spark, sf_dir):
    """A grid whose sets are all simulated under rules that depend on equity."""
    terms = search.Terms(SLIPPAGE, COMMISSION, RULES, cash=3000.0, periods=HOURS)
    return search.scores(_all(spark, sf_dir), strategies.strategy("sma_cross"), SETS, "total_return", terms)


@query("SELECT (row_number() OVER (ORDER BY f, s) - 1)::BIGINT AS combo_id, f::INTEGER AS fast, s::INTEGER AS slow FROM range(5, 26, 5) a(f) CROSS JOIN range(20, 61, 10) b(s)")
def parameter_product(spark, sf_dir):
    return search.product_table(spark, GRID)


@query(over_bars("SELECT fast, " + ", ".join(f"max(CASE WHEN slow = {w} THEN floor(sharpe * 1000000 + 0.5) / 1000000 END) AS slow_{w}" for w in (20, 30, 40, 50, 60)) + " FROM scored JOIN (VALUES " + ", ".join(f"({k}, {s['fast']}, {s['slow']})" for k, s in enumerate(SETS)) + ") v(combo_id, fast, slow) USING (combo_id) GROUP BY fast", *SCORED))
def score_heatmap(spark, sf_dir):
    found = search.scores(_all(spark, sf_dir), strategies.strategy("sma_cross"), SETS, "sharpe", TERMS)
    names = spark.createDataFrame([(k, s["fast"], s["slow"]) for k, s in enumerate(SETS)], "combo_id long, fast int, slow int")
    wide = found.join(F.broadcast(names), "combo_id").groupBy("fast").pivot("slow", [20, 30, 40, 50, 60]).agg(F.max("score"))
    return wide.select("fast", *[F.col(str(w)).alias(f"slow_{w}") for w in (20, 30, 40, 50, 60)])


TRADE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber"]
LOTS = """WITH t AS (SELECT l_linestatus || '-' || (l_suppkey % 7) AS symbol, CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END AS side, l_quantity AS q, round(l_extendedprice / l_quantity) AS price, l_shipdate, l_orderkey, l_linenumber,
  row_number() OVER (PARTITION BY l_linestatus || '-' || (l_suppkey % 7) ORDER BY l_shipdate, l_orderkey, l_linenumber) AS trade FROM lineitem WHERE l_quantity > 0),
p AS (SELECT *, sum(side * q) OVER (PARTITION BY symbol ORDER BY trade) AS pos FROM t),
s AS (SELECT *, pos - side * q AS before FROM p),
parts AS (
  SELECT symbol, trade, side, price, l_shipdate, l_orderkey, l_linenumber, least(q, abs(before)) AS q, true AS closes, before AS book FROM s WHERE before * side < 0
  UNION ALL SELECT symbol, trade, side, price, l_shipdate, l_orderkey, l_linenumber, CASE WHEN before * side < 0 THEN q - abs(before) ELSE q END, false, CASE WHEN before * side < 0 THEN 0 ELSE before END FROM s WHERE before * side >= 0 OR q > abs(before)
),
stretches AS (SELECT *, count(CASE WHEN NOT closes AND book = 0 THEN 1 END) OVER (PARTITION BY symbol ORDER BY trade, closes DESC) AS episode FROM parts),
cum AS (SELECT *, sum(q) OVER (PARTITION BY symbol, episode, closes ORDER BY trade) AS hi FROM stretches)
"""


@query(LOTS + "SELECT c.symbol, c.trade::INTEGER AS trade, count(*) AS lots, floor(sum((least(o.hi, c.hi) - greatest(o.hi - o.q, c.hi - c.q)) * (c.price - o.price) * -c.side) * 1000000 + 0.5) / 1000000 AS pnl FROM cum o JOIN cum c ON o.symbol = c.symbol AND o.episode = c.episode AND NOT o.closes AND c.closes AND o.hi > c.hi - c.q AND c.hi > o.hi - o.q GROUP BY 1, 2")
def trade_fifo_pnl(spark, sf_dir):
    lots = metrics.realised(tables.line_trades(spark, sf_dir), order=TRADE_ORDER)
    return lots.groupBy("symbol", "trade").agg(F.count("*").alias("lots"), F.sum("pnl").alias("pnl"))


_PAIRS = LOTS + """, lots AS (SELECT c.symbol, c.trade, c.l_shipdate, c.l_orderkey, c.l_linenumber, o.hi, (least(o.hi, c.hi) - greatest(o.hi - o.q, c.hi - c.q)) * (c.price - o.price) * -c.side AS pnl
  FROM cum o JOIN cum c ON o.symbol = c.symbol AND o.episode = c.episode AND NOT o.closes AND c.closes AND o.hi > c.hi - c.q AND c.hi > o.hi - o.q),
placed AS (SELECT *, count(CASE WHEN pnl >= 0 THEN 1 END) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, symbol, hi) AS run FROM lots),
streak AS (SELECT max(n) AS longest FROM (SELECT run, count(*) AS n FROM placed WHERE pnl < 0 GROUP BY run)),
active AS (SELECT symbol FROM t GROUP BY symbol ORDER BY count(*) DESC, min((l_shipdate, l_orderkey, l_linenumber)) LIMIT 1)
"""


@query(_PAIRS + f"""SELECT 0::BIGINT AS combo_id, count(*) AS trade_count, (SELECT count(*) FROM t WHERE side = 1) AS buy_count, (SELECT count(*) FROM t WHERE side = -1) AS sell_count, {r("(SELECT count(*) FROM t) / count(*)", "avg_trade_cost")}, {r("(SELECT sum(q) FROM t) / count(*)", "avg_trade_size")},
  {r("count(CASE WHEN pnl > 0 THEN 1 END)::DOUBLE / count(*)", "win_rate")}, {r("sum(CASE WHEN pnl > 0 THEN pnl END) / -sum(CASE WHEN pnl < 0 THEN pnl END)", "profit_factor")}, {r("avg(CASE WHEN pnl > 0 THEN pnl END)", "avg_profit")}, {r("avg(CASE WHEN pnl < 0 THEN -pnl END)", "avg_loss")},
  (SELECT longest FROM streak) AS max_consecutive_losses, (SELECT count(DISTINCT symbol) FROM t) AS symbol_count, (SELECT symbol FROM active) AS most_active_symbol FROM lots""")
def trade_measures(spark, sf_dir):
    return metrics.trade_metrics(tables.line_trades(spark, sf_dir), order=TRADE_ORDER)


# Stability


@query(over_bars('SELECT (s // 60)::INTEGER AS "window", s::INTEGER AS train_start, (s + 240)::INTEGER AS train_end, (s + 240)::INTEGER AS test_start, (s + 360)::INTEGER AS test_end FROM range(0, (SELECT max(bar_idx) + 1 - 360 + 1 FROM bars), 60) t(s)'))
def walk_windows(spark, sf_dir):
    n = _all(spark, sf_dir).agg(F.max("bar_idx") + 1).first()[0]
    return stability.windows(spark, n, 240, 120, 60)


_CUT = """spans AS (SELECT (s // 60)::INTEGER AS w, unnest(['train', 'test']) AS split, unnest([s, s + 240]) AS lo, unnest([s + 240, s + 360]) AS hi FROM range(0, (SELECT max(bar_idx) + 1 - 360 + 1 FROM bars), 60) t(s)),
cuts AS MATERIALIZED (SELECT combo_id, w, split, symbol, ts, bar_idx - lo AS bar_idx, open, close, volume, signal FROM signals JOIN spans ON bar_idx >= lo AND bar_idx < hi)"""
_CUT_KEYS = "combo_id, w, split, "


@query(
    over_bars(
        f"""SELECT combo_id, count(*) AS windows, {r("avg(train)", "train_mean")}, {r("avg(test)", "test_mean")}, {r("coalesce(stddev_samp(test), 0)", "test_std")}, {r("min(test)", "worst")}, {r("avg(CASE WHEN abs(train) > 1e-12 THEN (train - test) / abs(train) ELSE 0 END)", "decay")},
  {r("avg(test) / (coalesce(stddev_samp(test), 0) + 1e-12)", "ratio")}, avg(test) / (coalesce(stddev_samp(test), 0) + 1e-12) >= 1 AND min(test) > 0 AS stable
  FROM (SELECT combo_id, w, max(CASE WHEN split = 'train' THEN sharpe END) AS train, max(CASE WHEN split = 'test' THEN sharpe END) AS test FROM scored GROUP BY 1, 2) GROUP BY combo_id""",
        SCORED[0], SCORED[1], _CUT, sql.held("cuts", key=_CUT_KEYS + "symbol"), sql.equity(_CUT_KEYS), sql.MARKET, sql.performance(_CUT_KEYS, periods=HOURS, rf=0.0),
    )
)
def walk_forward_stability(spark, sf_dir):
    signals = _sma_signals(spark, sf_dir, SETS)
    spans = stability.windows(spark, signals.agg(F.max("bar_idx") + 1).first()[0], 240, 120, 60)
    return stability.walk_forward(signals, spans, stability.default_simulation(SLIPPAGE, COMMISSION), HOURS)[1]


_FOLDS = """sized AS (SELECT greatest(3, (max(bar_idx) + 1) // 4) AS block, max(bar_idx) + 1 AS n FROM bars),
shares AS (SELECT *, greatest(2, floor(block * 0.7::DOUBLE)::BIGINT) AS ins FROM sized), stretches AS (SELECT *, greatest(1, block - ins) AS outs FROM shares),
spans AS (SELECT (k + 1)::INTEGER AS fold, unnest(['is', 'oos']) AS split, unnest([k * (ins + outs), k * (ins + outs) + ins]) AS lo, unnest([k * (ins + outs) + ins, (k + 1) * (ins + outs)]) AS hi FROM stretches, range(0, 4) t(k) WHERE (k + 1) * (ins + outs) <= n),
pieces AS MATERIALIZED (SELECT fold, split, symbol, ts, bar_idx - lo AS bar_idx, open, high, low, close, volume FROM bars JOIN spans ON bar_idx >= lo AND bar_idx < hi)"""
_FOLD_KEYS = "combo_id, fold, split, "
_FOLD_MEANS = ", ".join(f"CASE WHEN bar_idx >= {w - 1} THEN avg(close) OVER (PARTITION BY fold, split, symbol ORDER BY bar_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) END AS sma_{w}" for w in sorted({w for s in SETS for w in s.values()}))


@query(
    over_bars(
        f"""SELECT fold, combo_id, {r("ins", "is_score")}, {r("oos", "oos_score")} FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY ins DESC, combo_id) AS nth FROM (
  SELECT fold, combo_id, max(CASE WHEN split = 'is' THEN sharpe END) AS ins, max(CASE WHEN split = 'oos' THEN sharpe END) AS oos FROM scored GROUP BY 1, 2)) WHERE nth = 1""",
        _FOLDS, f"means AS MATERIALIZED (SELECT *, {_FOLD_MEANS} FROM pieces)", f"signals AS ({_EACH})", sql.held(key=_FOLD_KEYS + "symbol"), sql.equity(_FOLD_KEYS), sql.MARKET, sql.performance(_FOLD_KEYS, periods=HOURS),
    )
)
def walk_forward_grid(spark, sf_dir):
    bars = _all(spark, sf_dir)
    cut = walkforward.folds(bars.agg(F.max("bar_idx") + 1).first()[0], 4)
    return walkforward.grid_by_fold(bars, cut, strategies.strategy("sma_cross"), SETS, "sharpe", TERMS)


@query("""WITH t AS (SELECT event_type AS test, user_id % 20 AS part, least(1, avg(value) / 400) AS p FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY p, test, part) AS k, count(*) OVER () AS m FROM t)
SELECT test, part, floor(p * 1000000 + 0.5) / 1000000 AS p, floor(greatest(0, least(1, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) * 1000000 + 0.5) / 1000000 AS adjusted, least(1, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) <= 0.1 AS rejected FROM r""")
def benjamini_hochberg(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    tests = events.groupBy(F.col("event_type").alias("test"), (F.col("user_id") % 20).alias("part")).agg(F.least(F.lit(1.0), F.avg("value") / 400).alias("p"))
    return stability.benjamini_hochberg(tests, alpha=0.1)


@query(
    over_bars(
        f"""SELECT CASE regime WHEN 0 THEN 'low_vol' WHEN 1 THEN 'mid_vol' ELSE 'high_vol' END AS regime, count(*) AS bars, {r("CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) * sqrt(6048.0) / stddev_samp(ret) ELSE 0 END", "sharpe")}, {r("min(dd)", "max_drawdown")},
  {r("coalesce(count(CASE WHEN nth > 1 AND ret > 0 THEN 1 END)::DOUBLE / nullif(count(CASE WHEN nth > 1 AND ret <> 0 THEN 1 END), 0), 0)", "win_rate")}
  FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY bar_idx) AS nth, (equity - max(equity) OVER (PARTITION BY regime ORDER BY bar_idx)) / max(equity) OVER (PARTITION BY regime ORDER BY bar_idx) AS dd FROM classed) GROUP BY regime""",
        *CURVE, sql.RANGES, smoothed("e", "ranges", "tr", "2.0::DOUBLE / 15"), "vol AS MATERIALIZED (SELECT bar_idx, floor(avg(v) * 1000000 + 0.5) / 1000000 AS atr FROM e GROUP BY bar_idx)",
        "classed AS MATERIALIZED (SELECT c.*, ((SELECT quantile_cont(atr, 1.0::DOUBLE / 3) FROM vol) < atr)::INTEGER + ((SELECT quantile_cont(atr, 2.0::DOUBLE / 3) FROM vol) < atr)::INTEGER AS regime FROM curve c JOIN vol USING (bar_idx))", recursive=True,
    )
)
def regimes(spark, sf_dir):
    bars = _all(spark, sf_dir)
    equity = portfolio.vector(strategies.strategy("sma_cross").signals(bars, [{"fast": 10, "slow": 30}]), SLIPPAGE, COMMISSION)
    mean = ind.atr(bars).groupBy("bar_idx").agg(F.avg("atr").alias("atr")).select("bar_idx", _rounded("atr"))
    return stability.regimes(equity.join(mean, "bar_idx"), periods=6048.0).drop("combo_id")


@query(over_bars(f"SELECT {r('sharpe', 'sharpe')}, 1.0::DOUBLE AS p_value, false AS significant FROM scored", *CURVE, sql.MARKET, sql.performance("", periods=HOURS, rf=0.0)))
def permutation_test(spark, sf_dir):
    equity = portfolio.vector(_sma_signals(spark, sf_dir), SLIPPAGE, COMMISSION)
    return stability.permutation_test(equity, ["combo_id"], periods=HOURS).drop("combo_id")


def _walked(x: str) -> str:
    """One pass of the keyed permutation over x, of halves of `bits` bits."""
    left, right = f"({x} // w)", f"({x} % w)"
    for k in range(6):
        left, right = right, f"xor({left}, (({right} * 40503 + k{k}) * 33769 // 65536) % w)"
    return f"({left} * w + {right})"


# which return stands where, pass by pass, until the place is one of the curve's; then as measured
_DRAWN = [
    "sized AS MATERIALIZED (SELECT max(bar_idx) AS n, (1 << greatest(1, ceil(ceil(log2(greatest(max(bar_idx), 2))) / 2)::INTEGER))::BIGINT AS w FROM curve)",
    "named AS MATERIALIZED (SELECT i, " + ", ".join(f"('0x' || substr(md5('42:' || i || ':{k}'), 1, 7))::BIGINT AS k{k}" for k in range(6)) + " FROM range(1, 201) p(i))",
    "walked(i, bar_idx, x) AS (SELECT i, c.bar_idx, " + _walked("(c.bar_idx - 1)") + " FROM curve c, named, sized WHERE c.bar_idx > 0 UNION ALL SELECT i, bar_idx, " + _walked("x") + " FROM walked JOIN named USING (i), sized WHERE x >= n)",
    "grown AS (SELECT i, x + 1 AS place, ln(greatest(1 + ret, 1e-300::DOUBLE)) AS growth FROM walked JOIN curve USING (bar_idx), sized WHERE x < n UNION ALL SELECT i, 0, 0.0::DOUBLE FROM named)",
    "levels AS (SELECT i, place, exp(sum(growth) OVER (PARTITION BY i ORDER BY place)) AS level FROM grown)",
    "depths AS (SELECT i, min(level / peak - 1) AS depth FROM (SELECT *, max(level) OVER (PARTITION BY i ORDER BY place) AS peak FROM levels) GROUP BY i)",
]


@query(over_bars(f"SELECT {r('max_drawdown', 'max_drawdown')}, {r('((SELECT count(*) FROM depths d WHERE d.depth >= s.max_drawdown) + 1)::DOUBLE / 201', 'p_value')}, ((SELECT count(*) FROM depths d WHERE d.depth >= s.max_drawdown) + 1)::DOUBLE / 201 < 0.05 AS significant FROM scored s", *CURVE, sql.MARKET, sql.performance("", periods=HOURS, rf=0.0), *_DRAWN, recursive=True))
def permutation_drawdown(spark, sf_dir):
    """How many of 200 orders of the returns sink as little as the actual one."""
    equity = portfolio.vector(_sma_signals(spark, sf_dir), SLIPPAGE, COMMISSION)
    return stability.permutation_test(equity, ["combo_id"], 200, periods=HOURS, statistic="max_drawdown").drop("combo_id")


_NEARBY = [{"fast": f, "slow": w} for f, w in ((10, 30), (9, 30), (11, 30), (10, 27), (10, 33))]
_NEAR_MEANS = ", ".join(f"CASE WHEN bar_idx >= {w - 1} THEN avg(close) OVER {rows(w)} END AS sma_{w}" for w in (9, 10, 11, 27, 30, 33))
_NEAR_EACH = " UNION ALL ".join(f"SELECT {k}::BIGINT AS combo_id, *, CASE WHEN sma_{s['fast']} > sma_{s['slow']} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS signal FROM means" for k, s in enumerate(_NEARBY))


@query(
    over_bars(
        f"""SELECT parameter, base_value, {r("b", "base_score")}, {r("l", "low_score")}, {r("h", "high_score")}, {r("greatest(abs(l - b), abs(h - b))", "largest_change")} FROM (
  SELECT 'fast' AS parameter, 10.0::DOUBLE AS base_value, max(CASE WHEN combo_id = 0 THEN sharpe END) AS b, max(CASE WHEN combo_id = 1 THEN sharpe END) AS l, max(CASE WHEN combo_id = 2 THEN sharpe END) AS h FROM scored
  UNION ALL SELECT 'slow', 30.0, max(CASE WHEN combo_id = 0 THEN sharpe END), max(CASE WHEN combo_id = 3 THEN sharpe END), max(CASE WHEN combo_id = 4 THEN sharpe END) FROM scored)""",
        f"means AS MATERIALIZED (SELECT *, {_NEAR_MEANS} FROM bars)", f"signals AS ({_NEAR_EACH})", sql.held(key="combo_id, symbol"), sql.equity("combo_id, "), sql.MARKET, sql.performance("combo_id, ", periods=HOURS),
    )
)
def sensitivity(spark, sf_dir):
    score = search.scorer(_all(spark, sf_dir), strategies.strategy("sma_cross"), "sharpe", TERMS)
    return stability.sensitivity(spark, {"fast": 10, "slow": 30}, lambda sets: dict(enumerate(score(sets))))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity of the moving-average crossover on event bars."""
    return QUERIES["sim_vector"](spark, sf_dir)
