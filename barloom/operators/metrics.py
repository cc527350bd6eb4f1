"""Measures of equity curves and trades, for all combinations in one aggregate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.indicators import drawdown, simple_return
from barloom.operators.scan import running, stretch

PERIODS = 252 * 390  # minutes of a year's trading days
RISK_FREE = 0.02
#: Bars of a year, by kind of data (fixed values).
PRESETS = {"minute": 252 * 390, "hour": 252 * 6, "daily": 252, "forex-1m": 358_800}
RISK = ["var", "cvar", "ulcer_index", "downside_deviation"]
#: Measures of trades that are numbers and no measure of performance.
TRADES = ["trade_count", "buy_count", "sell_count", "avg_trade_cost", "avg_trade_size", "profit_factor", "avg_profit", "avg_loss", "max_consecutive_losses", "symbol_count"]
PERFORMANCE = ["sharpe", "sortino", "max_drawdown", "total_return", "annualized_return", "volatility", "calmar", "win_rate", "beta"]


def market_returns(bars: DataFrame) -> DataFrame:
    """bar_idx, market: the mean simple return of all symbols."""
    return bars.withColumn("_r", simple_return()).groupBy("bar_idx").agg(F.avg("_r").alias("market"))


def _zero_if(bad: Column, value: Column) -> Column:
    return F.when(bad, 0.0).otherwise(value)


def _quotient(top: Column, bottom: Column, least: float = 1e-12) -> Column:
    """top / bottom; 0 where bottom is empty or not above `least`."""
    good = bottom > least
    return F.coalesce(F.when(good, top / F.when(good, bottom)), F.lit(0.0))


#: Pairs of moments that summaries hold: the rows and the values whose mean, spread and product with another they tell.
_MOMENTS = ["ret", "down", "market"]


def _summaries(rows: DataFrame, keys: list[str], rf: float) -> DataFrame:
    """Summaries of stretches of curves (keys, bar_idx, equity, ret, market) that can be merged: a row for each stretch."""
    part = rows.withColumn("_part", stretch()).withColumn("excess", F.col("ret") - rf)
    part = part.withColumn("down", F.when(F.col("excess") < 0, F.col("excess"))).withColumn("_dd", drawdown("equity", [*keys, "_part"]))
    later = F.col("bar_idx") > 0
    paired = F.when(F.col("market").isNotNull(), F.col("ret"))
    moments = [x for c in _MOMENTS for x in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"), (F.var_pop(c) * F.count(c)).alias(f"m2_{c}"))]
    return part.groupBy(*keys, "_part").agg(
        F.count("*").alias("n"), F.sum("excess").alias("excess"), F.min("_dd").alias("fall"), F.max("equity").alias("high"), F.min("equity").alias("low"),
        F.min_by("equity", "bar_idx").alias("first"), F.max_by("equity", "bar_idx").alias("last"),
        F.sum(F.when(later & (F.col("ret") > 0), 1).otherwise(0)).alias("wins"), F.sum(F.when(later & (F.col("ret") != 0), 1).otherwise(0)).alias("moves"),
        *moments, F.avg(paired).alias("mean_paired"), (F.covar_pop("ret", "market") * F.count("market")).alias("c2"),
    )


def _merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One summary of each curve, of the summaries of its stretches. The deepest fall is a stretch's own, or from an earlier one's peak to its lowest."""
    by_part = Window.partitionBy(*keys).orderBy("_part")
    peak = F.max("high").over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    over = Window.partitionBy(*keys)
    rows = parts.withColumn("_fall", F.least("fall", (F.col("low") - peak) / F.greatest(peak, F.lit(1e-12))))
    rows = rows.withColumns({f"_{c}": F.sum(F.col(f"n_{c}") * F.col(f"mean_{c}")).over(over) / F.nullif(F.sum(f"n_{c}").over(over), F.lit(0)) for c in _MOMENTS})
    rows = rows.withColumn("_paired", F.sum(F.col("n_market") * F.col("mean_paired")).over(over) / F.nullif(F.sum("n_market").over(over), F.lit(0)))
    spread = lambda c: F.sum(F.col(f"m2_{c}") + F.col(f"n_{c}") * F.pow(F.col(f"mean_{c}") - F.col(f"_{c}"), 2))
    deviation = lambda c: F.when(F.sum(f"n_{c}") > 1, F.sqrt(spread(c) / F.nullif(F.sum(f"n_{c}") - 1, F.lit(0))))
    together = F.sum(F.col("c2") + F.col("n_market") * (F.col("mean_paired") - F.col("_paired")) * (F.col("mean_market") - F.col("_market")))
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum("excess") / F.sum("n")).alias("mean"), deviation("ret").alias("spread"), deviation("down").alias("down"), F.sum("n_down").alias("n_down"),
        F.min("_fall").alias("max_drawdown"), F.min_by("first", "_part").alias("first"), F.max_by("last", "_part").alias("last"), F.sum("wins").alias("wins"), F.sum("moves").alias("moves"),
        (together / F.nullif(F.sum("n_market"), F.lit(0))).alias("cov"), (spread("market") / F.nullif(F.sum("n_market"), F.lit(0))).alias("var"),
    )


def performance(equity: DataFrame, keys: list[str], periods: float = PERIODS, risk_free: float = RISK_FREE, market: DataFrame | None = None) -> DataFrame:
    """keys and PERFORMANCE of equity (keys, bar_idx, equity, ret); beta is 0 without market (bar_idx, any of keys, market).

    Sharpe and volatility take the sample deviation of all returns; Sortino that of the negative excess ones;
    win_rate passes over the first bar and returns of 0; beta is by population moments. A long curve is summed up in stretches, and their summaries are merged.
    """
    rows = equity if market is None else equity.join(market, [c for c in market.columns if c != "market"], "left")
    rf, year = risk_free / periods, math.sqrt(periods)
    agg = _merged(_summaries(rows if market is not None else rows.withColumn("market", F.lit(0.0)), keys, rf), keys)
    growth = F.when((F.col("first") > 0) & (F.col("last") > 0), F.col("last") / F.when(F.col("first") > 0, F.col("first")))
    years = F.greatest((F.col("n") - 1) / periods, F.lit(1e-9))
    annual = F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce(F.pow(growth, 1 / years) - 1, F.lit(-1.0)))
    out = agg.withColumns({
        "sharpe": _quotient(F.col("mean") * year, F.col("spread")),
        "sortino": _zero_if(F.col("n_down") < 2, _quotient(F.col("mean") * year, F.col("down"))),
        "total_return": F.when(F.col("first") != 0, F.col("last") / F.when(F.col("first") != 0, F.col("first")) - 1).otherwise(0.0),
        "annualized_return": annual,
        "volatility": F.coalesce(F.col("spread") * year, F.lit(0.0)),
        "win_rate": F.when(F.col("moves") > 0, F.col("wins") / F.when(F.col("moves") > 0, F.col("moves"))).otherwise(0.0),
        "beta": _quotient(F.col("cov"), F.col("var")),
    })
    return out.withColumn("calmar", _quotient(F.col("annualized_return"), F.abs("max_drawdown"))).select(*keys, *PERFORMANCE)


def risk(equity: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """keys, var, cvar (mean of returns at or below var), ulcer_index, downside_deviation."""
    var = percentiles(equity, keys, "ret", [alpha]).select(*keys, F.col("values")[0].alias("var"))
    peak = running(equity, keys, {"_peak": ("max", F.col("equity"))})
    rows = peak.withColumn("_dd", (F.col("equity") - F.col("_peak")) / F.greatest("_peak", F.lit(1e-12))).join(var, keys)
    return rows.groupBy(*keys).agg(
        F.first("var").alias("var"), F.coalesce(F.avg(F.when(F.col("ret") <= F.col("var"), F.col("ret"))), F.first("var")).alias("cvar"),
        F.sqrt(F.avg(F.pow(F.col("_dd") * 100, 2))).alias("ulcer_index"), F.coalesce(F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))), F.lit(0.0)).alias("downside_deviation"),
    )


#: Ranks of percentile_approx() are off by a share of 1 / ACCURACY at most.
ACCURACY = 10_000


def percentiles(rows: DataFrame, keys: list[str], column: str, shares: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """keys and values, the exact percentiles (between neighbours, in proportion) of column at each of shares; null values are passed over.

    Groups may be of any size: sketches, which merge, tell two values that surely enclose each percentile; what is below is counted, and only what is
    between is ranked, by distinct values with their counts. No task holds a group.
    """
    low, high = ([min(1.0, max(0.0, p + d / accuracy)) for p in shares] for d in (-2, 2))
    known = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_x"))
    bounds = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_x", low, accuracy).alias("_low"), F.percentile_approx("_x", high, accuracy).alias("_high"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    # of small groups, whose neighbouring ranks the margin may not hold, all is ranked
    every = lambda c, edge: F.when(F.col("_n") <= 4 * accuracy, F.array_repeat(edge, len(shares))).otherwise(F.col(c)).alias(c)
    bounds = bounds.select(*keys, "_n", every("_low", "_min"), every("_high", "_max"))
    near = known.join(bounds.select(*keys, "_low", "_high"), keys)
    below = near.groupBy(*keys).agg(*[F.count(F.when(F.col("_x") < F.col("_low")[k], 1)).alias(f"_b{k}") for k in range(len(shares))])
    within = F.filter(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda k: (F.col("_x") >= F.get("_low", k)) & (F.col("_x") <= F.get("_high", k)))
    tally = near.select(*keys, "_x", F.explode(within).alias("_k")).groupBy(*keys, "_k", "_x").agg(F.count("*").alias("_c"))
    place = bounds.join(below, keys).select(*keys, F.posexplode(F.array(*[F.struct(((F.col("_n") - 1) * F.lit(float(p))).alias("at"), F.col(f"_b{k}").alias("below")) for k, p in enumerate(shares)])).alias("_k", "_p"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_k").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = tally.withColumn("_upto", upto).join(place, [*keys, "_k"])
    ranked = ranked.withColumns({"_upto": F.col("_upto") + F.col("_p.below"), "_at": F.col("_p.at")})
    first, second = (F.min(F.when(F.col("_upto") > f("_at"), F.col("_x"))) for f in (F.floor, F.ceil))
    share = F.max(F.col("_at") - F.floor("_at"))
    value = F.when(first == second, first).otherwise((1 - share) * first + share * second)
    each = ranked.groupBy(*keys, "_k").agg(value.alias("_value"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_value"))), lambda v: v["_value"]).alias("values"))


def batch_score(equity: DataFrame, metric: str, periods: float = PERIODS, risk_free: float = RISK_FREE, market: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """combo_id (or keys), score: one measure of each combination; KeyError if it isn't one of performance() or risk()."""
    keys = keys or ["combo_id"]
    if metric in PERFORMANCE:
        return performance(equity, keys, periods, risk_free, market).select(*keys, F.col(metric).alias("score"))
    if metric in RISK:
        return risk(equity, keys).select(*keys, F.col(metric).alias("score"))
    raise KeyError(metric)


def _in_turn(order: list[str]) -> list[Column]:
    """Nulls last, as SQL has them."""
    return [F.asc_nulls_last(c) for c in order]


def realised(trades: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Profits of closed lots, first in first out: keys, symbol, trade (place of the closing trade), lot, pnl.

    trades: keys, symbol, side, quantity, price and the columns `order`. A purchase closes the oldest short lots
    and the rest opens a long one; sales mirror this. Costs aren't part of the profit. Quantities count to a billionth.
    Of trades at the same place of `order`, purchases come first, then smaller quantities, then lower prices: what still ties is alike, so no result depends on how rows lie.

    Between two times at which nothing is held, what opens and what closes lie on one scale of running quantity, opened and
    closed in the same order: each stretch between two ends on it belongs to one opening and one closing trade. So all is windows by keys, symbol and such episodes.
    """
    keys, order = keys or ["combo_id"], order or ["bar_idx"]
    own = [*keys, "symbol"]
    usable = trades.where("symbol is not null and symbol <> '' and quantity > 0")
    in_order = Window.partitionBy(*own).orderBy("trade")
    signed = usable.withColumn("_sign", F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0))
    placed = signed.withColumn("trade", F.row_number().over(Window.partitionBy(*own).orderBy(*_in_turn(order), F.desc("_sign"), *_in_turn(["quantity", "price"]))))
    held = F.sum(F.col("_sign") * F.col("quantity")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("_book", F.coalesce(F.round(held, 9), F.lit(0.0)))
    against = F.when(F.col("_book") * F.col("_sign") < 0, F.least("quantity", F.abs("_book"))).otherwise(0.0)
    rest = F.round(F.col("quantity") - against, 9)
    parts = F.array(F.struct(F.lit(True).alias("closes"), against.alias("q")), F.struct(F.lit(False).alias("closes"), rest.alias("q")))
    columns = [*own, *[c for c in order if c not in (*own, "trade")], "trade"]
    split = placed.withColumn("_begins", (rest > 0) & (F.abs("_book") == against)).select(*columns, "price", "_sign", "_begins", F.explode(parts).alias("p")).where("p.q > 0")
    by_part = Window.partitionBy(*own).orderBy("trade", F.desc("p.closes"))
    episode = F.sum(F.when(F.col("_begins") & ~F.col("p.closes"), 1).otherwise(0)).over(by_part.rowsBetween(Window.unboundedPreceding, 0))
    split = split.withColumn("_episode", episode)
    within = [*own, "_episode"]
    so_far = Window.partitionBy(*within, "p.closes").orderBy("trade").rowsBetween(Window.unboundedPreceding, 0)
    ends = split.withColumn("_end", F.round(F.sum("p.q").over(so_far), 9))
    on_scale = Window.partitionBy(*within).orderBy("_end", "trade", "p.closes")
    # the first opening and the first closing that end here or later, found from the far end
    back = Window.partitionBy(*within).orderBy(F.desc("_end"), F.desc("trade"), F.desc("p.closes")).rowsBetween(Window.unboundedPreceding, 0)
    first = lambda closes, value: F.last(F.when(F.col("p.closes") == closes, value), ignorenulls=True).over(back)
    closing = F.struct(*[F.col(c) for c in columns if c not in own], "price", "_sign")
    pieces = ends.withColumns({"_q": F.round(F.col("_end") - F.coalesce(F.lag("_end").over(on_scale), F.lit(0.0)), 9), "_opened": first(False, F.struct("trade", "price")), "_closed": first(True, closing)})
    pieces = pieces.where("_q > 0 and _opened is not null and _closed is not null")
    pnl = F.col("_q") * (F.col("_closed.price") - F.col("_opened.price")) * -F.col("_closed._sign")
    lot = F.row_number().over(Window.partitionBy(*own, "_closed.trade").orderBy("_opened.trade")) - 1
    return pieces.select(*own, *[F.col(f"_closed.{c}").alias(c) for c in columns if c not in own], lot.alias("lot"), pnl.alias("pnl"))


def trade_metrics(trades: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Twelve measures of trades for each of keys, of profits realised first in, first out.

    avg_trade_cost and avg_trade_size are by realised lot, by trade if none is realised. The streak of losses goes in
    the order of realisation. profit_factor is infinite without losses, 0 without gains. Of equally active
    symbols, the one that traded first counts.
    """
    keys, order = keys or ["combo_id"], order or ["bar_idx"]
    lots = realised(trades, keys, order)
    w = Window.partitionBy(*keys).orderBy(*_in_turn(order), "symbol", "trade", "lot")
    # losses in a row have had equally many other lots before them
    breaks = F.sum(F.when(F.col("pnl") < 0, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = lots.withColumn("_run", breaks).where("pnl < 0").groupBy(*keys, "_run").agg(F.count("*").alias("_length"))
    streak = runs.groupBy(*keys).agg(F.max("_length").alias("max_consecutive_losses"))
    gain, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, -F.col("pnl"))
    won = lots.groupBy(*keys).agg(
        F.count("*").alias("trade_count"), F.count(gain).alias("_wins"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("_gain"), F.coalesce(F.sum(loss), F.lit(0.0)).alias("_loss"),
        F.coalesce(F.avg(gain), F.lit(0.0)).alias("avg_profit"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
    )
    per_symbol = trades.groupBy(*keys, "symbol").agg(
        F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"), F.sum("cost").alias("_cost"), F.sum("quantity").alias("_size"),
        F.sum(F.when(F.col("side") == "BUY", 1).otherwise(0)).alias("_buys"), F.sum(F.when(F.col("side") == "SELL", 1).otherwise(0)).alias("_sells"),
    )
    named = F.col("symbol").isNotNull() & (F.col("symbol") != "")
    active = per_symbol.groupBy(*keys).agg(
        F.sum("_n").alias("_trades"), F.count(F.when(named, 1)).alias("symbol_count"), F.sum("_cost").alias("_cost"), F.sum("_size").alias("_size"), F.sum("_buys").alias("buy_count"), F.sum("_sells").alias("sell_count"),
        F.min(F.when(named, F.struct((-F.col("_n")).alias("n"), "_first", "symbol")))["symbol"].alias("most_active_symbol"),
    )
    out = active.join(won, keys, "left").join(streak, keys, "left").na.fill(0)
    some = F.when(F.col("trade_count") > 0, F.col("trade_count"))
    each = F.coalesce(some, F.col("_trades"))
    factor = F.when(F.col("_loss") > 0, F.col("_gain") / F.when(F.col("_loss") > 0, F.col("_loss"))).when(F.col("_gain") > 0, F.lit(float("inf"))).otherwise(0.0)
    return out.select(
        *keys, "trade_count", "buy_count", "sell_count", (F.col("_cost") / each).alias("avg_trade_cost"), (F.col("_size") / each).alias("avg_trade_size"), F.coalesce(F.col("_wins") / some, F.lit(0.0)).alias("win_rate"),
        factor.alias("profit_factor"), "avg_profit", "avg_loss", "max_consecutive_losses", "symbol_count", F.coalesce("most_active_symbol", F.lit("")).alias("most_active_symbol"),
    )
