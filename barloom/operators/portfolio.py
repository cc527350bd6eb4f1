"""Simulation of signals: positions one bar later, fills at the open, costs, equity, trades, risk rules.

vector() is window functions and aggregates alone. Rules that depend on equity are first looked for on that curve (see batch): as
long as none binds, it is the curve under rules as well. equity_under() goes on from the first bar in which one does, many
combinations at a time; sequential(), which also tells trades and risk events, then streams the run's bars in order through a step that sees all assets of a bar.
Signals are rows (combo_id, symbol, ts, bar_idx, open, close, volume, signal) with every symbol in every bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clipped, day_id, series, small, week_id
from barloom.functions.costs import Commission, FixedCommission, FixedSlippage, PercentCommission, PercentSlippage, Rules, Slippage
from barloom.operators import batch, scan
from barloom.operators.scan import fold

CASH = 1_000_000.0
KEYS = ["combo_id", "symbol"]


def positions(signals: DataFrame, slippage: Slippage, commission: Commission, rules: Rules | None = None, multiplier: float | Column = 1.0) -> DataFrame:
    """signals with position, prev_position, delta, fill_price, slippage_cash, commission_cash, pnl of each bar.

    The position is the signal of the bar before, clipped; it is entered at the open. Profit counts the
    position before from close to open, and the new one from open to close.
    """
    dealt = scan.in_parts(signals, 2, lambda rows, own: _lagged(rows, own), KEYS)
    rows = dealt.withColumn("delta", F.col("position") - F.col("prev_position"))
    price = slippage.price(F.col("open"), F.col("delta"), F.abs("delta"), F.col("volume"))
    if rules and (rules.limit_up or rules.limit_down):
        price = rules.limited(price, F.col("close_before"))
    rows = rows.withColumn("fill_price", price)
    each = multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))
    later = F.col("close_before").isNotNull()
    cash = {
        "slippage_cash": F.abs(F.col("fill_price") - F.col("open")) * F.abs("delta") * each,
        "commission_cash": commission.cash(F.abs("fill_price") * F.abs("delta") * each, F.abs("delta")),
        "pnl": (F.col("prev_position") * (F.col("open") - F.col("close_before")) + F.col("position") * (F.col("close") - F.col("open"))) * each,
    }
    return rows.withColumns({n: F.when(later, v).otherwise(0.0) for n, v in cash.items()})


def _lagged(signals: DataFrame, keys: list[str]) -> DataFrame:
    """signals with position, prev_position, close_before, and target where they have the signal wanted, _wanted."""
    w = series(keys)
    held = lambda c, k: F.coalesce(clipped(F.lag(c, k).over(w)), F.lit(0.0))
    target = {"target": held("_wanted", 1)} if "_wanted" in signals.columns else {}
    return signals.withColumns({"position": held("signal", 1), "prev_position": held("signal", 2), "close_before": F.lag("close").over(w), **target})


def equity_of(held: DataFrame, cash: float = CASH, keys: list[str] | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """equity, ret and turnover by bar of positions(): cash plus what was gained so far, never below 0; and `more` aggregates of a bar.

    Losses beyond all cash are forgiven once: the lowest point below 0 so far is added back.
    """
    keys, more = keys or ["combo_id"], more or {}
    per_bar = held.groupBy(*keys, "bar_idx").agg(F.min("ts").alias("ts"), F.sum(F.col("pnl") - F.col("slippage_cash") - F.col("commission_cash")).alias("gain"), F.sum(F.abs("delta")).alias("turnover"), *[c.alias(n) for n, c in more.items()])
    # two levels: gains and their lowest sum within stretches, and what stretches bring in
    part = per_bar.withColumn("_part", scan.stretch()).repartition(*keys, "_part")
    inside = Window.partitionBy(*keys, "_part").orderBy("bar_idx")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    later = lambda x: F.when(F.col("bar_idx") > 0, x)
    rows = part.withColumn("_sum", F.sum("gain").over(so_far)).withColumn("_least", F.min(later(F.col("_sum"))).over(so_far))
    ends = rows.groupBy(*keys, "_part").agg(F.sum("gain").alias("_gain"), F.min(later(F.col("_sum"))).alias("_low"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_in", F.coalesce(F.sum("_gain").over(earlier), F.lit(0.0)) + cash).withColumn("_low_in", F.min(F.col("_in") + F.col("_low")).over(earlier)).withColumn("_follows", F.count("*").over(earlier) > 0)
    joined = rows.join(ends.select(*keys, "_part", "_in", "_low_in", "_follows"), [*keys, "_part"])

    def level(so_far: Column, least: Column) -> Column:
        return so_far + F.col("_in") - F.least(F.coalesce("_low_in", F.lit(0.0)), F.coalesce(least + F.col("_in"), F.lit(0.0)), F.lit(0.0))

    last_sum, last_least = (F.lag(c).over(inside) for c in ("_sum", "_least"))
    out = joined.withColumn("equity", level(F.col("_sum"), F.col("_least"))).withColumn("_before", F.when(last_sum.isNotNull() | F.col("_follows"), level(F.coalesce(last_sum, F.lit(0.0)), last_least)))
    before = F.col("_before")
    ret = F.when(before.isNotNull(), (F.col("equity") - before) / F.when(before > 1, before).otherwise(1.0)).otherwise(0.0)
    return out.withColumn("ret", ret).select(*keys, "ts", "bar_idx", "equity", "ret", "turnover", *more)


def vector(signals: DataFrame, slippage: Slippage, commission: Commission, rules: Rules | None = None, cash: float = CASH, multiplier: float | Column = 1.0) -> DataFrame:
    """equity_of(positions(...)): all combinations at once."""
    return equity_of(positions(signals, slippage, commission, rules, multiplier), cash)


def equity_under(signals: DataFrame, slippage: Slippage, commission: Commission, rules: Rules | None = None, cash: float = CASH, multiplier: float = 1.0) -> DataFrame:
    """combo_id, ts, bar_idx, equity, ret, turnover of all combinations under all rules: what a single run gives each of them.

    Combinations in which no rule binds are vector()'s curves, and so are the others up to the first bar where one does, from which they are
    stepped on together. Whether any binds is found by a job of this call; if none does, no Python worker starts.
    """
    if rules is None or not rules.by_equity:
        return vector(signals, slippage, commission, rules, cash, multiplier)
    held = _unruled(signals, slippage, commission, rules, multiplier)
    found, n = batch.fetched(batch.screen(held, rules, cash, multiplier))
    curve = equity_of(held, cash)
    if not n:
        return curve
    groups = batch.groups_of(n, int(signals.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    until = found.select(F.col("combo_id").alias("_combo"), "from")
    before = curve.join(small(until), F.col("combo_id") == F.col("_combo"), "left").where("`from` is null or bar_idx < `from`").select(*curve.columns)
    return before.unionByName(batch.stepped(held, found, slippage, commission, rules, multiplier, groups))


def _unruled(signals: DataFrame, slippage: Slippage, commission: Commission, rules: Rules, multiplier: float) -> DataFrame:
    """positions() under the largest position alone, which doesn't depend on equity, and `target`, the position wanted."""
    rows = signals.withColumn("_wanted", F.col("signal"))
    if rules.max_position > 0:
        rows = rows.withColumn("signal", clipped(clipped(F.col("signal")), -rules.max_position, rules.max_position))
    return positions(rows, slippage, commission, rules, multiplier).drop("_wanted")


def trades_of(held: DataFrame) -> DataFrame:
    """Fills of positions() with a change of position."""
    some = held.where("abs(delta) >= 1e-12 and close_before is not null")
    return some.select(
        "combo_id", "ts", "bar_idx", "symbol", F.when(F.col("delta") >= 0, "BUY").otherwise("SELL").alias("side"), F.abs("delta").alias("quantity"), F.col("fill_price").alias("price"),
        (F.col("slippage_cash") + F.col("commission_cash")).alias("cost"),
    )


def bankruptcy(equity: DataFrame) -> DataFrame:
    """For each combination, whether equity reached 0 and in which bar first."""
    first = F.min(F.when(F.col("equity") <= 0, F.col("bar_idx")))
    return equity.groupBy("combo_id").agg(first.isNotNull().alias("bankrupt"), first.alias("bankrupt_bar"))


def cost_scenarios(signals: DataFrame, scenarios: dict[str, tuple[Slippage, Commission]], rules: Rules | None = None, cash: float = CASH, multiplier: float = 1.0) -> DataFrame:
    """vector() of one set of signals under each named pair of costs, with the column scenario; one job.

    Positions are found once; each scenario only prices them anew.
    """
    if not scenarios or any(not n.strip() for n in scenarios):
        raise ValueError("scenarios need names")
    base = positions(signals, FixedSlippage(0.0), FixedCommission(0.0), rules, multiplier).drop("fill_price", "slippage_cash", "commission_cash")
    priced = []
    for name, (slippage, commission) in scenarios.items():
        price = slippage.price(F.col("open"), F.col("delta"), F.abs("delta"), F.col("volume"))
        price = rules.limited(price, F.col("close_before")) if rules and (rules.limit_up or rules.limit_down) else price
        slip, fee = F.abs(price - F.col("open")) * F.abs("delta") * multiplier, commission.cash(F.abs(price) * F.abs("delta") * multiplier, F.abs("delta"))
        priced.append(F.struct(F.lit(name).alias("scenario"), slip.alias("slip"), fee.alias("fee")))
    each = base.withColumn("_priced", F.explode(F.array(*priced)))
    later = F.col("close_before").isNotNull()
    each = each.withColumns({"scenario": F.col("_priced.scenario"), "slippage_cash": F.when(later, F.col("_priced.slip")).otherwise(0.0), "commission_cash": F.when(later, F.col("_priced.fee")).otherwise(0.0)})
    return equity_of(each, cash, ["scenario", "combo_id"])


def _price_at(slippage: Slippage, price: float, side: float, quantity: float, volume: float) -> float:
    """As the column expression of slippage, for one trade."""
    sign = 1.0 if side >= 0 else -1.0
    if isinstance(slippage, FixedSlippage):
        return price + sign * slippage.points
    if isinstance(slippage, PercentSlippage):
        return price * (1 + sign * slippage.rate)
    return price * (1 + sign * min(quantity / max(volume, 1.0), slippage.most) * slippage.impact)


def _fee_at(commission: Commission, notional: float, quantity: float) -> float:
    if isinstance(commission, FixedCommission):
        return max(quantity, 0.0) * commission.value
    if isinstance(commission, PercentCommission):
        return max(notional, 0.0) * commission.rate
    tiers = sorted(commission.tiers)
    rate = next((r for bound, r in tiers if notional <= bound), tiers[-1][1] if tiers else commission.fallback)
    return max(notional, 0.0) * rate


class _Account:
    """What one combination carries from bar to bar."""

    def __init__(self, cash: float, n: int):
        self.equity = self.peak = self.day_anchor = self.week_anchor = cash
        self.held, self.addons = [0.0] * n, [0] * n
        self.day = self.week = None
        self.day_stop = self.week_stop = self.stopped = self.reducing = self.told = False


def sequential(signals: DataFrame, slippage: Slippage, commission: Commission, rules: Rules | None = None, cash: float = CASH, multiplier: float = 1.0) -> DataFrame:
    """By bar: equity, ret, turnover, positions, trades and risk events, under all rules.

    Within a bar: halving or stopping after losses, largest position, add-ons, risk of a trade, margin; then
    fills and profit; then the tests for losses, which bind from the next bar. Days and weeks that
    begin anew lift their stops. A bar of a combination is one row with an array over symbols, by name.
    Where no rule binds, which a job of this call finds out, all of it comes from windows.
    """
    if rules is None or not rules.by_equity:
        return _assembled(positions(signals, slippage, commission, rules, multiplier), cash)
    if rules.max_position <= 0:
        held = _unruled(signals, slippage, commission, rules, multiplier)
        if batch.screen(held, rules, cash, multiplier).isEmpty():
            return _assembled(held, cash)
    return _bar_by_bar(signals, slippage, commission, rules, cash, multiplier)


def _bar_by_bar(signals: DataFrame, slippage: Slippage, commission: Commission, rules: Rules | None = None, cash: float = CASH, multiplier: float = 1.0) -> DataFrame:
    """sequential(), whether or not a rule binds."""
    w = series(KEYS)
    rows = signals.withColumn("_target", F.coalesce(clipped(F.lag("signal").over(w)), F.lit(0.0))).withColumn("_before", F.lag("close").over(w))
    asset = F.struct("symbol", "open", "close", "volume", "_target", "_before")
    bars = rows.groupBy("combo_id", "bar_idx").agg(F.min("ts").alias("ts"), F.sort_array(F.collect_list(asset)).alias("assets"))
    bars = bars.withColumn("day", day_id(F.col("ts"))).withColumn("week", week_id(F.col("ts")))

    def step(account, row):
        assets, day, week = row
        if account is None:
            account = _Account(cash, len(assets))
            account.day, account.week = day, week
            return account, (cash, 0.0, 0.0, account.held, [], [])
        return _bar(account, assets, day, week, slippage, commission, rules, multiplier)

    made = "equity double, ret double, turnover double, positions array<double>, trades array<struct<symbol:string,side:string,quantity:double,price:double,cost:double>>, events array<struct<type:string,detail:string>>"
    return fold(bars, ["combo_id"], ["bar_idx"], ["assets", "day", "week"], lambda: None, step, made)


_TRADE = "struct<symbol:string,side:string,quantity:double,price:double,cost:double>"


def _assembled(held: DataFrame, cash: float) -> DataFrame:
    """sequential()'s rows of positions() under which no rule binds."""
    trade = F.struct("symbol", F.when(F.col("delta") >= 0, "BUY").otherwise("SELL").alias("side"), F.abs("delta").alias("quantity"), F.col("fill_price").alias("price"), (F.col("slippage_cash") + F.col("commission_cash")).alias("cost"))
    filled = F.when((F.abs("delta") >= 1e-12) & F.col("close_before").isNotNull(), trade)
    more = {
        "_held": F.sort_array(F.collect_list(F.struct("symbol", "position"))),
        "trades": F.sort_array(F.collect_list(filled)).cast(f"array<{_TRADE}>"),
    }
    out = equity_of(held, cash, more=more)
    return out.withColumn("positions", F.transform("_held", lambda h: h["position"])).withColumn("events", F.array().cast("array<struct<type:string,detail:string>>")).drop("_held")


def _targets(a: _Account, assets: list[dict], rules: Rules | None, multiplier: float) -> tuple[list[float], bool]:
    """Positions that the rules allow, and whether a rule bit."""
    cur, bit = [x["_target"] for x in assets], False
    if rules is None:
        return cur, bit
    if a.reducing:
        cur, bit = [c * 0.5 for c in cur], True
    if a.day_stop or a.week_stop or a.stopped:
        cur, bit = [0.0] * len(cur), True
    if rules.max_position > 0:
        limited = [max(-rules.max_position, min(rules.max_position, c)) for c in cur]
        bit = bit or any(abs(x - y) > 1e-8 + 1e-5 * abs(y) for x, y in zip(limited, cur, strict=True))
        cur = limited
    if rules.max_addons > 0:
        for k, (prev, now) in enumerate(zip(a.held, cur, strict=True)):
            if abs(prev) < 1e-12 or prev * now <= 0:
                a.addons[k] = 0
            elif abs(now) > abs(prev) + 1e-12:
                a.addons[k] += 1
                if a.addons[k] > rules.max_addons:
                    cur[k], a.addons[k], bit = prev, rules.max_addons, True
            elif abs(now) < abs(prev) - 1e-12:
                a.addons[k] = 0
    if rules.max_risk_per_trade > 0 and a.equity > 0:
        wanted = sum(abs(c - p) * x["open"] * multiplier for c, p, x in zip(cur, a.held, assets, strict=True))
        allowed = rules.max_risk_per_trade * a.equity
        if wanted > allowed:
            cur, bit = [p + (c - p) * allowed / (wanted + 1e-12) for c, p in zip(cur, a.held, strict=True)], True
    needed = rules.margin_ratio * sum(abs(c) * x["open"] * multiplier for c, x in zip(cur, assets, strict=True))
    if needed > a.equity:
        cur, bit = [c * max(a.equity / (needed + 1e-12), 0.0) for c in cur], True
    return cur, bit


def _bar(a: _Account, assets: list[dict], day: int, week: int, slippage: Slippage, commission: Commission, rules: Rules | None, multiplier: float):
    start = a.equity
    if day != a.day:
        a.day, a.day_anchor, a.day_stop = day, start, False
    if week != a.week:
        a.week, a.week_anchor, a.week_stop = week, start, False
    cur, bit = _targets(a, assets, rules, multiplier)
    events = [{"type": "position_limit", "detail": "target limited by rules"}] if bit else []
    trades, pnl, cost, turnover = [], 0.0, 0.0, 0.0
    for prev, now, x in zip(a.held, cur, assets, strict=True):
        delta = now - prev
        price = _price_at(slippage, x["open"], delta, abs(delta), x["volume"])
        if rules and rules.limit_up is not None:
            price = min(price, x["_before"] * (1 + rules.limit_up))
        if rules and rules.limit_down is not None:
            price = max(price, x["_before"] * (1 - rules.limit_down))
        own = abs(price - x["open"]) * abs(delta) * multiplier + _fee_at(commission, abs(price) * abs(delta) * multiplier, abs(delta))
        pnl += (prev * (x["open"] - x["_before"]) + now * (x["close"] - x["open"])) * multiplier
        cost, turnover = cost + own, turnover + abs(delta)
        if abs(delta) >= 1e-12:
            trades.append({"symbol": x["symbol"], "side": "BUY" if delta >= 0 else "SELL", "quantity": abs(delta), "price": price, "cost": own})
    a.equity, a.held = max(start + pnl - cost, 0.0), cur
    a.peak = max(a.peak, a.equity)
    if rules:
        _losses(a, rules, events)
    return a, (a.equity, (a.equity - start) / (start if start > 1 else 1.0), turnover, cur, trades, events)


def _losses(a: _Account, rules: Rules, events: list[dict]) -> None:
    """Tests after a bar; what they find binds from the next one."""
    share = lambda anchor: (anchor - a.equity) / max(anchor, 1e-12)
    if rules.max_daily_loss > 0 and not a.day_stop and share(a.day_anchor) >= rules.max_daily_loss:
        a.day_stop = True
        events.append({"type": "daily_loss_breach", "detail": f"{share(a.day_anchor):.6f}"})
    if rules.max_weekly_loss > 0 and not a.week_stop and share(a.week_anchor) >= rules.max_weekly_loss:
        a.week_stop = True
        events.append({"type": "weekly_loss_breach", "detail": f"{share(a.week_anchor):.6f}"})
    if rules.max_drawdown > 0:
        deep = share(a.peak) >= rules.max_drawdown
        a.reducing = a.reducing or (deep and rules.drawdown_action == "reduce")
        if deep:
            a.stopped = a.stopped or rules.drawdown_action == "stop"
            if not a.told:
                events.append({"type": "drawdown_breach", "detail": f"{share(a.peak):.6f}"})
            a.told = True


def events_of(simulated: DataFrame) -> DataFrame:
    return simulated.select("combo_id", F.col("bar_idx").alias("bar"), F.explode("events").alias("e")).select("combo_id", "bar", "e.type", "e.detail")


def trade_log(simulated: DataFrame) -> DataFrame:
    each = simulated.select("combo_id", "ts", "bar_idx", F.explode("trades").alias("t"))
    return each.select("combo_id", "ts", "bar_idx", "t.symbol", "t.side", "t.quantity", "t.price", "t.cost")
