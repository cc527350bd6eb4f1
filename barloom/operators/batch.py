"""Simulation of many combinations under rules that depend on equity: screen, then step.

screen() runs every combination without those rules, by windows alone, and finds the first bar at which one of them
binds. Before it the combination's curve is what it would be without rules; combinations in which none binds are done. For the others,
stepped() goes on from that bar, bar by bar: a task holds the state of some dozens of combinations in arrays and takes one step a
bar for all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import day_id, series, small, week_id
from barloom.functions.costs import Commission, FixedCommission, FixedSlippage, PercentCommission, PercentSlippage, Rules, Slippage

#: Combinations that one task steps through together.
TOGETHER = 128
#: A loss is looked at bar by bar where windows find it this close to a limit: sums of other orders round otherwise.
_CLOSE = 1e-9


def _beyond(held: DataFrame, rules: Rules, cash: float, multiplier: float) -> DataFrame:
    """combo_id, bar_idx and what a simulation carries into the bar, by bar, of positions() without rules; binds: whether a rule acts in the bar or on its loss."""
    added = (F.abs("position") > F.abs("prev_position") + 1e-12) & (F.col("position") * F.col("prev_position") > 0)
    per_bar = held.groupBy("combo_id", "bar_idx").agg(
        F.min("ts").alias("ts"), F.sum(F.col("pnl") - F.col("slippage_cash") - F.col("commission_cash")).alias("gain"),
        (F.sum(F.abs("position") * F.col("open")) * multiplier).alias("open_value"), (F.sum(F.abs("delta") * F.col("open")) * multiplier).alias("traded"), F.max(added).alias("added"),
    )
    w = series(["combo_id"])
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = per_bar.withColumn("path", F.sum("gain").over(so_far) + cash)
    lowest = F.coalesce(F.min(F.when(F.col("bar_idx") > 0, F.col("path"))).over(so_far), F.lit(0.0))
    rows = rows.withColumn("equity", F.col("path") - F.least(lowest, F.lit(0.0))).withColumns({"day": day_id(F.col("ts")), "week": week_id(F.col("ts"))})
    rows = rows.withColumn("before", F.coalesce(F.lag("equity").over(w), F.lit(cash))).withColumn("peak", F.max("equity").over(so_far))
    rows = rows.withColumns({f"{p}_anchor": F.first("before").over(Window.partitionBy("combo_id", p).orderBy("bar_idx")) for p in ("day", "week")})
    lost = lambda anchor, limit: (F.col(anchor) - F.col("equity")) / F.greatest(F.col(anchor), F.lit(1e-12)) >= limit * (1 - _CLOSE)
    acts: list[Column] = []
    if rules.margin_ratio > 0:
        acts.append(F.col("open_value") * rules.margin_ratio > F.col("before") * (1 - _CLOSE))
    if rules.max_addons > 0:
        acts.append(F.col("added"))
    if rules.max_risk_per_trade > 0:
        acts.append((F.col("before") > 0) & (F.col("traded") > F.col("before") * rules.max_risk_per_trade * (1 - _CLOSE)))
    if rules.max_daily_loss > 0:
        acts.append(lost("day_anchor", rules.max_daily_loss))
    if rules.max_weekly_loss > 0:
        acts.append(lost("week_anchor", rules.max_weekly_loss))
    if rules.max_drawdown > 0:
        acts.append(lost("peak", rules.max_drawdown))
    any_of = F.lit(False)
    for a in acts:
        any_of = any_of | a
    return rows.withColumn("binds", (F.col("bar_idx") > 0) & any_of)


def screen(held: DataFrame, rules: Rules, cash: float, multiplier: float) -> DataFrame:
    """A row for each combination of held (positions(), largest positions applied) in which a rule binds: combo_id, from (the first such bar), and of the bar before it equity, peak,
    day, day_anchor, week, week_anchor."""
    rows = _beyond(held, rules, cash, multiplier)
    w = series(["combo_id"])
    known = ["peak", "day", "day_anchor", "week", "week_anchor"]
    state = F.struct(F.col("bar_idx"), F.col("before").alias("equity"), *[F.lag(c).over(w).alias(c) for c in known])
    first = rows.withColumn("_state", state).where("binds").groupBy("combo_id").agg(F.min("_state").alias("s"))
    return first.select("combo_id", F.col("s.bar_idx").alias("from"), "s.equity", *[f"s.{c}" for c in known])


def fetched(found: DataFrame) -> tuple[DataFrame, int]:
    """found of screen() and its number of rows, evaluated once where it is small."""
    rows = found.limit(MOST_STATES + 1).collect()
    if len(rows) > MOST_STATES:
        return found, found.count()
    return found.sparkSession.createDataFrame(rows, found.schema), len(rows)


def groups_of(combinations: int, partitions: int) -> int:
    """Into how many groups combinations go: enough for all partitions, of 16 at least and TOGETHER at most."""
    return -(-combinations // max(16, min(TOGETHER, -(-combinations // partitions))))


def _prices(slippage: Slippage, price: np.ndarray, delta: np.ndarray, volume: np.ndarray) -> np.ndarray:
    """As the column expression of slippage."""
    sign = np.where(delta >= 0, 1.0, -1.0)
    if isinstance(slippage, FixedSlippage):
        return price + sign * slippage.points
    if isinstance(slippage, PercentSlippage):
        return price * (1 + sign * slippage.rate)
    return price * (1 + sign * np.minimum(np.abs(delta) / np.maximum(volume, 1.0), slippage.most) * slippage.impact)


def _fees(commission: Commission, notional: np.ndarray, quantity: np.ndarray) -> np.ndarray:
    if isinstance(commission, FixedCommission):
        return np.maximum(quantity, 0.0) * commission.value
    if isinstance(commission, PercentCommission):
        return np.maximum(notional, 0.0) * commission.rate
    tiers = sorted(commission.tiers)
    if not tiers:
        return np.maximum(notional, 0.0) * commission.fallback
    rates = np.array([r for _, r in tiers])
    return np.maximum(notional, 0.0) * rates[np.minimum(np.searchsorted([b for b, _ in tiers], notional), len(tiers) - 1)]


class Accounts:
    """The state of some combinations, in arrays with a place for each, and for each asset of each."""

    def __init__(self, slippage: Slippage, commission: Commission, rules: Rules, multiplier: float):
        self.slippage, self.commission, self.rules, self.multiplier = slippage, commission, rules, multiplier
        self.places: dict[int, int] = {}
        self.assets: dict[tuple[int, str], int] = {}
        self.equity, self.peak, self.day_anchor, self.week_anchor = (np.zeros(0) for _ in range(4))
        self.day, self.week = (np.zeros(0, np.int64) for _ in range(2))
        self.day_stop, self.week_stop, self.stopped, self.reducing = (np.zeros(0, bool) for _ in range(4))
        self.held, self.addons = np.zeros(0), np.zeros(0, np.int64)
        self._ids: np.ndarray | None = None
        self._symbols: list[str] | None = None

    def find(self, ids: np.ndarray, symbols: list[str], rows: dict[str, np.ndarray]) -> None:
        """Places of the rows of a bar (ids ascending); combinations that are new take their state from rows."""
        if self._ids is not None and len(ids) == len(self._ids) and np.array_equal(ids, self._ids) and symbols == self._symbols:
            return
        self._ids, self._symbols = ids, symbols
        self.starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        self.owner = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(ids))))
        new = [int(k) for k in self.starts if int(ids[k]) not in self.places]
        if new:
            for k in new:
                self.places[int(ids[k])] = len(self.places)
            for name in ("equity", "peak", "day", "day_anchor", "week", "week_anchor"):
                setattr(self, name, np.concatenate([getattr(self, name), rows[f"_{name}"][new].astype(getattr(self, name).dtype)]))
            for name in ("day_stop", "week_stop", "stopped", "reducing"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros(len(new), bool)]))
        at, missing = np.empty(len(ids), np.int64), []
        for k, key in enumerate(zip(ids.tolist(), symbols, strict=True)):
            if key not in self.assets:
                self.assets[key] = len(self.assets)
                missing.append(k)
            at[k] = self.assets[key]
        self.held = np.concatenate([self.held, rows["prev_position"][missing]])
        self.addons = np.concatenate([self.addons, np.zeros(len(missing), np.int64)])
        self.at, self.who = at, np.array([self.places[int(ids[k])] for k in self.starts])

    def _sum(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)

    def step(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equity, return and turnover of each combination after a bar."""
        who, owner, rules = self.who, self.owner, self.rules
        start, prev = self.equity[who].copy(), self.held[self.at]
        for name in ("day", "week"):
            now, known, anchor, stop = rows[name][self.starts], getattr(self, name), getattr(self, f"{name}_anchor"), getattr(self, f"{name}_stop")
            anew = now != known[who]
            known[who], anchor[who], stop[who] = now, np.where(anew, start, anchor[who]), stop[who] & ~anew
        cur = self._allowed(rows["target"], prev, rows["open"], start)
        delta = cur - prev
        price = _prices(self.slippage, rows["open"], delta, rows["volume"])
        if rules.limit_up is not None:
            price = np.minimum(price, rows["before"] * (1 + rules.limit_up))
        if rules.limit_down is not None:
            price = np.maximum(price, rows["before"] * (1 - rules.limit_down))
        moved = np.abs(delta)
        cost = np.abs(price - rows["open"]) * moved * self.multiplier + _fees(self.commission, np.abs(price) * moved * self.multiplier, moved)
        pnl = (prev * (rows["open"] - rows["before"]) + cur * (rows["close"] - rows["open"])) * self.multiplier
        equity = np.maximum(start + self._sum(pnl) - self._sum(cost), 0.0)
        self.held[self.at], self.equity[who] = cur, equity
        self.peak[who] = np.maximum(self.peak[who], equity)
        share = lambda anchor: (anchor[who] - equity) / np.maximum(anchor[who], 1e-12)
        if rules.max_daily_loss > 0:
            self.day_stop[who] |= share(self.day_anchor) >= rules.max_daily_loss
        if rules.max_weekly_loss > 0:
            self.week_stop[who] |= share(self.week_anchor) >= rules.max_weekly_loss
        if rules.max_drawdown > 0 and rules.drawdown_action in ("stop", "reduce"):
            hit = self.stopped if rules.drawdown_action == "stop" else self.reducing
            hit[who] |= share(self.peak) >= rules.max_drawdown
        return equity, (equity - start) / np.where(start > 1, start, 1.0), self._sum(moved)

    def _allowed(self, target: np.ndarray, prev: np.ndarray, price: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Positions that the rules allow, in the order in which they act."""
        who, owner, rules = self.who, self.owner, self.rules
        cur = np.where(self.reducing[who][owner], target * 0.5, target)
        cur = np.where((self.day_stop[who] | self.week_stop[who] | self.stopped[who])[owner], 0.0, cur)
        if rules.max_position > 0:
            cur = np.clip(cur, -rules.max_position, rules.max_position)
        if rules.max_addons > 0:
            flat = (np.abs(prev) < 1e-12) | (prev * cur <= 0)
            more, less = ~flat & (np.abs(cur) > np.abs(prev) + 1e-12), ~flat & (np.abs(cur) < np.abs(prev) - 1e-12)
            count = np.where(flat | less, 0, self.addons[self.at] + more)
            over = more & (count > rules.max_addons)
            cur, self.addons[self.at] = np.where(over, prev, cur), np.where(over, rules.max_addons, count)
        if rules.max_risk_per_trade > 0:
            wanted, allowed = self._sum(np.abs(cur - prev) * price * self.multiplier), rules.max_risk_per_trade * start
            over = (start > 0) & (wanted > allowed)
            cur = np.where(over[owner], prev + (cur - prev) * (allowed / (wanted + 1e-12))[owner], cur)
        needed = rules.margin_ratio * self._sum(np.abs(cur) * price * self.multiplier)
        over = needed > start
        return np.where(over[owner], cur * np.maximum(start / (needed + 1e-12), 0.0)[owner], cur)


#: Combinations whose state at the bar where a rule binds is held by the driver, at most; beyond it, the screen runs again where it is joined.
MOST_STATES = 10_000
_STATE = ["equity", "peak", "day", "day_anchor", "week", "week_anchor"]


def stepped(held: DataFrame, found: DataFrame, slippage: Slippage, commission: Commission, rules: Rules, multiplier: float, groups: int) -> DataFrame:
    """combo_id, ts, bar_idx, equity, ret, turnover of the combinations of found (from screen()), from the bar `from` on.

    Combinations are dealt to `groups` groups; rows of a group stream by bar. Combinations are told apart by 64-bit hashes of their ids.
    """
    state = found.select(F.col("combo_id").alias("_combo"), "from", *[F.col(c).alias(f"_{c}") for c in _STATE])
    rows = held.join(small(state), F.col("combo_id") == F.col("_combo")).where(F.col("bar_idx") >= F.col("from"))
    number = F.xxhash64("combo_id")
    used = rows.select(
        F.pmod(number, F.lit(groups)).alias("_group"), number.alias("_id"), "combo_id", "ts", "bar_idx", "symbol", *[F.col(c).cast("double").alias(c) for c in ("open", "close", "volume")],
        F.col("target").alias("target"), F.col("close_before").cast("double").alias("before"), F.col("prev_position").alias("prev_position"),
        day_id(F.col("ts")).cast("long").alias("day"), week_id(F.col("ts")).cast("long").alias("week"), *[f"_{c}" for c in _STATE],
    )
    names = used.columns
    numbers = ["open", "close", "volume", "target", "before", "prev_position", "day", "week", *[f"_{c}" for c in _STATE]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        group, accounts = None, None
        for batch in batches:
            whole = batch if rest is None or not len(rest) else pa.concat_batches([rest, batch])
            cuts, made = _bars(whole), []
            for first, last in zip(cuts[:-2], cuts[1:-1], strict=True):
                group, accounts, out = one(whole.slice(first, last - first), group, accounts)
                made.append(out)
            if made:
                yield pa.concat_batches(made)
            rest = whole.slice(cuts[-2]) if len(cuts) > 1 else whole
        if rest is not None and len(rest):
            yield one(rest, group, accounts)[2]

    def _bars(whole: pa.RecordBatch) -> list[int]:
        """Where bars begin, and the end."""
        of, bar = (whole.column(names.index(c)).to_numpy() for c in ("_group", "bar_idx"))
        change = np.flatnonzero((of[1:] != of[:-1]) | (bar[1:] != bar[:-1])) + 1
        return [0, *change.tolist(), len(whole)] if len(whole) else [0]

    def one(bar: pa.RecordBatch, group, accounts):
        now = bar.column(0)[0].as_py()
        if now != group:
            group, accounts = now, Accounts(slippage, commission, rules, multiplier)
        rows = {c: bar.column(names.index(c)).to_numpy(zero_copy_only=False) for c in numbers}
        accounts.find(bar.column(1).to_numpy(), bar.column(names.index("symbol")).to_pylist(), rows)
        equity, ret, turnover = accounts.step(rows)
        firsts = bar.take(pa.array(accounts.starts))
        return group, accounts, pa.RecordBatch.from_arrays([*(firsts.column(names.index(c)) for c in ("combo_id", "ts", "bar_idx")), pa.array(equity), pa.array(ret), pa.array(turnover)], ["combo_id", "ts", "bar_idx", "equity", "ret", "turnover"])

    schema = used.select("combo_id", "ts", "bar_idx").schema.add("equity", "double").add("ret", "double").add("turnover", "double")
    return used.repartition("_group").sortWithinPartitions("_group", "bar_idx", "_id", "symbol").mapInArrow(run, schema)
