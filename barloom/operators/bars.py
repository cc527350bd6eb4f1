"""OHLCV bars: normalising, de-duplicating, aligning, filling, resampling, rolling contracts.

Bars are rows (symbol, ts, open, high, low, close, volume); aligned ones also have bar_idx, which counts the
common calendar from 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import SMALL_ROWS, finite_or_null, is_finite, series, small
from barloom.operators import scan

PRICES = ["open", "high", "low", "close"]
FIELDS = [*PRICES, "volume"]


def normalise(raw: DataFrame) -> DataFrame:
    """Headers trimmed, in lower case, blanks as underscores; `index` or `date` counts as datetime; prices as
    doubles; ts in UTC. Rows whose time can't be read are dropped. A missing column raises ValueError."""
    names = [re.sub(r"\s", "_", c.strip().lower()) for c in raw.columns]
    for alias in ("index", "date"):
        if "datetime" not in names and alias in names:
            names[names.index(alias)] = "datetime"
    missing = [c for c in ["datetime", *FIELDS] if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    named = raw.toDF(*names)
    ts = F.try_to_timestamp(F.col("datetime").cast("string")) if dict(named.dtypes)["datetime"] not in ("timestamp", "timestamp_ntz", "date") else F.col("datetime").cast("timestamp")
    rest = [c for c in named.columns if c not in ("datetime", *FIELDS)]
    return named.select(*rest, ts.alias("ts"), *[finite_or_null(F.col(c).try_cast("double")).alias(c) for c in FIELDS]).where("ts is not null")


def keep_last(bars: DataFrame, arrival: list[str], keys: list[str] | None = None) -> DataFrame:
    """Of rows with equal keys, the one that arrived last."""
    last = Window.partitionBy(*(keys or ["symbol", "ts"])).orderBy(*[F.desc(c) for c in arrival])
    return bars.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")


def resample(bars: DataFrame, rule: str) -> DataFrame:
    """Bars of longer buckets: first open, highest high, lowest low, last close, summed volume.

    rule: a Spark interval such as `6 hours`, aligned to the first day, or `week`, `month`, `quarter`, `year`, labelled
    by the bucket's last day. Empty prices are passed over; buckets without any of a price are dropped.
    """
    if rule in ("week", "month", "quarter", "year"):
        start = F.date_trunc(rule, F.col("ts").cast("timestamp"))
        bucket = {
            "week": start + F.expr("interval 6 days"),
            "month": F.last_day(start).cast("timestamp"),
            "quarter": (F.add_months(start.cast("date"), 3) - F.expr("interval 1 day")).cast("timestamp"),
            "year": (F.add_months(start.cast("date"), 12) - F.expr("interval 1 day")).cast("timestamp"),
        }[rule]
    else:
        count, unit = rule.split()
        seconds = int(count) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
        at = F.col("ts").cast("timestamp")
        if 86400 % seconds:  # buckets that don't divide a day count from the first day
            first = F.lit(bars.agg(F.date_trunc("day", F.min("ts").cast("timestamp")).alias("d")).first()["d"])
        else:
            first = F.lit("1970-01-01").cast("timestamp")
        origin = F.unix_timestamp(first)
        bucket = F.timestamp_seconds(F.floor((F.unix_timestamp(at) - origin) / seconds) * seconds + origin)
    edge = lambda c, by: getattr(F, by)(F.col(c), F.when(F.col(c).isNotNull(), F.col("ts")))
    out = bars.groupBy("symbol", bucket.alias("_bucket")).agg(
        edge("open", "min_by").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), edge("close", "max_by").alias("close"), F.sum("volume").alias("volume")
    )
    return out.withColumnRenamed("_bucket", "ts").dropna(subset=PRICES).select("symbol", "ts", *FIELDS)


def of_ticks(ticks: DataFrame, symbol: str, ts: str, price: Column, volume: Column, unit: str, tie: list[str]) -> DataFrame:
    """Bars of single prices, by calendar unit (`hour`, `day`); equal times go by the columns `tie`."""
    order = F.struct(F.col(ts), *tie)
    rows = ticks.select(F.col(symbol).alias("symbol"), F.date_trunc(unit, F.col(ts).cast("timestamp")).alias("_bar"), price.cast("double").alias("price"), volume.cast("double").alias("size"), order.alias("_order")).where("symbol is not null and price is not null")
    return rows.groupBy("symbol", "_bar").agg(
        F.min_by("price", "_order").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "_order").alias("close"), F.sum("size").alias("volume")
    ).withColumnRenamed("_bar", "ts")


def _calendar(bars: DataFrame) -> tuple[DataFrame, bool]:
    """(every symbol at every time of any symbol, with bar_idx; whether series have more rows than a stretch), after one job that counts as far as plans depend on it."""
    times, symbols = bars.select("ts").distinct(), bars.select("symbol").distinct()
    counted = symbols.limit(SMALL_ROWS + 1).select(F.lit("symbols").alias("what")).unionByName(times.limit(scan.PART_ROWS + 1).select(F.lit("times").alias("what")))
    n = dict(counted.groupBy("what").count().collect())
    few_symbols, long = n.get("symbols", 0) <= SMALL_ROWS, n.get("times", 0) > scan.PART_ROWS
    if long:
        times = numbered(times)
    grid = times.crossJoin(F.broadcast(symbols)) if few_symbols else symbols.crossJoin(small(times))  # all of it is asked for
    whole = grid.join(bars, ["symbol", "ts"], "left")
    return whole if long else whole.withColumn("bar_idx", F.row_number().over(series(["symbol"], "ts")) - 1), long


def numbered(times: DataFrame) -> DataFrame:
    """times (ts, each once) with bar_idx, their place: counted within days, and days on from each other."""
    dealt = times.withColumn("_day", F.to_date("ts"))
    days = dealt.groupBy("_day").agg(F.count("*").alias("_n"))
    before = days.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each day
    placed = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_day").orderBy("ts")) - 1)
    return placed.join(before.select("_day", "_before"), "_day").select("ts", (F.col("_before") + F.col("_nth")).cast("int").alias("bar_idx"))


def on_calendar(bars: DataFrame) -> DataFrame:
    """Every symbol at every time of any symbol, with bar_idx; prices null where a symbol has no bar."""
    return _calendar(bars)[0]


def fill(aligned: DataFrame, long: bool = True) -> DataFrame:
    """Prices carried forward; one gap row before a symbol's first bar takes its prices; empty volume: 0."""
    wanted = {f"_{c}": ("last", F.col(c)) for c in PRICES} | {f"_next_{c}": ("next", F.col(c)) for c in PRICES}
    rows = scan.running(aligned, ["symbol"], wanted, long=long)
    return rows.withColumns({c: F.coalesce(f"_{c}", f"_next_{c}") for c in PRICES} | {"volume": F.coalesce("volume", F.lit(0.0))}).select(*aligned.columns)


def repair_start(aligned: DataFrame, long: bool = True) -> DataFrame:
    """Rows before a symbol's first row with finite prices become copies of it, volume included; later gaps
    are carried forward, field by field. Symbols without such a row stay as they are (see problems())."""
    whole = is_finite(F.col("open")) & is_finite(F.col("high")) & is_finite(F.col("low")) & is_finite(F.col("close"))
    found = F.struct("bar_idx", *FIELDS)
    if long:
        first = aligned.where(whole).groupBy("symbol").agg(F.min_by(found, "bar_idx").alias("_first"))
        rows = aligned.join(first, "symbol", "left")
    else:
        entire = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = aligned.withColumn("_first", F.first(F.when(whole, found), ignorenulls=True).over(entire))
    early = F.col("bar_idx") < F.col("_first.bar_idx")
    rows = rows.withColumns({c: F.when(early, F.col(f"_first.{c}")).otherwise(finite_or_null(F.col(c))) for c in FIELDS}).select(*aligned.columns)
    return scan.running(rows, ["symbol"], {c: ("last", F.col(c)) for c in FIELDS}, long=long).select(*aligned.columns)


def align(bars: DataFrame) -> DataFrame:
    """Bars of all symbols on their common calendar without gaps. Series longer than a stretch are filled stretch by stretch (see scan.running)."""
    grid, long = _calendar(bars)
    return repair_start(fill(grid, long), long)


PROBLEMS = {
    "prices not finite": lambda: ~(is_finite(F.col("open")) & is_finite(F.col("high")) & is_finite(F.col("low")) & is_finite(F.col("close"))),
    "high below low": lambda: F.col("high") < F.col("low"),
    "price not positive": lambda: (F.col("open") <= 0) | (F.col("high") <= 0) | (F.col("close") <= 0),
    "volume negative": lambda: F.col("volume") < 0,
    "volume not finite": lambda: ~is_finite(F.col("volume")),
}


def problems(bars: DataFrame) -> DataFrame:
    """For each symbol, how many rows break each of the rules PROBLEMS."""
    counts = [F.sum(F.when(F.coalesce(bad(), F.lit(False)), 1).otherwise(0)).alias(name.replace(" ", "_")) for name, bad in PROBLEMS.items()]
    return bars.groupBy("symbol").agg(*counts)


def validate(bars: DataFrame) -> DataFrame:
    """bars, or a ValueError that names the rules broken."""
    found = [r.asDict() for r in problems(bars).collect()]
    broken = sorted({name for r in found for name, n in r.items() if name != "symbol" and n})
    if broken:
        raise ValueError("invalid bars: " + ", ".join(b.replace("_", " ") for b in broken))
    return bars


def part(bars: DataFrame, start: int, end: int) -> DataFrame:
    """Bars from start up to but not including end, counted anew."""
    return bars.where((F.col("bar_idx") >= start) & (F.col("bar_idx") < end)).withColumn("bar_idx", F.col("bar_idx") - start)


def continuous(contracts: DataFrame, rolls: DataFrame | None = None, method: str = "difference", keys: list[str] | None = None) -> DataFrame:
    """One series from contracts (contract, seq, ts and prices), or one for each of `keys`: contract seq is used up to the next one's roll.

    rolls (keys, seq, roll): when each contract but the first takes over; by default at its first bar. At each roll the
    new contract is moved onto the level of the series so far: by the difference of its first and the last
    close (`difference`) or by their ratio (`ratio`; none without both). Volume is as it was.
    """
    keys = keys or []
    each = [*keys, "seq"]
    own = contracts.groupBy(*each).agg(F.min("ts").alias("roll"))
    starts = own if rolls is None else own.drop("roll").join(rolls, each, "left")
    by_seq = Window.partitionBy(*keys).orderBy("seq")  # one row for each contract
    spans = starts.withColumn("until", F.lead("roll").over(by_seq)).withColumn("from", F.when(F.row_number().over(by_seq) > 1, F.col("roll")))
    used = contracts.join(small(spans.select(*each, "from", "until")), each).where("(from is null or ts >= from) and (until is null or ts < until)").drop("from", "until")
    edges = used.groupBy(*each).agg(F.min_by("close", "ts").alias("first"), F.max_by("close", "ts").alias("last"))
    before = F.lag("last").over(by_seq)
    if method == "difference":
        # moving each contract by the gaps at all rolls so far puts it on the level of the moved ones before
        shift = F.sum(F.coalesce(before - F.col("first"), F.lit(0.0))).over(by_seq)
    elif method == "ratio":
        step = F.when(before.isNotNull() & (before != 0) & (F.col("first") != 0), before / F.when(F.col("first") != 0, F.col("first"))).otherwise(1.0)
        shift = F.exp(F.sum(F.ln(step)).over(by_seq))
    else:
        raise ValueError(f"unknown roll method: {method}")
    moved = used.join(small(edges.withColumn("shift", shift).select(*each, "shift")), each)
    change = (lambda c: F.col(c) + F.col("shift")) if method == "difference" else (lambda c: F.col(c) * F.col("shift"))
    out = moved.withColumns({c: change(c) for c in PRICES})
    return keep_last(out, ["seq"], [*keys, "ts"]).select(*keys, "ts", "contract", *FIELDS)
