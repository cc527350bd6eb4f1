"""Is a result more than luck: windows, corrections, sensitivity, permutations, regimes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import series, small
from barloom.operators import metrics, portfolio
from barloom.operators.indicators import drawdown


#: Hypotheses of one correction: they are ranked in one window.
MOST_TESTS = 10_000_000


def windows(spark: SparkSession, n_bars: int, train: int, test: int, step: int) -> DataFrame:
    """window, train_start, train_end, test_start, test_end (ends exclusive), each `step` bars on."""
    if min(train, test, step) <= 0:
        raise ValueError("train, test and step must be positive")
    if n_bars < train + test:
        return spark.createDataFrame([], "window int, train_start int, train_end int, test_start int, test_end int")
    start = F.explode(F.sequence(F.lit(0), F.lit(n_bars - train - test), F.lit(step)))
    rows = spark.range(1).select(start.alias("train_start"))
    return rows.select(
        (F.col("train_start") / step).cast("int").alias("window"), "train_start", (F.col("train_start") + train).alias("train_end"), (F.col("train_start") + train).alias("test_start"), (F.col("train_start") + train + test).alias("test_end")
    )


def walk_forward(signals: DataFrame, spans: DataFrame, simulate: Callable[[DataFrame], DataFrame], periods: float = 525_600, risk_free: float = 0.0, threshold: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(window, split and Sharpe ratio of each combination, stability of each combination), in one job.

    signals (combo_id, ...) are cut by spans (of windows()); simulate() turns signals keyed by combo_id to equity.
    decay is how much of the training ratio the test loses. Stable: mean over deviation of test ratios at least
    threshold and the worst above 0.
    """
    both = spans.select("window", F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"{s}_start").alias("from"), F.col(f"{s}_end").alias("to")) for s in ("train", "test")])).alias("s"))
    both = both.select("window", "s.split", "s.from", "s.to")
    cut = signals.join(small(both), (F.col("bar_idx") >= F.col("from")) & (F.col("bar_idx") < F.col("to")))
    cut = cut.withColumn("bar_idx", F.col("bar_idx") - F.col("from")).withColumn("combo_id", F.struct("combo_id", "window", "split")).drop("window", "split", "from", "to")
    scored = metrics.performance(simulate(cut), ["combo_id"], periods, risk_free).select("combo_id.*", "sharpe", "total_return", "max_drawdown")
    wide = scored.groupBy("combo_id", "window").agg(*[F.max(F.when(F.col("split") == s, F.col("sharpe"))).alias(s) for s in ("train", "test")])
    wide = wide.withColumn("decay", F.when(F.abs("train") > 1e-12, (F.col("train") - F.col("test")) / F.abs(F.when(F.abs("train") > 1e-12, F.col("train")))).otherwise(0.0))
    summary = wide.groupBy("combo_id").agg(
        F.count("*").alias("windows"), F.avg("train").alias("train_mean"), F.avg("test").alias("test_mean"), F.coalesce(F.stddev_samp("test"), F.lit(0.0)).alias("test_std"), F.min("test").alias("worst"), F.avg("decay").alias("decay")
    )
    summary = summary.withColumn("ratio", F.col("test_mean") / (F.col("test_std") + 1e-12)).withColumn("stable", (F.col("ratio") >= threshold) & (F.col("worst") > 0))
    return wide, summary


def benjamini_hochberg(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """tests with adjusted (p * m / rank, least over larger ranks, at most 1) and rejected.

    p outside [0, 1] or empty raises. The ranks are of one table of tests, which has a row for each hypothesis; more
    than MOST_TESTS raise ValueError.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    if tests.limit(MOST_TESTS + 1).count() > MOST_TESTS:
        raise ValueError(f"more than {MOST_TESTS} tests")
    checked = F.when(F.col(p).isNull() | F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1), F.raise_error(F.lit("p-values must be in [0, 1]")).cast("double")).otherwise(F.col(p))
    by_p = Window.orderBy("_p")
    ranked = tests.withColumn("_p", checked).withColumn("_rank", F.row_number().over(by_p)).withColumn("_m", F.count("*").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    least = F.min(F.col("_p") * F.col("_m") / F.col("_rank")).over(Window.orderBy("_rank").rowsBetween(0, Window.unboundedFollowing))
    out = ranked.withColumn("adjusted", F.greatest(F.lit(0.0), F.least(F.lit(1.0), least)))
    return out.withColumn("rejected", F.col("adjusted") <= alpha).drop("_p", "_rank", "_m")


def perturbed(base: dict, share: float = 0.1) -> list[dict]:
    """base, then base with each of its numbers moved down and up by share (0: to -share and share)."""
    if share <= 0:
        raise ValueError("share must be positive")
    out = [dict(base)]
    for name, value in base.items():
        if isinstance(value, bool) or not isinstance(value, int | float):
            continue
        for factor in (-share, share):
            moved = value * (1 + factor) if value else factor
            out.append(base | {name: moved})
    return out


def sensitivity(spark: SparkSession, base: dict, score: Callable[[list[dict]], dict[int, float]], share: float = 0.1) -> DataFrame:
    """parameter, base_value, low, high (scores), change of each number of base; score() takes all sets at once."""
    sets = perturbed(base, share)
    found = score(sets)
    names = [n for n, v in base.items() if not isinstance(v, bool) and isinstance(v, int | float)]
    rows = [(n, float(base[n]), float(found[0]), float(found[1 + 2 * k]), float(found[2 + 2 * k])) for k, n in enumerate(names)]
    out = spark.createDataFrame(rows, "parameter string, base_value double, base_score double, low_score double, high_score double")
    return out.withColumn("largest_change", F.greatest(F.abs(F.col("low_score") - F.col("base_score")), F.abs(F.col("high_score") - F.col("base_score"))))


#: Rounds of the permutation; bars of a curve whose returns go to every task, at most (beyond it, rows are dealt); places that are summed up at once.
_ROUNDS, MOST_RETURNS, BLOCK = 6, 1 << 22, 1 << 16


def round_keys(seed: int, order: int) -> list[int]:
    """The keys of an order of returns: 28 bits each."""
    return [int(hashlib.md5(f"{seed}:{order}:{k}".encode()).hexdigest()[:7], 16) for k in range(_ROUNDS)]


def _half_bits(n: int) -> int:
    """Half the bits of the smallest even number of bits that tells n places apart."""
    return max(1, -(-(max(n, 2) - 1).bit_length() // 2))


def _crossed(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    return ((half * 40503 + key) * 33769 // 65536) % (1 << bits)


def places(at: np.ndarray, n: int, keys: list[int], back: bool = False) -> np.ndarray:
    """Where a keyed permutation of 0 to n - 1 puts `at`, or, back, what it puts there: a Feistel network over the smallest square of a power of two that
    holds n, walked on until it comes to a number below n."""
    bits = _half_bits(n)
    mask = (1 << bits) - 1

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for key in reversed(keys) if back else keys:
            if back:
                left, right = right ^ _crossed(left, key, bits), left
            else:
                left, right = right, left ^ _crossed(right, key, bits)
        return left << bits | right

    out = once(at.astype(np.int64))
    beyond = np.flatnonzero(out >= n)
    while len(beyond):
        out[beyond] = once(out[beyond])
        beyond = beyond[out[beyond] >= n]
    return out


_SUMMARY = "_block long, _total double, _top double, _low double, _fall double"


def _fallen(growth: np.ndarray) -> tuple[float, float, float, float]:
    """Of the logarithms of a stretch's growth: total, highest and lowest so far, deepest fall from a peak of its own."""
    path = np.cumsum(growth)
    return float(path[-1]), float(path.max()), float(path.min()), float(np.expm1((path - np.maximum.accumulate(path)).min()))


def _drawn_summaries(returns: DataFrame, keys: list[str], n: DataFrame, permutations: int, seed: int) -> DataFrame:
    """keys, _order and a summary of each stretch of BLOCK places of each reordering of returns (keys, bar_idx > 0, _growth)."""
    spark, kinds = returns.sparkSession, dict(returns.dtypes)
    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    if returns.limit(MOST_RETURNS + 1).count() <= MOST_RETURNS:
        rows = returns.select(*keys, "bar_idx", "_growth").toPandas()
        curves = {}
        for key, own in rows.groupby(keys, sort=False) if len(rows) else []:
            curves[key] = own.sort_values("bar_idx")["_growth"].to_numpy(np.float64)
        held = spark.sparkContext.broadcast(list(curves.items()))
        work = [(c, order, block) for c, (_, g) in enumerate(curves.items()) for order in range(1, permutations + 1) for block in range(-(-len(g) // BLOCK))]
        tasks = spark.createDataFrame(work, "curve int, _order int, block int").repartition(min(len(work), 4 * spark.sparkContext.defaultParallelism) or 1)

        def summed(batches):
            for frame in batches:
                out = []
                for c, order, block in frame.itertuples(index=False):
                    key, growth = held.value[c]
                    at = np.arange(block * BLOCK, min((block + 1) * BLOCK, len(growth)))
                    out.append((*key, order, block, *_fallen(growth[places(at, len(growth), round_keys(seed, order), back=True)])))
                yield pd.DataFrame(out, columns=[*keys, "_order", "_block", "_total", "_top", "_low", "_fall"])

        return tasks.mapInPandas(summed, f"{fields}, _order int, {_SUMMARY}")

    def put(batches):
        for frame in batches:
            made = []
            for order in range(1, permutations + 1):
                own, named = frame.assign(_order=order), round_keys(seed, order)
                for size, at in own.groupby("_n").groups.items():
                    own.loc[at, "_place"] = places(own.loc[at, "bar_idx"].to_numpy(np.int64) - 1, int(size), named)
                made.append(own)
            for own in made:
                own["_place"] = own["_place"].astype(np.int64)
                own["_block"] = own["_place"] // BLOCK
                yield own[[*keys, "_order", "_block", "_place", "_growth"]]

    dealt = returns.join(n, keys).select(*keys, "bar_idx", "_growth", "_n").mapInPandas(put, f"{fields}, _order int, _block long, _place long, _growth double")

    def of_block(frame: pd.DataFrame) -> pd.DataFrame:
        out = [(*[frame[k].iloc[0] for k in keys], frame["_order"].iloc[0], frame["_block"].iloc[0], *_fallen(frame.sort_values("_place")["_growth"].to_numpy()))]
        return pd.DataFrame(out, columns=[*keys, "_order", "_block", "_total", "_top", "_low", "_fall"])

    return dealt.groupBy(*keys, "_order", "_block").applyInPandas(of_block, f"{fields}, _order int, {_SUMMARY}")


def permutation_test(equity: DataFrame, keys: list[str], permutations: int = 1000, alpha: float = 0.05, periods: float = 525_600, risk_free: float = 0.0, statistic: str = "sharpe", seed: int = 42) -> DataFrame:
    """keys, the statistic (of metrics.PERFORMANCE), p_value, significant of a test by reordering returns: the share of
    orders, the actual one among them, in which the statistic is as large or larger.

    Measures of max_drawdown and calmar depend on the order. Each reordering is a keyed permutation (places()): which return stands where follows from
    arithmetic, so nothing is sorted; stretches of places are summed up in tasks, compounded from the first equity, and only their summaries are shuffled. Curves of up to
    MOST_RETURNS bars in all are sent to every task, of more their returns are dealt to the stretches. The other measures don't depend on order, so
    every reordering ties with the actual one and p is 1; that is stated rather than drawn from rounding noise.
    """
    actual = metrics.performance(equity, keys, periods, risk_free).select(*keys, statistic)
    if statistic not in ("max_drawdown", "calmar"):
        p = F.lit((permutations + 1.0) / (permutations + 1.0))
        return actual.withColumn("p_value", p).withColumn("significant", p < alpha)
    returns = equity.where("bar_idx > 0").select(*keys, F.col("bar_idx").cast("long").alias("bar_idx"), F.ln(F.greatest(1 + F.col("ret"), F.lit(1e-300))).alias("_growth"))
    n = equity.groupBy(*keys).agg((F.count("*") - 1).alias("_n"))
    parts = _drawn_summaries(returns, keys, n, permutations, seed)
    own = [*keys, "_order"]
    earlier = Window.partitionBy(*own).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)))
    peak = F.greatest(F.coalesce(F.max(F.col("_before") + F.col("_top")).over(earlier), F.lit(0.0)), F.lit(0.0))
    placed = placed.withColumn("_fall", F.least("_fall", F.exp(F.col("_before") + F.col("_low") - peak) - 1))
    drawn = placed.groupBy(*own).agg(F.least(F.min("_fall"), F.lit(0.0)).alias("_fall"), F.sum("_total").alias("_total")).join(n, keys)
    if statistic == "calmar":
        annual = F.exp(F.col("_total") / F.greatest(F.col("_n") / periods, F.lit(1e-9))) - 1
        value = F.when(F.col("_fall") < -1e-12, annual / F.abs(F.when(F.col("_fall") < -1e-12, F.col("_fall")))).otherwise(0.0)
    else:
        value = F.col("_fall")
    found = actual.join(drawn.withColumn("_drawn", value).select(*keys, "_drawn"), keys, "left").groupBy(*keys).agg(F.first(statistic).alias(statistic), F.count(F.when(F.col("_drawn") >= F.col(statistic), 1)).alias("_m"), F.count("_drawn").alias("_of"))
    p = F.when(F.col("_of") == 0, 1.0).otherwise((F.col("_m") + 1) / (permutations + 1))
    return found.select(*keys, statistic, p.alias("p_value"), (p < alpha).alias("significant"))


def regimes(rows: DataFrame, k: int = 3, keys: list[str] | None = None, periods: float = 525_600, risk_free: float = 0.0) -> DataFrame:
    """Measures of the bars of rows (keys, bar_idx, equity, ret, atr) by k quantile classes of atr.

    The lowest class has its upper bound; drawdowns are of each class's bars in a row. Combinations with under
    10 * k bars of known atr have none; classes with under 10 bars have zeros.
    """
    keys = keys or ["combo_id"]
    valid = rows.where("atr is not null and not isnan(atr)")
    enough = valid.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= 10 * k)
    cuts = metrics.percentiles(valid, keys, "atr", [j / k for j in range(1, k)]).withColumnRenamed("values", "_cuts").join(enough, keys)
    classed = valid.join(cuts, keys).withColumn("regime", F.size(F.filter("_cuts", lambda c: c < F.col("atr"))))
    own = [*keys, "regime"]
    placed = classed.withColumn("_dd", drawdown("equity", own)).withColumn("_nth", F.row_number().over(series(own)))
    rf, year = risk_free / periods, periods**0.5
    out = placed.groupBy(*own).agg(F.count("*").alias("bars"), F.avg(F.col("ret") - rf).alias("_mean"), F.stddev_samp("ret").alias("_std"), F.min("_dd").alias("_dd"), F.count(F.when((F.col("_nth") > 1) & (F.col("ret") > 0), 1)).alias("_wins"), F.count(F.when((F.col("_nth") > 1) & (F.col("ret") != 0), 1)).alias("_moves"))
    enough = F.col("bars") >= 10
    ratio = F.when(F.col("_std") > 1e-12, F.col("_mean") * year / F.when(F.col("_std") > 1e-12, F.col("_std"))).otherwise(0.0)
    name = F.element_at(F.array(F.lit("low_vol"), F.lit("mid_vol"), F.lit("high_vol")), F.col("regime") + 1) if k == 3 else F.concat(F.lit("regime_"), F.col("regime").cast("string"))
    return out.select(*keys, name.alias("regime"), "bars", *[F.when(enough, v).otherwise(0.0).alias(n) for n, v in (("sharpe", ratio), ("max_drawdown", F.col("_dd")), ("win_rate", F.coalesce(F.col("_wins") / F.when(F.col("_moves") > 0, F.col("_moves")), F.lit(0.0))))])


def default_simulation(slippage, commission):
    """simulate() for walk_forward(): the vector simulation."""
    return lambda signals: portfolio.vector(signals, slippage, commission)
