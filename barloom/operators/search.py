"""Parameter search: every set of a batch is a combination of one Spark job."""

from __future__ import annotations

import contextlib
import itertools
import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.costs import Commission, Rules, Slippage
from barloom.operators import metrics, portfolio
from barloom.operators.strategies import Axis, Strategy

BATCH = 128
Score = Callable[[list[dict]], list[float]]


@dataclass
class Found:
    method: str
    metric: str
    maximize: bool
    trials: list[tuple[dict, float]] = field(default_factory=list)

    @property
    def best(self) -> tuple[dict, float]:
        """The first of the best trials; scores that aren't numbers are the worst."""
        sign = 1.0 if self.maximize else -1.0
        return max(self.trials, key=lambda t: sign * t[1] if t[1] == t[1] else float("-inf"))

    def top(self, n: int = 20) -> list[tuple[dict, float]]:
        sign = -1.0 if self.maximize else 1.0
        return sorted(self.trials, key=lambda t: (t[1] != t[1], sign * t[1]))[:n]


    def as_dict(self) -> dict:
        """For JSON: the method, the best set and all trials."""
        params, score = self.best
        return {"type": "optimization", "method": self.method, "metric": self.metric, "maximize": self.maximize, "best": {"params": params, "score": score}, "trials": [{**p, "score": s} for p, s in self.trials]}


def product(axes: dict[str, Axis]) -> list[dict]:
    """All sets of values, the last axis fastest."""
    return [dict(zip(axes, values, strict=True)) for values in itertools.product(*[a.values() for a in axes.values()])]


def product_table(spark: SparkSession, axes: dict[str, Axis]) -> DataFrame:
    """combo_id and a column for each axis, made on the executors; numbered as product()."""
    sizes = [len(a.values()) for a in axes.values()]
    total = 1
    for n in sizes:
        total *= n
    rows, left = spark.range(total).withColumnRenamed("id", "combo_id"), total
    for (name, axis), n in zip(axes.items(), sizes, strict=True):
        left //= n
        rows = rows.withColumn(name, F.get(F.array(*map(F.lit, axis.values())), F.floor(F.col("combo_id") / left) % n))
    return rows


def draws(axes: dict[str, Axis], n: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    return [{name: axis.draw(rng) for name, axis in axes.items()} for _ in range(n)]


@dataclass(frozen=True)
class Terms:
    """What every set of a search is simulated and measured under, as a single run is."""

    slippage: Slippage
    commission: Commission
    rules: Rules | None = None
    cash: float = portfolio.CASH
    multiplier: float = 1.0
    periods: float = metrics.PERIODS
    risk_free: float = metrics.RISK_FREE

    def equity(self, signals: DataFrame) -> DataFrame:
        return portfolio.equity_under(signals, self.slippage, self.commission, self.rules, self.cash, self.multiplier)

    def simulated(self, signals: DataFrame) -> DataFrame:
        return portfolio.sequential(signals, self.slippage, self.commission, self.rules, self.cash, self.multiplier)

    def trades(self, signals: DataFrame) -> DataFrame:
        return portfolio.trade_log(self.simulated(signals))


def scores(bars: DataFrame, strategy: Strategy, sets: list[dict], metric: str, terms: Terms) -> DataFrame:
    """combo_id, score of each set: signals, simulation under all rules, and measure of all of them in one plan.

    metric: a measure of performance, else of risk, else of trades; of trades, sets that never trade have none. KeyError for any other.
    """
    signals = strategy.signals(bars, sets)
    if metric in metrics.TRADES:
        return metrics.trade_metrics(terms.trades(signals), ["combo_id"], ["bar_idx"]).select("combo_id", F.col(metric).cast("double").alias("score"))
    market = metrics.market_returns(bars) if metric == "beta" else None
    return metrics.batch_score(terms.equity(signals), metric, terms.periods, terms.risk_free, market)


def scorer(bars: DataFrame, strategy: Strategy, metric: str, terms: Terms) -> Score:
    """A function that scores a batch of sets. The driver gets one number for each set."""

    def score(sets: list[dict]) -> list[float]:
        found = dict(scores(bars, strategy, sets, metric, terms).collect())
        return [found.get(k, float("nan")) for k in range(len(sets))]

    return score


@contextlib.contextmanager
def kept(bars: DataFrame) -> Iterator[DataFrame]:
    """bars, cached while a search uses them over and over; bars that are cached already are left as they are."""
    if bars.is_cached:
        yield bars
        return
    held = bars.cache()
    try:
        yield held
    finally:
        held.unpersist()


def _in_batches(score: Score, sets: list[dict], batch: int) -> list[tuple[dict, float]]:
    parts = [sets[first : first + batch] for first in range(0, len(sets), batch)]
    return [pair for part in parts for pair in zip(part, score(part), strict=True)]


def grid(strategy: Strategy, score: Score, metric: str, axes: dict[str, Axis] | None = None, maximize: bool = True, batch: int = BATCH) -> Found:
    """All sets of the axes that the strategy accepts."""
    return Found("grid", metric, maximize, _in_batches(score, strategy.usable(product(axes or strategy.axes)), batch))


def randomly(strategy: Strategy, score: Score, metric: str, trials: int = 200, seed: int = 42, axes: dict[str, Axis] | None = None, maximize: bool = True, batch: int = BATCH, method: str = "random") -> Found:
    """Sets drawn from the axes, in order of the seed; unusable ones are left out."""
    return Found(method, metric, maximize, _in_batches(score, strategy.usable(draws(axes or strategy.axes, trials, seed)), batch))


#: Trials drawn at random before densities are estimated; the share of trials that count as good; candidates for each pick.
FIRST, GOOD, CANDIDATES = 20, 0.15, 24


def bayesian(strategy: Strategy, score: Score, metric: str, trials: int = 200, seed: int = 42, axes: dict[str, Axis] | None = None, maximize: bool = True, batch: int = BATCH) -> Found:
    """Search by tree-structured Parzen estimates.

    The first FIRST trials are random. Then the best GOOD share of the trials and the others give each axis two densities; of CANDIDATES sets drawn from
    the good one, that with the largest ratio of good to bad, over all axes, is tried. A tenth as many sets as there are trials so far is scored in one job.
    """
    axes, rng, sign = axes or strategy.axes, random.Random(seed), 1.0 if maximize else -1.0
    found = Found("bayesian", metric, maximize)
    while len(found.trials) < trials:
        left = trials - len(found.trials)
        if len(found.trials) < min(FIRST, trials):
            sets = strategy.usable(draws(axes, 4 * min(FIRST, left), rng.randrange(1 << 30)))[: min(FIRST, left, batch)]
        else:
            ranked = sorted(found.trials, key=lambda t: -sign * t[1] if t[1] == t[1] else float("inf"))
            cut = max(2, math.ceil(GOOD * len(ranked)))
            good, bad = ({name: Density(axis, [t[0][name] for t in part]) for name, axis in axes.items()} for part in (ranked[:cut], ranked[cut:]))
            sets = []
            for _ in range(max(1, min(batch, left, len(ranked) // 10))):
                drawn = strategy.usable([{name: d.draw(rng) for name, d in good.items()} for _ in range(CANDIDATES)]) or strategy.usable(draws(axes, CANDIDATES, rng.randrange(1 << 30)))
                if drawn:
                    sets.append(max(drawn, key=lambda s: sum(good[n].log(s[n]) - bad[n].log(s[n]) for n in axes)))
        if not sets:
            break
        found.trials += _in_batches(score, sets, batch)
    return found


class Density:
    """The density of some values of an axis: for numbers, a normal curve around each, as wide as its neighbours are away, and a flat share worth one
    value; for choices, counts and one for each choice."""

    def __init__(self, axis: Axis, values: list):
        self.axis, self.values = axis, sorted(values) if axis.kind != "choice" else values
        self.span = max(axis.high - axis.low, 1e-12)
        edges = [axis.low, *self.values, axis.high]
        least = self.span / min(100, len(values) + 1)
        self.widths = [min(self.span, max(least, edges[k + 1] - edges[k], edges[k + 2] - edges[k + 1])) for k in range(len(values))] if axis.kind != "choice" else []

    def draw(self, rng: random.Random):
        k = rng.randrange(len(self.values) + 1)
        if k == len(self.values):
            return self.axis.draw(rng)
        if self.axis.kind == "choice":
            return self.values[k]
        moved = min(self.axis.high, max(self.axis.low, rng.gauss(self.values[k], self.widths[k])))
        if self.axis.kind == "int":
            return int(self.axis.low + min(round((moved - self.axis.low) / self.axis.step), int((self.axis.high - self.axis.low) / self.axis.step)) * self.axis.step)
        return moved

    def log(self, value) -> float:
        if self.axis.kind == "choice":
            return math.log((self.values.count(value) + 1) / (len(self.values) + len(self.axis.choices)))
        flat = 1 / self.span
        return math.log((flat + sum(math.exp(-0.5 * ((value - v) / w) ** 2) / (w * 2.5066282746310002) for v, w in zip(self.values, self.widths, strict=True))) / (len(self.values) + 1))


def genetic(strategy: Strategy, score: Score, metric: str, generations: int = 20, population: int = 50, seed: int = 42, axes: dict[str, Axis] | None = None, maximize: bool = True) -> Found:
    """Evolves a population, one Spark job a generation: tournaments of three, crossing at two points in seven of
    ten pairs, and each value drawn anew once in five."""
    axes, rng, sign = axes or strategy.axes, random.Random(seed), 1.0 if maximize else -1.0
    names, found = list(axes), Found("genetic", metric, maximize)
    people = strategy.usable([{n: a.draw(rng) for n, a in axes.items()} for _ in range(4 * population)])[:population]
    for _ in range(generations):
        if not people:
            break
        judged = list(zip(people, score(people), strict=True))
        found.trials += judged
        fit = lambda t: sign * t[1] if t[1] == t[1] else float("-inf")
        children: list[dict] = []
        for _ in range(4 * population):
            a, b = (dict(max(rng.sample(judged, min(3, len(judged))), key=fit)[0]) for _ in range(2))
            if rng.random() < 0.7 and len(names) > 1:
                low, high = sorted(rng.sample(range(len(names) + 1), 2))
                for n in names[low:high]:
                    a[n], b[n] = b[n], a[n]
            children += strategy.usable([{n: axes[n].draw(rng) if rng.random() < 0.2 else v for n, v in a.items() if n in axes}])
            if len(children) >= population:
                break
        people = children[:population]
    return found
