"""Walk-forward optimisation: choose parameters on one stretch, judge them on the next."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import small
from barloom.operators import metrics, portfolio, search
from barloom.operators.bars import part
from barloom.operators.indicators import simple_return
from barloom.operators.strategies import Axis, Strategy


@dataclass(frozen=True)
class Fold:
    fold: int
    is_start: int
    is_end: int
    oos_start: int
    oos_end: int


def folds(n_bars: int, splits: int = 5, share: float = 0.7, expanding: bool = False) -> list[Fold]:
    """Stretches to optimise on and to judge on, block by block; none if there are too few bars."""
    block = max(3, n_bars // max(1, splits))
    inside = max(2, int(block * share))
    outside = max(1, block - inside)
    if n_bars < 4 or inside + outside >= n_bars:
        return []
    out: list[Fold] = []
    for k in range(splits):
        start = 0 if expanding else k * (inside + outside)
        end = inside + k * outside if expanding else start + inside
        if end + outside > n_bars:
            break
        out.append(Fold(k + 1, start, end, end, end + outside))
    return out


def grid_by_fold(bars: DataFrame, cut: list[Fold], strategy: Strategy, sets: list[dict], metric: str, terms: search.Terms, maximize: bool = True) -> DataFrame:
    """fold, combo_id, score and out-of-sample score of the best set of each fold; all folds and sets in one job.

    Indicators begin anew in every stretch, as bars are counted from its start. Every stretch of a symbol is a series of its
    own: its name is the stretch's number before the symbol.
    """
    spark = bars.sparkSession
    spans = spark.createDataFrame([(f.fold, s, a, b) for f in cut for s, a, b in (("is", f.is_start, f.is_end), ("oos", f.oos_start, f.oos_end))], "fold int, split string, from int, to int")
    pieces = bars.join(small(spans), (F.col("bar_idx") >= F.col("from")) & (F.col("bar_idx") < F.col("to"))).withColumn("bar_idx", F.col("bar_idx") - F.col("from"))
    stretch = F.concat_ws("|", F.col("fold").cast("string"), "split", "symbol")
    signals = strategy.signals(pieces.withColumn("symbol", stretch).drop("fold", "split", "from", "to"), sets)
    parts = F.split("symbol", r"\|", 3)
    series = F.struct("combo_id", parts[0].cast("int").alias("fold"), parts[1].alias("split"))
    named = signals.withColumn("combo_id", series).withColumn("symbol", parts[2])
    own = ["combo_id", "fold", "split"]
    curves = terms.equity(named).select("combo_id.*", *[c for c in ("ts", "bar_idx", "equity", "ret", "turnover")])
    market = None
    if metric == "beta":  # returns begin anew in every stretch, too
        each = pieces.withColumn("_r", simple_return(keys=["fold", "split", "symbol"]))
        market = each.groupBy("fold", "split", "bar_idx").agg(F.avg("_r").alias("market"))
    scored = metrics.batch_score(curves, metric, terms.periods, terms.risk_free, market, own)
    wide = scored.groupBy("fold", "combo_id").agg(*[F.max(F.when(F.col("split") == s, F.col("score"))).alias(f"{s}_score") for s in ("is", "oos")])
    order = F.struct(F.col("is_score") if maximize else -F.col("is_score"), -F.col("combo_id"))
    return wide.groupBy("fold").agg(F.max_by(F.struct("combo_id", "is_score", "oos_score"), order).alias("b")).select("fold", "b.*")


@dataclass
class Outcome:
    folds: list[tuple[Fold, dict, dict, dict]]  # the fold, its best set, measures (of performance, risk and trades) inside and outside
    settings: dict = field(default_factory=dict)

    def means(self, outside: bool = True) -> dict[str, float]:
        """Of each measure of performance and risk."""
        rows = [f[3 if outside else 2] for f in self.folds]
        return {k: sum(r[k] for r in rows) / len(rows) for k in (*metrics.PERFORMANCE, *metrics.RISK) if k in rows[0]} if rows else {}

    def overfitting(self) -> dict[str, float]:
        """The mean ratio of each measure outside to inside, where the latter isn't 0."""
        out = {}
        for k in metrics.PERFORMANCE:
            ratios = [o[k] / i[k] for _, _, i, o in self.folds if abs(i[k]) >= 1e-12]
            if ratios:
                out[k] = sum(ratios) / len(ratios)
        return out


    def as_dict(self) -> dict:
        """For JSON: the settings, means outside, ratios to inside, and each fold."""
        folds = [{**asdict(f), "params": p, "inside": i, "outside": o} for f, p, i, o in self.folds]
        return {"type": "walk_forward", "settings": self.settings, "means": self.means(), "overfitting": self.overfitting(), "folds": folds}


def run(bars: DataFrame, n_bars: int, strategy: Strategy, terms: search.Terms, metric: str = "sharpe", method: str = "bayesian", trials: int = 100, splits: int = 5, share: float = 0.7, expanding: bool = False, maximize: bool = True, seed: int = 42, axes: dict[str, Axis] | None = None) -> Outcome:
    """Optimises inside each fold by any method and reports the best set inside and outside, under the same terms.

    ValueError if splits isn't positive, share isn't between 0 and 1, the method is unknown, or there are too few bars for a fold.
    """
    if splits < 1 or not 0 < share < 1:
        raise ValueError("splits must be positive and share between 0 and 1")
    if method not in ("grid", "random", "genetic", "bayesian"):
        raise ValueError(f"unknown method: {method}")
    cut = folds(n_bars, splits, share, expanding)
    if not cut:
        raise ValueError(f"{n_bars} bars are too few for {splits} folds")
    out = []
    for fold in cut:
        inside, outside = part(bars, fold.is_start, fold.is_end), part(bars, fold.oos_start, fold.oos_end)
        with search.kept(inside) as held:
            score = search.scorer(held, strategy, metric, terms)
            if method == "grid":
                found = search.grid(strategy, score, metric, axes, maximize)
            elif method == "random":
                found = search.randomly(strategy, score, metric, trials, seed, axes, maximize)
            elif method == "genetic":
                found = search.genetic(strategy, score, metric, max(1, trials // 10), 10, seed, axes, maximize)
            else:
                found = search.bayesian(strategy, score, metric, trials, seed, axes, maximize)
            best = found.best[0]
            own = [judged(stretch, strategy, best, terms) for stretch in (held, outside)]
        out.append((fold, best, *own))
    settings = {"strategy": strategy.name, "metric": metric, "method": method, "trials": trials, "splits": splits, "share": share, "expanding": expanding, "maximize": maximize, "seed": seed}
    return Outcome(out, settings)


def judged(bars: DataFrame, strategy: Strategy, params: dict, terms: search.Terms) -> dict:
    """Measures of one set: performance, risk and, where it trades, trades (with the prefix trade_ where performance has the name)."""
    of = lambda df: {k: v for k, v in row.asDict().items() if k != "combo_id"} if (row := df.first()) is not None else {}
    with search.kept(terms.simulated(strategy.signals(bars, [params]))) as curve:
        equity = curve.select("combo_id", "ts", "bar_idx", "equity", "ret", "turnover")
        found = of(metrics.performance(equity, ["combo_id"], terms.periods, terms.risk_free, metrics.market_returns(bars))) | of(metrics.risk(equity, ["combo_id"]))
        trades = of(metrics.trade_metrics(portfolio.trade_log(curve), ["combo_id"], ["bar_idx"]))
    return found | {f"trade_{k}" if k in found else k: v for k, v in trades.items()}
