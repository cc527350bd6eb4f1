"""What a user calls: backtests, cost comparisons, searches and walk-forward runs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import Config
from barloom.functions.costs import Commission, Slippage
from barloom.operators import assist_v4, metrics, portfolio, search, walkforward  # noqa: F401  assist_v4 registers itself
from barloom.operators.strategies import Axis, Strategy, combined, strategy
from barloom.plans import describe


@dataclass
class Report:
    """Equity, trades and measures of one run; frames are evaluated when used."""

    strategy: str
    params: dict
    simulated: DataFrame
    bars: DataFrame
    config: Config
    signals: DataFrame | None = None

    @property
    def equity(self) -> DataFrame:
        return self.simulated.select("combo_id", "ts", "bar_idx", "equity", "ret", "turnover")

    @property
    def trades(self) -> DataFrame:
        return portfolio.trade_log(self.simulated)

    @property
    def risk_events(self) -> DataFrame:
        return portfolio.events_of(self.simulated)

    def measures(self) -> dict[str, dict]:
        """performance, risk and trade measures; one row each comes to the driver."""
        c, keys = self.config, ["combo_id"]
        market = metrics.market_returns(self.bars)
        found = {
            "performance": metrics.performance(self.equity, keys, c.periods_per_year, c.risk_free_rate, market),
            "risk": metrics.risk(self.equity, keys),
            "trade": metrics.trade_metrics(self.trades, keys, ["bar_idx"]),
        }
        return {name: {k: v for k, v in row.asDict().items() if k != "combo_id"} if (row := df.first()) else {} for name, df in found.items()}

    def objective(self, metric: str) -> float:
        """A measure by name: of performance, then risk, then trades."""
        for group in self.measures().values():
            if metric in group:
                if isinstance(group[metric], str):
                    raise TypeError(f"{metric} is not a number")
                return float(group[metric])
        raise KeyError(metric)


def _begun(name: str, config: Config) -> Strategy:
    chosen = strategy(name)
    chosen.begin(config)
    return chosen


def backtest(bars: DataFrame, name: str, params: dict | None = None, config: Config | None = None) -> Report:
    """One strategy with one set of parameters, under all rules."""
    config = config or Config()
    chosen = _begun(name, config)
    full = chosen.defaults | (params or {})
    signals = _whole(bars, chosen, chosen.signals(bars, [full]))
    return Report(name, full, _simulated(signals, config), bars, config, signals)


def backtest_many(bars: DataFrame, parts: list[tuple[str, dict, float]], config: Config | None = None) -> Report:
    """The weighted mean of several strategies' signals."""
    config = config or Config()
    begun = [(_begun(n, config), p, w) for n, p, w in parts]
    signals = combined([(_whole(bars, s, s.signals(bars, [s.defaults | p])), w) for s, p, w in begun])
    return Report("+".join(n for n, _, _ in parts), {n: p for n, p, _ in parts}, _simulated(signals, config), bars, config, signals)


def _whole(bars: DataFrame, chosen: Strategy, signals: DataFrame) -> DataFrame:
    """signals; of a strategy that isn't the library's, a job looks for bars without one first, which would shift positions: ValueError."""
    return signals if type(chosen).__module__.startswith("barloom.") else describe.checked_signals(bars, signals)


def _simulated(signals: DataFrame, c: Config) -> DataFrame:
    return portfolio.sequential(signals, c.slippage, c.commission, c.trading_rules, c.initial_cash, c.contract_multiplier)


def compare_costs(bars: DataFrame, name: str, params: dict, scenarios: dict[str, tuple[Slippage, Commission]], config: Config | None = None) -> DataFrame:
    """Measures of one run under each named pair of costs and all rules, in one job."""
    config = config or Config()
    signals = strategy(name).signals(bars, [strategy(name).defaults | params])
    rules = config.trading_rules
    if rules.by_equity:
        runs = [portfolio.equity_under(signals, *costs, rules, config.initial_cash, config.contract_multiplier).withColumn("scenario", F.lit(name)) for name, costs in scenarios.items()]
        equity = reduce(DataFrame.unionByName, runs)
    else:
        equity = portfolio.cost_scenarios(signals, scenarios, rules, config.initial_cash, config.contract_multiplier)
    return metrics.performance(equity, ["scenario"], config.periods_per_year, config.risk_free_rate)


def terms_of(c: Config) -> search.Terms:
    return search.Terms(c.slippage, c.commission, c.trading_rules, c.initial_cash, c.contract_multiplier, c.periods_per_year, c.risk_free_rate)


def optimise(bars: DataFrame, name: str, method: str = "grid", axes: dict[str, Axis] | None = None, config: Config | None = None) -> search.Found:
    """Searches a strategy's parameters by grid, random, bayesian or genetic; every set is simulated as backtest() does."""
    c = config or Config()
    chosen = _begun(name, c)
    with search.kept(bars) as held:
        score = search.scorer(held, chosen, c.metric, terms_of(c))
        if method == "grid":
            return search.grid(chosen, score, c.metric, axes, c.maximize, c.batch_size)
        if method == "random":
            return search.randomly(chosen, score, c.metric, c.trials, c.seed, axes, c.maximize, c.batch_size)
        if method == "bayesian":
            return search.bayesian(chosen, score, c.metric, c.trials, c.seed, axes, c.maximize, c.batch_size)
        if method == "genetic":
            people = max(4, min(c.batch_size, c.trials))
            return search.genetic(chosen, score, c.metric, max(1, c.trials // max(2, people)), people, c.seed, axes, c.maximize)
    raise ValueError(f"unknown method: {method}")


def walk_forward(bars: DataFrame, n_bars: int, name: str, method: str = "bayesian", splits: int = 5, share: float = 0.7, expanding: bool = False, axes: dict[str, Axis] | None = None, config: Config | None = None) -> walkforward.Outcome:
    c = config or Config()
    chosen = _begun(name, c)
    return walkforward.run(bars, n_bars, chosen, terms_of(c), c.metric, method, c.trials, splits, share, expanding, c.maximize, c.seed, axes)
