"""Slippage, commission, price limits and orders, as column expressions."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _side(side: Column) -> Column:
    return F.when(side >= 0, 1.0).otherwise(-1.0)


class Slippage(ABC):
    @abstractmethod
    def price(self, price: Column, side: Column, quantity: Column, volume: Column) -> Column:
        """The price at which quantity trades; side >= 0 buys."""


@dataclass(frozen=True)
class FixedSlippage(Slippage):
    points: float

    def price(self, price, side, quantity, volume):
        return price + _side(side) * self.points


@dataclass(frozen=True)
class PercentSlippage(Slippage):
    rate: float

    def price(self, price, side, quantity, volume):
        return price * (1 + _side(side) * self.rate)


@dataclass(frozen=True)
class VolumeSlippage(Slippage):
    impact: float = 1.0
    most: float = 0.05

    def price(self, price, side, quantity, volume):
        share = F.least(quantity / F.greatest(volume, F.lit(1.0)), F.lit(float(self.most)))
        return price * (1 + _side(side) * share * self.impact)


def slippage_of(model: str, value: float, impact: float = 1.0) -> Slippage:
    """By name: fixed, percent, or volume (value: the largest share)."""
    if model == "volume":
        return VolumeSlippage(impact, value)
    return {"fixed": FixedSlippage, "percent": PercentSlippage}[model](value)


class Commission(ABC):
    @abstractmethod
    def cash(self, notional: Column, quantity: Column) -> Column:
        """The fee for a trade."""


@dataclass(frozen=True)
class FixedCommission(Commission):
    value: float

    def cash(self, notional, quantity):
        return F.greatest(quantity, F.lit(0.0)) * self.value


@dataclass(frozen=True)
class PercentCommission(Commission):
    rate: float

    def cash(self, notional, quantity):
        return F.greatest(notional, F.lit(0.0)) * self.rate


@dataclass(frozen=True)
class TieredCommission(Commission):
    """The rate of the first tier (upper bound, rate) that holds the notional, for all of it; above all, the last."""

    tiers: tuple[tuple[float, float], ...] = ()
    fallback: float = 0.0

    def cash(self, notional, quantity):
        rate = F.lit(float(self.fallback))
        if self.tiers:
            tiers = sorted(self.tiers)
            rate = F.lit(float(tiers[-1][1]))
            for bound, r in reversed(tiers):
                rate = F.when(notional <= bound, F.lit(float(r))).otherwise(rate)
        return F.greatest(notional, F.lit(0.0)) * rate


def commission_of(model: str, value: float, tiers: list[tuple[float, float]] | None = None) -> Commission:
    """By name: fixed, percent, tiered."""
    if model == "tiered":
        return TieredCommission(tuple(map(tuple, tiers or ())))
    return {"fixed": FixedCommission, "percent": PercentCommission}[model](value)


@dataclass(frozen=True)
class Rules:
    """Limits of a simulation; 0 or None means no limit."""

    margin_ratio: float = 0.1
    limit_up: float | None = None
    limit_down: float | None = None
    max_position: float = 0.0
    max_addons: int = 0
    max_risk_per_trade: float = 0.0
    max_daily_loss: float = 0.0
    max_weekly_loss: float = 0.0
    max_drawdown: float = 0.0
    drawdown_action: str = "stop"  # stop, reduce or alert

    @property
    def by_equity(self) -> bool:
        """Whether a rule is set that depends on equity or on positions held."""
        return any(x > 0 for x in (self.margin_ratio, self.max_position, self.max_addons, self.max_risk_per_trade, self.max_daily_loss, self.max_weekly_loss, self.max_drawdown))

    def limited(self, price: Column, close_before: Column) -> Column:
        """price within the limits around the close before."""
        if self.limit_up is not None:
            price = F.least(price, close_before * (1 + self.limit_up))
        if self.limit_down is not None:
            price = F.greatest(price, close_before * (1 - self.limit_down))
        return price

    def margin(self, notional: Column) -> Column:
        return F.greatest(notional, F.lit(0.0)) * self.margin_ratio


def fill_orders(orders: DataFrame, slippage: Slippage, rules: Rules | None = None) -> DataFrame:
    """orders (side BUY or SELL, kind market or limit, quantity, limit_price, and of the next bar open, high, low,
    volume, and close_before) with filled, fill_price and reason.

    A market order trades at the next open; a limit order at its limit, if the next bar's low (buying) or
    high (selling) reaches it. Slippage and price limits apply to both. A limit order without a price raises.
    """
    side = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    is_limit = F.col("kind") == "limit"
    touched = F.when(F.col("side") == "BUY", F.col("low") <= F.col("limit_price")).otherwise(F.col("high") >= F.col("limit_price"))
    limit = F.when(is_limit & F.col("limit_price").isNull(), F.raise_error(F.lit("a limit order needs a limit price")).cast("double")).otherwise(F.col("limit_price"))
    base = F.when(is_limit, limit).otherwise(F.col("open"))
    price = slippage.price(base, side, F.col("quantity"), F.col("volume"))
    price = rules.limited(price, F.col("close_before")) if rules else price
    filled = ~is_limit | touched
    return orders.withColumn("filled", filled).withColumn("fill_price", F.when(filled, price)).withColumn("reason", F.when(filled, F.lit("")).otherwise("limit not reached"))


@dataclass(frozen=True)
class ContractSpec:
    """What a symbol's contract is; sessions are pairs of times HH:MM."""

    symbol: str
    multiplier: float = 1.0
    min_tick: float = 0.0001
    sessions: tuple[tuple[str, str], ...] = field(default=(("00:00", "23:59"),))

    def __post_init__(self) -> None:
        if not self.symbol or self.multiplier <= 0 or self.min_tick <= 0 or not self.sessions:
            raise ValueError(f"bad contract: {self}")
        for time in (t for s in self.sessions for t in s):
            if not re.fullmatch(r"([01]\d|2[0-3]):[0-5]\d", time):
                raise ValueError(f"bad session time: {time}")


#: Contracts known by default (fixed values).
CONTRACTS = {"XAUUSD": ContractSpec("XAUUSD", 100.0, 0.01)}


def contract_of(symbol: str, overrides: dict[str, dict] | None = None) -> ContractSpec:
    """The override of a symbol, else its default, else the general one; any case."""
    name = symbol.strip().upper()
    own = {k.strip().upper(): v for k, v in (overrides or {}).items()}.get(name)
    base = CONTRACTS.get(name, ContractSpec(name))
    if own is None:
        return base
    sessions = tuple(tuple(s) for s in own["sessions"]) if "sessions" in own else base.sessions
    return ContractSpec(name, float(own.get("multiplier", base.multiplier)), float(own.get("min_tick", base.min_tick)), sessions)


def with_contracts(bars: DataFrame, overrides: DataFrame) -> DataFrame:
    """bars with multiplier and min_tick of overrides (symbol, multiplier, min_tick), else of the defaults. Of several
    overrides of a symbol that with the largest values counts."""
    own = overrides.groupBy(F.upper(F.trim("symbol")).alias("_name")).agg(F.max(F.struct("multiplier", "min_tick")).alias("_o")).select("_name", F.col("_o.multiplier").alias("_m"), F.col("_o.min_tick").alias("_t"))
    name, general = F.upper(F.trim("symbol")), ContractSpec("*")
    multiplier, tick = F.lit(general.multiplier), F.lit(general.min_tick)
    for spec in CONTRACTS.values():
        multiplier = F.when(name == spec.symbol, spec.multiplier).otherwise(multiplier)
        tick = F.when(name == spec.symbol, spec.min_tick).otherwise(tick)
    joined = bars.join(own, name == F.col("_name"), "left")
    return joined.withColumns({"multiplier": F.coalesce("_m", multiplier), "min_tick": F.coalesce("_t", tick)}).drop("_name", "_m", "_t")
