"""Settings of an engine, from defaults, a mapping or a YAML file."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from barloom.functions.columns import truth  # noqa: F401  flags of configurations
from barloom.functions.costs import Commission, Rules, Slippage, commission_of, slippage_of
from barloom.operators.metrics import PRESETS


@dataclass(frozen=True)
class Config:
    initial_cash: float = 1_000_000.0
    contract_multiplier: float = 1.0
    risk_free_rate: float = 0.02
    periods_per_year: float = 358_800.0
    period_preset: str | None = None
    slippage_model: str = "percent"
    slippage_value: float = 0.0001
    slippage_impact: float = 1.0
    commission_model: str = "percent"
    commission_value: float = 0.0002
    commission_tiers: list = field(default_factory=list)
    metric: str = "sharpe"
    maximize: bool = True
    trials: int = 200
    seed: int = 42
    batch_size: int = 128
    rules: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.initial_cash <= 0 or self.contract_multiplier <= 0 or self.trials <= 0 or self.batch_size <= 0 or self.slippage_value < 0 or self.commission_value < 0:
            raise ValueError("cash, multiplier, trials and batch size must be positive, costs not negative")
        if self.period_preset:
            if self.period_preset not in PRESETS:
                raise ValueError(f"unknown preset: {self.period_preset}")
            object.__setattr__(self, "periods_per_year", float(PRESETS[self.period_preset]))

    @property
    def slippage(self) -> Slippage:
        return slippage_of(self.slippage_model, self.slippage_value, self.slippage_impact)

    @property
    def commission(self) -> Commission:
        return commission_of(self.commission_model, self.commission_value, self.commission_tiers)

    @property
    def trading_rules(self) -> Rules:
        return Rules(**self.rules)


def config_of(given: dict | str | None = None) -> Config:
    """A Config from a mapping (unknown keys are passed over) or the path of a YAML file."""
    if isinstance(given, str):
        import yaml

        with open(given, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
    names = {f.name for f in fields(Config)}
    return Config(**{k: v for k, v in (given or {}).items() if k in names})
