"""Strategy parameters, each with the interval it may lie in."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


def bounded(default, interval: str):
    """A field whose value must lie in an interval written like ``[1, inf)``."""
    return field(default=default, metadata={"interval": interval})


def lies_in(value: float, interval: str) -> bool:
    low, high = (float(end) for end in interval[1:-1].split(","))
    return (low <= value if interval[0] == "[" else low < value) and (value <= high if interval[-1] == "]" else value < high)


class Checked:
    """Raises once for all fields outside their intervals and for all relations between fields that do not hold."""

    def relations(self) -> dict[str, bool]:
        return {}

    def __post_init__(self) -> None:
        wrong = [f"{f.name} is {getattr(self, f.name)}, allowed: {f.metadata['interval']}"
                 for f in fields(self) if "interval" in f.metadata and not lies_in(getattr(self, f.name), f.metadata["interval"])]
        wrong += [f"required: {relation}" for relation, holds in self.relations().items() if not holds]
        if wrong:
            raise ValueError(f"{type(self).__name__}: {'; '.join(wrong)}")


@dataclass(frozen=True)
class UniverseRules(Checked):
    lookback_days: int = bounded(240, "[1, inf)")
    market_cap_keep_ratio: float = bounded(0.8, "(0, 1]")
    amount_keep_ratio: float = bounded(0.8, "(0, 1]")
    dividend_years: int = bounded(3, "[2, inf)")
    payout_exclude_ratio: float = bounded(0.05, "[0, 1)")


@dataclass(frozen=True)
class SelectionRules(Checked):
    """Original annual selection; ``transaction_cost_rate`` is used by monthly portfolios."""

    dividend_yield_lookback_days: int = bounded(720, "[1, inf)")
    dividend_top_n: int = bounded(75, "[1, inf)")
    final_n: int = bounded(50, "[1, inf)")
    volatility_lookback_days: int = bounded(240, "[1, inf)")
    transaction_cost_rate: float = bounded(0.0, "[0, 1)")
    universe: UniverseRules = field(default_factory=UniverseRules)

    def relations(self) -> dict[str, bool]:
        return {"final_n <= dividend_top_n": self.final_n <= self.dividend_top_n}


@dataclass(frozen=True)
class IntradaySelectionRules(Checked):
    dividend_yield_lookback_days: int = bounded(720, "[1, inf)")
    dividend_top_n: int = bounded(150, "[1, inf)")
    final_n: int = bounded(50, "[1, inf)")
    lookback_trading_days: int = bounded(20, "[1, inf)")
    min_valid_days: int = bounded(20, "[1, inf)")
    transaction_cost_rate: float = bounded(0.0, "[0, 1)")
    universe: UniverseRules = field(default_factory=UniverseRules)
    #: Without it, infinite and NaN volatilities stay, and the factors they make NaN are ranked last.
    finite_only: bool = True

    def relations(self) -> dict[str, bool]:
        return {"final_n <= dividend_top_n": self.final_n <= self.dividend_top_n,
                "min_valid_days <= lookback_trading_days": self.min_valid_days <= self.lookback_trading_days}


@dataclass(frozen=True)
class TimingRules(Checked):
    index_code: str = "H30269"
    pb_factor: str = "pb_ratio_lf"
    trim_ratio: float = bounded(0.1, "[0, 0.5)")
    band_window_months: int = bounded(6, "[1, inf)")
    band_std_multiplier: float = bounded(1.5, "[0, inf)")

    def relations(self) -> dict[str, bool]:
        return {"index_code and pb_factor are named": bool(self.index_code and self.pb_factor)}


ORIGINAL = SelectionRules()
STRATEGY_1 = SelectionRules(dividend_top_n=150, volatility_lookback_days=20)
STRATEGY_2 = IntradaySelectionRules()
STRATEGY_3 = TimingRules()
