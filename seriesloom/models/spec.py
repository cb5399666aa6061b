"""Settings of the additive model."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist
from typing import Literal

Switch = bool | Literal["auto"]

# Seasonal blocks as (name, period in days, number of harmonics).
SEASONAL_BLOCKS = (("yearly", 365.25, 10), ("weekly", 7.0, 3), ("daily", 1.0, 4))

# The two settings used for all children alike, as (number, changepoint scale, seasonality scale).
FIXED_PAIRS = [(0, 0.001, 1.0), (1, 0.5, 10.0)]


@dataclass(frozen=True)
class ModelSpec:
    """y(t) = piecewise-linear trend + Fourier seasonality + noise, with priors on both parts."""

    n_changepoints: int = 25
    changepoint_range: float = 0.8
    yearly: Switch = "auto"
    weekly: Switch = "auto"
    daily: Switch = "auto"
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    seasonality_mode: Literal["additive", "multiplicative"] = "additive"
    interval_width: float = 0.8
    growth: Literal["linear"] = "linear"

    def __post_init__(self) -> None:
        if not 0.0 < self.interval_width < 1.0:
            raise ValueError("interval_width lies between 0 and 1")
        if self.changepoint_prior_scale <= 0 or self.seasonality_prior_scale <= 0:
            raise ValueError("prior scales are positive")

    @property
    def switches(self) -> tuple[Switch, Switch, Switch]:
        return (self.yearly, self.weekly, self.daily)

    @property
    def layout(self) -> int:
        """Bits of the seasonal blocks that have columns: forced on, or decided per key."""
        return sum(1 << i for i, switch in enumerate(self.switches) if switch)

    @property
    def width(self) -> int:
        """Number of design columns."""
        blocks = sum(2 * n for i, (_, _, n) in enumerate(SEASONAL_BLOCKS) if self.layout >> i & 1)
        return 2 + self.n_changepoints + blocks

    @property
    def z(self) -> float:
        """Normal quantile of the upper bound."""
        return NormalDist().inv_cdf((1.0 + self.interval_width) / 2.0)


ALL_SEASONS = ModelSpec(yearly=True, weekly=True, daily=True)
TREND_ONLY = ModelSpec(n_changepoints=0, yearly=False, weekly=False, daily=False)
