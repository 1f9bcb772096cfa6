"""Parameters of the research pipeline; the defaults are the frozen values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    min_history: int = 252
    min_price: float = 5.0
    liquidity_window: int = 20
    min_liquidity_days: int = 15
    min_median_dollar_volume: float = 10_000_000.0
    formation: int = 252
    min_pair_observations: int = 200
    min_correlation: float = 0.50
    max_partners: int = 10
    keep_last_month: bool = False
    exclude_issuer_before_topk: bool = False
    test_cap: int = 50
    fdr: float = 0.10
    half_life: tuple[float, float] = (2.0, 60.0)
    hedge_ratio: tuple[float, float] = (0.10, 10.0)
    min_spread_std: float = 0.001
    baseline_cap: int = 20
    sensitivity_caps: tuple[int, ...] = (10, 20, 30, 50)
    event_entry_z: float = 2.0
    event_partial_z: float = 1.0
    event_exit_z: float = 0.5
    extreme_return: float = 0.50
    max_missing_fraction: float = 0.05
    rtol: float = 1e-6
    atol: float = 1e-8
    calendar_coverage: float = 0.25
    entry_z: float = 2.0
    exit_z: float = 0.5
    stop_z: float = 4.0
    max_holding: int = 20
    max_pairs: int = 5
    pair_gross: float = 0.20
    portfolio_gross: float = 1.0
    cost_rate: float = 0.0010
    borrow_rate: float = 0.03
    trading_days: int = 252
    initial_equity: float = 1.0
    eligibility_asof: str = "execution"
    #: Borrow on a leg without a close: "free", or "spoil", which makes the cash account NaN from then on.
    unpriced_borrow: str = "free"
