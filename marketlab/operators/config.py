"""Settings of the research operators; the default numbers are fixed, published values."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CostConfig:
    """Single-leg execution model."""

    holding_periods: tuple[int, ...] = (1, 3, 6, 12)
    fee_bps: float = 20.0
    impact_coeff: float = 0.10
    max_impact: float = 0.05
    base_trade_notional: float = 250.0
    max_participation: float = 0.15
    vol_slippage_coeff: float = 0.25
    fill_alpha: float = 1.5
    fill_beta: float = 2.0
    fill_gamma: float = 0.8
    snapshot_hours: float = 1.0


@dataclass(frozen=True)
class PairCostConfig:
    """Two-leg execution model."""

    holding_periods: tuple[int, ...] = (1, 3, 6)
    fee_bps: float = 20.0
    impact_coeff: float = 0.08
    max_impact: float = 0.05
    base_trade_notional: float = 250.0
    max_participation: float = 0.10
    vol_slippage_coeff: float = 0.15
    fill_alpha: float = 1.75
    fill_beta: float = 1.0
    fill_gamma: float = 0.50
    fill_buffer_bps: float = 5.0
    staleness_ms: float = 1000.0


@dataclass(frozen=True)
class StrategyConfig:
    thresholds: tuple[float, ...] = (0.10, 0.15, 0.20, 0.25)
    holding_periods: tuple[int, ...] = (1, 3, 6, 12)
    train_ratio: float = 0.70
    fee_bps: float = 20.0
    impact_coeff: float = 0.10
    max_impact: float = 0.05
    base_trade_notional: float = 250.0
    max_participation: float = 0.15
    min_history_rows: int = 60
    min_train_trades: int = 20
    min_test_trades_target: int = 200
    model_type: str = "heuristic"
    model_candidates: tuple[str, ...] = ("logistic", "gradient_boosting", "bayesian")
    model_horizon: int = 1
    cv_splits: int = 4
    ensemble_blend: float = 0.5
    walk_folds: int = 4
    walk_min_train_periods: int = 4
    walk_min_train_samples: int = 120
    walk_test_periods: int = 12
    walk_min_test_trades: int = 20
    walk_embargo: int = 1
    top_confidence_pct: float = 1.0
    min_expected_edge: float = 0.0
    min_expected_net_ev: float = 0.0
    ev_grid: tuple[float, ...] = (0.0, 0.001, 0.002, 0.005)
    min_liquidity_log: float | None = None
    max_prob_vol_6: float | None = None
    max_spread_bps: float | None = 2500.0
    allowed_vol_regimes: tuple[int, ...] = (0, 1, 2)
    label_mode: str = "auto"
    label_quantiles: tuple[float, ...] = (0.60, 0.50, 0.40, 0.30, 0.20, 0.10, 0.0)
    label_target_rate: float = 0.35
    label_min_rate: float = 0.10
    label_max_rate: float = 0.90
    label_min_samples: int = 200
    reselect_on_test: bool = False

    def costs(self) -> CostConfig:
        return CostConfig(self.holding_periods, self.fee_bps, self.impact_coeff, self.max_impact, self.base_trade_notional, self.max_participation)


@dataclass(frozen=True)
class PairStrategyConfig(StrategyConfig):
    thresholds: tuple[float, ...] = (0.004, 0.006, 0.008, 0.010, 0.015)
    holding_periods: tuple[int, ...] = (1, 3, 6)
    fee_bps: float = 10.0
    impact_coeff: float = 0.05
    max_impact: float = 0.03
    base_trade_notional: float = 200.0
    max_participation: float = 0.08
    min_history_rows: int = 100
    min_train_trades: int = 50
    min_test_trades_target: int = 300
    walk_min_test_trades: int = 50
    walk_min_train_samples: int = 150
    walk_test_periods: int = 24
    pair_min_depth: float = 25.0
    min_pair_fill: float = 0.15
    pair_fill_buffer: float = 0.0025
    staleness_ms: float = 1000.0

    def pair_costs(self) -> PairCostConfig:
        return PairCostConfig(self.holding_periods, self.fee_bps, self.impact_coeff, self.max_impact, self.base_trade_notional, self.max_participation, staleness_ms=self.staleness_ms)


# fixed values: multipliers (m) and shifts (s) of the execution regimes
REGIMES: dict[str, dict[str, float]] = {
    "optimistic": {"impact_m": 0.70, "max_impact_m": 0.70, "vol_m": 0.60, "alpha_s": 0.60, "beta_m": 0.70, "gamma_m": 1.20},
    "base": {"impact_m": 1.0, "max_impact_m": 1.0, "vol_m": 1.0, "alpha_s": 0.0, "beta_m": 1.0, "gamma_m": 1.0},
    "pessimistic": {"impact_m": 1.40, "max_impact_m": 1.40, "vol_m": 1.50, "alpha_s": -0.60, "beta_m": 1.40, "gamma_m": 0.70},
}
PAIR_REGIMES: dict[str, dict[str, float]] = {
    "optimistic": {"impact_m": 0.7, "max_impact_m": 0.8, "vol_m": 0.7, "alpha_s": 0.5, "beta_m": 0.8, "gamma_m": 1.2, "buffer_m": 0.5},
    "base": {"impact_m": 1.0, "max_impact_m": 1.0, "vol_m": 1.0, "alpha_s": 0.0, "beta_m": 1.0, "gamma_m": 1.0, "buffer_m": 1.0},
    "pessimistic": {"impact_m": 1.4, "max_impact_m": 1.4, "vol_m": 1.5, "alpha_s": -0.5, "beta_m": 1.4, "gamma_m": 0.7, "buffer_m": 2.0},
}


def regime_costs(cfg: CostConfig | PairCostConfig, regime: str) -> dict[str, float]:
    """Cost parameters under an execution regime; unknown names mean base."""
    pair = isinstance(cfg, PairCostConfig)
    m = (PAIR_REGIMES if pair else REGIMES).get(regime.lower().strip(), (PAIR_REGIMES if pair else REGIMES)["base"])
    out = {
        "impact_coeff": cfg.impact_coeff * m["impact_m"],
        "max_impact": cfg.max_impact * m["max_impact_m"],
        "vol_slippage_coeff": cfg.vol_slippage_coeff * m["vol_m"],
        "fill_alpha": cfg.fill_alpha + m["alpha_s"],
        "fill_beta": cfg.fill_beta * m["beta_m"],
        "fill_gamma": cfg.fill_gamma * m["gamma_m"],
    }
    if pair:
        out["fill_buffer_bps"] = cfg.fill_buffer_bps * m["buffer_m"]
    return out


__all__ = ["CostConfig", "PairCostConfig", "StrategyConfig", "PairStrategyConfig", "REGIMES", "PAIR_REGIMES", "regime_costs", "replace"]
