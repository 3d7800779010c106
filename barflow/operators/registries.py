"""Ordered feature registries: which columns of the wide row a model reads, and their vector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite_or


@dataclass(frozen=True)
class Registry:
    """Names in the order a model was trained on. The vector fills what is missing or not finite with 0, so its length never changes."""

    model: str
    variant: str
    names: tuple[str, ...]

    def __post_init__(self):
        if len(set(self.names)) != len(self.names):
            raise ValueError(f"{self.model} {self.variant} names a feature twice")

    def columns(self, df: DataFrame) -> list[Column]:
        have = set(df.columns)
        return [(finite_or(F.col(n).cast("double")) if n in have else F.lit(0.0)).alias(n) for n in self.names]

    def vector(self, df: DataFrame) -> Column:
        return F.array(*self.columns(df))

    def of(self, available: set[str]) -> Registry:
        """The names that a narrower source has, in the same order."""
        return Registry(self.model, self.variant, tuple(n for n in self.names if n in available))


# The order of each model's features.
_SWING = """
rsi_14 stoch_rsi rsi_divergence macd_hist macd_hist_roc adx
ema_spread ema_spread_roc supertrend support_dist resistance_dist
bb_pct_b bb_squeeze atr_ratio hv_ratio range_pct_52w
obv_roc mfi volume_ratio close_pct_range
returns_1d returns_5d returns_20d
news_score_24h news_score_trend news_momentum news_spike earnings_score earnings_relevance announcement_score combined_score social_contrarian_score
pcr_norm pcr_roc_norm max_pain_dist_norm iv_percentile_norm implied_move_norm expiry_proximity call_wall_dist_norm put_wall_dist_norm
fii_5d_norm fii_signal dii_3d_norm flow_confluence insider_score order_flow_score delta_divergence institutional_bias
india_vix_norm rbi_proximity_norm rbi_cutting_cycle dollar_stress rupee_stress yield_headwind macro_score intermarket_score
rs_vs_banknifty banks_outperforming_nifty peer_rank_norm jpmorgan_norm crude_risk
earnings_proximity earnings_risk_flag pre_earnings_drift earnings_beat_prob is_expiry_week is_monday month_seasonality holiday_proximity
pattern_score chart_golden_cross chart_volume_breakout chart_bb_breakout
regime_bull regime_bear regime_high_vol regime_choppy regime_stability
tf_alignment_score rolling_accuracy_10 losing_streak_norm model_health_score avg_model_confidence
"""
_INTRADAY = """
rsi_14 stoch_rsi macd_hist macd_hist_roc bb_pct_b bb_squeeze atr_ratio volume_ratio returns_1d close_pct_range gap_pct support_dist resistance_dist
vwap_dist price_above_vwap
order_flow_score cum_delta_norm delta_divergence absorption_flag institutional_bias
news_score_24h news_spike announcement_score
pcr_norm max_pain_dist_norm expiry_proximity is_expiry_week is_expiry_day
is_monday is_friday is_midweek earnings_risk_flag holiday_proximity
india_vix_norm dollar_stress
pattern_score chart_inside_bar
regime_bull regime_bear regime_choppy
tf_alignment_score losing_streak_norm
"""
_POSITIONAL = """
rsi_14 adx ema_spread ema_spread_roc supertrend returns_5d returns_20d range_pct_52w hv_ratio support_dist resistance_dist
nim_norm nim_trend npa_norm npa_trend casa_norm loan_growth_norm roe_norm pb_vs_avg_norm beat_streak_norm fundamental_score
news_score_24h news_score_trend earnings_score earnings_relevance combined_score
demand_trend home_loan_trend hiring_trend alt_data_score insider_score promoter_trend_score
india_vix_norm rbi_proximity_norm rbi_cutting_cycle dollar_stress rupee_stress yield_headwind crude_risk macro_score intermarket_score rs_vs_banknifty peer_rank_norm
fii_5d_norm fii_signal flow_confluence dii_accumulation
pcr_norm iv_percentile_norm implied_move_norm
earnings_proximity earnings_beat_prob month_seasonality is_q4_india
regime_bull regime_bear regime_stability
rolling_accuracy_10 model_health_score
"""
_SWING_PROD = """
rsi_14 stoch_rsi rsi_divergence macd_hist macd_hist_roc adx
ema_spread ema_spread_roc supertrend support_dist resistance_dist
bb_pct_b bb_squeeze atr_ratio hv_ratio range_pct_52w
obv_roc mfi volume_ratio close_pct_range
returns_1d returns_5d returns_20d
news_score_24h news_score_trend news_spike news_momentum_3d
pcr_norm max_pain_dist_norm iv_percentile_norm implied_move_norm expiry_proximity
fii_5d_norm fii_signal fii_flow_surprise
india_vix_norm rbi_proximity_norm rbi_cutting_cycle dollar_stress rupee_stress yield_headwind crude_risk macro_score intermarket_score banknifty_relative_momentum_5d
earnings_proximity earnings_risk_flag is_expiry_week is_monday holiday_proximity
regime_bull regime_bear regime_high_vol regime_choppy regime_stability
pattern_score
atr_percentile_252 banks_above_50dma_pct
"""
_INTRADAY_PROD = """
rsi_14 stoch_rsi macd_hist macd_hist_roc bb_pct_b bb_squeeze atr_ratio volume_ratio returns_1d close_pct_range
gap_pct support_dist resistance_dist vwap_dist
news_score_24h news_spike news_momentum_3d
pcr_norm max_pain_dist_norm expiry_proximity
is_expiry_week is_monday earnings_risk_flag holiday_proximity
india_vix_norm dollar_stress banknifty_relative_momentum_5d
pattern_score
regime_bull regime_bear regime_choppy
atr_percentile_252 banks_above_50dma_pct
"""
_POSITIONAL_PROD = """
rsi_14 adx ema_spread ema_spread_roc supertrend returns_5d returns_20d range_pct_52w hv_ratio
support_dist resistance_dist
news_score_24h news_score_trend news_momentum_3d
india_vix_norm rbi_proximity_norm rbi_cutting_cycle dollar_stress rupee_stress yield_headwind crude_risk macro_score intermarket_score banknifty_relative_momentum_5d
fii_5d_norm fii_signal fii_flow_surprise
pcr_norm iv_percentile_norm implied_move_norm
earnings_proximity earnings_risk_flag is_expiry_week holiday_proximity
regime_bull regime_bear regime_stability
atr_percentile_252 banks_above_50dma_pct
"""
REGISTRIES: dict[tuple[str, str], Registry] = {
    (model, variant): Registry(model, variant, tuple(text.split()))
    for (model, variant), text in {
        ("swing", "full"): _SWING, ("swing", "prod"): _SWING_PROD, ("intraday", "full"): _INTRADAY, ("intraday", "prod"): _INTRADAY_PROD,
        ("positional", "full"): _POSITIONAL, ("positional", "prod"): _POSITIONAL_PROD,
    }.items()
}
