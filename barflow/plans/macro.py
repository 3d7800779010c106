"""Global, macro and intermarket queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import macro as mc
from ..sources import adapters as src
from .oracle import define, sql
from .registry import register

_W = "OVER (PARTITION BY name ORDER BY ts)"
_L = lambda k: f"round(coalesce((close / lag(close, {k}) {_W} - 1) * 100, 0), 4)"
_20 = "OVER (PARTITION BY name ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
define(
    "ser1",
    f"""SELECT name, ts, round(close, 4) AS level, {_L(1)} AS p1, {_L(5)} AS p5, {_L(20)} AS p20, round(coalesce(close - lag(close, 5) {_W}, 0), 4) AS chg5,
    CAST(CASE WHEN count(*) {_20} = 20 AND close > avg(close) {_20} THEN 1 ELSE 0 END AS DOUBLE) AS above20, list(close) {_20} AS l20, close FROM series""",
    "series",
)
define("ser2", "SELECT * EXCLUDE (l20, close), CASE WHEN len(l20) < 20 THEN 50.0 ELSE round(len(list_filter(l20, lambda v: v < close)) / 20.0::DOUBLE * 100, 1) END AS rank20 FROM ser1", "ser1")
define("mcal", "SELECT DISTINCT ts FROM series", "series")
define("sernames", "SELECT name, min(ts) AS f FROM series GROUP BY name", "series")
define("serf", "SELECT g.ts, s.* EXCLUDE (ts) FROM (SELECT c.ts, n.name FROM mcal c JOIN sernames n ON c.ts >= n.f) g ASOF JOIN ser2 s ON s.name = g.name AND g.ts >= s.ts", "mcal", "sernames", "ser2")
define(
    "globe",
    "SELECT *, round(us_10y_level - us_2y_level, 4) AS yield_spread FROM (SELECT ts, "
    + ", ".join(f"coalesce(max(CASE WHEN name = '{n}' THEN {f} END), 0.0::DOUBLE) AS {c}" for c, (n, f) in mc.GLOBAL.items())
    + " FROM serf GROUP BY ts)",
    "serf",
)
_pts = lambda c, hi, up, lo, dn: f"CASE WHEN {c} > {hi} THEN {up} WHEN {c} < {lo} THEN {dn} ELSE 0 END"
define(
    "verd",
    "SELECT *, CASE WHEN net_points >= 4 THEN 'STRONG_BULL' WHEN net_points >= 2 THEN 'BULL' WHEN net_points <= -4 THEN 'STRONG_BEAR' WHEN net_points <= -2 THEN 'BEAR' ELSE 'NEUTRAL' END AS verdict FROM (SELECT *, "
    + " + ".join(
        [
            _pts("sp500_1d_pct", 0.8, 2, -0.8, -2), _pts("dxy_5d_pct", 0.8, -2, -0.8, 2), _pts("usdinr_5d_pct", 1, -2, -0.5, 1), _pts("crude_5d_pct", 4, -1, -4, 1),
            _pts("india_vix_level", 22, -2, 13, 1), _pts("us_10y_5d_chg", 0.15, -1, -0.15, 1), _pts("jpmorgan_5d_pct", 1.5, 1, -1.5, -1), _pts("banknifty_1d_pct", 0.5, 1, -0.5, -1),
        ]
    )
    + " AS net_points FROM globe)",
    "globe",
)
define(
    "mkt0",
    """SELECT *, (dxy_5d_pct > 1 AND usdinr_5d_pct > 0.5)::INT AS dollar_stress, (dxy_5d_pct < -1 AND usdinr_5d_pct < -0.3)::INT AS dollar_ease, round(us_10y_5d_chg * 100, 1) AS us_10y_bp_5d,
    (round(us_10y_5d_chg * 100, 1) > 15)::INT AS yield_headwind, (round(us_10y_5d_chg * 100, 1) < -15)::INT AS yield_tailwind, (crude_level > 90 OR crude_5d_pct > 5)::INT AS crude_risk,
    (crude_level < 75 AND crude_5d_pct < 2)::INT AS crude_benign, (jpmorgan_5d_pct > 2)::INT AS global_banks_bullish, (jpmorgan_5d_pct < -2)::INT AS global_banks_bearish,
    round(banknifty_5d_pct - nifty_5d_pct, 4) AS bank_vs_nifty_rs, (round(banknifty_5d_pct - nifty_5d_pct, 4) > 0.5)::INT AS banks_outperforming, (round(banknifty_5d_pct - nifty_5d_pct, 4) < -0.5)::INT AS banks_underperforming FROM verd""",
    "verd",
)
define(
    "rates2",
    """SELECT *, CASE WHEN rbi_rate < lag(rbi_rate) OVER (ORDER BY effective_date) THEN 'CUTTING' WHEN rbi_rate > lag(rbi_rate) OVER (ORDER BY effective_date) THEN 'HIKING' ELSE 'HOLDING' END AS rbi_direction FROM rates""",
    "rates",
)
define(
    "mkt1",
    """SELECT m.*, r.rbi_rate, r.rbi_direction, r.credit_growth, coalesce(n.event_date - m.ts, 30) AS days_to_rbi, m.ts - p.event_date AS since FROM mkt0 m ASOF LEFT JOIN rates2 r ON m.ts >= r.effective_date
    ASOF LEFT JOIN meet n ON m.ts <= n.event_date ASOF LEFT JOIN meet p ON m.ts >= p.event_date""",
    "mkt0", "rates2", "meet",
)
define(
    "mkt",
    """SELECT *, (days_to_rbi <= 5)::INT AS is_rbi_week, CASE WHEN days_to_rbi = 0 THEN 0.4 WHEN days_to_rbi = 1 THEN 0.5 WHEN since = 1 THEN 0.8 ELSE 1 END::DOUBLE AS macro_event_mult,
    round(greatest(-1, least(1, (CASE rbi_direction WHEN 'CUTTING' THEN 0.2 WHEN 'HIKING' THEN -0.2 ELSE 0 END - CASE WHEN days_to_rbi <= 5 THEN 0.1 ELSE 0 END
      + CASE WHEN india_vix_level < 13 THEN 0.1 WHEN india_vix_level > 22 THEN -0.3 WHEN india_vix_level > 18 THEN -0.1 ELSE 0 END + CASE WHEN usdinr_5d_pct > 1.5 THEN -0.2 WHEN usdinr_5d_pct < -0.5 THEN 0.1 ELSE 0 END)::DOUBLE)), 3) AS macro_score FROM mkt1""",
    "mkt1",
)
_B = "OVER (PARTITION BY ticker ORDER BY ts)"
define("rs0", f"SELECT ticker, ts, {', '.join(f'coalesce((close / lag(close, {k}) {_B} - 1) * 100, 0) AS p{k}' for k in (1, 5, 20))} FROM bars", "bars")
define(
    "rs1",
    """SELECT r.ticker, r.ts, r.p1, r.p5, r.p20, CAST(row_number() OVER (PARTITION BY r.ts ORDER BY round(r.p5, 6) DESC, r.ticker) AS INT) AS peer_rank,
    round(r.p5 - coalesce(g.banknifty_5d_pct, 0), 6) AS rs_vs_banknifty_5d, round(r.p5 - CASE WHEN count(*) OVER d > 1 THEN (sum(r.p5) OVER d - r.p5) / (count(*) OVER d - 1) ELSE 0 END, 6) AS rs_vs_peers_5d
  FROM rs0 r LEFT JOIN globe g ON g.ts = r.ts WINDOW d AS (PARTITION BY r.ts)""",
    "rs0", "globe",
)
define(
    "imk",
    """SELECT *, round(greatest(-1, least(1, (CASE WHEN rs_vs_banknifty_5d > 0.5 THEN 0.25 ELSE 0 END + CASE WHEN rs_vs_peers_5d > 0.5 THEN 0.15 ELSE 0 END + CASE WHEN peer_rank = 1 THEN 0.1 ELSE 0 END
    - 0.15 * coalesce(yield_headwind, 0) + 0.1 * coalesce(yield_tailwind, 0) - 0.2 * coalesce(dollar_stress, 0) + 0.15 * coalesce(dollar_ease, 0) - 0.1 * coalesce(crude_risk, 0) + 0.05 * coalesce(crude_benign, 0)
    + 0.1 * coalesce(global_banks_bullish, 0) - 0.1 * coalesce(global_banks_bearish, 0) + 0.1 * coalesce(banks_outperforming, 0) - 0.1 * coalesce(banks_underperforming, 0))::DOUBLE)), 3) AS intermarket_score
  FROM rs1 LEFT JOIN mkt USING (ts)""",
    "rs1", "mkt",
)


def glob(spark, d):
    return mc.global_features(src.market_series(spark, d))


def market(spark, d):
    return mc.market_frame(src.market_series(spark, d), src.policy_rates(spark, d), src.meetings(spark, d))


def names(spark, d):
    return mc.name_frame(src.bars(spark, d), market(spark, d))


def q(key, part, cols, cte, exprs=None):
    """Select ``cols`` of ``part`` and the same columns of ``cte``."""
    exprs = exprs or {}
    register(key, lambda spark, d: part(spark, d).select(*cols), sql(f"SELECT {', '.join(f'{exprs[c]} AS {c}' if c in exprs else c for c in cols)} FROM {cte}", cte))


_G = ["ts", *mc.GLOBAL, "yield_spread"]
q("global_features", glob, _G, "globe")
q("bootstrap_history", lambda spark, d: mc.verdict(glob(spark, d)), ["ts", "sp500_1d_pct", "india_vix_level", "usdinr_5d_pct", "verdict"], "verd")
register(
    "percentile_rank_20",
    lambda spark, d: mc.series_features(src.market_series(spark, d)).select("name", "ts", "rank20"),
    sql("SELECT name, ts, CAST(rank20 AS DOUBLE) AS rank20 FROM ser2", "ser2"),
)
_BIAS = "CASE WHEN india_vix_level > 25 THEN 'AVOID' WHEN sp500_1d_pct > 0.8 THEN 'BULLISH_OPEN' WHEN sp500_1d_pct < -0.8 THEN 'BEARISH_OPEN' ELSE 'NEUTRAL_OPEN' END"
_SC = "CASE verdict WHEN 'STRONG_BULL' THEN 1 WHEN 'BULL' THEN 0.6 WHEN 'BEAR' THEN -0.6 WHEN 'STRONG_BEAR' THEN -1 ELSE 0 END::DOUBLE"
q("global_verdict", lambda spark, d: mc.verdict(glob(spark, d)), ["ts", "net_points", "verdict", "intraday_bias", "global_score"], "verd", {"intraday_bias": _BIAS, "global_score": _SC})
q("yield_features", lambda spark, d: mc.yields(glob(spark, d)), ["ts", "us_10y_level", "us_10y_bp_5d", "yield_headwind", "yield_tailwind"], "mkt0")
q("dollar_features", lambda spark, d: mc.dollar(glob(spark, d)), ["ts", "dxy_level", "dxy_5d_pct", "usdinr_level", "usdinr_5d_pct", "dollar_stress", "dollar_ease"], "mkt0")
q("crude_features", lambda spark, d: mc.crude(glob(spark, d)), ["ts", "crude_level", "crude_5d_pct", "crude_20d_pct", "crude_risk", "crude_benign"], "mkt0")
q("global_bank_features", lambda spark, d: mc.global_banks(glob(spark, d)), ["ts", "jpmorgan_1d_pct", "jpmorgan_5d_pct", "global_banks_bullish", "global_banks_bearish"], "mkt0")
q("sector_rotation", lambda spark, d: mc.rotation(glob(spark, d)), ["ts", "nifty_5d_pct", "banknifty_5d_pct", "bank_vs_nifty_rs", "banks_outperforming", "banks_underperforming"], "mkt0")
q("vix_features", lambda spark, d: mc.vix(glob(spark, d)), ["ts", "india_vix_level", "india_vix_1d_pct", "india_vix_pct20", "india_vix_high", "india_vix_panic"], "mkt0",
  {"india_vix_high": "(india_vix_level > 20)::INT", "india_vix_panic": "(india_vix_level > 25)::INT"})
q("currency_features", lambda spark, d: mc.currency(glob(spark, d)), ["ts", "usdinr_level", "usdinr_1d_pct", "usdinr_5d_pct", "usdinr_20d_pct", "rupee_stress"], "mkt0", {"rupee_stress": "(usdinr_5d_pct > 1)::INT"})
q("index_features", glob, ["ts", "nifty_1d_pct", "nifty_5d_pct"], "globe")
q("rate_direction", lambda spark, d: mc.rate_direction(src.policy_rates(spark, d)), ["effective_date", "rbi_rate", "rbi_direction"], "rates2")
q("rate_asof", lambda spark, d: mc.rate_asof(glob(spark, d).select("ts"), src.policy_rates(spark, d)), ["ts", "rbi_rate", "rbi_direction"], "mkt1")
q("meeting_proximity", lambda spark, d: mc.meeting_proximity(glob(spark, d).select("ts"), src.meetings(spark, d)), ["ts", "days_to_rbi", "is_rbi_week", "macro_event_mult"], "mkt", {"days_to_rbi": "CAST(days_to_rbi AS INT)"})
q("credit_features", lambda spark, d: mc.credit(mc.rate_asof(glob(spark, d).select("ts"), src.policy_rates(spark, d))), ["ts", "system_credit_growth", "credit_strong", "credit_weak"], "mkt1",
  {"system_credit_growth": "coalesce(credit_growth, 15.0::DOUBLE)", "credit_strong": "(coalesce(credit_growth, 15) > 14)::INT", "credit_weak": "(coalesce(credit_growth, 15) < 8)::INT"})
q("macro_score", market, ["ts", "macro_score", "macro_signal"], "mkt", {"macro_signal": "CASE WHEN macro_score > 0.3 THEN 'MACRO_BULLISH' WHEN macro_score < -0.3 THEN 'MACRO_BEARISH' ELSE 'MACRO_NEUTRAL' END"})
q("relative_strength", lambda spark, d: mc.relative_strength(src.bars(spark, d), glob(spark, d)), ["ticker", "ts", "rs_vs_banknifty_5d", "rs_vs_peers_5d", "peer_rank", "outperforming_sector", "outperforming_peers"], "rs1",
  {"outperforming_sector": "(rs_vs_banknifty_5d > 0.5)::INT", "outperforming_peers": "(rs_vs_peers_5d > 0.5)::INT"})
q("benchmark_join", lambda spark, d: mc.relative_strength(src.bars(spark, d), glob(spark, d)), ["ticker", "ts", "rs_vs_banknifty_5d"], "rs1")
_IS = "CASE WHEN intermarket_score > 0.4 THEN 'STRONG_INTERMARKET_BULL' WHEN intermarket_score > 0.15 THEN 'MILD_INTERMARKET_BULL' WHEN intermarket_score < -0.4 THEN 'STRONG_INTERMARKET_BEAR' WHEN intermarket_score < -0.15 THEN 'MILD_INTERMARKET_BEAR' ELSE 'INTERMARKET_NEUTRAL' END"
q("intermarket_score", names, ["ticker", "ts", "intermarket_score", "intermarket_signal"], "imk", {"intermarket_signal": _IS})
_c = lambda e: f"round(least(greatest(coalesce({e}, 0), -1), 1), 6)"
MF = {
    "india_vix_norm": f"-{_c('(coalesce(india_vix_level, 0) - 10) / 20 * 2 - 1')}", "india_vix_trend": _c("india_vix_1d_pct / 20"), "rbi_proximity_norm": "round(greatest(1 - least(days_to_rbi, 30) / 30, 0), 4)",
    "rbi_cutting_cycle": "CASE rbi_direction WHEN 'CUTTING' THEN 1 WHEN 'HIKING' THEN -1 ELSE 0 END", "dollar_stress_f": "coalesce(dollar_stress, 0)", "rupee_stress_f": _c("-usdinr_5d_pct / 2"),
    "yield_headwind_f": _c("-us_10y_bp_5d / 30"), "crude_risk_f": _c("-crude_5d_pct / 10"), "macro_score_f": _c("macro_score"), "intermarket_score_f": _c("intermarket_score"), "rs_vs_banknifty": _c("rs_vs_banknifty_5d / 3"),
    "banks_outperforming_nifty": "coalesce(banks_outperforming, 0)", "banknifty_relative_momentum_5d": _c("greatest(-10, least(10, coalesce(banknifty_5d_pct - nifty_5d_pct, 0))) / 5"), "peer_rank_norm": "round(1 - (peer_rank - 1) / 5, 3)",
}
q("macro_features", lambda spark, d: mc.features(names(spark, d)), ["ticker", "ts", *mc.FEATURES], "imk", {k: f"CAST({v} AS DOUBLE)" for k, v in MF.items()})
