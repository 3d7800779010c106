"""Regime queries over the daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regime as rg
from ..operators import technical as ta
from ..sources import adapters as src
from .oracle import define, sql
from .registry import query, register
from .technical import W, guarded

define("rg0", "SELECT t.ticker, t.ts, t.close, adx, ema_spread, returns_5d FROM tech_trend t JOIN tech_price p USING (ticker, ts)", "tech_trend", "tech_price")
define(
    "rg1",
    """SELECT *, ((adx > 22 AND ema_spread < -0.01) OR ema_spread < -0.015)::INT AS bear, ((adx > 22 AND ema_spread > 0.01) OR ema_spread > 0.015)::INT AS bull, (adx > 30 AND abs(returns_5d) > 0.025)::INT AS hv FROM rg0""",
    "rg0",
)
define(
    "regimes",
    f"""SELECT *, CASE WHEN bear + bull + hv = 0 THEN 1 ELSE 0 END AS chop, CASE WHEN hv = 1 THEN 'HIGH_VOLATILITY' WHEN bear = 1 THEN 'BEAR_TRENDING' WHEN bull = 1 THEN 'BULL_TRENDING' ELSE 'CHOPPY_SIDEWAYS' END AS regime,
    row_number() {W}) AS rn FROM rg1""",
    "rg1",
)
define(
    "regimes2",
    """SELECT r.*, CASE WHEN r.rn >= 3 THEN (SELECT count(*) FILTER (x.regime = r.regime) / count(*) FROM regimes x WHERE x.ticker = r.ticker AND x.rn BETWEEN r.rn - 9 AND r.rn) ELSE 0.5 END AS stability FROM regimes r""",
    "regimes",
)
define(
    "rpersist",
    """SELECT ticker, rn, ts, regime, regime AS committed FROM regimes WHERE rn = 1
  UNION ALL SELECT b.ticker, b.rn, b.ts, b.regime, CASE WHEN b.regime = p.committed OR b.regime = 'HIGH_VOLATILITY' THEN b.regime
      WHEN b.regime = p.regime AND b.regime = (SELECT z.regime FROM regimes z WHERE z.ticker = b.ticker AND z.rn = b.rn - 2) THEN b.regime ELSE p.committed END
    FROM rpersist p JOIN regimes b ON b.ticker = p.ticker AND b.rn = p.rn + 1""",
    "regimes",
)


def frame(spark, d):
    df = ta.price_action(ta.trend(src.bars(spark, d)))
    return rg.name(rg.classify(df))


register(
    "classify_regime",
    lambda spark, d: frame(spark, d).select("ticker", "ts", "regime_bull", "regime_bear", "regime_high_vol", "regime_choppy"),
    sql("SELECT ticker, ts, bull AS regime_bull, bear AS regime_bear, hv AS regime_high_vol, chop AS regime_choppy FROM regimes", "regimes"),
)
register("regime_name", lambda spark, d: frame(spark, d).select("ticker", "ts", "regime"), sql("SELECT ticker, ts, regime FROM regimes", "regimes"))
register(
    "regime_stability",
    lambda spark, d: rg.stability(frame(spark, d)).select("ticker", "ts", F.round("stability", 4).alias("stability")),
    sql("SELECT ticker, ts, round(CAST(stability AS DOUBLE), 4) AS stability FROM regimes2", "regimes2"),
)
define(
    "rpers2",
    f"""SELECT ticker, rn, ts, regime, lag(regime) {W}) AS l1, lag(regime, 2) {W}) AS l2 FROM regimes""",
    "regimes",
)
define(
    "rpers_rec",
    """SELECT ticker, rn, ts, regime, regime AS committed FROM rpers2 WHERE rn = 1
  UNION ALL SELECT b.ticker, b.rn, b.ts, b.regime, CASE WHEN b.regime = p.committed OR b.regime = 'HIGH_VOLATILITY' OR (b.regime = b.l1 AND b.regime = b.l2) THEN b.regime ELSE p.committed END
    FROM rpers_rec p JOIN rpers2 b ON b.ticker = p.ticker AND b.rn = p.rn + 1""",
    "rpers2",
)
register(
    "regime_persistence",
    lambda spark, d: rg.persist(frame(spark, d)).select("ticker", "ts", "regime", "committed_regime", "held"),
    sql("SELECT ticker, ts, regime, committed AS committed_regime, (committed <> regime)::INT AS held FROM rpers_rec", "rpers_rec"),
)
_P = {"bull_prob": "BULL_TRENDING", "bear_prob": "BEAR_TRENDING", "high_vol_prob": "HIGH_VOLATILITY", "choppy_prob": "CHOPPY_SIDEWAYS"}
register(
    "regime_probs",
    lambda spark, d: rg.probabilities(rg.stability(frame(spark, d))).select("ticker", "ts", *_P),
    sql(f"SELECT ticker, ts, {', '.join(f'''round(CASE WHEN regime = '{r}' THEN greatest(stability, 0.25) ELSE greatest((1 - greatest(stability, 0.25)) / 3, 0) END::DOUBLE, 3) AS {c}''' for c, r in _P.items())} FROM regimes2", "regimes2"),
)
define("rtr0", f"SELECT ticker, ts, rn, regime, coalesce((regime <> lag(regime) {W}))::INT, 0) AS chg FROM regimes", "regimes")
define(
    "rtr1",
    """SELECT a.ticker, a.ts, CAST(sum(b.chg) - first(b.chg ORDER BY b.ts) AS BIGINT) AS changes, count(*) FILTER (b.regime = 'BULL_TRENDING') AS n1, count(*) FILTER (b.regime = 'BEAR_TRENDING') AS n2,
    count(*) FILTER (b.regime = 'HIGH_VOLATILITY') AS n3, count(*) FILTER (b.regime = 'CHOPPY_SIDEWAYS') AS n4 FROM rtr0 a JOIN rtr0 b ON b.ticker = a.ticker AND b.ts BETWEEN a.ts - 10 AND a.ts GROUP BY a.ticker, a.ts""",
    "rtr0",
)
register(
    "regime_trend",
    lambda spark, d: rg.trend(frame(spark, d)).select("ticker", "ts", "regime_changes", "dominant_regime", "regime_stable"),
    sql(
        """SELECT ticker, ts, changes AS regime_changes, CASE greatest(n1, n2, n3, n4) WHEN n1 THEN 'BULL_TRENDING' WHEN n2 THEN 'BEAR_TRENDING' WHEN n3 THEN 'HIGH_VOLATILITY' ELSE 'CHOPPY_SIDEWAYS' END AS dominant_regime,
    (changes <= 1)::INT AS regime_stable FROM rtr1""",
        "rtr1",
    ),
)
RULES_SQL = "(VALUES ('BULL_TRENDING', true, false, 1.2::DOUBLE, 21, 1.5::DOUBLE), ('BEAR_TRENDING', false, true, 1.0, 4, 1.2), ('HIGH_VOLATILITY', true, true, 0.5, 2, 2.0), ('CHOPPY_SIDEWAYS', false, false, 0.0, 0, 1.0)) q(regime, trade_long, trade_short, position_mult, max_hold_days, stop_mult)"
register(
    "regime_rules",
    lambda spark, d: rg.with_rules(frame(spark, d)).select("ticker", "ts", "regime", "trade_long", "trade_short", "position_mult", "max_hold_days", "stop_mult"),
    sql(f"SELECT ticker, ts, regime, trade_long, trade_short, position_mult, max_hold_days, stop_mult FROM regimes JOIN {RULES_SQL} USING (regime)", "regimes"),
)
define("fb0", f"SELECT ticker, ts, i, close, close / lag(close) {W}) - 1 AS ret FROM cr0", "cr0")
define(
    "fb1",
    f"""SELECT b.*, nf / df AS e20, ns / ds AS e50, abs({guarded('avg(sign(ret))', 'ret', 14)}) AS cons, {guarded('stddev_samp(ret)', 'ret', 10)} * sqrt(252) * 100 AS hv10, {guarded('stddev_samp(ret)', 'ret', 30)} * sqrt(252) * 100 AS hv30
  FROM (SELECT f.*, nf, df, ns, ds FROM fb0 f JOIN cr_rec USING (ticker, i)) b""",
    "fb0", "cr_rec",
)
register(
    "regime_rule_fallback",
    lambda spark, d: rg.rule_fallback(src.bars(spark, d)).select("ticker", "ts", F.round("consistency", 6).alias("consistency"), "rule_regime"),
    sql(
        """SELECT ticker, ts, round(cons, 6) AS consistency, CASE WHEN i < 30 THEN 'CHOPPY_SIDEWAYS' WHEN hv10 > 30 THEN 'HIGH_VOLATILITY' WHEN close > e20 AND e20 > e50 AND cons > 0.35 THEN 'BULL_TRENDING'
    WHEN close < e20 AND e20 < e50 AND cons > 0.35 THEN 'BEAR_TRENDING' ELSE 'CHOPPY_SIDEWAYS' END AS rule_regime FROM fb1""".replace("SELECT b.*", "SELECT b.*"),
        "fb1",
    ),
)
register("regime_clusters", lambda spark, d: rg.clusters(src.bars(spark, d)))
register(
    "regime_ml_features",
    lambda spark, d: rg.ml_features(frame(spark, d)).select("ticker", "ts", "is_bull", "is_bear", "is_high_vol", "is_choppy", "allows_long", "allows_short", "position_mult"),
    sql(
        f"""SELECT ticker, ts, (regime = 'BULL_TRENDING')::INT AS is_bull, (regime = 'BEAR_TRENDING')::INT AS is_bear, (regime = 'HIGH_VOLATILITY')::INT AS is_high_vol, (regime = 'CHOPPY_SIDEWAYS')::INT AS is_choppy,
    trade_long::INT AS allows_long, trade_short::INT AS allows_short, position_mult FROM regimes JOIN {RULES_SQL} USING (regime)""",
        "regimes",
    ),
)
