"""Order-flow queries over the daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import orderflow as of
from ..sources import adapters as src
from .oracle import define, sql
from .registry import query, register
from .technical import W, guarded, last_n

define(
    "of1",
    f"""SELECT *, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS pos, {guarded('avg(volume)', 'volume', 20)} AS av20, row_number() {W}) AS rn,
    {guarded('avg(high - low)', 'high', 14)} AS typ, sum((high + low + close) / 3 * volume) OVER m / (sum(volume) OVER m + 1e-8) AS vw
  FROM bars WINDOW m AS (PARTITION BY ticker, date_trunc('month', ts) ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
    "bars",
)
define("of2", f"SELECT *, (2 * pos - 1) * volume AS delta, round(sum(pos * volume - (1 - pos) * volume) {W} ROWS UNBOUNDED PRECEDING), 6) AS cum FROM of1", "of1")
define(
    "of3",
    f"""SELECT *, CASE WHEN av20 IS NOT NULL THEN cum / (sum(av20) {W} ROWS UNBOUNDED PRECEDING) + 1) END AS cn,
    CASE WHEN rn < 5 THEN 'FLAT' WHEN cum > lag(cum, 4) {W}) THEN 'RISING' ELSE 'FALLING' END AS trend,
    CASE WHEN rn < 5 THEN 'NONE' WHEN close > lag(close, 2) {W}) AND NOT cum > lag(cum, 2) {W}) THEN 'BEARISH_DIVERGENCE'
      WHEN NOT close > lag(close, 2) {W}) AND cum > lag(cum, 2) {W}) THEN 'BULLISH_DIVERGENCE' ELSE 'CONFIRMED' END AS dv,
    CASE WHEN (close - vw) / (vw + 1e-8) > 0.003 THEN 'ABOVE_VWAP' WHEN (close - vw) / (vw + 1e-8) < -0.003 THEN 'BELOW_VWAP' ELSE 'AT_VWAP' END AS vs,
    volume / greatest(av20, 1) AS vr, coalesce(volume / greatest(av20, 1) > 2.5 AND high - low < typ * 0.3, false) AS absorbed,
    count(*) FILTER (volume > av20 * 2 AND close > open) {last_n(252)} AS bl, count(*) FILTER (volume > av20 * 2 AND close < open) {last_n(252)} AS br,
    round(count(*) FILTER (volume > av20 * 2) {last_n(252)} / count(*) {last_n(252)}, 4) AS lr FROM of2""",
    "of2",
)
define(
    "of4",
    """SELECT *, CASE WHEN bl > br * 1.5 THEN 'INSTITUTIONAL_BUYING' WHEN br > bl * 1.5 THEN 'INSTITUTIONAL_SELLING' ELSE 'NEUTRAL' END AS ib,
    CASE WHEN NOT (bl > br * 1.5 OR br > bl * 1.5) THEN 'LOW' WHEN greatest(bl, br) > 2 * least(bl, br) THEN 'HIGH' ELSE 'MEDIUM' END AS ic FROM of3""",
    "of3",
)
define(
    "of5",
    """SELECT *, round(greatest(-1, least(1, (CASE WHEN absorbed THEN 0.5 ELSE 1.0 END)::DOUBLE * (
      CASE trend WHEN 'RISING' THEN 0.25 WHEN 'FALLING' THEN -0.25 ELSE 0 END + CASE vs WHEN 'ABOVE_VWAP' THEN 0.2 WHEN 'BELOW_VWAP' THEN -0.2 ELSE 0 END
      + CASE dv WHEN 'BEARISH_DIVERGENCE' THEN -0.25 WHEN 'BULLISH_DIVERGENCE' THEN 0.25 ELSE 0 END
      + CASE ib WHEN 'INSTITUTIONAL_BUYING' THEN 1 WHEN 'INSTITUTIONAL_SELLING' THEN -1 ELSE 0 END * CASE ic WHEN 'HIGH' THEN 0.2 ELSE 0.1 END)::DOUBLE)), 3) AS sc FROM of4""",
    "of4",
)


def r(*names):
    return [F.round(n, 6).alias(n) for n in names]


register(
    "delta",
    lambda spark, d: of.delta(src.bars(spark, d)).select("ticker", "ts", *r("buy_vol", "sell_vol", "delta", "cum_delta", "cum_delta_norm"), "delta_trend"),
    sql("SELECT ticker, ts, round(pos * volume, 6) AS buy_vol, round((1 - pos) * volume, 6) AS sell_vol, round(delta, 6) AS delta, round(cum, 6) AS cum_delta, round(cn, 6) AS cum_delta_norm, trend AS delta_trend FROM of3", "of3"),
)
register(
    "delta_divergence",
    lambda spark, d: of.divergence(of.delta(src.bars(spark, d))).select("ticker", "ts", "delta_divergence"),
    sql("SELECT ticker, ts, dv AS delta_divergence FROM of3", "of3"),
)
register(
    "vwap_signal",
    lambda spark, d: of.vwap_signal(src.bars(spark, d)).select("ticker", "ts", *r("vwap_distance"), "vwap_signal"),
    sql("SELECT ticker, ts, round((close - vw) / (vw + 1e-8), 6) AS vwap_distance, vs AS vwap_signal FROM of3", "of3"),
)
register(
    "absorption",
    lambda spark, d: of.absorption(src.bars(spark, d)).select("ticker", "ts", *r("vol_ratio20"), "absorption_detected", "absorption_strength"),
    sql("SELECT ticker, ts, round(vr, 6) AS vol_ratio20, absorbed::INT AS absorption_detected, CASE WHEN absorbed AND vr > 5 THEN 'STRONG' WHEN absorbed THEN 'MODERATE' ELSE 'NONE' END AS absorption_strength FROM of3", "of3"),
)
register(
    "inst_bias",
    lambda spark, d: of.institutional_bias(src.bars(spark, d)).select("ticker", "ts", "bull_large", "bear_large", "large_candle_ratio", "inst_bias", "inst_conviction"),
    sql("SELECT ticker, ts, bl AS bull_large, br AS bear_large, lr AS large_candle_ratio, ib AS inst_bias, ic AS inst_conviction FROM of4", "of4"),
)
register(
    "order_flow_score",
    lambda spark, d: of.order_flow(src.bars(spark, d)).select("ticker", "ts", "order_flow_score", "order_flow_signal"),
    sql(
        """SELECT ticker, ts, sc AS order_flow_score, CASE WHEN sc > 0.4 THEN 'STRONG_BUYING_PRESSURE' WHEN sc > 0.15 THEN 'MILD_BUYING_PRESSURE' WHEN sc < -0.4 THEN 'STRONG_SELLING_PRESSURE'
    WHEN sc < -0.15 THEN 'MILD_SELLING_PRESSURE' ELSE 'BALANCED_FLOW' END AS order_flow_signal FROM of5""",
        "of5",
    ),
)
register(
    "bar_deltas",
    lambda spark, d: of.bar_deltas(src.bars(spark, d)).select("ticker", "ts", "age", *r("buy_vol", "sell_vol"), "bull"),
    sql("SELECT * FROM (SELECT ticker, ts, CAST(row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS INT) AS age, round(pos * volume, 6) AS buy_vol, round((1 - pos) * volume, 6) AS sell_vol, close >= open AS bull FROM of1) WHERE age <= 20", "of1"),
)
