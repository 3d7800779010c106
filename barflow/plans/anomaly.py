"""Anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly as an
from ..sources import adapters as src
from .oracle import define, sql
from .registry import register
from .technical import W, guarded

define(
    "an0",
    f"""SELECT *, close / lag(close) {W}) - 1 AS ret, abs((close - lag(close) {W})) / greatest(lag(close) {W}), 1)) AS gap, volume / greatest({guarded('avg(volume)', 'volume', 20)}, 1) AS vr,
    {guarded('avg(high - low)', 'high', 14)} AS typ, volume * 20 / {guarded('sum(volume)', 'volume', 20)} AS vr2, (high - low) * 14 / nullif({guarded('sum(high - low)', 'high', 14)}, 0) AS rr FROM bars""",
    "bars",
)
define("an1", f"SELECT *, (ret - {guarded('avg(ret)', 'ret', 20)}) / greatest({guarded('stddev_samp(ret)', 'ret', 20)}, 0.0001) AS sg FROM an0", "an0")
define(
    "an2",
    """SELECT *, CASE WHEN gap > 0.04 AND vr < 1 THEN 'LOW_VOL_GAP' WHEN vr > 2.5 AND high - low < typ * 0.3 THEN 'ABSORPTION' WHEN abs(sg) > 3.5 THEN 'PRICE_SHOCK' WHEN vr > 5 THEN 'EXTREME_VOLUME' ELSE 'NONE' END AS kind FROM an1""",
    "an1",
)
define(
    "an3",
    """SELECT *, (kind <> 'NONE')::INT AS fl, CASE WHEN coalesce(vr, 1) > 8 OR abs(coalesce(sg, 0)) > 4 THEN 'HIGH' WHEN kind <> 'NONE' OR coalesce(vr, 1) > 3 OR abs(coalesce(sg, 0)) > 2.5 THEN 'MEDIUM' ELSE 'LOW' END AS sev FROM an2""",
    "an2",
)
register(
    "rule_anomaly",
    lambda spark, d: an.rules(src.bars(spark, d)).select("ticker", "ts", "rule_anomaly", "anomaly_type", F.round("volume_spike_ratio", 4).alias("volume_spike_ratio"), F.round("price_sigma", 4).alias("price_sigma")),
    sql("SELECT ticker, ts, fl AS rule_anomaly, kind AS anomaly_type, round(vr, 4) AS volume_spike_ratio, round(sg, 4) AS price_sigma FROM an3", "an3"),
)
register(
    "anomaly_features",
    lambda spark, d: an.features(src.bars(spark, d)).select("ticker", "ts", *[F.round(c, 6).alias(c) for c in an.FEATURES]),
    sql(
        """SELECT ticker, ts, round(ret, 6) AS ret_1d, round(abs(ret), 6) AS ret_abs, round(vr2, 6) AS vol_ratio, round(rr, 6) AS range_ratio, round(abs(close - lag(close) OVER (PARTITION BY ticker ORDER BY ts)) / lag(close) OVER (PARTITION BY ticker ORDER BY ts), 6) AS gap, round(vr2 * abs(ret), 6) AS vol_x_ret FROM an1""",
        "an1",
    ),
)
register(
    "severity_action",
    lambda spark, d: an.severity(an.rules(src.bars(spark, d))).select("ticker", "ts", "is_anomaly", "severity", "recommended_action", "position_size_mult"),
    sql(
        f"""SELECT ticker, ts, fl AS is_anomaly, sev AS severity, CASE WHEN fl = 0 THEN '{an.ACTIONS["NONE"]}' WHEN sev = 'HIGH' THEN '{an.ACTIONS["HIGH"]}' WHEN sev = 'MEDIUM' THEN '{an.ACTIONS["MEDIUM"]}'
    ELSE '{an.ACTIONS["LOW"]}' END AS recommended_action, CASE WHEN fl = 1 AND sev = 'HIGH' THEN 0.5 WHEN fl = 1 THEN 0.75 ELSE 1.0 END::DOUBLE AS position_size_mult FROM an3""",
        "an3",
    ),
)
register("anomaly_score", lambda spark, d: an.outlier_score(src.bars(spark, d)).select("ticker", "ts", F.round("ml_score", 4).alias("ml_score"), "ml_anomaly"))
