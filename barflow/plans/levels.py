"""Support/resistance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import levels as lv
from ..sources import adapters as src
from .oracle import define, sql
from .registry import query, register
from .technical import W, guarded, pivot_sql

define("lb", "SELECT * EXCLUDE (age) FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS age FROM bars) WHERE age <= 252", "bars")
define(
    "lsnap0",
    f"""SELECT *, greatest(high - low, abs(high - lag(close) {W})), abs(low - lag(close) {W}))) AS tr, {guarded('avg(volume)', 'volume', 10)} AS v10, min(low) OVER (PARTITION BY ticker) AS fl,
    max(high) OVER (PARTITION BY ticker) AS fh, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM lb""",
    "lb",
)
define("lsnap", f"SELECT ticker, ts, close AS cur, volume, v10, atr / close AS atr_pct, fl, fh, n FROM (SELECT *, {guarded('avg(tr)', 'tr', 14)} AS atr FROM lsnap0) WHERE back = 1", "lsnap0")
define("lpiv", f"SELECT ticker, {pivot_sql('high', 8, True, False)} AS ph, {pivot_sql('low', 8, False, False)} AS pl FROM lb", "lb")
define(
    "lswing",
    """SELECT p.ticker, p.ph AS price, 'RESISTANCE' AS type, 'swing_high' AS method, least(count(*), 5) AS strength FROM (SELECT *, row_number() OVER () AS id FROM lpiv WHERE ph IS NOT NULL) p
    JOIN lb b ON b.ticker = p.ticker AND abs(b.high - p.ph) / p.ph < 0.005 GROUP BY p.id, p.ticker, p.ph
  UNION ALL SELECT p.ticker, p.pl, 'SUPPORT', 'swing_low', least(count(*), 5) FROM (SELECT *, row_number() OVER () AS id FROM lpiv WHERE pl IS NOT NULL) p
    JOIN lb b ON b.ticker = p.ticker AND abs(b.low - p.pl) / p.pl < 0.005 GROUP BY p.id, p.ticker, p.pl""",
    "lpiv", "lb",
)
define(
    "lround",
    """SELECT ticker, CAST(price AS DOUBLE) AS price, CASE WHEN price > cur THEN 'RESISTANCE' ELSE 'SUPPORT' END AS type, 'round_number' AS method, CASE WHEN step = 100 THEN 3 ELSE 2 END AS strength
  FROM (SELECT ticker, cur, step, round_even(cur / step, 0) * step + k * step AS price FROM lsnap, (VALUES (50), (100)) s(step), range(-8, 9) r(k)) WHERE price > 0 AND abs(price - cur) / cur <= 0.15""",
    "lsnap",
)
define(
    "lhist",
    """SELECT b.ticker, cur, fl, (fh - fl) / 25 AS size, least(greatest(CAST(floor((b.close - fl) / ((fh - fl) / 25 + 1e-8)) AS INT), 0), 24) AS bucket, sum(b.volume) AS vol
  FROM lb b JOIN lsnap s ON s.ticker = b.ticker WHERE fh > fl AND n >= 20 GROUP BY ALL""",
    "lb", "lsnap",
)
define(
    "lvol",
    """SELECT ticker, round(fl + (bucket + 0.5) * size, 2) AS price, CASE WHEN round(fl + (bucket + 0.5) * size, 2) > cur THEN 'RESISTANCE' ELSE 'SUPPORT' END AS type, 'volume_node' AS method, 4 AS strength
  FROM (SELECT *, quantile_cont(vol, 0.8) OVER (PARTITION BY ticker) AS cut FROM lhist) WHERE vol >= cut""",
    "lhist",
)
define(
    "loi0",
    """SELECT ticker, first(strike ORDER BY ce_oi DESC, strike) FILTER (ce_oi > 0) AS mc, first(strike ORDER BY pe_oi DESC, strike) FILTER (pe_oi > 0) AS mp FROM chain c
  WHERE fetched_at = (SELECT max(fetched_at) FROM chain x WHERE x.ticker = c.ticker) GROUP BY ticker""",
    "chain",
)
define("loi", "SELECT ticker, 900.0::DOUBLE + 8 * mc AS price, 'RESISTANCE' AS type, 'options_oi' AS method, 4 AS strength FROM loi0 WHERE mc IS NOT NULL UNION ALL SELECT ticker, 900.0::DOUBLE + 8 * mp, 'SUPPORT', 'options_oi', 4 FROM loi0 WHERE mp IS NOT NULL", "loi0")
define("lall", "SELECT * FROM lswing UNION ALL SELECT * FROM lround UNION ALL SELECT * FROM lvol UNION ALL SELECT * FROM loi", "lswing", "lround", "lvol", "loi")
define(
    "lclu",
    """SELECT ticker, cluster, avg(price) AS price, CAST(least(sum(strength), 8) AS INT) AS strength, CASE WHEN count(*) FILTER (type = 'RESISTANCE') >= count(*) FILTER (type = 'SUPPORT') THEN 'RESISTANCE' ELSE 'SUPPORT' END AS type,
    array_to_string(list_sort(list(DISTINCT method)), '+') AS method, count(*) AS touches
  FROM (SELECT *, CAST(sum(nw) OVER (PARTITION BY ticker ORDER BY price, type, method ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM (
    SELECT *, CASE WHEN abs(price - lag(price) OVER w) / greatest(lag(price) OVER w, 1) <= 0.005 THEN 0 ELSE 1 END AS nw FROM lall WINDOW w AS (PARTITION BY ticker ORDER BY price, type, method))) GROUP BY ticker, cluster""",
    "lall",
)
define(
    "lnear",
    """SELECT s.*, list_reverse_sort(list({'p': price, 's': strength}) FILTER (price < cur)) AS sup, list_sort(list({'p': price, 's': strength}) FILTER (price > cur)) AS res,
    min((price - cur) / cur) FILTER (price > cur AND strength >= 6) AS wu, min((cur - price) / cur) FILTER (price < cur AND strength >= 6) AS wd FROM lsnap s LEFT JOIN lclu c ON c.ticker = s.ticker GROUP BY ALL""",
    "lsnap", "lclu",
)
define(
    "lnear2",
    """SELECT *, coalesce(abs(cur - sup[1].p) / greatest(sup[1].p, 1), 0.05) AS sd, coalesce(abs(res[1].p - cur) / greatest(cur, 1), 0.05) AS rd,
    least(5 * atr_pct, coalesce(wu, 99)) / greatest(2 * atr_pct, 1e-9) AS ru, least(5 * atr_pct, coalesce(wd, 99)) / greatest(2 * atr_pct, 1e-9) AS rdn FROM lnear""",
    "lnear",
)


def max_oi(spark, d):
    from ..operators import options

    latest = options.latest_snapshot(src.chain(spark, d))
    top = options.max_oi_strikes(latest)
    return top.select("ticker", *[F.when(F.col(c) > 0, 900.0 + 8 * F.col(c)).otherwise(0.0).alias(c) for c in ("max_call_oi_strike", "max_put_oi_strike")])


def near_frame(spark, d):
    b = src.bars(spark, d)
    return lv.nearest(lv.snapshot(b), lv.all_levels(b, max_oi(spark, d)))


LV = ("ticker", "price", "type", "method", "strength")
register("swing_levels", lambda spark, d: lv.swing(src.bars(spark, d)).select(*LV), sql("SELECT ticker, price, type, method, CAST(strength AS INT) AS strength FROM lswing", "lswing"))
register("round_levels", lambda spark, d: lv.round_numbers(lv.snapshot(src.bars(spark, d))).select(*LV), sql("SELECT * FROM lround", "lround"))
register("volume_nodes", lambda spark, d: lv.volume_nodes(src.bars(spark, d)).select(*LV), sql("SELECT * FROM lvol", "lvol"))
register("oi_levels", lambda spark, d: lv.oi_levels(max_oi(spark, d)).select(*LV), sql("SELECT * FROM loi", "loi"))
register(
    "cluster_levels",
    lambda spark, d: lv.all_levels(src.bars(spark, d), max_oi(spark, d)).select("ticker", "cluster", F.round("price", 4).alias("price"), "strength", "type", "method", "touches"),
    sql("SELECT ticker, cluster, round(price, 4) AS price, strength, type, method, touches FROM lclu", "lclu"),
)
register(
    "nearest_levels",
    lambda spark, d: near_frame(spark, d).select(
        "ticker", "ts", *[F.round(c, 4).alias(c) for c in ("nearest_support", "nearest_resistance", "second_support", "second_resistance", "support_distance_pct", "resistance_distance_pct")],
        "support_strength", "resistance_strength", "near_support", "near_resistance"),
    sql(
        """SELECT ticker, ts, round(coalesce(sup[1].p, cur * 0.95), 4) AS nearest_support, round(coalesce(res[1].p, cur * 1.05), 4) AS nearest_resistance, round(coalesce(sup[2].p, cur * 0.9), 4) AS second_support,
    round(coalesce(res[2].p, cur * 1.1), 4) AS second_resistance, round(sd * 100, 4) AS support_distance_pct, round(rd * 100, 4) AS resistance_distance_pct, coalesce(sup[1].s, 1) AS support_strength,
    coalesce(res[1].s, 1) AS resistance_strength, (sd < 0.012)::INT AS near_support, (rd < 0.012)::INT AS near_resistance FROM lnear2""",
        "lnear2",
    ),
)


def _grade(c: str) -> str:
    return f"CASE WHEN coalesce(atr_pct, 0) <= 0 THEN 'C' WHEN {c} >= 2 THEN 'A' WHEN {c} >= 1.5 THEN 'B' WHEN {c} >= 1 THEN 'C' ELSE 'D' END"


register(
    "runway_grade",
    lambda spark, d: near_frame(spark, d).select("ticker", "entry_quality", "entry_quality_short", "entry_quality_score", "reward_risk_sr", F.round("atr_pct", 6).alias("atr_pct")),
    sql(
        f"""SELECT *, CASE entry_quality WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.6 WHEN 'C' THEN 0.2 ELSE -0.2 END::DOUBLE AS entry_quality_score, 2.5::DOUBLE AS reward_risk_sr FROM (
    SELECT ticker, {_grade('ru')} AS entry_quality, {_grade('rdn')} AS entry_quality_short, round(atr_pct, 6) AS atr_pct FROM lnear2)""",
        "lnear2",
    ),
)
register(
    "near_breakout",
    lambda spark, d: near_frame(spark, d).select("ticker", "near_breakout"),
    sql("SELECT ticker, coalesce((rd < 0.005 AND volume > v10 * 1.5)::INT, 0) AS near_breakout FROM lnear2", "lnear2"),
)
