"""Time-aware join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as fw
from ..operators import flow as fl
from ..operators import fundamentals as fd
from ..operators import joins as jn
from ..operators import levels as lv
from ..sources import adapters as src
from .levels import near_frame
from .oracle import define, sql
from .registry import register


def _clicks(spark, d):
    e = src.table(spark, d, "events").where(F.col("event_id").isNotNull())
    left = e.where(F.col("event_type") == "purchase").select("event_id", F.col("user_id").alias("ticker"), "ts")
    right = e.where(F.col("event_type") == "view").groupBy(F.col("user_id").alias("ticker"), "ts").agg(F.max("event_id").alias("view_id"))
    return left, right


_CL = """SELECT p.event_id, {pick} AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2) w ON w.user_id = p.user_id AND p.ts {op} w.ts"""
for _k, _f, _op in (("asof_backward", False, ">="), ("asof_forward_events", True, "<=")):
    register(_k, lambda spark, d, f=_f: jn.asof(*_clicks(spark, d), ["view_id"], unit="day", forward=f).select("event_id", "view_id"), sql(_CL.format(pick="w.v", op=_op)))
register(
    "asof_last_n",
    lambda spark, d: jn.asof_day(src.bars(spark, d).select("ticker", "ts"), fl.rolling(src.flows(spark, d)), ["fii_net_5d_cr", "fii_trend"], key=None, right_ts="trade_date"),
    sql("SELECT b.ticker, b.ts, f.fii_net_5d_cr, f.fii_trend FROM bars b ASOF LEFT JOIN fl2 f ON b.ts >= f.trade_date", "bars", "fl2"),
)
define("rcal", "SELECT DISTINCT trade_date AS d FROM flows", "flows")
define("rkey", "SELECT ticker, min(quarter) AS f FROM holding GROUP BY 1", "holding")
register(
    "ffill_reindex",
    lambda spark, d: jn.ffill_reindex(src.shareholding(spark, d).select("ticker", F.date_add("quarter", 2).alias("ts"), "promoter_pct"), src.flows(spark, d).select(F.col("trade_date").alias("ts")), ["promoter_pct"]).where(F.col("promoter_pct").isNotNull()),
    sql("SELECT c.ticker, c.d AS ts, h.promoter_pct FROM (SELECT k.ticker, d FROM rcal JOIN rkey k ON d >= k.f + 2) c ASOF JOIN (SELECT ticker, quarter + 2 AS t, promoter_pct FROM holding WHERE quarter + 2 IN (SELECT d FROM rcal)) h ON h.ticker = c.ticker AND c.d >= h.t", "rcal", "rkey", "holding"),
)
register(
    "anti_existing",
    lambda spark, d: src.table(spark, d, "documents").select("doc_id").join(src.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti"),
    sql("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
)
register(
    "nearest_level",
    lambda spark, d: near_frame(spark, d).select("ticker", F.round("nearest_support", 4).alias("nearest_support"), F.round("nearest_resistance", 4).alias("nearest_resistance")),
    sql("SELECT ticker, round(coalesce(sup[1].p, cur * 0.95), 4) AS nearest_support, round(coalesce(res[1].p, cur * 1.05), 4) AS nearest_resistance FROM lnear2", "lnear2"),
)
register(
    "peer_join",
    lambda spark, d: fd.peer_signal(fd.surprise(src.earnings(spark, d))).select("ticker", "result_date", "peer_beat_ratio"),
    sql("SELECT ticker, result_date, CAST(peer_beat_ratio AS DOUBLE) AS peer_beat_ratio FROM er3", "er3"),
)


def _indexed(spark, d):
    e = src.table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    x = fw.index_rows(e, "user_id", ["ts", "event_id"], F.to_date("ts"))
    return fw.prefix(x, "user_id", {"running": ("sum", F.round(F.col("value") * 100).cast("long")), "peak": ("max", F.col("value"))}, rows=16)


register(
    "running_totals",
    lambda spark, d: _indexed(spark, d).select("event_id", F.col("i").cast("long").alias("i"), "running", "peak"),
    sql("SELECT event_id, row_number() OVER w - 1 AS i, CAST(sum(round(value * 100)) OVER w AS BIGINT) AS running, max(value) OVER w AS peak FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"),
)
