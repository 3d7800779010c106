"""Streaming queries: the events table (or documents) as a file stream, drained once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as sg
from ..sources import adapters as src
from ..streaming import jobs
from .oracle import define, sql
from .registry import register


def events(spark, d):
    return jobs.source(spark, d, "events", src.table(spark, d, "events").schema)


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def ticks(spark, d):
    return events(spark, d).select("event_id", F.col("event_type").alias("ticker"), "ts", (F.lit(200000) + F.round(F.col("value") * 100)).cast("long").alias("milli"))


register(
    "stream_bars",
    lambda spark, d: ntz(jobs.drain(jobs.tick_bars(ticks(spark, d))), "ts"),
    sql("SELECT * FROM bars_intraday WHERE ts + INTERVAL 30 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES", "bars_intraday"),
)
register(
    "stream_dedupe",
    lambda spark, d: jobs.drain(jobs.dedupe(events(spark, d).select("event_id", "ts"), ["event_id"], delay="3650 days")).select("event_id"),
    sql("SELECT DISTINCT event_id FROM events"),
)
register(
    "stream_late_drop",
    lambda spark, d: jobs.drain(jobs.late_drop(events(spark, d).select("event_id", F.col("ts").alias("published"), (F.col("ts") + F.make_dt_interval(days=F.pmod("event_id", F.lit(10)).cast("int"))).alias("arrived")), "published", "arrived")).select("event_id"),
    sql("SELECT event_id FROM events WHERE event_id % 10 <= 7"),
)


def _scored(spark, d, apart: int = 1):
    """Articles ``apart`` minutes from each other."""
    docs = jobs.source(spark, d, "documents", src.table(spark, d, "documents").schema)
    return docs.select(F.col("source").alias("ticker"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60 * apart).alias("created_at"), (F.pmod(F.col("n_chars"), F.lit(21)) - 10).alias("tenths"))


def _window_sql(hours: int) -> str:
    return f"""SELECT ticker, t AS ts, count(*) AS count, round(avg(tenths) / 10, 4) AS score, count(*) FILTER (tenths > 2) AS positive, count(*) FILTER (tenths < -2) AS negative FROM (SELECT source AS ticker, n_chars % 21 - 10 AS tenths,
    date_trunc('hour', TIMESTAMP '2024-01-01' + to_minutes(doc_id * {hours // 4})) + to_hours(k) AS t, (SELECT max(doc_id) * {hours // 4} FROM documents) AS mx FROM documents, range(1, {hours + 1}) r(k)) WHERE t <= TIMESTAMP '2024-01-01' + to_minutes(mx) - INTERVAL 1 HOUR GROUP BY 1, 2"""


for _key, _hours in (("stream_sentiment_24h", 24), ("stream_sentiment_72h", 72)):
    register(_key, lambda spark, d, h=_hours: ntz(jobs.drain(jobs.sentiment(_scored(spark, d, h // 4), length=f"{h} hours")), "ts"), sql(_window_sql(_hours)))
register(
    "stream_sentiment",
    lambda spark, d: ntz(jobs.drain_to_end(_scored(spark, d), jobs.sentiment, ts="created_at"), "ts"),
    sql("""SELECT ticker, t AS ts, count(*) AS count, round(avg(tenths) / 10, 4) AS score, count(*) FILTER (tenths > 2) AS positive, count(*) FILTER (tenths < -2) AS negative FROM (SELECT source AS ticker, n_chars % 21 - 10 AS tenths,
    date_trunc('hour', TIMESTAMP '2024-01-01' + to_minutes(doc_id)) + to_hours(k) AS t FROM documents, range(1, 25) r(k)) WHERE t IS NOT NULL GROUP BY 1, 2"""),
)
YEAR = 366 * 86_400
#: A live rule answers for a row once the watermark has passed it.
define("passed", "SELECT event_id, ts AS event_ts FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES")
KINDS = ("BULL_TRENDING", "BEAR_TRENDING", "HIGH_VOLATILITY", "CHOPPY_SIDEWAYS")


def _regimes(stream):
    """A regime reading per event from its value's integer part."""
    k = (F.floor(F.col("value")).cast("int") % 4 + 1).cast("int")
    return stream.select("user_id", "ts", "event_id", F.element_at(F.array(*[F.lit(r) for r in KINDS]), k).alias("regime"))


define("sre0", f"SELECT user_id, event_id, {list(KINDS)}[CAST(floor(value) AS INT) % 4 + 1] AS regime, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
define("sre1", "SELECT *, lag(regime) OVER w AS l1, lag(regime, 2) OVER w AS l2 FROM sre0 WINDOW w AS (PARTITION BY user_id ORDER BY n)", "sre0")
define(
    "sre_rec",
    """SELECT user_id, n, event_id, regime, regime AS c FROM sre1 WHERE n = 1 UNION ALL SELECT b.user_id, b.n, b.event_id, b.regime, CASE WHEN b.regime = p.c OR b.regime = 'HIGH_VOLATILITY' OR (b.regime = b.l1 AND b.regime = b.l2) THEN b.regime ELSE p.c END
  FROM sre_rec p JOIN sre1 b ON b.user_id = p.user_id AND b.n = p.n + 1""",
    "sre1",
)
register(
    "stream_regime_state",
    lambda spark, d: jobs.drain_to_end(_regimes(events(spark, d)), lambda x: jobs.regime_state(x, key="user_id", order=("ts", "event_id"), idle=YEAR)).select("event_id", "regime", "committed_regime", "held"),
    sql("SELECT event_id, regime, c AS committed_regime, (c <> regime)::INT AS held FROM sre_rec", "sre_rec"),
)


def _cycles(spark, d):
    """The cycle adapter over the event stream, keyed by user and event type."""
    e = events(spark, d)
    k = F.get_json_object("props", "$.k").try_cast("long")
    a, b, s = F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(97)) + 1, F.pmod(F.coalesce(k, F.lit(0)), F.lit(31)) + 1, F.pmod(F.col("event_id") * 7, F.lit(89)) + 1
    t = a + b + s
    x = e.select("event_id", "ts", F.concat_ws("/", "user_id", "event_type").alias("skey"), F.when(F.col("event_type").isin("purchase", "error"), 1).otherwise(2).alias("confirm"),
                 F.round(a / t, 6).alias("prob_long"), F.round(b / t, 6).alias("prob_flat"), F.round(s / t, 6).alias("prob_short"))
    return sg.decisive(x).withColumn("confidence", F.round(F.greatest("prob_long", "prob_flat", "prob_short"), 6))


register("stream_stabiliser", lambda spark, d: jobs.drain_to_end(_cycles(spark, d), lambda x: jobs.stabiliser(x, idle=YEAR)).select("event_id", "decisive", "committed"), sql("SELECT event_id, dec AS decisive, com AS committed FROM st_rec", "st_rec"))
register("stream_alert_dedup", lambda spark, d: jobs.drain_to_end(_cycles(spark, d), lambda x: jobs.alert_dedup(x, idle=YEAR)).select("event_id", "sent"), sql("SELECT event_id, sent FROM sd_rec", "sd_rec"))
register("stream_cooldown", lambda spark, d: jobs.drain_to_end(events(spark, d).select(F.col("user_id").alias("skey"), "ts", "event_id"), jobs.cooldown).select("event_id", "emitted"), sql("SELECT event_id, emitted FROM cd_rec", "cd_rec"))
register(
    "stream_static_enrich",
    lambda spark, d: jobs.drain(jobs.static_enrich(events(spark, d).select("event_id", F.col("user_id").alias("c_custkey")), src.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")).select("event_id", "c_mktsegment"),
    sql("SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey"),
)


def _watch(spark, d):
    """Every user's events as price ticks of one position: entry 220, stop 205, target 236."""
    return events(spark, d).select(F.col("user_id").alias("position_id"), "ts", "event_id", (200 + F.col("value") / 10).alias("price"), F.lit(200.5).alias("stop"), F.lit(228.0).alias("target"))


register(
    "stream_exit_monitor",
    lambda spark, d: jobs.drain(jobs.exit_monitor(_watch(spark, d), trail=0.05)).where(F.col("exit_reason") != "").select("position_id", "event_id", F.round("high_water", 4).alias("high_water"), "exit_reason"),
    sql("""SELECT position_id, event_id, round(hw, 4) AS high_water, r AS exit_reason FROM (SELECT *, CASE WHEN px <= 200.5 THEN 'STOP_LOSS' WHEN px >= 228 THEN 'TARGET' WHEN px <= hw * 0.95 THEN 'TRAILING_STOP' END AS r FROM (
    SELECT user_id AS position_id, event_id, ts, 200 + value / 10 AS px, max(200 + value / 10) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hw FROM events JOIN passed USING (event_id))) WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY position_id ORDER BY ts, event_id) = 1""", "passed"),
)
register(
    "stream_latest_sink",
    lambda spark, d: jobs.latest_sink(events(spark, d).select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]),
    sql("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
)
