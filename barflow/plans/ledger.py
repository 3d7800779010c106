"""Ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as jn
from ..operators import ledger as lq
from ..operators import macro as mc
from ..operators import technical as ta
from ..sources import adapters as src
from .gates import AS_OF, frame, open_positions
from .oracle import define, sql
from .registry import register

CORE = """count(*) AS n_trades, count(*) FILTER (pnl_points > 0) AS wins, round(count(*) FILTER (pnl_points > 0) / count(*), 4) AS win_rate,
  round(coalesce(CAST(coalesce(sum(pnl_e4) FILTER (pnl_e4 > 0), 0) AS DOUBLE) / -sum(pnl_e4) FILTER (pnl_e4 < 0), 0), 4) AS profit_factor,
  round(coalesce(avg(pnl_points) FILTER (pnl_points > 0) / 100, 0), 6) AS avg_win_pct, round(coalesce(avg(pnl_points) FILTER (pnl_points <= 0) / 100, 0), 6) AS avg_loss_pct, CAST(sum(pnl_e4) AS DOUBLE) / 10000 AS total_pnl"""


def day():
    return F.lit(AS_OF).cast("date")


register("ledger", lambda spark, d: src.ledger(spark, d).drop("value_cents", "pnl_e4", "pnl_points", "trade_no"), sql("SELECT * EXCLUDE (value_cents, pnl_e4, pnl_points, trade_no) FROM ledger", "ledger"))
register("total_pnl", lambda spark, d: lq.total_pnl(src.ledger(spark, d)), sql("SELECT ticker, CAST(sum(pnl_e4) AS DOUBLE) / 10000 AS total_pnl, count(*) AS n_trades FROM ledger GROUP BY 1", "ledger"))
register(
    "monthly_pnl",
    lambda spark, d: lq.monthly_pnl(src.ledger(spark, d)),
    sql("SELECT CAST(date_trunc('month', close_date) AS DATE) AS month, CAST(sum(pnl_e4) AS DOUBLE) / 10000 AS pnl, count(*) AS n_trades, round(CAST(sum(pnl_e4) AS DOUBLE) / 10000 / 1e9, 6) AS drawdown_pct FROM ledger GROUP BY 1", "ledger"),
)
register(
    "perf_by_period",
    lambda spark, d: lq.performance(src.ledger(spark, d), day(), 30, ["ticker"]),
    sql(f"SELECT ticker, {CORE} FROM ledger WHERE close_date BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}' GROUP BY 1", "ledger"),
)
define("lnew", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY close_date DESC, trade_no DESC, signal_uuid DESC) AS age FROM ledger", "ledger")
register(
    "consecutive_losses",
    lambda spark, d: lq.consecutive_losses(src.ledger(spark, d)),
    sql("SELECT ticker, CAST(coalesce(min(age) FILTER (pnl_points > 0), 21) - 1 AS INT) AS consecutive_losses FROM lnew WHERE age <= 20 GROUP BY 1", "lnew"),
)
register("rolling_win_rate", lambda spark, d: lq.rolling_win_rate(src.ledger(spark, d)), sql("SELECT ticker, round(count(*) FILTER (pnl_points > 0) / count(*), 4) AS win_rate FROM lnew WHERE age <= 10 GROUP BY 1", "lnew"))
define("eq0", "SELECT ticker, close_date, 100000.0::DOUBLE + CAST(sum(sum(pnl_e4)) OVER (PARTITION BY ticker ORDER BY close_date) AS DOUBLE) / 10000 AS equity FROM ledger GROUP BY 1, 2", "ledger")
define("eq1", "SELECT *, greatest(100000.0::DOUBLE, max(equity) OVER (PARTITION BY ticker ORDER BY close_date)) AS peak FROM eq0", "eq0")
register("equity_curve", lambda spark, d: lq.equity_curve(src.ledger(spark, d)), sql("SELECT ticker, close_date, equity, peak, round((equity - peak) / peak, 6) AS drawdown FROM eq1", "eq1"))
register(
    "recent_signals",
    lambda spark, d: src.ledger(spark, d).select("signal_uuid", "signal", "confidence", "alignment", "regime", "pnl_pct", "close_date", "trade_no").orderBy(F.desc("close_date"), F.desc("trade_no"), F.desc("signal_uuid")).limit(20).drop("trade_no"),
    sql("SELECT signal_uuid, signal, confidence, alignment, regime, pnl_pct, close_date FROM ledger ORDER BY close_date DESC, trade_no DESC, signal_uuid DESC LIMIT 20", "ledger"),
)
register("open_positions", lambda spark, d: open_positions(spark, d).select("signal_uuid", "ticker", "signal", "category", "opened_at", "value", "risk_amount"), sql("SELECT signal_uuid, ticker, signal, category, opened_at, value, risk_amount FROM openpos", "openpos"))
register(
    "latest_outcome",
    lambda spark, d: lq.newest(src.ledger(spark, d), 1, ["ticker"]).select("ticker", "signal_uuid", "pnl_pct", "exit_reason"),
    sql("SELECT ticker, signal_uuid, pnl_pct, exit_reason FROM lnew WHERE age = 1", "lnew"),
)
register(
    "outcome_by_uuid",
    lambda spark, d: src.ledger(spark, d).where(F.col("signal_uuid") == src.ledger(spark, d).select(F.max("signal_uuid")).scalar()).select("signal_uuid", "ticker", "pnl_pct"),
    sql("SELECT signal_uuid, ticker, pnl_pct FROM ledger WHERE signal_uuid = (SELECT max(signal_uuid) FROM ledger)", "ledger"),
)
for _dim in ("regime", "alignment"):
    register(f"by_{_dim}", lambda spark, d, c=_dim: src.ledger(spark, d).groupBy(c).agg(*lq.core()), sql(f"SELECT {_dim}, {CORE} FROM ledger GROUP BY 1", "ledger"))


def regimes(spark, d):
    from .regime import frame as rframe

    return rframe(spark, d).select("ticker", "ts", "regime")


register("current_regime", lambda spark, d: ta.latest(regimes(spark, d)), sql("SELECT ticker, ts, regime FROM regimes QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1", "regimes"))
register(
    "regime_history",
    lambda spark, d: regimes(spark, d).where((F.col("ts") >= F.date_sub(day(), 10)) & (F.col("ts") <= day())),
    sql(f"SELECT ticker, ts, regime FROM regimes WHERE ts BETWEEN DATE '{AS_OF}' - 10 AND DATE '{AS_OF}'", "regimes"),
)

# Source -> (table, time column, limit hours).
SOURCES = {"orders": ("orders", "o_orderdate", 24), "shipments": ("lineitem", "l_shipdate", 48), "events": ("events", "ts", 1)}


def freshness(spark, d):
    out = None
    for name, (t, c, limit) in SOURCES.items():
        x = src.table(spark, d, t).agg(F.max(c).cast("timestamp_ntz").alias("last_update")).select(F.lit(name).alias("source"), "last_update", F.lit(limit).alias("limit_hours"))
        out = x if out is None else out.unionByName(x)
    return mc.staleness(out, F.lit("2024-01-31 00:00:00").cast("timestamp"))


_FRESH = " UNION ALL ".join(f"SELECT '{n}' AS source, CAST(max({c}) AS TIMESTAMP) AS last_update, {h} AS limit_hours FROM {t}" for n, (t, c, h) in SOURCES.items())
for _k in ("freshness", "staleness"):
    register(_k, freshness, sql(f"SELECT source, last_update, limit_hours, round(floor(epoch(TIMESTAMP '2024-01-31') - epoch(last_update)) / 3600, 1) AS hours_ago, round(floor(epoch(TIMESTAMP '2024-01-31') - epoch(last_update)) / 3600, 1) > limit_hours AS stale FROM ({_FRESH})"))
register(
    "table_counts",
    lambda spark, d: _counts(spark, d),
    sql(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in ("orders", "lineitem", "customer", "events", "documents"))),
)


def _counts(spark, d):
    out = None
    for t in ("orders", "lineitem", "customer", "events", "documents"):
        x = src.table(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("name"), "n_rows")
        out = x if out is None else out.unionByName(x)
    return out


def trades_view(spark, d):
    """Open positions marked at the last close on or before the as-of date, 2 % stop and 5 % target."""
    last = ta.latest(src.bars(spark, d).where(F.col("ts") <= day()).select("ticker", "ts", "close")).select("ticker", (F.col("close") / 1000).alias("last"))
    x = open_positions(spark, d).join(last, "ticker")
    sign = F.when(F.col("signal") == "LONG", 1).otherwise(-1)
    un = sign * (F.col("last") - 1)
    return x.select(
        "signal_uuid", "ticker", "signal", F.round(un, 6).alias("unrealised_pct"), F.round(un + 0.02, 6).alias("to_stop"), F.round(0.05 - un, 6).alias("to_target"), F.round(F.least(F.greatest((un + 0.02) / 0.07, F.lit(0.0)), F.lit(1.0)), 6).alias("progress"),
        F.datediff(day(), "opened_at").alias("days_open"), F.datediff("close_date", day()).alias("days_left"),
    )


register(
    "trades_view",
    trades_view,
    sql(
        f"""SELECT signal_uuid, ticker, signal, round(un, 6) AS unrealised_pct, round(un + 0.02, 6) AS to_stop, round(0.05 - un, 6) AS to_target, round(least(1, greatest(0, (un + 0.02) / 0.07)), 6) AS progress,
    CAST(DATE '{AS_OF}' - opened_at AS INT) AS days_open, CAST(close_date - DATE '{AS_OF}' AS INT) AS days_left FROM (SELECT p.*, CASE WHEN signal = 'LONG' THEN 1 ELSE -1 END * (c - 1) AS un FROM openpos p JOIN (
    SELECT ticker, arg_max(close, ts) / 1000 AS c FROM bars WHERE ts <= DATE '{AS_OF}' GROUP BY 1) USING (ticker))""",
        "openpos", "bars",
    ),
)
register(
    "live_panels",
    lambda spark, d: ta.price_metadata(src.bars(spark, d)).select("ticker", F.round("change_pct", 4).alias("change_pct"), F.rank().over(lq.W.partitionBy(F.lit(0)).orderBy(F.desc(F.round("change_pct", 4)))).alias("change_rank")),
    sql("SELECT ticker, round(ch, 4) AS change_pct, CAST(rank() OVER (ORDER BY round(ch, 4) DESC) AS INT) AS change_rank FROM pmeta", "pmeta"),
)
define("pm0", "SELECT *, lag(close) OVER t AS pc, volume / avg(volume) OVER (PARTITION BY ticker ORDER BY ts ROWS 9 PRECEDING) AS vr, max(high) OVER (PARTITION BY ticker ORDER BY ts ROWS 251 PRECEDING) AS h52, min(low) OVER (PARTITION BY ticker ORDER BY ts ROWS 251 PRECEDING) AS l52 FROM bars WINDOW t AS (PARTITION BY ticker ORDER BY ts)", "bars")
define("pmeta", "SELECT *, (close - pc) / pc * 100 AS ch FROM pm0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1", "pm0")
register(
    "price_metadata",
    lambda spark, d: ta.price_metadata(src.bars(spark, d)).select("ticker", "ts", "close", "prev_close", F.round("change_pct", 4).alias("change_pct"), F.round("vol_ratio", 4).alias("vol_ratio"), "high_52w", "low_52w"),
    sql("SELECT ticker, ts, close, pc AS prev_close, round(ch, 4) AS change_pct, round(vr, 4) AS vol_ratio, h52 AS high_52w, l52 AS low_52w FROM pmeta", "pmeta"),
)
register(
    "sharpe_simple",
    lambda spark, d: lq.sharpe_simple(src.ledger(spark, d), ["ticker"]),
    sql("SELECT ticker, CASE WHEN count(*) >= 3 AND stddev_pop(pnl_points) > 0 THEN round(avg(pnl_points) / stddev_pop(pnl_points) * sqrt(252), 4) ELSE 0 END AS sharpe FROM ledger GROUP BY 1", "ledger"),
)
# Lineage: outcomes are the ledger's own rows, snapshots the bars they were opened on.
register(
    "lineage_join",
    lambda spark, d: _lineage(spark, d),
    sql("SELECT signal_uuid, ticker, confidence, exit_reason, pnl_pct, CASE WHEN pnl_pct > 0.002 THEN 'WIN' WHEN pnl_pct < -0.002 THEN 'LOSS' ELSE 'BREAKEVEN' END AS outcome FROM ledger QUALIFY row_number() OVER (PARTITION BY signal_uuid ORDER BY close_date DESC) = 1", "ledger"),
)


def _lineage(spark, d):
    led = jn.keep_last(src.ledger(spark, d), ["signal_uuid"], ["close_date"])
    outcome = F.when(F.col("pnl_pct") > 0.002, "WIN").when(F.col("pnl_pct") < -0.002, "LOSS").otherwise("BREAKEVEN")
    return jn.lineage(led.select("signal_uuid", "ticker"), led.select("signal_uuid", "confidence"), led.select("signal_uuid", "close_date", "exit_reason", "pnl_pct"), led.select("signal_uuid", outcome.alias("outcome"))).drop("close_date")


register(
    "left_join_open_closed",
    lambda spark, d: src.ledger(spark, d).select("signal_uuid", "pnl_pct").join(open_positions(spark, d).select("signal_uuid", "value"), "signal_uuid", "left").groupBy(F.col("value").isNotNull().alias("still_open")).agg(F.count(F.lit(1)).alias("n")),
    sql("SELECT o.value IS NOT NULL AS still_open, count(*) AS n FROM ledger l LEFT JOIN openpos o ON o.signal_uuid = l.signal_uuid GROUP BY 1", "ledger", "openpos"),
)
