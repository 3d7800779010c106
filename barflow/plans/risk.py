"""Sizing, exposure, breaker and risk-context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as sg
from ..operators import ledger as lq
from ..operators import risk as rk
from ..operators import technical as ta
from ..sources import adapters as src
from .gates import AS_OF, model_probs, open_positions
from .macro import glob
from .oracle import define, sql
from .registry import register

_MODE = "CASE WHEN {0} < 50000 THEN 'SMALL' WHEN {0} < 200000 THEN 'GROWING' ELSE 'FULL' END"
register(
    "capital_mode",
    lambda spark, d: src.table(spark, d, "customer").select("c_custkey", rk.capital_mode(F.col("c_acctbal") * 30).alias("capital_mode")).select("c_custkey", "capital_mode", rk.mode_value("max_risk_pct").alias("max_risk_pct"), rk.mode_value("max_positions").alias("max_positions")),
    sql(f"SELECT c_custkey, m AS capital_mode, CASE m WHEN 'SMALL' THEN 0.01 WHEN 'GROWING' THEN 0.015 ELSE 0.02 END::DOUBLE AS max_risk_pct, CASE m WHEN 'SMALL' THEN 2 WHEN 'GROWING' THEN 3 ELSE 5 END AS max_positions FROM (SELECT *, {_MODE.format('c_acctbal * 30')} AS m FROM customer)"),
)


def sizing_rows(spark, d):
    """Bars with a directional swing vote; multiplier, drawdown, mode and category from the bar's integers."""
    v, h = F.col("volume").cast("long"), F.col("high").cast("long")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    x = model_probs(ta.trend(src.bars(spark, d))).where(F.col("swing") != "FLAT")
    return x.select(
        "ticker", "ts", F.col("swing").alias("direction"), F.lit(100000.0).alias("capital"), F.col("close").alias("current_price"), F.col("atr_14").alias("atr"), (v % 5 / 4).alias("size_mult"),
        pick(("SMALL", "GROWING", "FULL"), v % 3).alias("capital_mode"), pick(("swing", "intraday", "positional"), h % 3).alias("category"), (-(v % 9) / 100).alias("monthly_dd_pct"), F.lit(1.0).alias("event_mult"),
    )


define(
    "sz0",
    """SELECT t.ticker, t.ts, CASE WHEN a > b AND a >= s THEN 'LONG' ELSE 'SHORT' END AS direction, t.close AS px, t.atr_14 AS atr, v % 5 / 4 AS sm, ['SMALL', 'GROWING', 'FULL'][v % 3 + 1] AS mode, ['swing', 'intraday', 'positional'][CAST(t.high AS BIGINT) % 3 + 1] AS cat, -(v % 9) / 100 AS dd
  FROM (SELECT *, CAST(volume AS BIGINT) AS v, (CAST(close AS BIGINT) * 7 + CAST(volume AS BIGINT) * 3) % 97 + 1 AS a, (CAST(high AS BIGINT) * 5 + CAST(volume AS BIGINT)) % 31 + 1 AS b, (CAST(low AS BIGINT) * 11 + CAST(close AS BIGINT)) % 89 + 1 AS s FROM tech_trend) t
  WHERE (a > b AND a >= s) OR (s > b AND s > a)""",
    "tech_trend",
)
define(
    "sz1",
    """SELECT *, round(100000 * CASE mode WHEN 'SMALL' THEN 0.01 WHEN 'GROWING' THEN 0.015 ELSE 0.02 END::DOUBLE * (least(1.5, sm) * CASE WHEN dd <= -0.06 THEN 0.25 WHEN dd <= -0.04 THEN 0.5 WHEN dd <= -0.02 THEN 0.75 ELSE 1 END::DOUBLE), 2) AS risk,
    round(atr * CASE cat WHEN 'intraday' THEN 1 WHEN 'swing' THEN 2 ELSE 2.5 END::DOUBLE, 2) AS sd, round(atr * CASE cat WHEN 'intraday' THEN 2.5 WHEN 'swing' THEN 5 ELSE 6.5 END::DOUBLE, 2) AS td FROM sz0""",
    "sz0",
)
define("sz2", "SELECT *, CASE WHEN px > 0 AND atr > 0 AND risk > 0 AND sd > 0 THEN CASE WHEN greatest(1, floor(risk / sd)) * px > 40000 THEN greatest(1, floor(40000 / px)) ELSE greatest(1, floor(risk / sd)) END ELSE 0 END AS sh FROM sz1", "sz1")
register(
    "position_size",
    lambda spark, d: rk.position_size(sizing_rows(spark, d)).select("ticker", "ts", "direction", "shares", "stop_loss", "target", "position_value", "risk_amount"),
    sql(
        """SELECT ticker, ts, direction, CAST(sh AS BIGINT) AS shares, CASE WHEN sh > 0 THEN round(px - CASE direction WHEN 'LONG' THEN 1 ELSE -1 END * sd, 2) ELSE 0 END AS stop_loss, CASE WHEN sh > 0 THEN round(px + CASE direction WHEN 'LONG' THEN 1 ELSE -1 END * td, 2) ELSE 0 END AS target,
    round(sh * px, 2) AS position_value, CASE WHEN sh > 0 THEN round(sh * sd, 2) ELSE 0 END AS risk_amount FROM sz2""",
        "sz2",
    ),
)
CAPITAL = 25_000_000.0


def proposals(spark, d):
    x = ta.latest(model_probs(src.bars(spark, d)).where(F.col("ts") <= AS_OF).select("ticker", "ts", "swing"))
    return x.select("ticker", F.when(F.col("swing") == "SHORT", "SHORT").otherwise("LONG").alias("direction"), F.lit(1000000.0).alias("position_value"), F.lit(CAPITAL).alias("capital"), F.lit("FULL").alias("capital_mode"))


define("prop", f"SELECT ticker, CASE WHEN s > b AND s > a THEN 'SHORT' ELSE 'LONG' END AS direction FROM be0 WHERE ts <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1", "be0")
define(
    "expo",
    f"""SELECT p.ticker, direction, (SELECT coalesce(sum(value), 0) FROM openpos o WHERE o.ticker = p.ticker) AS nm, (SELECT coalesce(sum(value), 0) FROM openpos) AS al, (SELECT count(DISTINCT ticker) FROM openpos o WHERE o.signal = p.direction AND o.ticker <> p.ticker) + 1 AS cl,
    (SELECT coalesce(sum(CASE WHEN signal = 'LONG' THEN value ELSE -value END), 0) FROM openpos) + CASE WHEN direction = 'LONG' THEN 1000000 ELSE -1000000 END AS net FROM prop p""",
    "prop", "openpos",
)
_ER = f"CASE WHEN nm + 1000000 > {CAPITAL * 0.4} THEN 'name_cap' WHEN al + 1000000 > {CAPITAL * 0.8} THEN 'total_cap' WHEN cl > 3 THEN 'cluster_cap' WHEN abs(net) > {CAPITAL * 0.6} THEN 'net_cap' END"
register(
    "exposure_caps",
    lambda spark, d: rk.exposure(proposals(spark, d), open_positions(spark, d)).select("ticker", "direction", F.round("ticker_exposure", 2).alias("ticker_exposure"), F.round("total_exposure", 2).alias("total_exposure"), "exposure_reason", "exposure_allowed"),
    sql(f"SELECT ticker, direction, round(nm, 2) AS ticker_exposure, round(al, 2) AS total_exposure, {_ER} AS exposure_reason, {_ER} IS NULL AS exposure_allowed FROM expo", "expo"),
)
register(
    "net_exposure_cluster",
    lambda spark, d: rk.exposure(proposals(spark, d), open_positions(spark, d)).select("ticker", "direction", F.col("cluster").cast("long").alias("cluster"), F.round("net_pct", 6).alias("net_pct")),
    sql(f"SELECT ticker, direction, cl AS cluster, round(net / {CAPITAL}, 6) AS net_pct FROM expo", "expo"),
)


def admission_rows(spark, d):
    """Directional votes of the three models per bar, each proposing 10 to 50 thousand."""
    x = model_probs(src.bars(spark, d))
    one = lambda c: F.struct(F.lit(c).alias("category"), F.col(c).alias("direction"), F.greatest(f"{c}_long", f"{c}_flat", f"{c}_short").alias("confidence"))
    x = x.select("ticker", "ts", ((F.col("volume").cast("long") % 5 + 1) * 10000.0).alias("position_value"), F.explode(F.array(*[one(c) for c in ("swing", "positional", "intraday")])).alias("z"))
    return x.select("ticker", "ts", "position_value", "z.*").where(F.col("direction") != "FLAT")


# Sequential with a five-part state per step: checked against brute force in the tests.
register("admission", lambda spark, d: rk.admission(admission_rows(spark, d)))
register(
    "costs",
    lambda spark, d: rk.costs(src.ledger(spark, d).withColumn("position_value", F.col("value_cents") / 100)).select("signal_uuid", "cost_amount", "net_pnl_pct"),
    sql("SELECT signal_uuid, round(value_cents / 100 * 0.002, 4) AS cost_amount, round(pnl_pct - 0.002, 6) AS net_pnl_pct FROM ledger", "ledger"),
)


def breaker_rows(spark, d):
    """Per (ticker, month): P&L over 100k, losses as the streak, severity and accuracy from the counts."""
    x = src.ledger(spark, d).groupBy("ticker", F.trunc("close_date", "month").alias("month")).agg(F.sum("pnl_e4").alias("p"), F.count_if(F.col("pnl_points") <= 0).alias("l"), F.count(F.lit(1)).alias("n"))
    return x.select(
        "ticker", "month", (F.col("p") / 10000 / 1e6).alias("monthly_dd_pct"), (F.col("l") % 7).cast("int").alias("consecutive_losses"), F.when(F.col("n") % 11 == 0, "HIGH").otherwise("LOW").alias("severity"),
        F.lit(0.55).alias("model_accuracy_10"), F.when(F.col("n") % 3 == 0, "SMALL").when(F.col("n") % 3 == 1, "GROWING").otherwise("FULL").alias("capital_mode"),
    )


define(
    "brk",
    """SELECT *, CASE WHEN dd >= CASE m WHEN 'SMALL' THEN 0.08 WHEN 'GROWING' THEN 0.12 ELSE 0.15 END OR l % 7 >= 5 THEN 'HALT' WHEN dd >= CASE m WHEN 'SMALL' THEN 0.05 WHEN 'GROWING' THEN 0.08 ELSE 0.1 END OR l % 7 >= 3 OR n % 11 = 0 THEN 'PAUSE'
    WHEN dd >= CASE m WHEN 'SMALL' THEN 0.02 WHEN 'GROWING' THEN 0.03 ELSE 0.04 END THEN 'WARN' ELSE 'OK' END AS lv FROM (SELECT ticker, CAST(date_trunc('month', close_date) AS DATE) AS month, greatest(0, -CAST(sum(pnl_e4) AS DOUBLE) / 10000 / 1e6) AS dd,
      count(*) FILTER (pnl_points <= 0) AS l, count(*) AS n, ['SMALL', 'GROWING', 'FULL'][count(*) % 3 + 1] AS m FROM ledger GROUP BY 1, 2)""",
    "ledger",
)
register(
    "breaker_level",
    lambda spark, d: rk.breaker(breaker_rows(spark, d)).select("ticker", "month", "breaker_level", "breaker_size_mult", "breaker_allows"),
    sql("SELECT ticker, month, lv AS breaker_level, CASE lv WHEN 'OK' THEN 1 WHEN 'WARN' THEN 0.75 ELSE 0 END::DOUBLE AS breaker_size_mult, lv IN ('OK', 'WARN') AS breaker_allows FROM brk", "brk"),
)
register(
    "sink_on_change",
    lambda spark, d: rk.on_change(rk.breaker(breaker_rows(spark, d)).select("ticker", "month", "breaker_level"), "ticker", "month", "breaker_level"),
    sql("SELECT ticker, month, lv AS breaker_level FROM brk QUALIFY lv IS DISTINCT FROM lag(lv) OVER (PARTITION BY ticker ORDER BY month)", "brk"),
)
register(
    "vix_spike",
    lambda spark, d: rk.vix_spike(glob(spark, d).select("ts", "india_vix_level", F.round(F.col("india_vix_level") / (1 + F.col("india_vix_1d_pct") / 100), 4).alias("prev_vix"))),
    sql("""SELECT ts, india_vix_level, p AS prev_vix, CASE WHEN india_vix_level > 28 OR (p > 0 AND india_vix_level > 0 AND (india_vix_level - p) / p >= 0.3) THEN 'HALT_AND_FLATTEN' WHEN india_vix_level > 22 THEN 'PAUSE_NEW_ENTRIES' ELSE 'OK' END AS vix_action
  FROM (SELECT ts, india_vix_level, round(india_vix_level / (1 + india_vix_1d_pct / 100), 4) AS p FROM globe)""", "globe"),
)
register(
    "portfolio_heat",
    lambda spark, d: rk.heat(open_positions(spark, d), CAPITAL).select("ticker", F.round("risk", 2).alias("risk"), "n_positions", "heat", "total_heat", "heat_state"),
    sql(f"""SELECT ticker, round(r, 2) AS risk, n AS n_positions, round(r / {CAPITAL}, 6) AS heat, round(sum(r) OVER () / {CAPITAL}, 6) AS total_heat, CASE WHEN round(sum(r) OVER () / {CAPITAL}, 6) > 0.06 THEN 'FULL' WHEN round(sum(r) OVER () / {CAPITAL}, 6) > 0.04 THEN 'HIGH' ELSE 'OK' END AS heat_state
  FROM (SELECT ticker, sum(risk_amount) AS r, count(*) AS n FROM openpos GROUP BY 1)""", "openpos"),
)


def risk_rows(spark, d):
    """Monthly breaker rows with heat and form columns from the month's counts."""
    x = rk.breaker(breaker_rows(spark, d))
    return x.withColumns(
        {"heat": F.col("consecutive_losses") / 100, "losing_streak": F.col("consecutive_losses") % 4, "position_size_mult": F.when(F.col("severity") == "HIGH", 0.5).otherwise(1.0), "meta_size_mult": F.lit(0.75), "entry_quality": F.lit("B")}
    )


define(
    "rsk",
    """SELECT *, round(least(1.5, greatest(0, hm * dm * CASE WHEN n % 11 = 0 THEN 0.5 ELSE 1 END::DOUBLE * lm * 0.75::DOUBLE)), 6) AS f FROM (SELECT *, CASE WHEN l % 7 > 6 THEN 0 WHEN l % 7 > 4 THEN 0.5 ELSE 1 END::DOUBLE AS hm, CASE WHEN l % 7 % 4 >= 3 THEN 0 WHEN l % 7 % 4 = 2 THEN 0.5 ELSE 1 END::DOUBLE AS lm,
    CASE WHEN lv IN ('PAUSE', 'HALT') OR dd > CASE m WHEN 'SMALL' THEN 0.08 WHEN 'GROWING' THEN 0.12 ELSE 0.15 END THEN 0 WHEN dd > CASE m WHEN 'SMALL' THEN 0.05 WHEN 'GROWING' THEN 0.08 ELSE 0.1 END THEN 0.5 WHEN dd > CASE m WHEN 'SMALL' THEN 0.02 WHEN 'GROWING' THEN 0.03 ELSE 0.04 END THEN 0.75 ELSE 1 END::DOUBLE AS dm FROM brk)""",
    "brk",
)
register(
    "risk_features",
    lambda spark, d: rk.risk_features(risk_rows(spark, d)).select("ticker", "month", "heat_mult", "monthly_dd_mult", "loss_mult", "final_size_mult", "trading_allowed"),
    sql("SELECT ticker, month, hm AS heat_mult, dm AS monthly_dd_mult, lm AS loss_mult, f AS final_size_mult, (f > 0)::INT AS trading_allowed FROM rsk", "rsk"),
)
