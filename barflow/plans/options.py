"""Option-chain queries over the monthly chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import options as op
from ..sources import adapters as src
from .oracle import define, sql
from .registry import register

define("snaps", "SELECT ticker, fetched_at, sum(ce_oi) AS tc, sum(pe_oi) AS tp, round(CASE WHEN sum(ce_oi) = 0 THEN 1.0 ELSE sum(pe_oi) / sum(ce_oi) END, 3) AS pcr FROM chain GROUP BY 1, 2", "chain")
define(
    "snaps2",
    """SELECT *, round(CASE WHEN coalesce(o, 0) = 0 THEN 0.0 ELSE pcr - o END, 3) AS pcr_roc FROM (SELECT *, avg(pcr) OVER (PARTITION BY ticker ORDER BY fetched_at ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS o FROM snaps)""",
    "snaps",
)
define(
    "pain0",
    """SELECT a.ticker, a.fetched_at, a.strike, sum(CASE WHEN a.strike > b.strike THEN (a.strike - b.strike) * b.ce_oi WHEN a.strike < b.strike THEN (b.strike - a.strike) * b.pe_oi ELSE 0 END) AS pain
  FROM chain a JOIN chain b ON a.ticker = b.ticker AND a.fetched_at = b.fetched_at GROUP BY ALL""",
    "chain",
)
define("pain", "SELECT ticker, fetched_at, first(strike ORDER BY pain, strike) AS max_pain, min(pain) AS pain FROM pain0 GROUP BY 1, 2", "pain0")
define(
    "maxoi",
    """SELECT ticker, fetched_at, coalesce(first(strike ORDER BY ce_oi DESC, strike) FILTER (ce_oi > 0), 0) AS max_call_oi_strike, coalesce(first(strike ORDER BY pe_oi DESC, strike) FILTER (pe_oi > 0), 0) AS max_put_oi_strike
  FROM chain GROUP BY 1, 2""",
    "chain",
)
define(
    "atm",
    """SELECT ticker, fetched_at, spot, strike AS atm_strike, iv AS atm_iv, CASE WHEN spot > 0 THEN round((ce_price + pe_price) / spot * 100, 4) ELSE 0 END AS implied_move_pct FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker, fetched_at ORDER BY round(abs(strike - spot), 9), strike) AS k FROM spotted) WHERE k = 1""",
    "spotted",
)
define("atm_n", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fetched_at) AS n FROM atm", "atm")
define(
    "ivp",
    """SELECT a.ticker, a.fetched_at, CASE WHEN a.atm_iv = 0 OR count(*) FILTER (b.atm_iv > 0) < 10 THEN 50.0 ELSE round(count(*) FILTER (b.atm_iv > 0 AND b.atm_iv < a.atm_iv) / count(*) FILTER (b.atm_iv > 0) * 100, 4) END AS iv_percentile
  FROM atm_n a JOIN atm_n b ON b.ticker = a.ticker AND b.n BETWEEN a.n - 251 AND a.n GROUP BY a.ticker, a.fetched_at, a.atm_iv""",
    "atm_n",
)
define(
    "opt1",
    """SELECT s.*, p.max_pain, o.max_call_oi_strike, o.max_put_oi_strike, a.spot, a.implied_move_pct, v.iv_percentile,
    CASE WHEN spot = 0 OR max_pain = 0 THEN 0 ELSE round((spot - max_pain) / spot * 100, 4) END AS dist,
    last_day(fetched_at) - CAST((isodow(last_day(fetched_at)) - 4 + 7) % 7 AS INT) AS e0,
    last_day(CAST(date_trunc('month', fetched_at) + INTERVAL 1 MONTH AS DATE)) - CAST((isodow(last_day(CAST(date_trunc('month', fetched_at) + INTERVAL 1 MONTH AS DATE))) - 4 + 7) % 7 AS INT) AS e1
  FROM snaps2 s JOIN pain p USING (ticker, fetched_at) JOIN maxoi o USING (ticker, fetched_at) JOIN atm a USING (ticker, fetched_at) JOIN ivp v USING (ticker, fetched_at)""",
    "snaps2", "pain", "maxoi", "atm", "ivp",
)
define("opts", "SELECT *, (CASE WHEN fetched_at <= e0 THEN e0 ELSE e1 END) - fetched_at AS days FROM opt1", "opt1")


def snap(spark, d):
    c = src.chain(spark, d)
    return op.snapshot_frame(c, src.with_spot(c))


register("pcr", lambda spark, d: op.pcr(src.chain(spark, d)), sql("SELECT ticker, fetched_at, tc AS total_call_oi, tp AS total_put_oi, pcr FROM snaps", "snaps"))
register("pcr_roc", lambda spark, d: op.pcr_roc(op.pcr(src.chain(spark, d))).select("ticker", "fetched_at", "pcr", "pcr_roc"), sql("SELECT ticker, fetched_at, pcr, pcr_roc FROM snaps2", "snaps2"))
register(
    "max_pain",
    lambda spark, d: op.max_pain(src.chain(spark, d)).select("ticker", "fetched_at", "max_pain", F.round("pain", 4).alias("pain")),
    sql("SELECT ticker, fetched_at, max_pain, round(pain, 4) AS pain FROM pain", "pain"),
)
register("strike_cross", lambda spark, d: op.max_pain(op.latest_snapshot(src.chain(spark, d))).select("ticker", "max_pain"), sql("SELECT ticker, max_pain FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fetched_at DESC) AS k FROM pain) WHERE k = 1", "pain"))
register("iv_percentile", lambda spark, d: op.iv_percentile(op.at_the_money(src.with_spot(src.chain(spark, d)))).select("ticker", "fetched_at", "iv_percentile"), sql("SELECT ticker, fetched_at, CAST(iv_percentile AS DOUBLE) AS iv_percentile FROM ivp", "ivp"))
register("max_oi_strikes", lambda spark, d: op.max_oi_strikes(src.chain(spark, d)), sql("SELECT * FROM maxoi", "maxoi"))
register("atm_strike_iv", lambda spark, d: op.at_the_money(src.with_spot(src.chain(spark, d))).select("ticker", "fetched_at", F.round("spot", 6).alias("spot"), "atm_strike", F.round("atm_iv", 6).alias("atm_iv")), sql("SELECT ticker, fetched_at, round(spot, 6) AS spot, atm_strike, round(atm_iv, 6) AS atm_iv FROM atm", "atm"))
register("implied_move", lambda spark, d: op.at_the_money(src.with_spot(src.chain(spark, d))).select("ticker", "fetched_at", "implied_move_pct"), sql("SELECT ticker, fetched_at, implied_move_pct FROM atm", "atm"))
register(
    "max_pain_distance",
    lambda spark, d: snap(spark, d).select("ticker", "fetched_at", "max_pain_distance", "max_pain_direction"),
    sql("SELECT ticker, fetched_at, dist AS max_pain_distance, CASE WHEN dist > 0.5 THEN 'ABOVE_MAX_PAIN' WHEN dist < -0.5 THEN 'BELOW_MAX_PAIN' ELSE 'AT_MAX_PAIN' END AS max_pain_direction FROM opts", "opts"),
)
register(
    "expiry_features",
    lambda spark, d: op.expiry(src.bars(spark, d).select("ticker", F.col("ts").alias("fetched_at"))),
    sql(
        """SELECT ticker, fetched_at, CAST(greatest(days, 0) AS INT) AS days_to_monthly_expiry, (days BETWEEN 0 AND 5)::INT AS is_expiry_week, (days = 0)::INT AS is_expiry_day FROM (
    SELECT ticker, fetched_at, (CASE WHEN fetched_at <= e0 THEN e0 ELSE e1 END) - fetched_at AS days FROM (SELECT ticker, ts AS fetched_at,
    last_day(ts) - CAST((isodow(last_day(ts)) + 3) % 7 AS INT) AS e0,
    last_day(CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE)) - CAST((isodow(last_day(CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE))) + 3) % 7 AS INT) AS e1 FROM bars))""",
        "bars",
    ),
)
_clip = lambda e: f"round(least(greatest({e}, -1), 1), 6)"
OPT_FEATURES = {
    "pcr_norm": _clip("(pcr - 0.7) / 0.6 * 2 - 1"),
    "pcr_roc_norm": _clip("-pcr_roc / 0.3"),
    "max_pain_dist_norm": f"CASE WHEN spot > 0 AND max_pain > 0 THEN {_clip('-((spot - max_pain) / spot) / 0.03')} ELSE 0 END",
    "iv_percentile_norm": f"0 - {_clip('(iv_percentile - 20) / 60 * 2 - 1')}",
    "implied_move_norm": _clip("-implied_move_pct / 5.0"),
    "expiry_proximity": "CASE WHEN days <= 5 THEN round(greatest(1 - days / 5, 0), 4) ELSE 0 END",
    "call_wall_dist_norm": f"CASE WHEN max_call_oi_strike > spot THEN {_clip('(max_call_oi_strike - spot) / spot / 0.05')} ELSE 0 END",
    "put_wall_dist_norm": f"CASE WHEN max_put_oi_strike > 0 AND max_put_oi_strike < spot THEN {_clip('(spot - max_put_oi_strike) / spot / 0.05')} ELSE 0 END",
}
register(
    "options_features",
    lambda spark, d: op.features(snap(spark, d)).select("ticker", "fetched_at", *OPT_FEATURES),
    sql(f"SELECT ticker, fetched_at, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in OPT_FEATURES.items())} FROM opts", "opts"),
)
