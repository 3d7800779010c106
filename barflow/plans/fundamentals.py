"""Fundamental, earnings, alternative-data and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as ca
from ..operators import fundamentals as fd
from ..operators import options as op
from ..sources import adapters as src
from .oracle import define, sql
from .registry import register

_8 = "OVER (PARTITION BY ticker ORDER BY q ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"


def _trend(c: str, sign: str = "") -> str:
    return f"round(greatest(-1, least(1, CASE WHEN count(*) {_8} < 2 THEN 0 ELSE {sign}regr_slope({c}, q) {_8} / (abs(avg({c}) {_8}) + 1e-6) END)), 4)"


define(
    "fund1",
    f"""SELECT *, {_trend('nim')} AS nim_trend, {_trend('npa_gross', '-')} AS npa_trend, {_trend('loan_growth')} AS loan_trend, {_trend('casa_ratio')} AS casa_trend,
    round(pb_ratio / greatest(coalesce(avg(pb_ratio) FILTER (pb_ratio > 0) OVER (PARTITION BY ticker ORDER BY fetched_at RANGE BETWEEN INTERVAL 1825 DAYS PRECEDING AND CURRENT ROW), 3.0), 0.1), 4) AS pb_vs_5yr_avg,
    round(coalesce(eps - lag(eps) OVER (PARTITION BY ticker ORDER BY q), 0), 4) AS eps_surprise FROM fund""",
    "fund",
)
define(
    "fund2",
    """SELECT *, least(q - coalesce(max(CASE WHEN NOT eps_surprise > 0 THEN q END) OVER (PARTITION BY ticker ORDER BY q ROWS UNBOUNDED PRECEDING), 0), 8) AS beat_streak FROM fund1""",
    "fund1",
)
define(
    "fund3",
    """SELECT *, round(greatest(-1, least(1, (CASE WHEN nim > 4 THEN 0.2 WHEN nim > 3.5 THEN 0.1 WHEN nim < 3 THEN -0.2 ELSE 0 END + CASE WHEN npa < 1 THEN 0.2 WHEN npa < 2 THEN 0.1 WHEN npa > 3 THEN -0.3 ELSE 0 END)::DOUBLE
    + nim_trend * 0.15::DOUBLE + npa_trend * 0.15::DOUBLE + (CASE WHEN roe > 18 THEN 0.1 WHEN roe > 15 THEN 0.05 WHEN roe < 12 THEN -0.1 ELSE 0 END + CASE WHEN casa_ratio > 48 THEN 0.1 WHEN casa_ratio < 40 THEN -0.1 ELSE 0 END)::DOUBLE)), 3) AS fundamental_score
  FROM (SELECT *, CASE WHEN coalesce(npa_gross, 0) = 0 THEN 1.3 ELSE npa_gross END AS npa FROM fund2)""",
    "fund2",
)


def fund(spark, d):
    return fd.frame(src.fundamentals(spark, d))


def q(key, part, cols, cte, exprs=None):
    exprs = exprs or {}
    register(key, lambda spark, d: part(spark, d).select(*cols), sql(f"SELECT {', '.join(f'{exprs[c]} AS {c}' if c in exprs else c for c in cols)} FROM {cte}", cte))


K = ["ticker", "fetched_at"]
q("trend_slope", fund, [*K, "nim_trend", "npa_trend", "loan_trend", "casa_trend"], "fund1")
GRADE = "CASE WHEN fundamental_score > 0.4 THEN 'EXCELLENT' WHEN fundamental_score > 0.1 THEN 'GOOD' WHEN fundamental_score > -0.1 THEN 'AVERAGE' WHEN fundamental_score > -0.4 THEN 'WEAK' ELSE 'POOR' END"
q("fundamental_grade", fund, [*K, "fundamental_score", "fundamental_grade"], "fund3", {"fundamental_grade": GRADE})
q("beat_streak", fund, [*K, "eps_surprise", "beat_streak"], "fund2", {"beat_streak": "CAST(beat_streak AS INT)"})
q("pb_vs_5y", fund, [*K, "pb_ratio", "pb_vs_5yr_avg"], "fund1")
register(
    "latest_non_null",
    lambda spark, d: fd.latest_non_null(src.fundamentals(spark, d), ["nim", "npa_gross", "casa_ratio", "roe", "pb_ratio"]),
    sql("SELECT ticker, " + ", ".join(f"arg_max({m}, fetched_at) FILTER ({m} > 0) AS {m}" for m in ("nim", "npa_gross", "casa_ratio", "roe", "pb_ratio")) + " FROM fund GROUP BY ticker", "fund"),
)
_s = lambda c, lo, hi: f"round(greatest(-1, least(1, ({c} - {lo}) / ({hi} - {lo}) * 2 - 1)), 6)"
q(
    "fundamental_features",
    lambda spark, d: fd.features(fund(spark, d)),
    [*K, *fd.FEATURES],
    "fund3",
    {
        "nim_norm": _s("nim", 2.5, 4.5), "nim_trend_f": "nim_trend", "npa_norm": _s("npa_gross", 4.0, 0.5), "npa_trend_f": "npa_trend", "casa_norm": _s("casa_ratio", 30, 52), "loan_growth_norm": _s("loan_growth", 5, 22),
        "roe_norm": _s("roe", 10, 20), "pb_vs_avg_norm": _s("pb_vs_5yr_avg", 1.5, 0.7), "beat_streak_norm": "round(least(beat_streak / 6, 1), 4)", "fundamental_score_f": "fundamental_score",
    },
)

define("er0", "SELECT *, round((actual_eps - estimated_eps) / greatest(abs(estimated_eps), 0.01) * 100, 4) AS surprise_pct, (actual_eps >= estimated_eps)::INT AS beat, row_number() OVER (PARTITION BY ticker ORDER BY result_date) AS n FROM earn", "earn")
_12 = "OVER (PARTITION BY ticker ORDER BY n ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
define(
    "er1",
    f"""SELECT a.*, (SELECT a.n - coalesce(max(b.n) FILTER (b.beat = 0), 0) FROM er0 b WHERE b.ticker = a.ticker AND b.n <= a.n) AS run FROM (SELECT *, round(avg(beat) {_12}, 4) AS hist_beat_rate,
    round(coalesce(avg(surprise_pct / 100) FILTER (beat = 1 AND surprise_pct <> 0) {_12}, 0.025), 4) AS hist_avg_gap_up FROM er0) a""",
    "er0",
)
define(
    "er2",
    """SELECT a.ticker, a.result_date, avg((p.surprise_pct > 0)::INT) AS ratio FROM er0 a LEFT JOIN (SELECT x.ticker AS t, x.result_date AS d, y.ticker AS peer, arg_max(y.surprise_pct, y.result_date) AS surprise_pct
    FROM er0 x JOIN er0 y ON y.ticker <> x.ticker AND y.result_date BETWEEN x.result_date - 90 AND x.result_date GROUP BY ALL) p ON p.t = a.ticker AND p.d = a.result_date GROUP BY 1, 2""",
    "er0",
)
define(
    "er3",
    """SELECT *, coalesce(round(ratio, 4), 0.5) AS peer_beat_ratio, CASE WHEN ratio IS NULL THEN 'UNKNOWN' WHEN round(ratio, 4) >= 0.67 THEN 'SECTOR_STRONG' WHEN round(ratio, 4) <= 0.33 THEN 'SECTOR_WEAK' ELSE 'SECTOR_MIXED' END AS peer_signal FROM er2""",
    "er2",
)
define(
    "er4",
    """SELECT b.ticker, b.ts, b.close, coalesce(nx.result_date - b.ts, 99) AS d, b.ts - pv.result_date AS since, h.hist_beat_rate, h.hist_avg_gap_up, p.peer_beat_ratio, p.peer_signal, row_number() OVER (PARTITION BY b.ticker ORDER BY b.ts) AS rn FROM bars b
    ASOF LEFT JOIN er0 nx ON nx.ticker = b.ticker AND b.ts <= nx.result_date ASOF LEFT JOIN er0 pv ON pv.ticker = b.ticker AND b.ts >= pv.result_date
    ASOF LEFT JOIN er1 h ON h.ticker = b.ticker AND b.ts >= h.result_date ASOF LEFT JOIN er3 p ON p.ticker = b.ticker AND b.ts >= p.result_date""",
    "bars", "er0", "er1", "er3",
)
_lag = lambda k: f"lag(close, {k}) OVER (PARTITION BY ticker ORDER BY ts)"
define(
    "er5",
    f"""SELECT *, CASE WHEN d <= 10 AND least(5, d + 1) >= 2 AND rn >= 10 THEN round(coalesce(close / CASE least(5, d + 1) WHEN 2 THEN {_lag(1)} WHEN 3 THEN {_lag(2)} WHEN 4 THEN {_lag(3)} ELSE {_lag(4)} END - 1, 0), 4) ELSE 0 END AS drift FROM er4""",
    "er4",
)
define(
    "er6",
    """SELECT *, CASE WHEN d = 0 THEN 0 WHEN d = 1 THEN 0.3 WHEN d = 2 THEN 0.5 WHEN d = 3 THEN 0.7 WHEN since = 1 THEN 0.8 ELSE 1 END::DOUBLE AS mult,
    round(greatest(0.1, least(0.9, coalesce(hist_beat_rate, 0.62) + CASE WHEN drift > 0.02 THEN 0.1 WHEN drift < -0.02 THEN -0.1 ELSE 0 END::DOUBLE + CASE peer_signal WHEN 'SECTOR_STRONG' THEN 0.08 WHEN 'SECTOR_WEAK' THEN -0.08 ELSE 0 END::DOUBLE)), 3) AS p FROM er5""",
    "er5",
)


def results(spark, d):
    return fd.surprise(src.earnings(spark, d))


def earn(spark, d):
    return fd.earnings_frame(src.bars(spark, d), src.earnings(spark, d))


q("surprise", results, ["ticker", "result_date", "surprise_pct", "beat_estimates"], "er0", {"beat_estimates": "beat"})
q("hist_reaction", lambda spark, d: fd.history(results(spark, d)), ["ticker", "result_date", "hist_beat_rate", "hist_avg_gap_up", "consecutive_beats"], "er1", {"consecutive_beats": "CAST(least(run, 12) AS INT)"})
q("peer_signal", lambda spark, d: fd.peer_signal(results(spark, d)), ["ticker", "result_date", "peer_beat_ratio", "peer_signal"], "er3")
q("asof_forward", lambda spark, d: fd.days_to_earnings(src.bars(spark, d).select("ticker", "ts"), results(spark, d)), ["ticker", "ts", "days_to_earnings", "days_since_earnings"], "er4", {"days_to_earnings": "CAST(d AS INT)", "days_since_earnings": "CAST(since AS INT)"})
q("pre_drift", earn, ["ticker", "ts", "pre_earnings_drift", "pre_earnings_bullish", "pre_earnings_bearish"], "er5", {"pre_earnings_drift": "CAST(drift AS DOUBLE)", "pre_earnings_bullish": "(drift > 0.015)::INT", "pre_earnings_bearish": "(drift < -0.015)::INT"})
q("beat_probability", earn, ["ticker", "ts", "beat_probability"], "er6", {"beat_probability": "CAST(p AS DOUBLE)"})
q("event_size_mult", earn, ["ticker", "ts", "earnings_size_mult"], "er6", {"earnings_size_mult": "mult"})
_S = [s.replace("'", "''") for s in fd.STRATEGIES]
_STRAT = f"CASE WHEN d <= 2 THEN '{_S[0]}' WHEN d <= 5 THEN '{_S[1]}' WHEN d <= 10 AND p > 0.70 THEN '{_S[2]}' WHEN d <= 10 AND p < 0.40 THEN '{_S[3]}' ELSE '{_S[4]}' END"
q("earnings_strategy", earn, ["ticker", "ts", "earnings_strategy"], "er6", {"earnings_strategy": _STRAT})
q(
    "earnings_features",
    earn,
    ["ticker", "ts", "days_to_earnings", "is_earnings_week", "is_earnings_day", "peer_beat_ratio", "hist_beat_rate", "hist_avg_gap_up", "beat_probability", "earnings_size_mult"],
    "er6",
    {"days_to_earnings": "CAST(d AS INT)", "is_earnings_week": "(d <= 5)::INT", "is_earnings_day": "(d = 0)::INT", "beat_probability": "CAST(p AS DOUBLE)", "earnings_size_mult": "mult", "peer_beat_ratio": "CAST(peer_beat_ratio AS DOUBLE)", "hist_avg_gap_up": "CAST(hist_avg_gap_up AS DOUBLE)"},
)

define(
    "alt0",
    """SELECT event_type AS keyword, CASE event_type WHEN 'signup' THEN 'hiring' WHEN 'error' THEN 'concern' ELSE 'product' END AS group_name, CAST(ts AS DATE) AS period, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL""",
)
_K = "OVER (PARTITION BY keyword ORDER BY period ROWS BETWEEN {} PRECEDING AND {})"
define(
    "alt1",
    f"""SELECT *, avg(value) {_K.format(3, 'CURRENT ROW')} AS r, CASE WHEN count(*) {_K.format(7, 'CURRENT ROW')} >= 8 THEN avg(value) {_K.format(7, '4 PRECEDING')} ELSE avg(value) {_K.format(3, 'CURRENT ROW')} END AS o FROM alt0""",
    "alt0",
)
define("alt2", "SELECT *, round((r - o) / greatest(o, 1), 4) AS slope FROM alt1", "alt1")
define(
    "alt3",
    """SELECT *, round(greatest(-1, least(1, d * 0.5 + h * 0.3 + c * 0.2)), 5) AS a FROM (SELECT period, round(coalesce(avg(slope) FILTER (group_name = 'product'), 0), 4) AS d, round(coalesce(avg(slope) FILTER (group_name = 'hiring'), 0), 4) AS h,
    round(-coalesce(avg(slope) FILTER (group_name = 'concern'), 0), 4) AS c FROM alt2 GROUP BY period)""",
    "alt2",
)


def alt(spark, d):
    kind = F.when(F.col("event_type") == "signup", "hiring").when(F.col("event_type") == "error", "concern").otherwise("product")
    counts = src.table(spark, d, "events").groupBy(F.col("event_type").alias("keyword"), kind.alias("group_name"), F.to_date("ts").alias("period")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return fd.alt_slopes(counts)


q("trend_slope_4w", alt, ["keyword", "period", "recent_avg", "older_avg", "slope"], "alt2", {"recent_avg": "round(r, 4)", "older_avg": "round(o, 4)"})
_HT = "CASE WHEN h > 0.15 THEN 'STRONG_EXPANSION' WHEN h > 0.05 THEN 'EXPANSION' WHEN h < -0.15 THEN 'STRONG_CONTRACTION' WHEN h < -0.05 THEN 'CONTRACTION' ELSE 'STABLE' END"
_AS = "CASE WHEN a > 0.3 THEN 'BULLISH_FUNDAMENTAL' WHEN a > 0.1 THEN 'MILD_POSITIVE' WHEN a < -0.3 THEN 'BEARISH_FUNDAMENTAL' WHEN a < -0.1 THEN 'MILD_NEGATIVE' ELSE 'NEUTRAL' END"
q("alt_score", lambda spark, d: fd.alt_score(alt(spark, d)), ["period", "demand_trend_score", "hiring_trend_score", "concern_trend_score", "alt_data_score", "hiring_trend", "alt_data_signal"], "alt3",
  {"demand_trend_score": "d", "hiring_trend_score": "h", "concern_trend_score": "c", "alt_data_score": "a", "hiring_trend": _HT, "alt_data_signal": _AS})
_c = lambda e: f"round(greatest(-1, least(1, {e})), 6)"
_LOANS = {"home_loan_trend": "purchase", "personal_loan_trend": "view", "credit_card_trend": "click"}
define("alt4", f"SELECT a.*, {', '.join(f'coalesce(s.{n}, 0) AS {n}' for n in _LOANS)} FROM alt3 a LEFT JOIN (SELECT period, " + ", ".join(f"max(slope) FILTER (keyword = '{k}') AS {n}" for n, k in _LOANS.items()) + " FROM alt2 GROUP BY 1) s USING (period)", "alt2", "alt3")


def alt_frame(spark, d):
    slopes = alt(spark, d)
    return fd.alt_features(fd.alt_score(slopes), slopes, _LOANS)


ALT = {"demand_trend": _c("d * 3"), "hiring_trend_f": _c("h * 4"), "concern_trend": _c("c"), "alt_data_score_f": _c("a"), **{n: _c(f"{n} * 5") for n in _LOANS}}
q("alt_features", alt_frame, ["period", *ALT], "alt4", ALT)
from .flow import insider  # noqa: E402

q("ownership_features", lambda spark, d: fd.ownership_features(insider(spark, d)), ["ticker", "quarter", "insider_score_f", "promoter_trend_score", "pledge_risk", "dii_accumulation"], "ins1",
  {"insider_score_f": _c("insider_score"), "promoter_trend_score": "CASE promoter_trend WHEN 'INCREASING' THEN 1 WHEN 'DECREASING' THEN -1 ELSE 0 END::DOUBLE", "pledge_risk": _c("-pledge_pct / 20"), "dii_accumulation": _c("dii_qoq * 5")})

define("hdays", "SELECT d AS holiday FROM (SELECT unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY))::DATE AS d FROM orders) WHERE isodow(d) < 6 AND d NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders) OR day(d) = 26 AND month(d) = 1")
define(
    "tcal",
    """SELECT *, min(CASE WHEN is_trading_day THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_trading_day FROM (SELECT d AS day, d IN (SELECT holiday FROM hdays) AS is_holiday,
    isodow(d) < 6 AND d NOT IN (SELECT holiday FROM hdays) AS is_trading_day FROM (SELECT unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY))::DATE AS d FROM orders))""",
    "hdays",
)


def holidays(spark, d):
    """Weekdays without any order, and every 26 January."""
    days = src.order_days(spark, d)
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    x = span.join(days.withColumn("_o", F.lit(True)), "day", "left")
    quiet = F.col("_o").isNull() & F.dayofweek("day").between(2, 6)
    return x.where(quiet | ((F.dayofmonth("day") == 26) & (F.month("day") == 1))).select(F.col("day").alias("holiday"))


register(
    "trading_calendar",
    lambda spark, d: ca.trading_calendar(src.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("ts")), holidays(spark, d)),
    sql("SELECT * FROM tcal", "tcal"),
)
register(
    "session_flags",
    lambda spark, d: ca.session(src.bars_intraday(spark, d)).select("ticker", "ts", "is_pre_market", "is_market_open", "is_closing"),
    sql("""SELECT ticker, ts, (isodow(ts) < 6 AND m BETWEEN 540 AND 554)::INT AS is_pre_market, (isodow(ts) < 6 AND m BETWEEN 555 AND 930)::INT AS is_market_open, (isodow(ts) < 6 AND m BETWEEN 900 AND 930)::INT AS is_closing
  FROM (SELECT ticker, ts, hour(ts) * 60 + minute(ts) AS m FROM bars_intraday)""", "bars_intraday"),
)
define(
    "caf",
    """SELECT e.*, o.dist, coalesce(h.holiday - e.ts, 99) AS hol, x.days_to_monthly_expiry AS dx, x.is_expiry_week AS ew, x.is_expiry_day AS ed FROM er6 e ASOF LEFT JOIN opts o ON o.ticker = e.ticker AND e.ts >= o.fetched_at
    ASOF LEFT JOIN hdays h ON e.ts <= h.holiday JOIN (SELECT ticker, ts, greatest(days, 0) AS days_to_monthly_expiry, (days BETWEEN 0 AND 5)::INT AS is_expiry_week, (days = 0)::INT AS is_expiry_day FROM (
      SELECT ticker, ts, (CASE WHEN ts <= e0 THEN e0 ELSE e1 END) - ts AS days FROM (SELECT ticker, ts, last_day(ts) - CAST((isodow(last_day(ts)) + 3) % 7 AS INT) AS e0,
      last_day(CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE)) - CAST((isodow(last_day(CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE))) + 3) % 7 AS INT) AS e1 FROM bars))) x ON x.ticker = e.ticker AND x.ts = e.ts""",
    "er6", "opts", "hdays", "bars",
)


def calendar_inputs(spark, d):
    from ..operators.joins import asof_day

    c = src.chain(spark, d)
    snap = op.snapshot_frame(c, src.with_spot(c))
    x = asof_day(earn(spark, d), snap, ["max_pain_distance"], right_ts="fetched_at")
    return op.expiry(x.withColumn("max_pain_distance", F.coalesce("max_pain_distance", F.lit(0.0))), "ts")


CA = {
    "earnings_proximity": "round(greatest(1 - least(d, 90) / 90, 0), 4)", "earnings_risk_flag": "(d <= 5)::INT", "pre_earnings_drift_norm": "round(greatest(-1, least(1, drift / 0.03)), 4)", "earnings_beat_prob": "round(p, 4)",
    "expiry_proximity": "round(greatest(1 - least(dx, 15) / 15, 0), 4)", "is_expiry_week_f": "ew", "is_expiry_day_f": "ed", "max_pain_dist_norm": "round(greatest(-1, least(1, coalesce(dist, 0) / 3)), 4)",
    "is_monday": "(isodow(ts) = 1)::INT", "is_friday": "(isodow(ts) = 5)::INT", "is_midweek": "(isodow(ts) BETWEEN 2 AND 4)::INT", "day_of_week_norm": "round((isodow(ts) - 3) / 2, 4)",
    "month_seasonality": "[0.6, 0.2, -0.3, 0.4, 0.1, 0.0, 0.3, 0.1, 0.0, 0.5, 0.7, 0.3][month(ts)]", "is_q4_india": "(month(ts) = 3)::INT", "is_oct_nov": "(month(ts) IN (10, 11))::INT",
    "quarter_norm": "round((quarter(ts) - 2.5) / 1.5, 4)", "holiday_proximity": "CASE WHEN hol <= 2 THEN round(greatest(1 - hol / 3, 0), 4) ELSE 0 END",
}
q("calendar_features", lambda spark, d: ca.features(calendar_inputs(spark, d), holidays(spark, d)), ["ticker", "ts", *ca.FEATURES], "caf", {k: f"CAST({v} AS DOUBLE)" for k, v in CA.items()})
