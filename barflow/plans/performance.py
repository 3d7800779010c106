"""Performance, attribution and behaviour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as lq
from ..sources import adapters as src
from .ledger import CORE
from .oracle import define, sql
from .registry import register

L = src.ledger
define(
    "prun",
    """SELECT ticker, coalesce(max(n) FILTER (w), 0) AS mw, coalesce(max(n) FILTER (NOT w), 0) AS ml FROM (SELECT ticker, w, g, count(*) AS n FROM (SELECT ticker, pnl_points > 0 AS w, row_number() OVER (PARTITION BY ticker ORDER BY close_date, trade_no, signal_uuid)
    - row_number() OVER (PARTITION BY ticker, pnl_points > 0 ORDER BY close_date, trade_no, signal_uuid) AS g FROM ledger) GROUP BY ALL) GROUP BY ticker""",
    "ledger",
)
define("pq0", "SELECT ticker, close_date, 1e9 + CAST(sum(sum(pnl_e4)) OVER (PARTITION BY ticker ORDER BY close_date) AS DOUBLE) / 10000 AS equity FROM ledger GROUP BY 1, 2", "ledger")
define("pq1", "SELECT *, greatest(1e9, max(equity) OVER w) AS peak, equity / coalesce(lag(equity) OVER w, 1e9) - 1 AS r FROM pq0 WINDOW w AS (PARTITION BY ticker ORDER BY close_date)", "pq0")
define(
    "pq2",
    f"""SELECT ticker, min(round((equity - peak) / peak, 6)) AS dd, arg_max(equity, close_date) AS ec, CASE WHEN count(*) > 1 AND stddev_pop(r) > 0 THEN (avg(r) - {(1 + 0.065) ** (1 / 252) - 1!r}) / stddev_pop(r) * sqrt(252) ELSE 0 END AS sh,
    CASE WHEN count(*) FILTER (r < 0) > 1 THEN (avg(r) * 252 - 0.065) / (stddev_pop(r) FILTER (r < 0) * sqrt(252)) ELSE 0 END AS so FROM pq1 GROUP BY 1""",
    "pq1",
)
define(
    "pmx",
    f"""SELECT t.*, q.*EXCLUDE (ticker), mw, ml, (ec - 1e9) / 1e9 AS tr FROM (SELECT ticker, {CORE}, round(avg(pnl_points) / 100, 6) AS avg_trade_pct, count(*) FILTER (signal = 'LONG') AS long_trades, count(*) FILTER (signal = 'SHORT') AS short_trades,
    round(count(*) FILTER (signal = 'LONG' AND pnl_points > 0) / count(*) FILTER (signal = 'LONG'), 4) AS long_win_rate, round(count(*) FILTER (signal = 'SHORT' AND pnl_points > 0) / count(*) FILTER (signal = 'SHORT'), 4) AS short_win_rate,
    round(avg(close_date - opened_at), 4) AS avg_hold_days, quantile_cont(close_date - opened_at, 0.5) AS median_hold_days FROM ledger GROUP BY 1) t JOIN pq2 q ON q.ticker = t.ticker JOIN prun u ON u.ticker = t.ticker""",
    "ledger", "pq2", "prun",
)
_M = ["n_trades", "wins", "win_rate", "profit_factor", "avg_win_pct", "avg_loss_pct", "avg_trade_pct", "long_trades", "short_trades", "long_win_rate", "short_win_rate", "avg_hold_days"]
register(
    "backtest_metrics",
    lambda spark, d: lq.metrics(L(spark, d)).select("ticker", *_M, F.col("median_hold_days").cast("double").alias("median_hold_days"), "max_drawdown_pct", *[F.round(c, 4).alias(c) for c in ("sharpe_ratio", "sortino_ratio", "expectancy_pct")], F.round("total_return_pct", 6).alias("total_return_pct"), "max_consec_wins", "max_consec_losses"),
    sql(
        f"SELECT ticker, {', '.join(_M)}, CAST(median_hold_days AS DOUBLE) AS median_hold_days, dd AS max_drawdown_pct, round(sh, 4) AS sharpe_ratio, round(so, 4) AS sortino_ratio, round(wins / n_trades * avg_win_pct + (1 - wins / n_trades) * avg_loss_pct, 4) AS expectancy_pct, round(tr, 6) AS total_return_pct, mw AS max_consec_wins, ml AS max_consec_losses FROM pmx",
        "pmx",
    ),
)
_G = """(CASE WHEN win_rate >= 0.58 THEN 2 WHEN win_rate >= 0.52 THEN 1 ELSE 0 END + CASE WHEN profit_factor >= 2 THEN 2 WHEN profit_factor >= 1.5 THEN 1 ELSE 0 END + CASE WHEN sh >= 1.5 THEN 2 WHEN sh >= 1 THEN 1 ELSE 0 END
  + CASE WHEN abs(dd) <= 0.1 THEN 2 WHEN abs(dd) <= 0.2 THEN 1 ELSE 0 END + CASE WHEN n_trades >= 100 THEN 1 ELSE 0 END)"""
register(
    "grade",
    lambda spark, d: lq.metrics(L(spark, d)).select("ticker", "grade_score", "grade", F.array_join("issues", ",").alias("issues"), "is_deployable"),
    sql(
        f"""SELECT ticker, g AS grade_score, CASE WHEN g >= 8 THEN 'A' WHEN g >= 6 THEN 'B' WHEN g >= 4 THEN 'C' ELSE 'D' END AS grade, concat_ws(',', CASE WHEN win_rate < 0.52 THEN 'win_rate' END, CASE WHEN profit_factor < 1.5 THEN 'profit_factor' END,
    CASE WHEN sh < 1 THEN 'sharpe' END, CASE WHEN abs(dd) > 0.2 THEN 'max_drawdown' END, CASE WHEN n_trades < 50 THEN 'n_trades' END) AS issues, g >= 6 AS is_deployable FROM (SELECT *, {_G} AS g FROM pmx)""",
        "pmx",
    ),
)
register("metrics_by_regime", lambda spark, d: L(spark, d).groupBy("regime").agg(*lq.core()).where(F.col("n_trades") >= 5), sql(f"SELECT regime, {CORE} FROM ledger GROUP BY 1 HAVING count(*) >= 5", "ledger"))
_D = {"category": "category", "regime_match": "CASE regime_match WHEN 1 THEN 'aligned' WHEN 0 THEN 'counter' ELSE 'unknown' END", "entry_quality": "entry_quality", "alignment": "alignment", "regime": "regime", "ticker": "ticker"}
register(
    "attribution",
    lambda spark, d: lq.attribution(L(spark, d)),
    sql(
        " UNION ALL ".join(
            f"""SELECT '{n}' AS dimension, {e} AS value, count(*) AS n_trades, round(count(*) FILTER (pnl_points > 0) / count(*), 4) AS win_rate, round(coalesce(CAST(coalesce(sum(pnl_e4) FILTER (pnl_e4 > 0), 0) AS DOUBLE) / -sum(pnl_e4) FILTER (pnl_e4 < 0), 0), 4) AS profit_factor,
      round(avg(pnl_points) / 2, 4) AS expectancy_r, round(avg(greatest(pnl_points, 0) + 1) / 100, 6) AS avg_mfe, round(avg(least(pnl_points, 0) - 1) / 100, 6) AS avg_mae FROM ledger GROUP BY {e}"""
            for n, e in _D.items()
        ),
        "ledger",
    ),
)
_BK = "CASE " + " ".join(f"WHEN confidence >= {lo} THEN '{n}'" for lo, n in lq.BUCKETS) + " ELSE '<0.55' END"
register(
    "calibration_buckets",
    lambda spark, d: lq.calibration(L(spark, d)),
    sql(f"SELECT {_BK} AS bucket, count(*) AS total, count(*) FILTER (pnl_points > 0) AS wins, round(count(*) FILTER (pnl_points > 0) / count(*), 4) AS win_rate, round(avg(pnl_points) / 100, 6) AS avg_pnl_pct FROM ledger GROUP BY 1", "ledger"),
)
define("mf0", "SELECT *, first(signal) OVER w AS s0, first(date_trunc('month', close_date)) OVER w AS m0 FROM lnew WHERE age <= 20 WINDOW w AS (PARTITION BY ticker ORDER BY age)", "lnew")
define(
    "mf1",
    """SELECT ticker, round(count(*) FILTER (age <= 10 AND pnl_points > 0) / count(*) FILTER (age <= 10), 4) AS acc, round(avg(confidence), 6) AS conf, round(stddev_pop(confidence), 6) AS sd, CAST(coalesce(min(age) FILTER (pnl_points > 0), 21) - 1 AS INT) AS lose,
    CAST(coalesce(min(age) FILTER (signal <> s0), 21) - 1 AS INT) AS sig, round(least(1, greatest(-1, coalesce(sum(pnl_points) FILTER (date_trunc('month', close_date) = m0), 0) / 10)), 4) AS mon FROM mf0 GROUP BY 1""",
    "mf0",
)
_HM = "round(CASE WHEN lose >= 3 THEN 0.5 WHEN lose = 2 THEN 0.75 ELSE 1 END::DOUBLE * CASE WHEN acc < 0.4 THEN 0.5 WHEN acc < 0.5 THEN 0.75 ELSE 1 END::DOUBLE * CASE WHEN mon < -0.8 THEN 0 WHEN mon < -0.5 THEN 0.5 ELSE 1 END::DOUBLE, 4)"
register(
    "meta_features",
    lambda spark, d: lq.meta_features(L(spark, d)),
    sql(
        f"""SELECT ticker, acc AS rolling_accuracy_10, conf AS avg_model_confidence, sd AS conf_std, lose AS losing_streak, sig AS signal_streak, mon AS monthly_pnl_norm, round(least(lose, 5) / 5, 4) AS losing_streak_norm, round(least(sig, 5) / 5, 4) AS signal_streak_norm,
    round(least(1, greatest(-1, (acc * 0.4 + conf * 0.3 + (1 - least(lose, 5) / 5) * 0.3) * 2 - 1)), 6) AS model_health_score, {_HM} AS meta_size_mult FROM mf1""",
        "mf1",
    ),
)
register(
    "report_stats",
    lambda spark, d: lq.meta_features(L(spark, d)).join(lq.total_pnl(L(spark, d)), "ticker").select("ticker", "rolling_accuracy_10", "total_pnl", "n_trades", "model_health_score"),
    sql("""SELECT ticker, acc AS rolling_accuracy_10, CAST(p AS DOUBLE) / 10000 AS total_pnl, n AS n_trades, round(least(1, greatest(-1, (acc * 0.4 + conf * 0.3 + (1 - least(lose, 5) / 5) * 0.3) * 2 - 1)), 6) AS model_health_score
  FROM mf1 JOIN (SELECT ticker, sum(pnl_e4) AS p, count(*) AS n FROM ledger GROUP BY 1) USING (ticker)""", "mf1", "ledger"),
)
register(
    "weekday_breakdown",
    lambda spark, d: lq.weekday(L(spark, d)),
    sql("""SELECT w AS weekday, count(trade_no) AS n_trades, round(coalesce(count(*) FILTER (pnl_points > 0) / nullif(count(trade_no), 0), 0), 4) AS win_rate, coalesce(CAST(sum(pnl_e4) AS DOUBLE) / 10000, 0) AS pnl FROM (VALUES (1, 'Mon'), (2, 'Tue'), (3, 'Wed'), (4, 'Thu'), (5, 'Fri')) v(k, w)
  LEFT JOIN ledger ON isodow(close_date) = k GROUP BY 1""", "ledger"),
)
register("portfolio_stats", lambda spark, d: L(spark, d).groupBy("ticker", "category").agg(*lq.core()), sql(f"SELECT ticker, category, {CORE} FROM ledger GROUP BY 1, 2", "ledger"))
register(
    "monthly_distribution",
    lambda spark, d: lq.monthly_distribution(L(spark, d)),
    sql("""SELECT count(*) AS months, count(*) FILTER (p > 0) AS positive_months, round(avg(p), 2) AS avg_month, max(p) AS best_month, min(p) AS worst_month FROM (SELECT CAST(sum(pnl_e4) AS DOUBLE) / 10000 AS p FROM ledger GROUP BY date_trunc('month', close_date))""", "ledger"),
)
register(
    "equity_milestones",
    lambda spark, d: lq.milestones(lq.equity_curve(L(spark, d))),
    sql("SELECT ticker, CAST(p AS INT) AS part, max(close_date) AS close_date, arg_max(equity, close_date) AS equity FROM (SELECT *, ntile(4) OVER (PARTITION BY ticker ORDER BY close_date) AS p FROM eq0) GROUP BY 1, 2", "eq0"),
)
_H = "close_date - opened_at"
define("pb1", f"SELECT ticker, avg({_H}) FILTER (pnl_points > 0) AS w, avg({_H}) FILTER (pnl_points <= 0) AS l FROM ledger GROUP BY 1", "ledger")
define(
    "pb3",
    """SELECT ticker, count(*) FILTER (pp <= 0 AND opened_at - pc >= 0 AND opened_at - pc < 1) AS n FROM (SELECT *, lag(pnl_points) OVER w AS pp, lag(close_date) OVER w AS pc FROM ledger WINDOW w AS (PARTITION BY ticker ORDER BY close_date, trade_no, signal_uuid)) GROUP BY 1""",
    "ledger",
)
define("pb4", "SELECT ticker, avg(least(pnl_points * 2, 15)) / 10 AS a FROM ledger WHERE pnl_points > 0 AND signal = 'LONG' GROUP BY 1", "ledger")
define("pb5", "SELECT ticker, stddev_pop(value_cents) / avg(value_cents) AS cv, count(*) AS n, count(*) FILTER (confidence < 0.55) / count(*) AS lo FROM ledger GROUP BY 1", "ledger")
B = ["ticker"]
register("loss_aversion", lambda spark, d: lq.loss_aversion(L(spark, d), B), sql("SELECT ticker, round(w, 4) AS win_hold, round(l, 4) AS loss_hold, round(l / w, 4) AS ratio, (l / w > 1.5)::INT AS detected FROM pb1", "pb1"))
register("overtrading", lambda spark, d: lq.overtrading(L(spark, d), B), sql("SELECT ticker, round(lo, 4) AS low_conf_share, (lo > 0.15)::INT AS detected FROM pb5", "pb5"))
register("revenge_trading", lambda spark, d: lq.revenge(L(spark, d)), sql("SELECT ticker, n AS revenge_trades, (n >= 2)::INT AS detected FROM pb3", "pb3"))
register("early_exit", lambda spark, d: lq.early_exit(L(spark, d), B), sql("SELECT ticker, round(a, 6) AS achieved_ratio, (a < 0.6)::INT AS detected FROM pb4", "pb4"))
register("sizing_cv", lambda spark, d: lq.sizing_cv(L(spark, d), B), sql("SELECT ticker, round(cv, 4) AS sizing_cv, (n >= 5 AND cv > 0.5)::INT AS detected FROM pb5", "pb5"))
register(
    "behaviour_grade",
    lambda spark, d: lq.behaviour(L(spark, d)).select("ticker", "n_trades", F.array_join("flags", ",").alias("flags"), "n_flags", "behaviour_grade"),
    sql(
        """SELECT ticker, n AS n_trades, f AS flags, CASE WHEN f = '' THEN 0 ELSE len(string_split(f, ',')) END::INT AS n_flags, CASE WHEN n < 10 THEN 'INSUFFICIENT' WHEN f = '' THEN 'A' WHEN len(string_split(f, ',')) = 1 THEN 'B' WHEN len(string_split(f, ',')) = 2 THEN 'C' ELSE 'D' END AS behaviour_grade
  FROM (SELECT a.ticker, e.n, concat_ws(',', CASE WHEN a.l / a.w > 1.5 THEN 'loss_aversion' END, CASE WHEN e.lo > 0.15 THEN 'overtrading' END, CASE WHEN c.n >= 2 THEN 'revenge_trading' END, CASE WHEN x.a < 0.6 THEN 'early_exit' END, CASE WHEN e.cv > 0.5 THEN 'sizing' END) AS f
    FROM pb1 a JOIN pb5 e USING (ticker) JOIN pb3 c USING (ticker) JOIN pb4 x USING (ticker))""",
        "pb1", "pb3", "pb4", "pb5",
    ),
)
