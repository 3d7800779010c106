"""Outcome-labelling and walk-forward queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as sg
from ..operators import ledger as lq
from ..operators import outcomes as bt
from ..operators import regime as rg
from ..sources import adapters as src
from .gates import model_probs
from .oracle import define, sql
from .regime import frame as regime_frame
from .registry import register
from .technical import W, guarded

define(
    "be0",
    f"""SELECT ticker, ts, open, high, low, close, row_number() {W}) - 1 AS i, {guarded('avg(high - low)', 'high', 14)} AS atr, (CAST(close AS BIGINT) * 7 + CAST(volume AS BIGINT) * 3) % 97 + 1 AS a,
    (CAST(high AS BIGINT) * 5 + CAST(volume AS BIGINT)) % 31 + 1 AS b, (CAST(low AS BIGINT) * 11 + CAST(close AS BIGINT)) % 89 + 1 AS s FROM bars""",
    "bars",
)
define(
    "be1",
    """SELECT *, e - sg * atr * 2 AS st, e + sg * atr * 5 AS tg FROM (SELECT ticker, ts, i, atr, signal, CASE WHEN signal = 'LONG' THEN 1 ELSE -1 END AS sg, round(close * (1 + CASE WHEN signal = 'LONG' THEN 1 ELSE -1 END * 0.0005::DOUBLE), 4) AS e
    FROM (SELECT *, CASE WHEN a > b AND a >= s THEN 'LONG' WHEN s > b AND s > a THEN 'SHORT' ELSE 'FLAT' END AS signal FROM be0) WHERE signal <> 'FLAT' AND atr IS NOT NULL)""",
    "be0",
)
define(
    "bo",
    """SELECT *, CASE k WHEN 0 THEN 'GAP_FILL' WHEN 1 THEN 'STOP_LOSS' WHEN 2 THEN 'TARGET' ELSE 'TIME_EXIT' END AS reason, sg * (px - e) / e - 0.002 AS net FROM (SELECT n.*, p.i AS xi, p.ts AS xts,
    CASE WHEN sg * (p.open - st) < 0 THEN 0 WHEN sg * (p.close - st) <= 0 THEN 1 WHEN sg * (p.close - tg) >= 0 THEN 2 WHEN p.i - n.i >= 8 THEN 3 END AS k, CASE WHEN sg * (p.open - st) < 0 THEN p.open ELSE p.close * (1 - sg * 0.0005) END AS px
    FROM be1 n JOIN be0 p ON p.ticker = n.ticker AND p.i > n.i AND p.i <= n.i + 8) WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, i ORDER BY xi) = 1""",
    "be0", "be1",
)


def ents(spark, d):
    b = bt.indexed(src.bars(spark, d))
    return bt.entries(model_probs(b), F.col("swing")), b


def done(spark, d):
    e, b = ents(spark, d)
    return bt.outcomes(e, b), b


for _k in ("barrier_outcome", "barrier_join"):
    register(
        _k,
        lambda spark, d: done(spark, d)[0].select("ticker", "ts", "signal", F.round("entry_price", 4).alias("entry_price"), "exit_ts", F.round("exit_price", 4).alias("exit_price"), "exit_reason", "days_held", F.round("net_pnl_pct", 6).alias("net_pnl_pct"), F.round("r_multiple", 6).alias("r_multiple")),
        sql("SELECT ticker, ts, signal, e AS entry_price, xts AS exit_ts, round(px, 4) AS exit_price, reason AS exit_reason, CAST(xi - i AS INT) AS days_held, round(net, 6) AS net_pnl_pct, round(sg * (px - e) / nullif(abs(e - st), 0), 6) AS r_multiple FROM bo", "bo"),
    )
register(
    "excursions",
    lambda spark, d: bt.excursions(*done(spark, d)).select("ticker", "i", F.round("mfe", 6).alias("mfe"), F.round("mae", 6).alias("mae")),
    sql(
        """SELECT o.ticker, CAST(o.i AS INT) AS i, round(CASE WHEN signal = 'LONG' THEN max(p.high) / e - 1 ELSE 1 - min(p.low) / e END, 6) AS mfe, round(CASE WHEN signal = 'LONG' THEN min(p.low) / e - 1 ELSE 1 - max(p.high) / e END, 6) AS mae
  FROM bo o JOIN be0 p ON p.ticker = o.ticker AND p.i > o.i AND p.i <= o.xi GROUP BY o.ticker, o.i, signal, e""",
        "bo", "be0",
    ),
)
def _path(entries: str, bars: str) -> str:
    return f"""SELECT n.ticker, n.i, n.hold, n.sg, e, st, tg, p.i AS bi, p.close AS c, greatest(n.sg * e, max(n.sg * p.close) OVER (PARTITION BY n.ticker, n.i ORDER BY p.i)) AS pk
  FROM {entries} n JOIN {bars} p ON p.ticker = n.ticker AND p.i > n.i AND p.i <= n.i + n.hold"""


def _legs(path: str, limit: str) -> str:
    hits = (
        ("TARGET_1R", 0.5, "WHEN sg * (c - e) >= abs(e - st) THEN 'TARGET_1R'"), ("TARGET_2R", 0.3, "WHEN sg * (c - e) >= 2 * abs(e - st) THEN 'TARGET_2R'"),
        ("REST", 0.2, "WHEN sg * (c - tg) >= 0 THEN 'TARGET' WHEN sg * (c / e - 1) >= 0.02 AND sg * c <= pk - abs(pk) * 0.015 THEN 'TRAILING_STOP'"),
    )
    return " UNION ALL ".join(
        f"""SELECT ticker, i, '{name}' AS leg, {share}::DOUBLE AS share, bi AS exit_i, r AS exit_reason, {share} * sg * (c - e) / e AS p FROM (SELECT *, CASE WHEN sg * (c - st) <= 0 THEN 'STOP_LOSS' {hit} WHEN bi - i >= hold THEN '{limit}' END AS r FROM {path})
      WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, i ORDER BY bi) = 1"""
        for name, share, hit in hits
    )


# Swing entries held as long as the regime of their bar allows; intraday ones to the end of their session.
define("be2", f"SELECT b.*, CASE r.regime {' '.join(f"WHEN '{k}' THEN {v[3]}" for k, v in rg.RULES.items() if v[3])} ELSE 8 END AS hold FROM be1 b LEFT JOIN (SELECT ticker, ts, regime FROM regimes) r USING (ticker, ts)", "be1", "regimes")
define("bl0", _path("be2", "be0"), "be0", "be2")
define("bl1", _legs("bl0", "TIME_EXIT"), "bl0")
define(
    "ie0",
    """SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS i, row_number() OVER d AS nth, count(*) OVER (PARTITION BY ticker, CAST(ts AS DATE)) AS n, CASE WHEN close >= open THEN 1 ELSE -1 END AS sg
  FROM bars_intraday WINDOW d AS (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts)""",
    "bars_intraday",
)
define("ie1", "SELECT *, e * (1 - sg * 0.01::DOUBLE) AS st, e * (1 + sg * 0.03::DOUBLE) AS tg FROM (SELECT ticker, i, n - nth AS hold, sg, round(close * (1 + sg * 0.0005::DOUBLE), 4) AS e FROM ie0 WHERE nth % 4 = 1 AND n > nth)", "ie0")
define("il0", _path("ie1", "ie0"), "ie0", "ie1")
define("il1", _legs("il0", "SESSION_CLOSE"), "il0")


def _ladder(spark, d):
    e, b = ents(spark, d)
    return bt.ladder(bt.hold_by_regime(e, regime_frame(spark, d)), b)


def _session_ladder(spark, d):
    b = bt.indexed(src.bars_intraday(spark, d))
    return bt.ladder(bt.session_entries(b), b, "SESSION_CLOSE")


for _key, _fn, _cte in (("exit_ladder", _ladder, "bl1"), ("exit_ladder_intraday", _session_ladder, "il1")):
    register(
        _key,
        lambda spark, d, fn=_fn: fn(spark, d).select("ticker", "i", "leg", "share", "exit_i", "exit_reason", F.round("leg_pnl_pct", 6).alias("leg_pnl_pct")),
        sql(f"SELECT ticker, CAST(i AS INT) AS i, leg, share, CAST(exit_i AS INT) AS exit_i, exit_reason, round(p, 6) AS leg_pnl_pct FROM {_cte}", _cte),
    )
define("no0", "SELECT ticker, i, xi, net, row_number() OVER (PARTITION BY ticker ORDER BY i) AS n FROM bo", "bo")
define(
    "no_rec",
    """SELECT ticker, n, i, xi, net, true AS taken, xi AS busy FROM no0 WHERE n = 1 UNION ALL SELECT b.ticker, b.n, b.i, b.xi, b.net, b.i > r.busy, CASE WHEN b.i > r.busy THEN b.xi ELSE r.busy END FROM no_rec r JOIN no0 b ON b.ticker = r.ticker AND b.n = r.n + 1""",
    "no0",
)
register(
    "non_overlapping",
    lambda spark, d: bt.non_overlapping(done(spark, d)[0].select("ticker", "i", "exit_i", F.round("net_pnl_pct", 6).alias("net_pnl_pct"))),
    sql("SELECT ticker, CAST(i AS INT) AS i, CAST(xi AS INT) AS exit_i, round(net, 6) AS net_pnl_pct FROM no_rec WHERE taken", "no_rec"),
)
register(
    "close_trade",
    lambda spark, d: bt.close_trade(_closed(spark, d)).select("signal_uuid", "net_amount", "net_pct", "r_multiple_now", "held_hours"),
    sql(
        """SELECT signal_uuid, round(sg * (x - 1000) * shares - 1000 * shares * 0.002, 4) AS net_amount, round(sg * (x - 1000) / 1000 - 0.002, 6) AS net_pct, round(sg * (x - 1000) / 20, 4) AS r_multiple_now, (close_date - opened_at) * 24.0::DOUBLE AS held_hours
  FROM (SELECT *, CASE WHEN signal = 'LONG' THEN 1 ELSE -1 END AS sg, 1000.0::DOUBLE + CASE WHEN signal = 'LONG' THEN 1 ELSE -1 END * pnl_points * 10 AS x FROM ledger)""",
        "ledger",
    ),
)


def _closed(spark, d):
    """Ledger rows as positions opened at 1000 with a 2 % stop."""
    sign = F.when(F.col("signal") == "LONG", 1.0).otherwise(-1.0)
    return src.ledger(spark, d).withColumns({"entry_price": F.lit(1000.0), "exit_price": 1000 + sign * F.col("pnl_points") * 10, "stop_price": 1000 - sign * 20})


register(
    "walk_forward_windows",
    lambda spark, d: bt.walk_forward(src.bars(spark, d)),
    sql("""SELECT ticker, CAST(k AS INT) AS fold, CAST(k * 126 AS INT) AS train_start, CAST(k * 126 + 504 AS INT) AS train_end, CAST(k * 126 + 504 AS INT) AS test_start, CAST(k * 126 + 630 AS INT) AS test_end
  FROM (SELECT ticker, count(*) AS n FROM bars GROUP BY 1), range(0, 1000) r(k) WHERE k * 126 + 630 <= n""", "bars"),
)
define("fr", """SELECT ticker, CAST(floor((i - 504) / 126) AS INT) AS fold, count(*) AS n, round(count(*) FILTER (net > 0) / count(*), 4) AS wr, coalesce(sum(net) FILTER (net > 0) / -sum(net) FILTER (net < 0), 0) AS pf FROM bo WHERE i >= 504 GROUP BY 1, 2""", "bo")
define("fs", "SELECT ticker, round(avg(wr), 4) AS m, round(stddev_pop(wr), 4) AS s, min(wr) AS lo, round(avg(pf), 3) AS pm, round(min(pf), 3) AS pn, count(*) FILTER (wr > 0.5) AS ok, count(*) AS n, CAST(sum(n) AS BIGINT) AS tt FROM fr GROUP BY 1", "fr")
register(
    "fold_stability",
    lambda spark, d: bt.stability(bt.fold_results(done(spark, d)[0])),
    sql("SELECT ticker, m AS win_rate_mean, s AS win_rate_std, lo AS win_rate_min, pm AS pf_mean, pn AS pf_min, ok AS profitable_folds, n AS total_folds, tt AS total_trades, round(ok / n, 4) AS consistency FROM fs", "fs"),
)


def judged(spark, d):
    m = lq.metrics(src.ledger(spark, d))
    return m.join(bt.stability(bt.fold_results(done(spark, d)[0])).select("ticker", "consistency"), "ticker")


register(
    "deployability",
    lambda spark, d: bt.deployability(judged(spark, d)).select("ticker", F.array_join("fail_reasons", ",").alias("fail_reasons"), "deployable"),
    sql("""SELECT ticker, f AS fail_reasons, f = '' AS deployable FROM (SELECT p.ticker, concat_ws(',', CASE WHEN win_rate < 0.52 THEN 'win_rate' END, CASE WHEN profit_factor < 1.4 THEN 'profit_factor' END, CASE WHEN abs(dd) > 0.22 THEN 'max_drawdown' END,
    CASE WHEN round(ok / n, 4) < 0.6 THEN 'consistency' END, CASE WHEN n_trades < 30 THEN 'n_trades' END) AS f FROM pmx p JOIN fs USING (ticker))""", "pmx", "fs"),
)
register(
    "scale_gate",
    lambda spark, d: bt.scale_gate(lq.metrics(src.ledger(spark, d))).select("ticker", "scale_up"),
    sql("SELECT ticker, win_rate >= 0.52 AND profit_factor >= 1.5 AND sh >= 1 AND abs(dd) <= 0.2 AND n_trades >= 50 AS scale_up FROM pmx", "pmx"),
)
