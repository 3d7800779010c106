"""Candlestick and chart-pattern queries."""

from __future__ import annotations

from ..operators import patterns as pt
from ..sources import adapters as src
from .oracle import define, sql
from .registry import register
from .technical import W, guarded

define(
    "pt1",
    f"""SELECT *, abs(close - open) AS b, high - low AS rg, close > open AS u, greatest(open, close) AS tp, least(open, close) AS bt, lag(open) {W}) AS o1, lag(close) {W}) AS c1,
    lag(open, 2) {W}) AS o2, lag(close, 2) {W}) AS c2, high - greatest(open, close) AS uw, least(open, close) - low AS lw FROM bars""",
    "bars",
)
_PATS = {
    "engulfing": "CASE WHEN b > abs(c1 - o1) AND NOT c1 > o1 AND u AND open <= c1 AND close >= o1 THEN 1 WHEN b > abs(c1 - o1) AND c1 > o1 AND NOT u AND open >= c1 AND close <= o1 THEN -1 ELSE 0 END",
    "hammer": "CASE WHEN rg <> 0 AND lw > 2 * b AND uw < 0.3 * b AND b > 0 THEN 1 ELSE 0 END",
    "shooting_star": "CASE WHEN rg <> 0 AND uw > 2 * b AND lw < 0.3 * b AND b > 0 THEN -1 ELSE 0 END",
    "doji": "CASE WHEN rg <> 0 AND b / rg < 0.1 THEN 0.5 ELSE 0 END",
    "morning_star": "CASE WHEN NOT c2 > o2 AND abs(c1 - o1) < abs(c2 - o2) * 0.3 AND u AND close > (o2 + c2) / 2 THEN 1 ELSE 0 END",
    "evening_star": "CASE WHEN c2 > o2 AND abs(c1 - o1) < abs(c2 - o2) * 0.3 AND NOT u AND close < (o2 + c2) / 2 THEN -1 ELSE 0 END",
    "marubozu": "CASE WHEN rg <> 0 AND b / rg > 0.92 THEN CASE WHEN u THEN 1 ELSE -1 END ELSE 0 END",
    "harami": "CASE WHEN tp < greatest(o1, c1) AND bt > least(o1, c1) THEN CASE WHEN u THEN 0.5 ELSE -0.5 END ELSE 0 END",
    "spinning_top": "CASE WHEN rg <> 0 AND b / rg < 0.3 AND uw > b AND lw > b THEN 0.3 ELSE 0 END",
    "three_soldiers": "CASE WHEN u AND c1 > o1 AND c2 > o2 AND close > c1 AND c1 > c2 THEN 1 ELSE 0 END",
    "three_crows": "CASE WHEN NOT u AND NOT c1 > o1 AND NOT c2 > o2 AND close < c1 AND c1 < c2 THEN -1 ELSE 0 END",
}
define("pt2", f"SELECT *, {', '.join(f'CAST({e} AS DOUBLE) AS p_{n}' for n, e in _PATS.items())} FROM pt1", "pt1")

for _n in _PATS:
    _triple = _n.startswith("three")
    register(
        f"pat_{_n}",
        lambda spark, d, n=_n, t=_triple: pt.candles(src.bars(spark, d), classical_triples=t).select("ticker", "ts", f"pat_{n}"),
        sql(f"SELECT ticker, ts, p_{_n} AS pat_{_n} FROM pt2", "pt2"),
    )

_SCORED = {n: w for n, w in pt.WEIGHTS.items() if not n.startswith("three")}
define(
    "pt3",
    f"""SELECT *, round(greatest(-100, least(100, {' + '.join(f'p_{n} * {w} * 20' for n, w in _SCORED.items())})), 1) AS sc,
    {' + '.join(f'(p_{n} > 0)::INT' for n in _SCORED)} AS nb, {' + '.join(f'(p_{n} < 0)::INT' for n in _SCORED)} AS ns FROM pt2""",
    "pt2",
)
register(
    "pattern_score",
    lambda spark, d: pt.pattern_score(pt.candles(src.bars(spark, d))).select("ticker", "ts", "pattern_score", "pattern_signal", "pattern_bull_count", "pattern_bear_count"),
    sql(
        """SELECT ticker, ts, sc AS pattern_score, CASE WHEN sc > 60 THEN 'STRONG_BULL_PATTERN' WHEN sc > 30 THEN 'BULL_PATTERN' WHEN sc < -60 THEN 'STRONG_BEAR_PATTERN' WHEN sc < -30 THEN 'BEAR_PATTERN'
    ELSE 'NO_PATTERN' END AS pattern_signal, nb AS pattern_bull_count, ns AS pattern_bear_count FROM pt3""",
        "pt3",
    ),
)
define("cr0", f"SELECT ticker, ts, close, row_number() {W}) - 1 AS i FROM bars", "bars")
define(
    "cr_rec",
    """SELECT ticker, i, ts, close AS nf, 1.0::DOUBLE AS df, close AS ns, 1.0::DOUBLE AS ds FROM cr0 WHERE i = 0
  UNION ALL SELECT b.ticker, b.i, b.ts, b.close + r.nf * (1 - 2.0::DOUBLE / 21), 1 + r.df * (1 - 2.0::DOUBLE / 21), b.close + r.ns * (1 - 2.0::DOUBLE / 51), 1 + r.ds * (1 - 2.0::DOUBLE / 51)
  FROM cr_rec r JOIN cr0 b ON b.ticker = r.ticker AND b.i = r.i + 1""",
    "cr0",
)
define("cr1", f"SELECT ticker, ts, round(nf / df, 8) AS f, round(ns / ds, 8) AS s, lag(round(nf / df, 8)) {W}) AS pf, lag(round(ns / ds, 8)) {W}) AS ps FROM cr_rec", "cr_rec")
register(
    "ema_cross",
    lambda spark, d: pt.crosses(src.bars(spark, d)).select("ticker", "ts", "chart_golden_cross", "chart_death_cross"),
    sql("SELECT ticker, ts, coalesce((pf < ps AND f > s)::INT, 0) AS chart_golden_cross, coalesce((pf > ps AND f < s)::INT, 0) AS chart_death_cross FROM cr1", "cr1"),
)
define("bk0", f"SELECT *, 4 * {guarded('stddev_samp(close)', 'close', 20)} / {guarded('avg(close)', 'close', 20)} AS w, {guarded('max(high)', 'high', 20)} AS h20, {guarded('avg(volume)', 'volume', 10)} AS v10 FROM bars", "bars")
define("bk1", f"SELECT *, {guarded('quantile_cont(w, 0.15)', 'w', 60)} AS p15 FROM bk0", "bk0")
for _k, _e in {
    "volume_breakout": f"close > lag(h20) {W}) AND volume > v10 * 1.5",
    "bb_breakout": f"lag(w, 4) {W}) < lag(p15, 4) {W}) AND w > lag(w, 2) {W})",
    "inside_bar": f"high < lag(high) {W}) AND low > lag(low) {W})",
}.items():
    register(
        _k,
        lambda spark, d, k=_k: pt.breakouts(src.bars(spark, d)).select("ticker", "ts", f"chart_{k}"),
        sql(f"SELECT ticker, ts, coalesce(({_e})::INT, 0) AS chart_{_k} FROM bk1", "bk1"),
    )
