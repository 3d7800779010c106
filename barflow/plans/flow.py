"""Flow and ownership queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow as fl
from ..operators import joins as jn
from ..operators import orderflow as of
from ..sources import adapters as src
from .oracle import define, sql
from .registry import register

_T = "OVER (ORDER BY trade_date ROWS BETWEEN {} PRECEDING AND {})"


def _t(c: str) -> str:
    w3 = _T.format(2, "CURRENT ROW")
    return f"CASE WHEN count(*) {w3} < 3 THEN 'NEUTRAL' WHEN count(*) FILTER ({c} > 0) {w3} = 3 THEN 'BUYING' WHEN count(*) FILTER ({c} > 0) {w3} = 0 THEN 'SELLING' ELSE 'MIXED' END"


_B = _T.format(19, "1 PRECEDING")
define(
    "fl1",
    "SELECT trade_date, "
    + ", ".join(f"round(sum({s}_net_cr) {_T.format(n - 1, 'CURRENT ROW')}, 6) AS {s}_net_{n}d_cr" for s, n in (("fii", 1), ("fii", 3), ("fii", 5), ("fii", 10), ("dii", 1), ("dii", 3)))
    + f""", {_t('fii_net_cr')} AS fii_trend, {_t('dii_net_cr')} AS dii_trend,
    round(CASE WHEN count(*) {_B} >= 5 AND stddev_pop(fii_net_cr) {_B} > 0 THEN greatest(-3, least(3, (fii_net_cr - avg(fii_net_cr) {_B}) / stddev_pop(fii_net_cr) {_B})) ELSE 0 END, 6) AS fii_flow_surprise FROM flows""",
    "flows",
)
define(
    "fl2",
    """SELECT *, CASE WHEN fii_net_5d_cr > 500 AND dii_net_3d_cr > 0 THEN 'BOTH_BUYING' WHEN fii_net_5d_cr < -500 AND dii_net_3d_cr < 0 THEN 'BOTH_SELLING' ELSE 'MIXED' END AS flow_confluence,
    greatest(-1, least(1, fii_net_5d_cr / 5000)) AS fii_signal, greatest(-1, least(1, dii_net_3d_cr / 5000)) AS dii_signal,
    CASE WHEN fii_net_5d_cr > 2000 THEN 'STRONG BUY' WHEN fii_net_5d_cr > 500 THEN 'BUYING' WHEN fii_net_5d_cr < -2000 THEN 'STRONG SELL' WHEN fii_net_5d_cr < -500 THEN 'SELLING' ELSE 'NEUTRAL' END AS fii_signal_text FROM fl1""",
    "fl1",
)
define(
    "bulk",
    """SELECT *, round(buy_cr - sell_cr, 6) AS bulk_net_cr, buy_cr > sell_cr AS bulk_is_buying, n_deals > 0 AS bulk_deal_detected FROM (SELECT CAST(o_orderdate AS DATE) AS trade_date,
    CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')), 0) AS DOUBLE) / 1e6 AS buy_cr,
    CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')), 0) AS DOUBLE) / 1e6 AS sell_cr, count(*) AS n_deals FROM orders GROUP BY 1)""",
)
define(
    "blk0",
    """SELECT r_name AS ticker, CAST(l_shipdate AS DATE) AS trade_date, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS net, count(*) AS n_deals
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2""",
)
define("blk", "SELECT ticker, trade_date, n_deals, net / 1e6 AS block_net_cr, CAST(sum(net) OVER (PARTITION BY ticker ORDER BY trade_date RANGE BETWEEN INTERVAL 5 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE) / 1e6 AS block_5d_net_cr, net > 0 AS block_is_buying FROM blk0", "blk0")
_Q = "OVER (PARTITION BY ticker ORDER BY quarter)"
define(
    "hold2",
    f"""SELECT *, round(coalesce(promoter_pct - lag(promoter_pct) {_Q}, 0), 4) AS promoter_qoq, CASE WHEN promoter_pct > lag(promoter_pct) {_Q} AND lag(promoter_pct) {_Q} > lag(promoter_pct, 2) {_Q} THEN 'INCREASING'
    WHEN promoter_pct < lag(promoter_pct) {_Q} AND lag(promoter_pct) {_Q} < lag(promoter_pct, 2) {_Q} THEN 'DECREASING' ELSE 'STABLE' END AS promoter_trend,
    round(coalesce(dii_pct - lag(dii_pct) {_Q}, 0), 4) AS dii_qoq, round(fii_pct + dii_pct, 4) AS total_institutional FROM holding""",
    "holding",
)
define(
    "ins0",
    """SELECT h.*, b.block_5d_net_cr, b.block_is_buying FROM hold2 h ASOF LEFT JOIN blk b ON b.ticker = h.ticker AND h.quarter >= b.trade_date""",
    "hold2", "blk",
)
define(
    "ins1",
    """SELECT *, round(greatest(-1, least(1, CASE promoter_trend WHEN 'INCREASING' THEN 0.4 WHEN 'DECREASING' THEN -0.4 ELSE 0 END::DOUBLE + greatest(-0.3::DOUBLE, least(0.3::DOUBLE, promoter_qoq * 10))
    + CASE WHEN pledge_pct > 20 THEN -0.3 WHEN pledge_pct > 10 THEN -0.1 ELSE 0 END::DOUBLE + CASE WHEN coalesce(block_5d_net_cr, 0) > 200 THEN 0.2 WHEN coalesce(block_5d_net_cr, 0) < -200 THEN -0.2 ELSE 0 END::DOUBLE)), 3) AS insider_score FROM ins0""",
    "ins0",
)

R6 = lambda *c: [F.round(x, 6).alias(x) for x in c]


def rolled(spark, d):
    return fl.rolling(src.flows(spark, d))


def insider(spark, d):
    h = fl.holding_breakdown(fl.promoter_trend(src.shareholding(spark, d)))
    blocks = src.kept(spark, d, ("block_features",), lambda: fl.block_features(src.block_deals(spark, d)))
    return fl.insider_score(jn.asof_day(h, blocks, ["block_5d_net_cr", "block_is_buying"], left_ts="quarter", right_ts="trade_date"))


_SUMS = ["fii_net_1d_cr", "fii_net_3d_cr", "fii_net_5d_cr", "fii_net_10d_cr", "dii_net_1d_cr", "dii_net_3d_cr"]
register("flow_daily", lambda spark, d: src.flows(spark, d).select("trade_date", *R6("fii_buy_cr", "fii_sell_cr", "fii_net_cr", "dii_buy_cr", "dii_sell_cr", "dii_net_cr")),
         sql("SELECT trade_date, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("fii_buy_cr", "fii_sell_cr", "fii_net_cr", "dii_buy_cr", "dii_sell_cr", "dii_net_cr")) + " FROM flows", "flows"))
register("flow_rolling", lambda spark, d: rolled(spark, d).select("trade_date", *_SUMS), sql(f"SELECT trade_date, {', '.join(_SUMS)} FROM fl1", "fl1"))
register("flow_trend", lambda spark, d: rolled(spark, d).select("trade_date", "fii_trend", "dii_trend"), sql("SELECT trade_date, fii_trend, dii_trend FROM fl1", "fl1"))
register("flow_confluence", lambda spark, d: rolled(spark, d).select("trade_date", "flow_confluence", "fii_signal_text"), sql("SELECT trade_date, flow_confluence, fii_signal_text FROM fl2", "fl2"))
register("flow_surprise", lambda spark, d: rolled(spark, d).select("trade_date", "fii_flow_surprise"), sql("SELECT trade_date, fii_flow_surprise FROM fl1", "fl1"))
register("flow_norm", lambda spark, d: rolled(spark, d).select("trade_date", *R6("fii_signal", "dii_signal")), sql("SELECT trade_date, round(fii_signal, 6) AS fii_signal, round(dii_signal, 6) AS dii_signal FROM fl2", "fl2"))
register(
    "bulk_deal_summary",
    lambda spark, d: fl.bulk_summary(src.bulk_deals(spark, d)).select("trade_date", *R6("buy_cr", "sell_cr"), "bulk_net_cr", "bulk_is_buying", "bulk_deal_detected", "n_deals"),
    sql("SELECT trade_date, round(buy_cr, 6) AS buy_cr, round(sell_cr, 6) AS sell_cr, bulk_net_cr, bulk_is_buying, bulk_deal_detected, n_deals FROM bulk", "bulk"),
)
register(
    "block_deal_features",
    lambda spark, d: fl.block_features(src.block_deals(spark, d)).select("ticker", "trade_date", "n_deals", *R6("block_net_cr", "block_5d_net_cr"), "block_is_buying"),
    sql("SELECT ticker, trade_date, n_deals, round(block_net_cr, 6) AS block_net_cr, round(block_5d_net_cr, 6) AS block_5d_net_cr, block_is_buying FROM blk", "blk"),
)
register("promoter_trend", lambda spark, d: fl.promoter_trend(src.shareholding(spark, d)).select("ticker", "quarter", "promoter_pct", "promoter_qoq", "promoter_trend", "pledge_pct"),
         sql("SELECT ticker, quarter, promoter_pct, promoter_qoq, promoter_trend, pledge_pct FROM hold2", "hold2"))
register("holding_breakdown", lambda spark, d: fl.holding_breakdown(src.shareholding(spark, d)).select("ticker", "quarter", "fii_pct", "dii_pct", "dii_qoq", "total_institutional"),
         sql("SELECT ticker, quarter, fii_pct, dii_pct, dii_qoq, total_institutional FROM hold2", "hold2"))
register(
    "insider_score",
    lambda spark, d: insider(spark, d).select("ticker", "quarter", "insider_score", "insider_signal"),
    sql("""SELECT ticker, quarter, insider_score, CASE WHEN insider_score > 0.4 THEN 'STRONG_BULL' WHEN insider_score > 0.1 THEN 'MILD_BULL' WHEN insider_score < -0.4 THEN 'STRONG_BEAR'
    WHEN insider_score < -0.1 THEN 'MILD_BEAR' ELSE 'NEUTRAL' END AS insider_signal FROM ins1""", "ins1"),
)


def flow_frame(spark, d):
    """Bars with order flow, market flows, bulk deals and ownership, each as of the bar."""
    x = of.order_flow(src.bars(spark, d)).select("ticker", "ts", "order_flow_score", "delta_divergence_flag", "absorption_detected", "inst_bias")
    x = jn.asof_day(x, rolled(spark, d), [*_SUMS, "fii_signal", "fii_flow_surprise", "flow_confluence"], key=None, right_ts="trade_date")
    x = jn.asof_day(x, fl.bulk_summary(src.bulk_deals(spark, d)), ["bulk_net_cr"], key=None, right_ts="trade_date")
    return jn.asof_day(x, insider(spark, d), ["insider_score", "promoter_qoq", "block_5d_net_cr", "block_is_buying"], right_ts="quarter")


_c = lambda e: f"round(least(greatest(coalesce({e}, 0), -1), 1), 10)"
_FL = {
    "fii_5d_norm": _c("fii_net_5d_cr / 5000"), "fii_signal": "round(fii_signal, 10)", "fii_flow_surprise": _c("fii_flow_surprise / 3.0::DOUBLE"), "dii_3d_norm": _c("dii_net_3d_cr / 2000"),
    "bulk_deal_norm": _c("bulk_net_cr / 200"), "flow_confluence_score": "CASE flow_confluence WHEN 'BOTH_BUYING' THEN 1 WHEN 'BOTH_SELLING' THEN -1 ELSE 0 END", "insider_score": _c("insider_score"),
    "promoter_change": _c("promoter_qoq * 20"), "block_5d_norm": _c("block_5d_net_cr / 500"), "block_is_buying": "coalesce(block_is_buying::INT, 0)", "order_flow_score": _c("sc"),
    "delta_divergence": "CASE WHEN dv LIKE '%DIVERGENCE' THEN 1 ELSE 0 END", "absorption_flag": "absorbed::INT",
    "institutional_bias": "CASE ib WHEN 'INSTITUTIONAL_BUYING' THEN 1 WHEN 'INSTITUTIONAL_SELLING' THEN -1 ELSE 0 END",
}
define(
    "flf",
    """SELECT o.ticker, o.ts, o.sc, o.dv, o.absorbed, o.ib, f.* EXCLUDE (trade_date), b.bulk_net_cr, i.insider_score, i.promoter_qoq, i.block_5d_net_cr, i.block_is_buying FROM of5 o
    ASOF LEFT JOIN fl2 f ON o.ts >= f.trade_date ASOF LEFT JOIN bulk b ON o.ts >= b.trade_date ASOF LEFT JOIN ins1 i ON i.ticker = o.ticker AND o.ts >= i.quarter""",
    "of5", "fl2", "bulk", "ins1",
)
register("flow_features", lambda spark, d: fl.features(flow_frame(spark, d)), sql(f"SELECT ticker, ts, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _FL.items())} FROM flf", "flf"))
