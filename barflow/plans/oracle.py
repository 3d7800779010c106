"""DuckDB common table expressions the SQL checks are built from."""

from __future__ import annotations

_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def define(name: str, body: str, *needs: str) -> None:
    _CTES[name] = (body, needs)


def _collect(name: str, seen: list[str]) -> None:
    for need in _CTES[name][1]:
        _collect(need, seen)
    if name not in seen:
        seen.append(name)


class Check:
    """A SQL check; its CTEs are resolved once every domain is loaded."""

    def __init__(self, select: str, needs: tuple[str, ...]):
        self.select, self.needs = select, needs

    def render(self) -> str:
        return _render(self.select, *self.needs)


def sql(select: str, *needs: str) -> Check:
    """``select`` over the named CTEs and everything they need."""
    return Check(select, needs)


def _render(select: str, *needs: str) -> str:
    order: list[str] = []
    for need in needs:
        _collect(need, order)
    if not order:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_CTES[n][0]})" for n in order) + "\n" + select


define(
    "line_px",
    """SELECT r_name, s_name, n_nationkey, l_orderkey * 8 + l_linenumber AS k, l_quantity, CAST(l_shipdate AS DATE) AS ts,
    CAST(round(1000 * (1 + l_discount - l_tax)) AS BIGINT) + CAST(l_quantity AS BIGINT)
      + 2 * abs(((date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 240) + 240) % 240 - 120) AS px
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)

for _name, _key in (("bars", "r_name"), ("supplier_bars", "s_name")):
    define(
        _name,
        f"""SELECT {_key} AS ticker, ts, CAST(first(px ORDER BY k, px) AS DOUBLE) AS open, CAST(max(px) AS DOUBLE) AS high, CAST(min(px) AS DOUBLE) AS low,
    CAST(last(px ORDER BY k, px) AS DOUBLE) AS close, sum(l_quantity) AS volume FROM line_px GROUP BY 1, 2""",
        "line_px",
    )

define(
    "ticks",
    "SELECT event_type AS ticker, ts, event_id, CAST(200000 + round(value * 100) AS BIGINT) AS milli FROM events",
)
define(
    "bars_intraday",
    """SELECT ticker, time_bucket(INTERVAL '30 minutes', ts) AS ts, first(milli ORDER BY t.ts, event_id) / 1000.0::DOUBLE AS open, max(milli) / 1000.0::DOUBLE AS high,
    min(milli) / 1000.0::DOUBLE AS low, last(milli ORDER BY t.ts, event_id) / 1000.0::DOUBLE AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM ticks t GROUP BY ticker, time_bucket(INTERVAL '30 minutes', t.ts)""",
    "ticks",
)
define(
    "chain",
    """SELECT r_name AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS fetched_at, p_size AS strike,
    coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0.0::DOUBLE) AS ce_oi,
    coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0.0::DOUBLE) AS pe_oi,
    coalesce(CAST(sum(CASE WHEN l_returnflag = 'A' THEN round(l_discount * 100) END) AS DOUBLE) / (count(*) FILTER (l_returnflag = 'A') * 100), 0.0::DOUBLE) AS ce_price,
    coalesce(CAST(sum(CASE WHEN l_returnflag = 'R' THEN round(l_discount * 100) END) AS DOUBLE) / (count(*) FILTER (l_returnflag = 'R') * 100), 0.0::DOUBLE) AS pe_price,
    CAST(sum(round(l_tax * 100)) AS DOUBLE) / (count(*) * 100) AS iv, count(*) AS n_lines
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""",
)
define(
    "spotted",
    "SELECT *, CAST(sum(strike * n_lines) OVER (PARTITION BY ticker, fetched_at) AS DOUBLE) / sum(n_lines) OVER (PARTITION BY ticker, fetched_at) AS spot FROM chain",
    "chain",
)
define(
    "flows0",
    """SELECT CAST(o_orderdate AS DATE) AS trade_date, CAST(round(o_totalprice * 100) AS BIGINT) AS c, c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AS fgn,
    o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS buy FROM orders JOIN customer ON o_custkey = c_custkey""",
)
define(
    "flows",
    """SELECT *, round(fii_buy_cr - fii_sell_cr, 6) AS fii_net_cr, round(dii_buy_cr - dii_sell_cr, 6) AS dii_net_cr FROM (
    SELECT trade_date, CAST(coalesce(sum(c) FILTER (fgn AND buy), 0) AS DOUBLE) / 1e6 AS fii_buy_cr, CAST(coalesce(sum(c) FILTER (fgn AND NOT buy), 0) AS DOUBLE) / 1e6 AS fii_sell_cr,
      CAST(coalesce(sum(c) FILTER (NOT fgn AND buy), 0) AS DOUBLE) / 1e6 AS dii_buy_cr, CAST(coalesce(sum(c) FILTER (NOT fgn AND NOT buy), 0) AS DOUBLE) / 1e6 AS dii_sell_cr
    FROM flows0 GROUP BY 1)""",
    "flows0",
)
define(
    "ledger0",
    """SELECT *, CAST(round((l_discount - l_tax) * 100) AS BIGINT) - 1 AS pct, CAST(round(l_extendedprice * 100) AS BIGINT) AS cts, r_name AS ticker
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
define(
    "ledger",
    """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cts) AS signal_uuid, l_orderkey * 8 + l_linenumber AS trade_no, ticker,
    CASE WHEN l_returnflag = 'R' THEN 'SHORT' ELSE 'LONG' END AS signal,
    ['swing', 'intraday', 'positional'][l_linenumber % 3 + 1] AS category,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'BULL_TRENDING' WHEN '2-HIGH' THEN 'BEAR_TRENDING' WHEN '3-MEDIUM' THEN 'HIGH_VOLATILITY' ELSE 'CHOPPY_SIDEWAYS' END AS regime,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'A+' WHEN 'AUTOMOBILE' THEN 'A' WHEN 'MACHINERY' THEN 'B' WHEN 'HOUSEHOLD' THEN 'C' ELSE 'F' END AS alignment,
    round(0.5 + l_discount * 4, 2) AS confidence,
    CASE WHEN l_tax < 0.02 THEN 'A' WHEN l_tax < 0.04 THEN 'B' WHEN l_tax < 0.06 THEN 'C' ELSE 'D' END AS entry_quality,
    CASE WHEN l_linestatus = 'O' THEN 1 WHEN l_returnflag = 'A' THEN 0 END AS regime_match,
    CAST(o_orderdate AS DATE) AS opened_at, CAST(o_orderdate AS DATE) + l_linenumber * 3 AS close_date, l_linenumber * 72.0::DOUBLE AS hold_hours,
    pct AS pnl_points, pct / 100.0::DOUBLE AS pnl_pct, cts * pct AS pnl_e4, cts * pct / 10000.0::DOUBLE AS pnl_amount, round(pct / 2.0::DOUBLE, 2) AS r_multiple,
    (greatest(pct, 0) + 1) / 100.0::DOUBLE AS mfe, (least(pct, 0) - 1) / 100.0::DOUBLE AS mae, l_quantity AS shares, cts AS value_cents,
    CASE WHEN pct > 2 THEN 'TARGET' WHEN pct < -2 THEN 'STOP_LOSS' ELSE 'TIME_EXIT' END AS exit_reason FROM ledger0""",
    "ledger0",
)
define(
    "news",
    """SELECT doc_id, source AS ticker, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at,
    CASE WHEN instr(text, chr(10)) > 0 THEN text[:instr(text, chr(10)) - 1] ELSE text END AS title,
    CASE WHEN instr(text, chr(10)) > 0 THEN text[instr(text, chr(10)) + 1:] ELSE '' END AS summary FROM documents""",
)
define(
    "cycles0",
    """SELECT event_id, user_id AS key, ts, event_type AS category, CAST(round(value * 100) AS BIGINT) % 97 + 1 AS lw,
    coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 31 + 1 AS fw, (event_id * 7) % 89 + 1 AS sw FROM events""",
)
define(
    "cycles",
    """SELECT event_id, key, ts, category, round(lw / (lw + fw + sw), 6) AS prob_long, round(fw / (lw + fw + sw), 6) AS prob_flat, round(sw / (lw + fw + sw), 6) AS prob_short FROM cycles0""",
    "cycles0",
)
define(
    "clean",
    """SELECT * EXCLUDE (mv) FROM (SELECT *, abs(close / lag(close) OVER (PARTITION BY ticker ORDER BY ts) - 1) AS mv FROM bars) WHERE mv < 0.26""",
    "bars",
)

SERIES_NAMES = "sp500 nasdaq dow us_vix india_vix crude gold copper dxy usdinr us_10y us_2y nifty banknifty jpmorgan hsbc".split()
SERIES_DIVISORS = [1, 1, 1, 70, 65, 12.5, 1, 1, 10, 12.5, 250, 260, 1, 1, 1, 1]
define(
    "series",
    f"""SELECT {SERIES_NAMES}[n_nationkey + 1] AS name, ts, CAST(last(px ORDER BY k, px) AS DOUBLE) / {SERIES_DIVISORS}[n_nationkey + 1]::DOUBLE AS close FROM line_px WHERE n_nationkey < 16 GROUP BY n_nationkey, ts""",
    "line_px",
)
define(
    "holding",
    """SELECT r_name AS ticker, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, """
    + ", ".join(
        f"round(CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (c_mktsegment = '{s}'), 0) AS DOUBLE) / sum(CAST(round(o_totalprice * 100) AS BIGINT)) * 100, 4) AS {c}"
        for c, s in (("promoter_pct", "BUILDING"), ("fii_pct", "AUTOMOBILE"), ("dii_pct", "MACHINERY"), ("public_pct", "HOUSEHOLD"), ("pledge_pct", "FURNITURE"))
    )
    + """ FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
define(
    "fund0",
    """SELECT r_name AS ticker, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS fetched_at, CAST(sum(round(l_tax * 100)) AS DOUBLE) / count(*) - 4 AS tax, CAST(sum(round(l_discount * 100)) AS DOUBLE) / count(*) - 5 AS disc,
    sum(l_quantity) / count(*) - 25.5 AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
define(
    "fund",
    """SELECT ticker, fetched_at, round(3.5 + tax * 4, 4) AS nim, round(1.8 + disc * 4, 4) AS npa_gross, round(44 + qty * 4, 4) AS casa_ratio, round(14 + tax * 40, 4) AS loan_growth, round(15 + disc * 20, 4) AS roe,
    round(3 + qty, 4) AS pb_ratio, round(20 + disc * 10, 4) AS eps, row_number() OVER (PARTITION BY ticker ORDER BY fetched_at) AS q FROM fund0""",
    "fund0",
)
define("earn", "SELECT * FROM (SELECT ticker, fetched_at + 14 AS result_date, eps AS actual_eps, lag(eps) OVER (PARTITION BY ticker ORDER BY fetched_at) AS estimated_eps FROM fund) WHERE estimated_eps IS NOT NULL", "fund")
define(
    "rates",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS effective_date, 6.0::DOUBLE + count(*) FILTER (o_orderpriority = '1-URGENT') % 5 * 0.25::DOUBLE AS rbi_rate, round(count(*) % 12 + 5.0::DOUBLE, 2) AS credit_growth FROM orders GROUP BY 1""",
)
define("meet", "SELECT CAST(max(o_orderdate) AS DATE) AS event_date FROM orders WHERE month(o_orderdate) % 2 = 0 GROUP BY date_trunc('month', o_orderdate)")
