"""Ingestion queries: table rows are rendered as the landed text would be, then parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import parse_date, parse_time
from ..operators import joins as jn
from ..operators import technical as ta
from ..sources import adapters as src
from ..sources import landing as ld
from ..streaming import jobs
from .gates import model_probs
from .oracle import define, sql
from .registry import register

num = lambda c: F.format_number(c, 6)


def flow_text(spark, d):
    """Flows as CSV text: day-month-year dates, thousands commas, NA on every 31st."""
    na = F.dayofmonth("trade_date") == 31
    return src.flows(spark, d).select(F.date_format("trade_date", "d MMM yyyy").alias("date"), F.when(na, "NA").otherwise(num("fii_buy_cr")).alias("buy"), num("fii_sell_cr").alias("sell"), num("fii_net_cr").alias("net"), "trade_date")


register(
    "ingest_flow_csv",
    lambda spark, d: ld.ingest_new(ld.parse_flow(flow_text(spark, d)), src.flows(spark, d).where(F.col("trade_date") < "1996-01-01")),
    sql("SELECT trade_date, CASE WHEN day(trade_date) = 31 THEN 0 ELSE fii_buy_cr END AS buy, fii_sell_cr AS sell, fii_net_cr AS net FROM flows WHERE trade_date >= DATE '1996-01-01'", "flows"),
)


def _double(spark, d):
    raw = flow_text(spark, d)
    late = raw.withColumn("net", num(F.regexp_replace("net", ",", "").cast("double") + 1000000))
    return jn.keep_first(ld.parse_flow(raw).withColumn("o", F.lit(0)).unionByName(ld.parse_flow(late).withColumn("o", F.lit(1))), ["trade_date"], ["o"]).drop("o")


register("ingest_flow_union_dedupe", _double, sql("SELECT trade_date, CASE WHEN day(trade_date) = 31 THEN 0 ELSE fii_buy_cr END AS buy, fii_sell_cr AS sell, fii_net_cr AS net FROM flows", "flows"))


def _upsert(spark, d):
    f = src.flows(spark, d)
    day = F.dayofmonth("trade_date")
    old = f.where(day % 3 != 0).select("trade_date", F.when(day % 5 != 0, F.when(day % 7 == 0, F.lit(0.0)).otherwise(F.col("fii_net_cr"))).alias("v"))
    new = f.where(day % 2 == 0).select("trade_date", F.round(F.col("fii_net_cr") + 1, 6).alias("v"))
    return jn.upsert_fill_only(old, new, "trade_date", "v")


_UP = """SELECT trade_date, CASE WHEN status = 'skipped' THEN o ELSE n END AS v, status FROM (SELECT *, CASE WHEN d % 3 = 0 THEN 'inserted' WHEN d % 2 = 0 AND (o IS NULL OR abs(o) <= 0.01) THEN 'updated' ELSE 'skipped' END AS status FROM (
  SELECT trade_date, day(trade_date) AS d, CASE WHEN day(trade_date) % 3 <> 0 AND day(trade_date) % 5 <> 0 THEN CASE WHEN day(trade_date) % 7 = 0 THEN 0 ELSE fii_net_cr END END AS o, CASE WHEN day(trade_date) % 2 = 0 THEN round(fii_net_cr + 1, 6) END AS n
  FROM flows WHERE day(trade_date) % 3 <> 0 OR day(trade_date) % 2 = 0))"""
for _k in ("upsert_fill_only", "full_outer_upsert"):
    register(_k, _upsert, sql(_UP, "flows"))


def month_html(spark, d):
    """One HTML table per year with a row per month."""
    m = src.flows(spark, d).groupBy(F.year("trade_date").alias("year"), F.month("trade_date").alias("m")).agg(F.round(F.sum("fii_net_cr"), 6).alias("net"))
    name = F.date_format(F.make_date("year", "m", F.lit(1)), "MMMM")
    row = F.concat(F.lit("<tr><td>"), name, F.lit("</td><td><b>"), num("net"), F.lit("</b></td></tr>"))
    return m.groupBy("year").agg(F.concat(F.lit("<table><tr><th>Month</th><th>Equity</th></tr>"), F.array_join(F.sort_array(F.collect_list(row)), "\n"), F.lit("</table>")).alias("html"))


register(
    "html_table_to_rows",
    lambda spark, d: ld.month_flow_rows(ld.html_table_rows(month_html(spark, d), keep=["year"])).select("month_end", *[F.round(c, 4).alias(c) for c in ("net", "buy", "sell")]),
    sql("SELECT m AS month_end, round(n, 4) AS net, round(greatest(n, 0), 4) AS buy, round(greatest(-n, 0), 4) AS sell FROM (SELECT last_day(trade_date) AS m, round(sum(fii_net_cr), 6) AS n FROM flows GROUP BY 1)", "flows"),
)
register(
    "resolve_column_aliases",
    lambda spark, d: ld.resolve_aliases(
        src.flows(spark, d).select("trade_date", num("fii_buy_cr").alias("Gross Purchase"), num("fii_sell_cr").alias("grossSales")), {"buy": ("buyValue", "gross purchase"), "sell": ("sellValue", "GROSSSALES"), "net": ("netValue",)}
    ).withColumn("net", F.round("net", 6)),
    sql("SELECT trade_date, fii_buy_cr AS buy, fii_sell_cr AS sell, fii_net_cr AS net FROM flows WHERE fii_buy_cr <> 0 OR fii_sell_cr <> 0", "flows"),
)


def category_rows(spark, d):
    """Orders as category flow rows; furniture customers carry a category no bucket takes."""
    o = src.table(spark, d, "orders").join(src.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    names = {"BUILDING": "FII/FPI", "AUTOMOBILE": "Foreign Portfolio", "MACHINERY": "DII", "HOUSEHOLD": "Mutual Fund", "FURNITURE": "Retail"}
    from ..functions.scalars import lookup

    buy = F.col("o_orderpriority").isin(*src.BUY_PRIORITIES)
    return o.select(F.col("o_orderdate").cast("date").alias("date"), lookup("c_mktsegment", names).alias("category"), F.when(buy, src.cents("o_totalprice")).alias("buyValue"), F.when(~buy, src.cents("o_totalprice")).alias("sellValue"))


_S = lambda seg, b: f"CAST(coalesce(sum(c) FILTER (seg IN ({seg}) AND {b}), 0) AS BIGINT)"
_FB, _FS, _DB, _DS = _S("'BUILDING', 'AUTOMOBILE'", "buy"), _S("'BUILDING', 'AUTOMOBILE'", "NOT buy"), _S("'MACHINERY', 'HOUSEHOLD'", "buy"), _S("'MACHINERY', 'HOUSEHOLD'", "NOT buy")
register(
    "flow_rows_by_category",
    lambda spark, d: ld.flow_by_category(category_rows(spark, d)),
    sql(f"""SELECT *, fii_buy - fii_sell AS fii_net, dii_buy - dii_sell AS dii_net FROM (SELECT trade_date, {_FB} AS fii_buy, {_FS} AS fii_sell, {_DB} AS dii_buy, {_DS} AS dii_sell FROM (SELECT CAST(o_orderdate AS DATE) AS trade_date, CAST(round(o_totalprice * 100) AS BIGINT) AS c,
    c_mktsegment AS seg, o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS buy FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1) WHERE fii_buy <> 0 OR fii_sell <> 0 OR dii_buy <> 0 OR dii_sell <> 0"""),
)


def bhavcopy(spark, d):
    """The chain as daily-file rows in both vocabularies: near expiry with real OI, a past and a far one with noise."""
    c = src.chain(spark, d)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(o).alias("oi"), F.col(p).alias("px"), F.lit(x).alias("days"), F.lit(f).alias("f")) for k, o, p in (("CE", "ce_oi", "ce_price"), ("PE", "pe_oi", "pe_price"), ("XX", "ce_oi", "ce_price")) for x, f in ((20, 1), (50, 3), (-10, 5))]))
    x = c.select("ticker", F.col("fetched_at").alias("trade_date"), "strike", kinds.alias("z"))
    old = x.select("trade_date", F.col("ticker").alias("SYMBOL"), F.lit("OPTSTK").alias("INSTRUMENT"), F.date_format(F.date_add("trade_date", F.col("z.days")), "dd-MMM-yyyy").alias("EXPIRY_DT"), F.col("strike").cast("string").alias("STRIKE_PR"), F.col("z.k").alias("OPTION_TYP"), num(F.col("z.oi") * F.col("z.f")).alias("OPEN_INT"), num(F.col("z.px")).alias("CLOSE"))
    new = x.select("trade_date", F.col("ticker").alias("TckrSymb"), F.lit("STO").alias("FinInstrmTp"), F.date_add("trade_date", F.col("z.days")).cast("string").alias("XpryDt"), F.col("strike").cast("string").alias("StrkPric"), F.col("z.k").alias("OptnTp"), num(F.col("z.oi") * F.col("z.f")).alias("OpnIntrst"), num(F.col("z.px")).alias("ClsPric"), F.lit("25.5").alias("UndrlygPric"))
    even = F.month("trade_date") % 2 == 0
    return old.where(even).unionByName(new.where(~even), allowMissingColumns=True)


register(
    "chain_from_bhavcopy",
    lambda spark, d: ld.chain_from_bhavcopy(bhavcopy(spark, d)).select("symbol", "fetched_at", "strike", "ce_oi", "pe_oi", F.round("ce_price", 5).alias("ce_price"), "spot"),
    sql("SELECT ticker AS symbol, fetched_at, CAST(strike AS DOUBLE) AS strike, ce_oi, pe_oi, round(ce_price, 5) AS ce_price, CASE WHEN month(fetched_at) % 2 = 1 THEN 25.5 END::DOUBLE AS spot FROM chain", "chain"),
)


def chain_json(spark, d):
    """One JSON document per snapshot (at most 50 strikes each)."""
    c = src.with_spot(src.chain(spark, d))
    leg = lambda o, p: F.struct(F.col(o).alias("openInterest"), F.col(p).alias("lastPrice"), F.col("iv").alias("impliedVolatility"))
    rows = c.groupBy("ticker", "fetched_at", "spot").agg(F.collect_list(F.struct(F.col("strike").alias("strikePrice"), leg("ce_oi", "ce_price").alias("CE"), leg("pe_oi", "pe_price").alias("PE"))).alias("data"))
    return rows.select("ticker", "fetched_at", F.to_json(F.struct(F.struct(F.col("spot").alias("underlyingValue"), "data").alias("records"))).alias("body"))


register(
    "chain_from_json",
    lambda spark, d: ld.chain_from_json(chain_json(spark, d)).select("ticker", "fetched_at", F.round("spot", 6).alias("spot"), "strike", "ce_oi", "pe_oi", F.round("ce_price", 6).alias("ce_price"), F.round("iv", 6).alias("iv")),
    sql("SELECT ticker, fetched_at, round(spot, 6) AS spot, strike, ce_oi, pe_oi, round(ce_price, 6) AS ce_price, round(iv, 6) AS iv FROM spotted", "spotted"),
)


def _times(spark, d):
    n = src.news(spark, d).withColumn("t", F.col("created_at").cast("timestamp"))
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.date_format("t", "EEE, dd MMM yyyy HH:mm:ss Z")).when(k == 1, F.date_format("t", "yyyyMMdd'T'HHmmss'Z'")).otherwise(F.date_format("t", "yyyy-MM-dd HH:mm:ss"))
    return n.select("doc_id", parse_time(text).cast("timestamp_ntz").alias("published_iso"))


register("news_time_parse", _times, sql("SELECT doc_id, created_at AS published_iso FROM news", "news"))


def _deals(spark, d):
    x = src.table(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("trade_date"), F.col("l_suppkey").cast("string").alias("client"), F.col("l_returnflag").alias("side"), F.format_number(F.col("l_orderkey") * 1000 + F.col("l_partkey"), 0).alias("quantity"), F.format_number(F.col("l_quantity"), 2).alias("price"), F.lit("X").alias("symbol")
    )
    return ld.parse_deals(x, "x").groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


register("deals_parse", _deals, sql("SELECT side, count(*) AS n, CAST(sum(q) AS DOUBLE) AS quantity FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS t, l_suppkey, l_returnflag AS side, l_orderkey * 1000 + l_partkey AS q FROM lineitem) GROUP BY 1"))


def _quarters(spark, d):
    h = src.shareholding(spark, d)
    k = F.month("quarter") % 3
    text = F.when(F.month("quarter") == 1, F.upper(F.date_format("quarter", "dd-MMM-yyyy"))).when(F.month("quarter") == 4, F.date_format("quarter", "dd-MM-yyyy")).when(F.month("quarter") == 7, F.col("quarter").cast("string")).otherwise("garbage")
    return h.select("ticker", F.col("quarter").alias("expected"), parse_date(text).alias("quarter"))


register("quarter_parse", _quarters, sql("SELECT ticker, quarter AS expected, CASE WHEN month(quarter) <> 10 THEN quarter END AS quarter FROM holding", "holding"))


def filings(spark, d):
    """Documents as exchange filings: blank headline on every fifth, category by number."""
    cats = F.array(*[F.lit(c) for c in ("Dividend", "General", "Board Meeting", "Others")])
    n = src.news(spark, d)
    return n.select("doc_id", "ticker", F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("title")).alias("headline"), F.concat(F.lit("sub "), F.col("doc_id").cast("string")).alias("news_sub"), F.get(cats, (F.col("doc_id") % 4).cast("int")).alias("category"), F.to_date("created_at").alias("announcement_date"))


_PRI = " OR ".join(f"contains(lower(t || ' ' || category), '{c.lower()}')" for c in ld.PRIORITY)
define("fil", "SELECT ticker, created_at::DATE AS announcement_date, CASE WHEN doc_id % 5 = 0 OR trim(title) = '' THEN 'sub ' || doc_id ELSE trim(title) END AS t, ['Dividend', 'General', 'Board Meeting', 'Others'][doc_id % 4 + 1] AS category FROM news", "news")
register(
    "announcements_ingest",
    lambda spark, d: ld.announcements(filings(spark, d)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n")),
    sql("SELECT ticker, count(*) AS n FROM (SELECT DISTINCT ticker, t, announcement_date FROM fil) GROUP BY 1", "fil"),
)
register(
    "announcement_priority",
    lambda spark, d: ld.announcements(filings(spark, d).withColumn("ticker", F.col("doc_id").cast("string"))).select("doc_id", "is_high_priority"),
    sql(f"SELECT doc_id, ({_PRI})::INT AS is_high_priority FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR trim(title) = '' THEN 'sub ' || doc_id ELSE trim(title) END AS t, ['Dividend', 'General', 'Board Meeting', 'Others'][doc_id % 4 + 1] AS category FROM news)", "news"),
)


def _texts(spark, d):
    o = src.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("announcement_date"))
    day, k = F.date_add("announcement_date", 10), F.col("o_orderkey") % 6
    fmt = F.when(k == 0, F.date_format(day, "d MMMM yyyy")).when(k == 1, F.date_format(day, "yyyy-MM-dd")).when(k == 2, F.date_format(day, "dd-MM-yyyy")).when(k == 3, F.date_format(day, "MMMM d, yyyy")).when(k == 4, F.date_format(day, "dd/MM/yyyy")).otherwise("soon")
    return ld.event_dates(o.withColumn("text", F.concat(F.lit("Board meeting to be held on "), fmt, F.lit(" to consider results")))).select("o_orderkey", "result_date")


register("earnings_dates_from_text", _texts, sql("SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 6 = 5 THEN 0 ELSE 10 END AS result_date FROM orders"))
_OHLC = ["ticker", "ts", "open", "high", "low", "close", "volume"]
register("bars", lambda spark, d: src.bars(spark, d), sql("SELECT * FROM bars", "bars"))
register("bars_intraday", lambda spark, d: src.bars_intraday(spark, d), sql("SELECT * FROM bars_intraday", "bars_intraday"))
register("supplier_bars", lambda spark, d: src.bars(spark, d, by="s_name"), sql("SELECT * FROM supplier_bars", "supplier_bars"))
register("clean_bars", lambda spark, d: ta.clean_bars(src.bars(spark, d)).select(*_OHLC), sql("SELECT * FROM clean", "clean"))
register(
    "market_hours",
    lambda spark, d: ta.market_hours(src.bars_intraday(spark, d)).select("ticker", "ts", "local_ts"),
    sql("SELECT ticker, ts, l AS local_ts FROM (SELECT ticker, ts, ts + INTERVAL 330 MINUTES AS l FROM bars_intraday) WHERE strftime(l, '%H:%M') BETWEEN '09:15' AND '15:30'", "bars_intraday"),
)
register(
    "resample_bars",
    lambda spark, d: ta.resample(src.bars(spark, d), "week").select(*_OHLC),
    sql("SELECT ticker, CAST(date_trunc('week', b.ts) AS DATE) AS ts, arg_min(open, b.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.ts) AS close, sum(volume) AS volume FROM bars b GROUP BY ticker, date_trunc('week', b.ts)", "bars"),
)
register(
    "drop_forming_bar",
    lambda spark, d: ta.drop_forming(src.bars_intraday(spark, d), src.bars_intraday(spark, d).select(F.max("ts") + F.expr("interval 10 minutes")).scalar(), 30).select("ticker", "ts"),
    sql("SELECT ticker, ts FROM bars_intraday WHERE ts + INTERVAL 30 MINUTES <= (SELECT max(ts) FROM bars_intraday) + INTERVAL 10 MINUTES", "bars_intraday"),
)
register(
    "reconcile_check",
    lambda spark, d: ld.reconcile(src.flows(spark, d).select(F.year("trade_date").alias("year"), F.col("fii_buy_cr").alias("buy"), F.col("fii_sell_cr").alias("sell"), (F.col("fii_net_cr") + F.when(F.dayofmonth("trade_date") == 13, 5.0).otherwise(0.0)).alias("net")), "year"),
    sql("""SELECT year, n AS n_rows, k AS n_ok, round(k / n, 4) AS ok_share, k = n AS consistent FROM (SELECT CAST(year(trade_date) AS INT) AS year, count(*) AS n, count(*) FILTER (day(trade_date) <> 13) AS k FROM flows GROUP BY 1)""", "flows"),
)
_OK = "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate {0}, o_orderkey {0}) = 1"


def stored(sink):
    """Two batches of orders, one after the other, through a sink and read back."""

    def run(spark, d):
        orders = src.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
        path = jobs.scratch(spark)
        for batch in (F.col("o_orderdate") < "1998-01-01", F.col("o_orderdate") >= "1998-01-01"):
            sink(orders.where(batch), path, ["o_custkey"], ["o_orderdate", "o_orderkey"])
        return ld.read_sink(spark, path).drop("o_orderdate")

    return run


for _k, _sink, _dir in (("sink_insert_ignore", ld.insert_ignore, "ASC"), ("sink_replace", ld.replace, "DESC")):
    register(_k, stored(_sink), sql(_OK.format(_dir)))
register("sink_latest_upsert", lambda spark, d: jn.keep_last(src.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]), sql("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"))


def _log(spark, d):
    x = model_probs(src.bars(spark, d))
    one = lambda c: F.when(F.col(c) != "FLAT", F.struct(F.lit(c).alias("category"), F.col(c).alias("direction"), F.col(f"{c}_long").alias("confidence")))
    return ld.signal_log_rows(x.select("ticker", "ts", F.array_compact(F.array(one("swing"), one("intraday"))).alias("signals"))).select("ticker", "ts", "category", "signal")


register(
    "signal_log_rows",
    _log,
    sql("""SELECT ticker, ts, category, signal FROM (SELECT b.ticker, b.ts, x.category, x.signal, sw, iy FROM (SELECT ticker, ts, CASE WHEN a > b AND a >= s THEN 'LONG' WHEN s > b AND s > a THEN 'SHORT' ELSE 'FLAT' END AS sw, CASE WHEN a2 > b2 AND a2 >= s2 THEN 'LONG' WHEN s2 > b2 AND s2 > a2 THEN 'SHORT' ELSE 'FLAT' END AS iy
    FROM (SELECT ticker, ts, (c * 7 + v * 3) % 97 + 1 AS a, (h * 5 + v) % 31 + 1 AS b, (l * 11 + c) % 89 + 1 AS s, (c * 7 + v * 3 + 26) % 97 + 1 AS a2, (h * 5 + v + 34) % 31 + 1 AS b2, (l * 11 + c + 38) % 89 + 1 AS s2 FROM (SELECT ticker, ts, close::BIGINT AS c, volume::BIGINT AS v, high::BIGINT AS h, low::BIGINT AS l FROM bars))) b,
    LATERAL (VALUES ('swing', sw), ('intraday', iy), ('none', 'FLAT')) x(category, signal)) WHERE (category <> 'none' AND signal <> 'FLAT') OR (category = 'none' AND sw = 'FLAT' AND iy = 'FLAT')""", "bars"),
)
register(
    "feature_snapshot_json",
    lambda spark, d: ld.feature_json(ta.momentum(src.bars(spark, d)).withColumn("ret", F.lit(0.5)), ["rsi_14", "stoch_rsi", "close", "ret"], ["ticker", "ts"]).select("ticker", "ts", "n_features", F.get_json_object("feature_values", "$.close").cast("double").alias("close_json")),
    sql("SELECT ticker, ts, 2 + (rsi_14 IS NOT NULL)::INT + (stoch_rsi IS NOT NULL)::INT AS n_features, close AS close_json FROM tech_momentum", "tech_momentum"),
)
