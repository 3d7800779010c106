"""Projections of the warehouse tables onto the engine's market schemas.

Dimension joins are broadcast only behind a check of the dimension's stored size (:func:`checked`);
beyond it they stay shuffle joins, which AQE splits on skew.
Prices, amounts and percentages are summed as integers so results do not depend on the order of
addition.  First/last prices ride in one packed long (order key, then price): the aggregate stays
a hash aggregate over fixed-width buffers with a map-side combine.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import ContextVar, copy_context
from decimal import Decimal
from functools import partial, wraps
from threading import Lock, RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

_kept: ContextVar[dict | None] = ContextVar("kept", default=None)
_stores: dict[tuple, dict] = {}
_making = Lock()


def _version(spark: SparkSession, sf_dir: str) -> tuple:
    """Size and time of each table of a folder: what is derived from them holds as long as these do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for s in fs.listStatus(path):
        total = fs.getContentSummary(s.getPath())
        found.append((s.getPath().getName(), s.getModificationTime(), total.getLength(), total.getFileCount()))
    return tuple(sorted(found))


def kept(spark: SparkSession, sf_dir: str, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """Within :func:`once`: the rows written under ``key`` and read from there, made by whoever asks first."""
    store = _kept.get()
    if store is None:
        return make()
    with _making:
        lock = store.setdefault(("lock", sf_dir, key), RLock())
    with lock:
        if (sf_dir, key) not in store:
            rows, path = make(), f"{scratch(spark)}/{key[0]}"
            rows.write.parquet(path)
            store[sf_dir, key] = spark.read.schema(rows.schema).parquet(path)
        return store[sf_dir, key]


def derived(fn):
    """An adapter whose rows are bounded by the calendar: within :func:`once` they are written and read from there."""

    @wraps(fn)
    def get(spark: SparkSession, sf_dir: str, *args, **kw) -> DataFrame:
        return kept(spark, sf_dir, (fn.__name__, args, tuple(sorted(kw.items()))), lambda: fn(spark, sf_dir, *args, **kw))

    return get


def together(spark: SparkSession, sf_dir: str, parts: dict[str, Callable[[SparkSession, str], DataFrame]]) -> dict[str, DataFrame]:
    """Frames bounded by the calendar, made side by side and, within :func:`once`, written: plans stay short, and Spark shares its cores between them."""
    if _kept.get() is None:
        return {n: make(spark, sf_dir) for n, make in parts.items()}
    bars(spark, sf_dir)  # most parts need them
    with ThreadPoolExecutor(min(8, len(parts))) as pool:
        jobs = {n: pool.submit(copy_context().run, kept, spark, sf_dir, (n,), partial(make, spark, sf_dir)) for n, make in parts.items()}
        return {n: j.result() for n, j in jobs.items()}


def once(query):
    """A query that uses derived tables again and again: each fact table behind them is scanned once, and the plan stays short.

    What is written serves later queries of the session too, until one of the folder's tables changes.
    """

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = _kept.set(_stores.setdefault((spark.sparkContext.applicationId, sf_dir, _version(spark, sf_dir)), {}))
        try:
            return query(spark, sf_dir)
        finally:
            _kept.reset(token)

    return run


PACK = 1 << 20  # above every price that ``lineitem_price`` can make


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BROADCAST_LIMIT = 64 << 20
#: Stored bytes up to which a dimension is not counted, and what a row takes in a broadcast table besides its columns.
UNCOUNTED, ROW_BYTES = 256 << 10, 32


def _rows(base: DataFrame) -> int:
    """Rows of a scan, which Parquet has in its footers; within :func:`once` they are counted once."""
    store = _kept.get()
    if store is None:
        return base.count()
    key = ("rows", base.semanticHash())
    if key not in store:
        store[key] = base.count()
    return store[key]


def _width(df: DataFrame) -> int:
    """Bytes that a row takes in a broadcast table."""
    return ROW_BYTES + sum(max(8, f.dataType().defaultSize()) for f in df._jdf.schema().fields())


def checked(dimension: DataFrame, base: DataFrame | None = None, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast ``dimension`` if the scan it has one row per row of (``base``) is below ``limit`` bytes, stored and as a table in memory.

    The stored size comes from the file statistics of that scan; Catalyst multiplies sizes along joins, so
    a chain of small lookups would otherwise look larger than the fact table it describes. Files may be much smaller than
    their rows, and the driver holds a broadcast table, of several queries at a time: so the rows are counted as well.
    """
    base = dimension if base is None else base
    stored = int(str(base._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if stored > limit or stored > UNCOUNTED and _rows(base) * _width(dimension) > limit:
        return dimension
    return F.broadcast(dimension)


# Market series carried by the first nations, with the divisor that brings the price to its usual level.
SERIES = {
    "sp500": 1.0, "nasdaq": 1.0, "dow": 1.0, "us_vix": 70.0, "india_vix": 65.0, "crude": 12.5, "gold": 1.0, "copper": 1.0,
    "dxy": 10.0, "usdinr": 12.5, "us_10y": 250.0, "us_2y": 260.0, "nifty": 1.0, "banknifty": 1.0, "jpmorgan": 1.0, "hsbc": 1.0,
}


def supplier_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppkey → region name, used as ticker."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region")
    named = (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "s_name", F.col("r_name").alias("ticker"), F.get(F.array(*[F.lit(n) for n in SERIES]), "n_nationkey").alias("series"))
    )
    return checked(named, supplier)


def lineitem_price() -> F.Column:
    """Integer price: level from discount and tax, jitter from quantity, a 240-day triangle trend."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    wave = F.abs(F.pmod(day, F.lit(240)) - 120) * 2
    return (F.round(1000 * (1 + F.col("l_discount") - F.col("l_tax"))).cast("long") + F.col("l_quantity").cast("long") + wave).cast("long")


def _packed_bars(spark: SparkSession, sf_dir: str, *by: str, extra: dict[str, F.Column] | None = None) -> DataFrame:
    """Daily bars per ``by`` columns of :func:`supplier_region`, first and last price still packed with their order key, and ``extra`` sums."""
    px = F.col("px")
    packed = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * PACK + px
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", F.col("l_shipdate").cast("date").alias("ts"), lineitem_price().alias("px")
    )
    names = supplier_region(spark, sf_dir).select("s_suppkey", *by)
    return (
        lines.join(names, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(*by, "ts")
        .agg(
            F.min(packed).alias("_first"),
            F.max(px).cast("double").alias("high"),
            F.min(px).cast("double").alias("low"),
            F.max(packed).alias("_last"),
            F.sum("l_quantity").alias("volume"),
            *[c.alias(n) for n, c in (extra or {}).items()],
        )
    )


def _line_sums() -> dict[str, F.Column]:
    """Lines and the sums of their tax, discount and quantity, as integers."""
    whole = lambda c: F.sum(c.cast("long"))
    return {"n": F.count(F.lit(1)), "tax": whole(F.round(F.col("l_tax") * 100)), "disc": whole(F.round(F.col("l_discount") * 100)), "qty": whole(F.col("l_quantity"))}


@derived
def _region_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed bars and sums of each region and series: the bars of both and the ratios are put together from one reading of the lines."""
    return _packed_bars(spark, sf_dir, "ticker", "series", extra=_line_sums())


@derived
def bars(spark: SparkSession, sf_dir: str, by: str = "ticker") -> DataFrame:
    """Daily OHLCV per region (``by='ticker'``) or per supplier (``by='s_name'``)."""
    if by in ("ticker", "series") and _kept.get() is not None:
        x = _region_series(spark, sf_dir).groupBy(by, "ts").agg(*[f(c).alias(c) for c, f in {"_first": F.min, "high": F.max, "low": F.min, "_last": F.max, "volume": F.sum}.items()])
    else:
        x = _packed_bars(spark, sf_dir, by)
    return x.where(F.col(by).isNotNull()).select(
        F.col(by).alias("ticker"),
        "ts",
        (F.col("_first") % PACK).cast("double").alias("open"),
        "high",
        "low",
        (F.col("_last") % PACK).cast("double").alias("close"),
        "volume",
    )


def bars_intraday(spark: SparkSession, sf_dir: str, minutes: int = 30) -> DataFrame:
    """OHLCV per event type and ``minutes`` window; ties inside a microsecond break on the event id."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    return tick_bars(events.select("event_id", F.col("event_type").alias("ticker"), "ts", (F.lit(200000) + F.round(F.col("value") * 100)).cast("long").alias("milli")), minutes)


def tick_bars(ticks: DataFrame, minutes: int) -> DataFrame:
    """(ticker, ts, event_id, milli) ticks to bars; ``milli`` is the price in thousandths, of any size."""
    slot = F.window("ts", f"{minutes} minutes")["start"]
    offset = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("slot").cast("timestamp"))
    at = tick_order(offset)
    return (
        ticks.withColumn("slot", slot)
        .groupBy("ticker", F.col("slot").alias("ts"))
        .agg(
            F.min_by("milli", at).alias("_first"),
            F.max("milli").alias("_high"),
            F.min("milli").alias("_low"),
            F.max_by("milli", at).alias("_last"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select(
            "ticker",
            "ts",
            (F.col("_first") / 1000).alias("open"),
            (F.col("_high") / 1000).alias("high"),
            (F.col("_low") / 1000).alias("low"),
            (F.col("_last") / 1000).alias("close"),
            "volume",
        )
    )


def tick_order(offset: F.Column) -> F.Column:
    """Time offset, then event id, as one number: a fixed-width buffer, so the aggregate stays a hash aggregate."""
    return offset.cast("decimal(18,0)") * F.lit(Decimal(10**19)).cast("decimal(20,0)") + F.col("event_id").cast("decimal(19,0)")


def cents(name: str) -> F.Column:
    return F.round(F.col(name) * 100).cast("long")


@derived
def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly option chain: strike = part size, calls from flag A, puts from flag R, vol from N."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_discount", "l_tax",
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("fetched_at"),
    )
    part = checked(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    names = supplier_region(spark, sf_dir).select("s_suppkey", "ticker")
    call, put = F.col("l_returnflag") == "A", F.col("l_returnflag") == "R"
    mean = lambda cond, c: F.coalesce(F.try_divide(F.sum(F.when(cond, cents(c))), F.count(F.when(cond, 1)) * 100), F.lit(0.0))
    return (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(names, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("ticker", "fetched_at", F.col("p_size").alias("strike"))
        .agg(
            F.coalesce(F.sum(F.when(call, F.col("l_quantity"))), F.lit(0.0)).alias("ce_oi"),
            F.coalesce(F.sum(F.when(put, F.col("l_quantity"))), F.lit(0.0)).alias("pe_oi"),
            mean(call, "l_discount").alias("ce_price"),
            mean(put, "l_discount").alias("pe_price"),
            mean(F.lit(True), "l_tax").alias("iv"),
            F.count(F.lit(1)).alias("n_lines"),
        )
    )


def with_spot(chain_df: DataFrame) -> DataFrame:
    """Adds the snapshot's spot: line-weighted mean strike (joined back, one row per snapshot)."""
    spot = chain_df.groupBy("ticker", "fetched_at").agg((F.sum(F.col("strike") * F.col("n_lines")) / F.sum("n_lines")).alias("spot"))
    return chain_df.join(spot, ["ticker", "fetched_at"])


FOREIGN_SEGMENTS = ("BUILDING", "AUTOMOBILE")
BUY_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily foreign/domestic buy, sell and net values in millions of cents."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderpriority", F.col("o_orderdate").cast("date").alias("trade_date"))
    customer = checked(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
    foreign = F.col("c_mktsegment").isin(*FOREIGN_SEGMENTS)
    buy = F.col("o_orderpriority").isin(*BUY_PRIORITIES)
    value = lambda cond: (F.coalesce(F.sum(F.when(cond, cents("o_totalprice"))), F.lit(0)) / 1e6)
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("trade_date")
        .agg(
            value(foreign & buy).alias("fii_buy_cr"),
            value(foreign & ~buy).alias("fii_sell_cr"),
            value(~foreign & buy).alias("dii_buy_cr"),
            value(~foreign & ~buy).alias("dii_sell_cr"),
        )
        .withColumns(
            {
                "fii_net_cr": F.round(F.col("fii_buy_cr") - F.col("fii_sell_cr"), 6),
                "dii_net_cr": F.round(F.col("dii_buy_cr") - F.col("dii_sell_cr"), 6),
            }
        )
    )


REGIME_BY_PRIORITY = {
    "1-URGENT": "BULL_TRENDING",
    "2-HIGH": "BEAR_TRENDING",
    "3-MEDIUM": "HIGH_VOLATILITY",
    "4-NOT SPECIFIED": "CHOPPY_SIDEWAYS",
    "5-LOW": "CHOPPY_SIDEWAYS",
}
GRADE_BY_SEGMENT = {"BUILDING": "A+", "AUTOMOBILE": "A", "MACHINERY": "B", "HOUSEHOLD": "C", "FURNITURE": "F"}
CATEGORIES = ("swing", "intraday", "positional")


def ledger(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Closed trades: one per order line, opened on the order date, closed 3 days per line number; with ``orders`` those of these orders."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    placed = table(spark, sf_dir, "orders") if orders is None else orders
    placed = placed.select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("opened_at"))
    customer = checked(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
    names = supplier_region(spark, sf_dir).select("s_suppkey", "ticker")
    from ..functions.scalars import lookup

    pct = F.round((F.col("l_discount") - F.col("l_tax")) * 100).cast("long") - 1
    placed = placed.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")  # before the lines, which are many more
    if orders is not None:
        placed = checked(placed, orders)
    return (
        lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(names, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents("l_extendedprice")).alias("signal_uuid"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("trade_no"),
            "ticker",
            F.when(F.col("l_returnflag") == "R", "SHORT").otherwise("LONG").alias("signal"),
            F.when(F.col("l_linenumber") % 3 == 0, "swing").when(F.col("l_linenumber") % 3 == 1, "intraday").otherwise("positional").alias("category"),
            lookup("o_orderpriority", REGIME_BY_PRIORITY).alias("regime"),
            lookup("c_mktsegment", GRADE_BY_SEGMENT).alias("alignment"),
            F.round(0.5 + F.col("l_discount") * 4, 2).alias("confidence"),
            F.when(F.col("l_tax") < 0.02, "A").when(F.col("l_tax") < 0.04, "B").when(F.col("l_tax") < 0.06, "C").otherwise("D").alias("entry_quality"),
            F.when(F.col("l_linestatus") == "O", 1).when(F.col("l_returnflag") == "A", 0).cast("int").alias("regime_match"),
            "opened_at",
            F.date_add("opened_at", F.col("l_linenumber") * 3).alias("close_date"),
            (F.col("l_linenumber") * 72).cast("double").alias("hold_hours"),
            pct.alias("pnl_points"),
            (pct / 100).alias("pnl_pct"),
            (cents("l_extendedprice") * pct).alias("pnl_e4"),
            (cents("l_extendedprice") * pct / 10000).alias("pnl_amount"),
            F.round(pct / 2, 2).alias("r_multiple"),
            ((F.greatest(pct, F.lit(0)) + 1) / 100).alias("mfe"),
            ((F.least(pct, F.lit(0)) - 1) / 100).alias("mae"),
            F.col("l_quantity").alias("shares"),
            cents("l_extendedprice").alias("value_cents"),
            F.when(pct > 2, "TARGET").when(pct < -2, "STOP_LOSS").otherwise("TIME_EXIT").alias("exit_reason"),
        )
    )


def ledger_since(spark: SparkSession, sf_dir: str, floors: DataFrame) -> DataFrame:
    """Closed trades without the orders that hold none from its day's ``_floor`` on; ``floors``: (ticker, close_date, _floor, and the span ``_from``, ``_to`` of opening dates).

    A line number, which is what a trade number adds to eight times its order's, is at most the days from opening to closing.
    """
    least = F.col("_floor") - F.greatest(F.datediff("close_date", "_from"), F.lit(0))
    opened = floors.select(least.alias("_least"), F.explode(F.sequence("_from", "_to")).alias("_opened")).groupBy("_opened").agg(F.min("_least").alias("_least"))

    def make():
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
        x = orders.join(checked(opened, floors), F.col("o_orderdate").cast("date") == F.col("_opened"), "left")
        return x.where(F.coalesce(F.col("o_orderkey") * 8 >= F.col("_least"), F.lit(True))).select(*orders.columns)

    return ledger(spark, sf_dir, kept(spark, sf_dir, ("newest_orders",), make))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles, one minute apart; first line is the title, the rest the summary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("ticker"))
    pos = F.instr("text", "\n")
    return docs.select(
        "doc_id",
        "ticker",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).cast("timestamp_ntz").alias("created_at"),
        F.when(pos > 0, F.substring(F.col("text"), F.lit(1), pos - 1)).otherwise(F.col("text")).alias("title"),
        F.when(pos > 0, F.substring(F.col("text"), pos + 1, F.length("text"))).otherwise(F.lit("")).alias("summary"),
    )


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model probabilities per key and cycle from the event stream."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    long_w = F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(97)) + 1
    flat_w = F.pmod(F.coalesce(k, F.lit(0)), F.lit(31)) + 1
    short_w = F.pmod(F.col("event_id") * 7, F.lit(89)) + 1
    total = long_w + flat_w + short_w
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("key"), "ts", F.col("event_type").alias("category"),
        F.round(long_w / total, 6).alias("prob_long"),
        F.round(flat_w / total, 6).alias("prob_flat"),
        F.round(short_w / total, 6).alias("prob_short"),
    )


@derived
def market_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, ts, close): one close per market series and day, scaled to its usual level."""
    from ..functions.scalars import lookup

    x = bars(spark, sf_dir, by="series")
    return x.select(F.col("ticker").alias("name"), "ts", (F.col("close") / lookup("ticker", SERIES, 1.0)).alias("close"))


def bank_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes of the bank index."""
    return market_series(spark, sf_dir).where(F.col("name") == "banknifty").select("ts", "close")


def bulk_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as market-wide deals: urgent/high are buys, the rest sells."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("trade_date"), F.col("o_custkey").alias("client"), F.col("o_orderkey").alias("quantity"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "BUY").otherwise("SELL").alias("trade_type"), cents("o_totalprice").alias("value_cents"),
    )


def block_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as per-name deals: flag A buys, R sells; value in millions of cents."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice", F.col("l_shipdate").cast("date").alias("trade_date"))
    names = supplier_region(spark, sf_dir).select("s_suppkey", "ticker")
    return (
        lines.where(F.col("l_returnflag").isin("A", "R"))
        .join(names, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("ticker", "trade_date", F.when(F.col("l_returnflag") == "A", "BUY").otherwise("SELL").alias("buy_sell"), cents("l_extendedprice").alias("value_cents"))
    )


HOLDERS = {"promoter_pct": "BUILDING", "fii_pct": "AUTOMOBILE", "dii_pct": "MACHINERY", "public_pct": "HOUSEHOLD", "pledge_pct": "FURNITURE"}


def shareholding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly value share of each customer segment per region, in percent."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("quarter"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region")
    agg = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("ticker"), "quarter")
        .agg(F.sum(cents("o_totalprice")).alias("_all"), *[F.coalesce(F.sum(F.when(F.col("c_mktsegment") == s, cents("o_totalprice"))), F.lit(0)).alias(c) for c, s in HOLDERS.items()])
    )
    return agg.select("ticker", "quarter", *[F.round(F.col(c) / F.col("_all") * 100, 4).alias(c) for c in HOLDERS])


@derived
def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly ratios per region from order-line averages, spread around banking levels."""
    if _kept.get() is not None:
        x = _region_series(spark, sf_dir).groupBy("ticker", F.trunc("ts", "quarter").alias("fetched_at"))
        agg = x.agg(*[F.sum(c).alias(c) for c in _line_sums()])
    else:
        lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_tax", F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("fetched_at"))
        names = supplier_region(spark, sf_dir).select("s_suppkey", "ticker")
        agg = lines.join(names, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("ticker", "fetched_at").agg(*[c.alias(n) for n, c in _line_sums().items()])
    tax, disc, qty = F.col("tax") / F.col("n") - 4, F.col("disc") / F.col("n") - 5, F.col("qty") / F.col("n") - 25.5
    rounded = lambda c, name: F.round(c, 4).alias(name)
    return agg.select(
        "ticker", "fetched_at", rounded(3.5 + tax * 4, "nim"), rounded(1.8 + disc * 4, "npa_gross"), rounded(44 + qty * 4, "casa_ratio"), rounded(14 + tax * 40, "loan_growth"),
        rounded(15 + disc * 20, "roe"), rounded(3 + qty, "pb_ratio"), rounded(20 + disc * 10, "eps"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as social posts: one conversation per hour, one turn per minute."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("source"), "text", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).cast("timestamp_ntz").alias("created_at")
    )


def scored_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a score in tenths (-10..10) taken from the text's length."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("ticker"), "doc_id", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).cast("timestamp_ntz").alias("created_at"),
        (F.pmod(F.col("n_chars"), F.lit(21)) - 10).alias("tenths"),
    )


@derived
def policy_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly policy rate in quarter-point steps, and a credit growth figure, from order counts."""
    o = table(spark, sf_dir, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("effective_date"), "o_orderpriority")
    agg = o.groupBy("effective_date").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"), F.count(F.lit(1)).alias("n"))
    return agg.select("effective_date", (F.lit(6.0) + F.pmod(F.col("u"), F.lit(5)) * 0.25).alias("rbi_rate"), F.round(F.pmod(F.col("n"), F.lit(12)) + 5.0, 2).alias("credit_growth"))


@derived
def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date that has an order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy meeting dates: the last order date of every even month."""
    o = order_days(spark, sf_dir).select(F.col("day").alias("d")).where(F.month("d") % 2 == 0)
    return o.groupBy(F.trunc("d", "month").alias("m")).agg(F.max("d").alias("event_date")).select("event_date")


@derived
def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly results per region: EPS against the previous quarter's as the estimate."""
    from pyspark.sql import Window as W

    w = W.partitionBy("ticker").orderBy("fetched_at")
    x = fundamentals(spark, sf_dir).select("ticker", F.date_add("fetched_at", 14).alias("result_date"), "fetched_at", F.col("eps").alias("actual_eps"), F.lag("eps").over(w).alias("estimated_eps"))
    return x.where(F.col("estimated_eps").isNotNull()).drop("fetched_at")


NEWS_MINUTES = 2400 * 1440  # the days the bars cover


def bar_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles about the names that have bars, spread over the bars' years; score in tenths, ``kind`` of what it is about."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("ticker"))
    kind = F.when(F.col("n_chars") % 3 == 0, "earnings").when(F.col("n_chars") % 3 == 1, "announcement").otherwise("news")
    return docs.join(checked(region), F.pmod("doc_id", F.lit(5)) == F.col("r_regionkey")).select(
        "ticker", "doc_id", F.timestamp_seconds(F.lit(788918400) + F.pmod(F.col("doc_id") * 7919, F.lit(NEWS_MINUTES)) * 60).cast("timestamp_ntz").alias("created_at"),
        (F.pmod(F.col("n_chars"), F.lit(21)) - 10).alias("tenths"), kind.alias("kind"),
    )


def earlier_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The social posts as if 26 years earlier, within the bars' years."""
    return posts(spark, sf_dir).withColumn("created_at", F.expr("created_at - interval 26 years"))
