"""Landed files to typed rows, and rows to sinks.  Readers take explicit schemas; parsing never raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_number, parse_date

FLOW_FIELDS = ("buy", "sell", "net")
CHAIN_JSON = """struct<records:struct<underlyingValue:double,data:array<struct<strikePrice:int,
  CE:struct<openInterest:double,lastPrice:double,impliedVolatility:double>,PE:struct<openInterest:double,lastPrice:double,impliedVolatility:double>>>>>"""


def read_flow_csv(spark: SparkSession, paths: Sequence[str] | str, fields: Sequence[str] = FLOW_FIELDS) -> DataFrame:
    """Year-sharded CSV as text columns, with the file each row came from."""
    schema = ", ".join(["date string", *[f"{f} string" for f in fields]])
    return spark.read.csv(paths, schema=schema, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).withColumn("file", F.input_file_name())


def parse_flow(raw: DataFrame, fields: Sequence[str] = FLOW_FIELDS) -> DataFrame:
    """Dates and numbers typed; rows without a readable date or last field (the net) are dropped, other missing numbers are 0."""
    x = raw.select(parse_date("date", ("d MMM yyyy", "yyyy-MM-dd")).alias("trade_date"), *[clean_number(f).alias(f) for f in fields])
    return x.dropna(subset=["trade_date", fields[-1]]).fillna(0.0, list(fields[:-1]))


def ingest_new(parsed: DataFrame, existing: DataFrame, key: str = "trade_date") -> DataFrame:
    """Rows whose key is not loaded yet, the first per key."""
    from ..operators.joins import keep_first

    fresh = parsed.join(existing.select(key), key, "left_anti")
    return keep_first(fresh, [key], [c for c in fresh.columns if c != key])


def html_table_rows(raw: DataFrame, html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """``<tr>`` rows of whole HTML documents as arrays of cell text."""
    rows = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)))
    x = raw.select(*keep, rows.alias("_tr"))
    cells = F.transform(F.regexp_extract_all("_tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]+>", "")))
    return x.select(*keep, cells.alias("cells")).where(F.size("cells") > 0)


def month_flow_rows(rows: DataFrame, year: str = "year") -> DataFrame:
    """Month-name rows to month ends, the signed net split into buy and sell."""
    net = clean_number(F.get("cells", F.lit(1)))
    day = F.last_day(F.try_to_timestamp(F.concat_ws(" ", F.lit("1"), F.get("cells", F.lit(0)), F.col(year).cast("string")), F.lit("d MMMM yyyy")).cast("date"))
    x = rows.select(day.alias("month_end"), net.alias("net"))
    return x.dropna().withColumns({"buy": F.greatest(F.col("net"), F.lit(0.0)), "sell": F.greatest(-F.col("net"), F.lit(0.0))})


def resolve_aliases(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """First present (non-NULL) alias of every target; net falls back to buy - sell, all-zero rows go."""
    low = {c.lower(): c for c in df.columns}
    cols = {t: F.coalesce(*[clean_number(F.col(low[a.lower()]).cast("string")) for a in names if a.lower() in low], F.lit(None).cast("double")) for t, names in aliases.items()}
    used = {low[a.lower()] for names in aliases.values() for a in names if a.lower() in low}
    x = df.select(*[c for c in df.columns if c not in used], *[c.alias(t) for t, c in cols.items()])
    if {"buy", "sell", "net"} <= set(aliases):
        x = x.withColumn("net", F.coalesce("net", F.col("buy") - F.col("sell")))
        x = x.withColumns({"buy": F.coalesce("buy", F.greatest(F.col("net"), F.lit(0.0))), "sell": F.coalesce("sell", F.greatest(-F.col("net"), F.lit(0.0)))})
    zero = F.lit(True)
    for t in aliases:
        zero = zero & (F.coalesce(F.col(t), F.lit(0.0)) == 0)
    return x.where(~zero)


def flow_by_category(rows: DataFrame, date: str = "date", category: str = "category", buy: str = "buyValue", sell: str = "sellValue") -> DataFrame:
    """Category text to foreign and domestic buckets per date; days without any value go."""
    text = F.upper(F.col(category))
    foreign, domestic = text.rlike("FII|FPI|FOREIGN"), text.rlike("DII|MF|MUTUAL|INSURANCE")
    domestic = domestic & ~foreign
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    x = rows.groupBy(F.col(date).alias("trade_date")).agg(
        total(foreign, buy).alias("fii_buy"), total(foreign, sell).alias("fii_sell"), total(domestic, buy).alias("dii_buy"), total(domestic, sell).alias("dii_sell")
    )
    x = x.withColumns({"fii_net": F.col("fii_buy") - F.col("fii_sell"), "dii_net": F.col("dii_buy") - F.col("dii_sell")})
    return x.where((F.col("fii_buy") != 0) | (F.col("fii_sell") != 0) | (F.col("dii_buy") != 0) | (F.col("dii_sell") != 0))


# The two column vocabularies of the exchange's daily derivative file.
BHAVCOPY = {
    "symbol": ("SYMBOL", "TckrSymb"), "instrument": ("INSTRUMENT", "FinInstrmTp"), "expiry": ("EXPIRY_DT", "XpryDt"), "strike": ("STRIKE_PR", "StrkPric"),
    "kind": ("OPTION_TYP", "OptnTp"), "oi": ("OPEN_INT", "OpnIntrst"), "price": ("CLOSE", "ClsPric"), "underlying": ("UndrlygPric",),
}


def chain_from_bhavcopy(raw: DataFrame, day: str = "trade_date") -> DataFrame:
    """Option rows of the nearest expiry on or after the day (else the last), calls and puts side by side."""
    low = {c.lower(): c for c in raw.columns}
    pick = lambda t: F.coalesce(*[F.col(low[a.lower()]).cast("string") for a in BHAVCOPY[t] if a.lower() in low], F.lit(None).cast("string"))
    x = raw.select(F.col(day).alias("fetched_at"), *[pick(t).alias(t) for t in BHAVCOPY])
    x = x.where(F.col("kind").isin("CE", "PE")).withColumns({"expiry": parse_date("expiry", ("dd-MMM-yyyy", "yyyy-MM-dd")), **{c: clean_number(c) for c in ("strike", "oi", "price", "underlying")}})
    key = ["symbol", "fetched_at"]
    best = x.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("expiry") >= F.col("fetched_at"), F.col("expiry"))), F.max("expiry")).alias("expiry"))
    near = x.join(best, [*key, "expiry"], "left_semi")
    side = lambda k, c: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))), F.lit(0.0))
    return near.groupBy(*key, "strike").agg(side("CE", "oi").alias("ce_oi"), side("PE", "oi").alias("pe_oi"), side("CE", "price").alias("ce_price"), side("PE", "price").alias("pe_price"), F.max(F.when(F.col("underlying") > 0, F.col("underlying"))).alias("spot"))


def chain_from_json(raw: DataFrame, body: str = "body", keep: Sequence[str] = ("ticker", "fetched_at")) -> DataFrame:
    x = raw.select(*keep, F.from_json(body, CHAIN_JSON).alias("j")).select(*keep, F.col("j.records.underlyingValue").alias("spot"), F.explode_outer("j.records.data").alias("r"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return x.select(*keep, "spot", F.col("r.strikePrice").alias("strike"), zero("r.CE.openInterest").alias("ce_oi"), zero("r.PE.openInterest").alias("pe_oi"), zero("r.CE.lastPrice").alias("ce_price"), zero("r.PE.lastPrice").alias("pe_price"), zero("r.CE.impliedVolatility").alias("iv"))


def parse_deals(raw: DataFrame, symbol: str | None = None) -> DataFrame:
    """Quantity and price text to value in crore; one row per (date, client, side, quantity)."""
    x = raw.withColumns({"quantity": clean_number("quantity"), "price": clean_number("price")}).dropna(subset=["quantity", "price"])
    if symbol is not None:
        x = x.where(F.upper("symbol") == symbol.upper())
    x = x.withColumn("value_cr", F.round(F.col("quantity") * F.col("price") / 1e7, 6))
    return x.dropDuplicates(["trade_date", "client", "side", "quantity"])


# High-priority announcement categories.
PRIORITY = (
    "Financial Results", "Board Meeting", "Dividend", "Acquisition", "Merger/Amalgamation", "Rights Issue", "Buyback", "Change in Management", "Regulatory Action",
    "RBI Action", "Credit Rating", "Analyst/Institutional Investor Meet", "Investor Presentation",
)


def announcements(raw: DataFrame) -> DataFrame:
    """Headline from the first filled field, priority flag, one row per (ticker, title, date)."""
    from ..functions.scalars import keyword_any

    x = raw.withColumn("title", F.coalesce(*[F.when(F.length(F.trim(F.col(c))) > 0, F.trim(F.col(c))) for c in ("headline", "news_sub") if c in raw.columns]))
    hit = keyword_any(F.concat_ws(" ", "title", "category"), PRIORITY)
    return x.where(F.col("title").isNotNull()).withColumn("is_high_priority", hit.cast("int")).dropDuplicates(["ticker", "title", "announcement_date"])


DATE_PATTERN = r"(\d{1,2}[-/ ](?:[A-Za-z]{3,9}|\d{1,2})[-/ ]\d{4}|\d{4}-\d{2}-\d{2}|[A-Z][a-z]{2,8} \d{1,2}, \d{4})"


def event_dates(raw: DataFrame, text: str = "text", fallback: str = "announcement_date") -> DataFrame:
    """First readable date in the text, else the announcement's own."""
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(DATE_PATTERN), F.lit(1)), lambda d: parse_date(d))
    return raw.withColumn("result_date", F.coalesce(F.try_element_at(F.array_compact(found), F.lit(1)), F.col(fallback)))


def reconcile(rows: DataFrame, by: str) -> DataFrame:
    """Share of rows whose buy - sell equals net, per file or year; flags, never fixes."""
    ok = F.abs(F.col("buy") - F.col("sell") - F.col("net")) < 0.01
    x = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_ok"))
    return x.withColumns({"ok_share": F.round(F.col("n_ok") / F.col("n_rows"), 4), "consistent": F.col("n_ok") == F.col("n_rows")})


def signal_log_rows(df: DataFrame, signals: str = "signals") -> DataFrame:
    """One row per emitted signal, or a single FLAT row."""
    x = df.withColumn("_s", F.explode_outer(F.when(F.size(signals) > 0, F.col(signals))))
    return x.withColumns({"category": F.coalesce("_s.category", F.lit("none")), "signal": F.coalesce("_s.direction", F.lit("FLAT")), "confidence": F.coalesce("_s.confidence", F.lit(0.0))}).drop("_s", signals)


def feature_json(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Finite numeric features as one JSON text, with their number."""
    m = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))
    ok = F.map_filter(m, lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return df.select(*keep, F.size(ok).alias("n_features"), F.to_json(ok).alias("feature_values"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions below a sink's folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName()[1:]) for s in found or [])


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a keyed sink."""
    return spark.read.parquet(f"{path}/v{_versions(spark, path)[-1]}")


def insert_ignore(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Adds the rows whose key the table lacks, the first per key, as a new version; a half-written version never counts."""
    from ..operators.joins import keep_first

    spark, new, done = batch.sparkSession, keep_first(batch, keys, order), _versions(batch.sparkSession, path)
    if done:
        old = read_sink(spark, path)
        new = old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))
    write_table(new, f"{path}/v{done[-1] + 1 if done else 0}", mode="overwrite")


def replace(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Puts the last row per key of the batch in the place of the table's, as a new version."""
    from ..operators.joins import keep_last

    spark, new, done = batch.sparkSession, keep_last(batch, keys, order), _versions(batch.sparkSession, path)
    if done:
        new = new.unionByName(read_sink(spark, path).join(new.select(*keys), list(keys), "left_anti"))
    write_table(new, f"{path}/v{done[-1] + 1 if done else 0}", mode="overwrite")


def write_table(df: DataFrame, path: str, partitions: Sequence[str] = (), mode: str = "append") -> None:
    """Partitioned Parquet; rows are gathered by partition first so each directory gets few files."""
    out = df.repartition(*partitions) if partitions else df
    w = out.write.mode(mode)
    (w.partitionBy(*partitions) if partitions else w).parquet(path)
