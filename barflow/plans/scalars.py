"""Scalar-rule queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..sources import adapters as src
from .oracle import sql
from .registry import register

T = src.table
register("clip", lambda spark, d: T(spark, d, "events").select("event_id", sc.clip(F.col("value") / 200 - 0.5).alias("clipped")), sql("SELECT event_id, round(least(1, greatest(-1, value / 200 - 0.5)), 6) AS clipped FROM events"))
register(
    "scale_linear",
    lambda spark, d: T(spark, d, "orders").select("o_orderkey", sc.scale_linear("o_totalprice", 50000, 450000, digits=10).alias("up"), sc.scale_linear("o_totalprice", 450000, 50000, digits=10).alias("down"), sc.scale_linear("o_totalprice", 50000, 450000, invert=True, digits=10).alias("inv")),
    sql("SELECT o_orderkey, round(x, 10) AS up, round(-x, 10) AS down, round(-x, 10) AS inv FROM (SELECT o_orderkey, least(1, greatest(-1, (o_totalprice - 50000) / 400000 * 2 - 1)) AS x FROM orders)"),
)
register(
    "sanitise",
    lambda spark, d: T(spark, d, "events").select("event_id", sc.sanitise(F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 5 == 1, F.lit(float("nan"))).when(F.col("event_id") % 5 == 2, F.lit(float("inf"))).otherwise(F.col("value"))).alias("v")),
    sql("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 0 ELSE round(value, 6) END AS v FROM events"),
)
register(
    "label_ladder",
    lambda spark, d: T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sc.ladder("l_discount", [(0.08, "HIGH"), (0.05, "MID"), (0.02, "LOW")], "NONE").alias("label"), sc.ladder_below("l_quantity", [(10, "S"), (30, "M")], "L").alias("size")),
    sql("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.08 THEN 'HIGH' WHEN l_discount > 0.05 THEN 'MID' WHEN l_discount > 0.02 THEN 'LOW' ELSE 'NONE' END AS label, CASE WHEN l_quantity < 10 THEN 'S' WHEN l_quantity < 30 THEN 'M' ELSE 'L' END AS size FROM lineitem"),
)
register("one_hot", lambda spark, d: T(spark, d, "events").withColumns(sc.one_hot("event_type", {"is_click": "click", "is_error": "error"})).select("event_id", "is_click", "is_error"), sql("SELECT event_id, (event_type = 'click')::INT AS is_click, (event_type = 'error')::INT AS is_error FROM events"))
WORDS = ("the", "and", "les", "und", "con")
register("keyword_any", lambda spark, d: T(spark, d, "documents").select("doc_id", sc.keyword_any("text", WORDS).alias("hit")), sql("SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in WORDS) + " AS hit FROM documents"))
register("keyword_count", lambda spark, d: T(spark, d, "documents").select("doc_id", sc.keyword_count("text", WORDS).alias("n")), sql("SELECT doc_id, " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in WORDS) + " AS n FROM documents"))
register(
    "html_clean",
    lambda spark, d: T(spark, d, "pages").select("page_id", F.md5(sc.html_clean("html")).alias("digest")),
    sql("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages"),
)
_D = "CAST(o_orderdate AS DATE)"
register(
    "date_scalars",
    lambda spark, d: T(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")).select("o_orderkey", ((F.dayofweek("day") + 5) % 7).alias("dow"), F.month("day").alias("month"), F.quarter("day").alias("quarter"), sc.monthly_expiry("day").alias("expiry"), F.datediff(sc.monthly_expiry("day"), "day").alias("days_to")),
    sql(f"""SELECT o_orderkey, CAST(isodow(d) - 1 AS INT) AS dow, CAST(month(d) AS INT) AS month, CAST(quarter(d) AS INT) AS quarter, CASE WHEN d <= e0 THEN e0 ELSE e1 END AS expiry, CAST((CASE WHEN d <= e0 THEN e0 ELSE e1 END) - d AS INT) AS days_to FROM (SELECT o_orderkey, {_D} AS d,
    last_day({_D}) - CAST((isodow(last_day({_D})) + 3) % 7 AS INT) AS e0, last_day(CAST(date_trunc('month', {_D}) + INTERVAL 1 MONTH AS DATE)) - CAST((isodow(last_day(CAST(date_trunc('month', {_D}) + INTERVAL 1 MONTH AS DATE))) + 3) % 7 AS INT) AS e1 FROM orders)"""),
)
register("json_scalars", lambda spark, d: T(spark, d, "events").select("event_id", sc.json_number("props", "$.k", 100).alias("k"), sc.json_number("props", "$.missing").alias("missing")), sql("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS k, CAST(NULL AS DOUBLE) AS missing FROM events"))
register("normalise_ticker", lambda spark, d: T(spark, d, "supplier").select("s_suppkey", sc.normalise_ticker(F.concat(F.col("s_name"), F.lit(".NS"))).alias("ticker")), sql("SELECT s_suppkey, s_name AS ticker FROM supplier"))
register(
    "null_coalesce",
    lambda spark, d: src.news(spark, d).select("doc_id", F.coalesce(F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("created_at")), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("ts")),
    sql("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' ELSE created_at END AS ts FROM news", "news"),
)
