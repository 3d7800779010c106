"""Cases in which a cap, a prefix or a packed value once lost or changed rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barflow.operators import joins as jn
from barflow.operators import sentiment as tx
from barflow.sources import adapters as src
from barflow.sources import landing as ld
from barflow.streaming import jobs

DAY = dt.datetime(2024, 1, 1, 9, 0)


@pytest.mark.parametrize("hold", [1, 5, 30, 31, 120])
def test_a_path_has_every_bar_of_the_hold(spark, hold):
    bars = spark.range(400).select(F.lit("A").alias("ticker"), F.col("id").cast("int").alias("i"), F.col("id").alias("ts"), *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close")])
    entries = spark.createDataFrame([("A", i, hold) for i in (0, 1, 29, 30, 59, 200)], "ticker string, i int, max_hold int")
    seen = {r.i: sorted(r.b) for r in jn.barrier(entries, bars).groupBy("i").agg(F.collect_list("bar_i").alias("b")).collect()}
    assert seen == {i: list(range(i + 1, i + hold + 1)) for i in (0, 1, 29, 30, 59, 200)}


def test_bars_of_high_prices_break_ties_by_event(spark):
    ticks = spark.createDataFrame(
        [("A", DAY, 2, 1_841_000), ("A", DAY, 1, 1_840_000), ("A", DAY + dt.timedelta(minutes=5), 9, 1_842_500), ("A", DAY + dt.timedelta(minutes=9), 4, 1_839_000), ("A", DAY + dt.timedelta(minutes=9), 3, 1_850_000)],
        "ticker string, ts timestamp, event_id long, milli long",
    )
    r = src.tick_bars(ticks, 30).first()
    assert (r.open, r.high, r.low, r.close, r.volume) == (1840.0, 1850.0, 1839.0, 1839.0, 5.0)


def test_a_flow_row_without_buy_stays(spark):
    raw = spark.createDataFrame([("1 Jan 2020", "NA", "2.5", "-1"), ("2 Jan 2020", "1", "2", "NA"), ("x", "1", "2", "3")], "date string, buy string, sell string, net string")
    assert [(r.trade_date.day, r.buy, r.sell, r.net) for r in ld.parse_flow(raw).collect()] == [(1, 0.0, 2.5, -1.0)]


@pytest.mark.parametrize("forward,want", [(False, {1: None, 2: 2, 3: 3}), (True, {1: 1, 2: 1, 3: None})])
def test_two_rows_on_one_day_join_once(spark, forward, want):
    left = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 2)), (3, dt.date(2024, 1, 9))], "id int, ts date").withColumn("ticker", F.lit("A"))
    right = spark.createDataFrame([("A", dt.datetime(2024, 1, 2, 9), 1), ("A", dt.datetime(2024, 1, 2, 15), 2), ("A", dt.datetime(2024, 1, 5), 3)], "ticker string, ts timestamp_ntz, v int")
    got = jn.asof_day(left, right, ["v"], forward=forward).collect()
    assert len(got) == 3 and {r.id: r.v for r in got} == want


def test_keywords_beyond_the_stored_summary_count(spark):
    news = spark.createDataFrame([(1, "t", "x" * 1500 + " growth rbi", DAY)], "doc_id int, title string, summary string, created_at timestamp")
    (r,) = tx.ingest(news, {"A": ("growth",)}, F.lit(DAY).cast("timestamp")).collect()
    assert r.ticker == "A" and len(r.summary) == 1000


def test_a_tickers_share_of_the_backlog(spark):
    rows = [(i, f"T{i % 2}", DAY + dt.timedelta(minutes=i)) for i in range(100)]
    news = spark.createDataFrame(rows, "doc_id int, ticker string, created_at timestamp")
    got = tx.backlog(news, 50, F.lit(True)).groupBy("ticker").count().collect()
    assert {r.ticker: r["count"] for r in got} == {"T0": 25, "T1": 25}


def test_latest_sink_goes_on_after_a_restart(spark, tmp_path):
    schema = "k string, ts long, v int"
    folder, base = str(tmp_path / "in"), f"file://{tmp_path}/state"
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], schema).coalesce(1).write.parquet(folder)
    run = lambda: {r.k: r.v for r in jobs.latest_sink(spark.readStream.schema(schema).parquet(folder), "k", ["ts"], base).collect()}
    assert run() == {"a": 1, "b": 1} == run()
    spark.createDataFrame([("a", 3, 3), ("c", 1, 1)], schema).coalesce(1).write.mode("append").parquet(folder)
    assert run() == {"a": 3, "b": 1, "c": 1}
    spark.createDataFrame([("a", 2, 2)], schema).coalesce(1).write.mode("append").parquet(folder)
    assert run() == {"a": 3, "b": 1, "c": 1} == run()
