import datetime as dt

from pyspark.sql import functions as F

from barflow.operators import gates as sg
from barflow.operators import joins as jn
from barflow.operators import outcomes as bt
from barflow.sources import landing as ld
from barflow.streaming import jobs

from .conftest import make_bars
from .test_rules import cycles


def test_flow_csv_round_trip(spark, tmp_path):
    for year, body in {"2020": '2 Jan 2020,"1,200.50",200.5,1000\n3 Jan 2020,NA,1,2\n', "2021": "4 Jan 2021,5,3,2\n4 Jan 2021,9,3,6\n"}.items():
        (tmp_path / f"flow_{year}.csv").write_text("date,buy,sell,net\n" + body)
    raw = ld.read_flow_csv(spark, str(tmp_path))
    got = ld.ingest_new(ld.parse_flow(raw), spark.createDataFrame([(dt.date(2019, 1, 1),)], "trade_date date")).orderBy("trade_date").collect()
    assert [(r.trade_date.isoformat(), r.buy) for r in got] == [("2020-01-02", 1200.5), ("2020-01-03", 0.0), ("2021-01-04", 5.0)]


def test_asof_bucketed_equals_brute_force(spark):
    left = [(k, i * 7 % 90) for i in range(200) for k in ("hot", "b")]
    right = [("hot", 3), ("hot", 40), ("hot", 41), ("b", 88)]
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = lambda c: base + F.make_dt_interval(days=F.col(c))
    lf = spark.createDataFrame([(k, d, i) for i, (k, d) in enumerate(left)], "ticker string, d int, id int").withColumn("ts", at("d"))
    rf = spark.createDataFrame(right, "ticker string, rd int").withColumn("ts", at("rd"))
    for forward in (False, True):
        got = {r.id: r.rd for r in jn.asof(lf, rf, ["rd"], unit="week", forward=forward).collect()}
        for i, (k, d) in enumerate(left):
            ok = [r for kk, r in right if kk == k and (r >= d if forward else r <= d)]
            assert got[i] == ((min(ok) if forward else max(ok)) if ok else None)
        day = {r.id: r.rd for r in jn.asof_day(lf, rf.withColumn("ts", F.to_date("ts")), ["rd"], forward=forward).collect()}
        assert day == got


def test_non_overlapping_trades_do_not_overlap(spark):
    b = bt.indexed(make_bars(spark, 250, ("AAA",)))
    done = bt.outcomes(bt.entries(b, F.when(F.col("i") % 3 == 0, "LONG").when(F.col("i") % 3 == 1, "SHORT").otherwise("FLAT")), b)
    all_rows = {r.i: r.exit_i for r in done.collect()}
    taken = sorted((r.i, r.exit_i) for r in bt.non_overlapping(done.select("ticker", "i", "exit_i")).collect())
    want, busy = [], -1
    for i in sorted(all_rows):
        if i > busy:
            want.append((i, all_rows[i]))
            busy = all_rows[i]
    assert taken == want


def test_stream_state_survives_batches(spark, tmp_path):
    """Six files, one per micro-batch: the streamed rule equals the batch closed form for all rows that the watermark has passed."""
    x = sg.decisive(cycles(spark, 600)).withColumn("confirm", F.lit(2)).select("skey", "ts", "event_id", "confirm", "decisive", "prob_long", "prob_flat", "prob_short")
    for part in range(6):
        x.where((F.col("event_id") >= part * 100) & (F.col("event_id") < part * 100 + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.event_id: r.committed for r in jobs.drain(jobs.stabiliser(stream)).collect()}
    passed = x.select(F.max("ts") - F.expr("interval 10 minutes")).first()[0]
    want = {r.event_id: r.committed for r in sg.stabilise(x, rows=16).collect() if r.ts <= passed}
    assert got == want and 500 < len(got) < 600


def test_latest_sink_keeps_newest(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("a", i), ("b", 10 - i)], "k string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert {(r.k, r.v) for r in jobs.latest_sink(stream, "k", ["v"], str(tmp_path / "out")).collect()} == {("a", 2), ("b", 10)}
