"""The registered stream of sentiment windows against brute force."""

import collections
import datetime
import random

from pyspark.sql import functions as F

from barflow.plans import registry

START, HOUR = datetime.datetime(2024, 1, 1), datetime.timedelta(hours=1)


def test_every_window_of_24_hours_is_answered(spark, tmp_path):
    """Each article counts in 24 windows, those that are open when the stream ends among them."""
    rng = random.Random(3)
    rows = [(i, "text", "en", rng.choice(["a", "b"]), rng.randrange(500)) for i in rng.sample(range(3000), 400)] + [(None, "text", "en", "a", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = collections.defaultdict(list)
    for i, _, _, source, n in rows[:-1]:
        for k in range(1, 25):
            want[source, START + (i // 60 + k) * HOUR].append(n % 21 - 10)
    got = {(r.ticker, r.ts): r for r in registry.queries()["stream_sentiment"](spark, str(tmp_path)).withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    for key, tenths in want.items():
        r = got[key]
        assert (r["count"], r.positive, r.negative) == (len(tenths), sum(t > 2 for t in tenths), sum(t < -2 for t in tenths))
        assert abs(r.score - sum(tenths) / len(tenths) / 10) < 0.00005001
