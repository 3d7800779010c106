"""Which dimensions are broadcast."""

from pyspark.sql import functions as F

from barflow.sources import adapters as src


def _hinted(df):
    return "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()


def test_small_files_with_many_rows_are_not_broadcast(spark, tmp_path):
    """1.2 million rows of few bytes each are a table of over 64 MB on the driver."""
    path = str(tmp_path / "wide.parquet")
    spark.range(1_200_000).select(F.col("id").alias("key"), F.lit("BUILDING").alias("segment")).coalesce(1).write.parquet(path)
    x = spark.read.parquet(path)
    assert int(str(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < src.BROADCAST_LIMIT
    assert not _hinted(src.checked(x))
    assert _hinted(src.checked(x.select("key"), x.select("key")))  # 48 MB
    assert _hinted(src.checked(spark.read.parquet(path).select("key", "segment"), limit=256 << 20))


def test_rows_are_counted_once_for_each_table(spark, tmp_path):
    frames = []
    for n in (150_000, 300_000):
        spark.range(n).write.parquet(path := str(tmp_path / f"t{n}.parquet"))
        frames.append(spark.read.parquet(path))
    token = src._kept.set({})
    try:
        assert [src._rows(f) for f in (*frames, *frames)] == [150_000, 300_000] * 2
        assert len(src._kept.get()) == 2
        assert src._rows(frames[0].where("id % 2 = 0")) == 75_000
    finally:
        src._kept.reset(token)
