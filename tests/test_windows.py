import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.functions import windows as fw
from barflow.operators import technical as ta

from .conftest import make_bars


def ema(x, span, adjust):
    a, out = 2 / (span + 1), []
    num = den = 0.0
    for i, v in enumerate(x):
        if adjust:
            num, den = num * (1 - a) + v, den * (1 - a) + 1
            out.append(num / den)
        else:
            out.append(v if i == 0 else a * v + (1 - a) * out[-1])
    return np.array(out)


@pytest.mark.parametrize("span,adjust", [(9, False), (50, False), (20, True)])
def test_ewm_equals_recurrence_across_blocks(spark, span, adjust):
    bars = make_bars(spark, 1500, ("AAA",))
    got = fw.ewm(bars, {"e": ("close", span, adjust)}).orderBy("ts").toPandas()
    np.testing.assert_allclose(got["e"], ema(got["close"], span, adjust), rtol=1e-12)


def series(spark, n=500, keys=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = 0 if rng.random() < 0.6 else int(rng.integers(1, keys))  # one hot key
        rows.append((k, i, f"2024-01-{1 + i * 28 // n:02d} 00:00:00", float(rng.integers(0, 100))))
    return spark.createDataFrame(rows, "k int, id int, t string, v double").withColumn("ts", F.col("t").cast("timestamp"))


def test_index_rows_blocked_and_prefix_equal_plain_windows(spark):
    df = fw.index_rows(series(spark), "k", ["ts", "id"], F.to_date("ts"))
    df = fw.prefix(df, "k", {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", F.when(F.col("v") > 80, F.col("v")))}, rows=7)
    w = fw.W.partitionBy("k").orderBy("ts", "id")
    run = fw.running(w)
    x = df.withColumns({"wi": F.row_number().over(w) - 1, "ws": F.sum("v").over(run), "wm": F.max("v").over(run), "wl": F.last(F.when(F.col("v") > 80, F.col("v")), ignorenulls=True).over(run)})
    bad = x.where((F.col("i") != F.col("wi")) | (F.col("s") != F.col("ws")) | (F.col("m") != F.col("wm")) | ~F.col("l").eqNullSafe(F.col("wl")))
    assert x.count() == 500 and bad.count() == 0
    b = fw.blocked(df, "i", 3, 8)
    lagged = fw.unblock(b.withColumn("p", F.lag("v", 3).over(fw.W.partitionBy("k", "_blk").orderBy("i"))))
    y = lagged.join(x.withColumn("q", F.lag("v", 3).over(w)).select("id", "q"), "id")
    assert y.count() == 500 and y.where(~F.col("p").eqNullSafe(F.col("q"))).count() == 0


def test_features_never_look_ahead(spark):
    bars = make_bars(spark, 290, ("AAA",))
    cut = bars.orderBy("ts").limit(270)
    names = [c for c in ta.FEATURES]
    full = ta.technical_frame(bars).select("ts", *names).toPandas().set_index("ts")
    part = ta.technical_frame(cut).select("ts", *names).toPandas().set_index("ts")
    both = full.loc[part.index]
    for c in names:
        np.testing.assert_allclose(both[c].astype(float), part[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_feature_bounds(spark):
    f = ta.zero_filled(ta.technical_frame(make_bars(spark, 300, ("AAA",)))).toPandas()
    assert f["rsi_14"].between(0, 100).all() and f["stoch_rsi"].between(-1e-6, 1.000001).all() and f["adx"].between(0, 100.001).all()
    assert np.isfinite(f[list(ta.FEATURES)].to_numpy(dtype=float)).all()
