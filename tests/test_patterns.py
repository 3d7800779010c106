import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barflow.operators import patterns as pt


def test_equal_band_widths_are_no_breakout(spark):
    """A narrow series whose last window has the closes of the window two bars before, in another order."""
    rng = np.random.default_rng(1)
    close = 1200 + np.concatenate([rng.integers(-60, 60, 70), rng.integers(-20, 20, 30)]).astype(float)
    close[-1], close[-2] = close[-22], close[-21]
    assert sorted(close[-20:]) == sorted(close[-22:-2])
    bars = pd.DataFrame({"ticker": "A", "ts": pd.date_range("2024-01-01", periods=100).date, "open": close, "high": close, "low": close, "close": close, "volume": 1.0})
    df = spark.createDataFrame(bars, "ticker string, ts date, open double, high double, low double, close double, volume double")
    got = [r.chart_bb_breakout for r in pt.breakouts(df).orderBy("ts").collect()]
    assert got[-1] == 0
    wider = bars.assign(close=[*close[:-1], close[-1] + 300])
    got = [r.chart_bb_breakout for r in pt.breakouts(spark.createDataFrame(wider, df.schema)).orderBy(F.col("ts")).collect()]
    assert got[-1] == 1
