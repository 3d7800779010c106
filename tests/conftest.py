import pytest

from barflow.session import local


@pytest.fixture(scope="session")
def spark():
    s = local(8, shuffle=4, name="barflow-tests", memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def make_bars(spark, n=300, tickers=("AAA", "BBB"), seed=42):
    """Seeded business-day OHLCV walk per ticker."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    parts = []
    for t in tickers:
        close = 1600 * np.cumprod(1 + rng.normal(0.0004, 0.012, n))
        open_ = close * (1 + rng.normal(0, 0.004, n))
        wick = np.abs(rng.normal(0, 0.005, n))
        parts.append(pd.DataFrame({
            "ticker": t, "ts": pd.bdate_range("2023-01-01", periods=n).date, "open": open_, "high": np.maximum(open_, close) * (1 + wick),
            "low": np.minimum(open_, close) * (1 - wick), "close": close, "volume": rng.integers(5_000_000, 20_000_000, n).astype(float),
        }))
    return spark.createDataFrame(pd.concat(parts), "ticker string, ts date, open double, high double, low double, close double, volume double")
