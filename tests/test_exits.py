"""Exit ladder: holds follow the regime, intraday legs close in their session."""

import datetime

from barflow.operators import outcomes as bt
from barflow.operators.regime import BEAR, BULL, CHOPPY

DAY = datetime.date(2024, 1, 1)


def test_holds_follow_the_regime_of_the_entry(spark):
    days = [DAY + datetime.timedelta(i) for i in range(40)]
    bars = spark.createDataFrame([("A", d, 100.0, 100.1, 99.9, 100.0, 1.0) for d in days], "ticker string, ts date, open double, high double, low double, close double, volume double")
    entries = spark.createDataFrame(
        [("A", i, days[i], "LONG", 1.0, 100.0, 90.0, 120.0, 8) for i in (0, 5, 10, 15)],
        "ticker string, i int, ts date, signal string, sign double, entry_price double, stop_price double, target_price double, max_hold int",
    )
    regimes = spark.createDataFrame([("A", days[0], BULL), ("A", days[5], BEAR), ("A", days[10], CHOPPY)], "ticker string, ts date, regime string")
    got = bt.ladder(bt.hold_by_regime(entries, regimes), bt.indexed(bars)).collect()
    assert {(r.i, r.exit_i - r.i, r.exit_reason) for r in got} == {(0, 21, "TIME_EXIT"), (5, 4, "TIME_EXIT"), (10, 8, "TIME_EXIT"), (15, 8, "TIME_EXIT")}
    assert len(got) == 12


def test_intraday_legs_close_in_their_session(spark):
    at = [datetime.datetime(2024, 1, d, 9, 30) + datetime.timedelta(minutes=30 * k) for d in (1, 2) for k in range(10)]
    close = [100 + 0.05 * k for k in range(20)]
    bars = bt.indexed(spark.createDataFrame([("A", t, c, c + 0.01, c - 0.01, c, 1.0) for t, c in zip(at, close)], "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double"))
    entries = bt.session_entries(bars)
    assert sorted((r.i, r.max_hold) for r in entries.collect()) == [(0, 9), (4, 5), (8, 1), (10, 9), (14, 5), (18, 1)]
    got = bt.ladder(entries, bars, "SESSION_CLOSE").collect()
    assert len(got) == 18 and all(r.exit_reason == "SESSION_CLOSE" and r.exit_i == (9 if r.i < 10 else 19) for r in got)
