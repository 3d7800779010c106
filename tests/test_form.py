"""Recent form: the day's trades from its floor on against the plain loop; small tables are made once for all groups."""

import datetime
import random

import pytest

from barflow.operators import ledger as lq
from barflow.plans import assembly
from barflow.sources import adapters as src

DAY = datetime.date(2024, 1, 1)
DDL = "ticker string, opened_at date, close_date date, trade_no long, signal_uuid string, pnl_points long, confidence double"


def trades(seed, share, n=1500, numbers=400):
    """Days of very different sizes, numbers that several trades share, long stretches without a win."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        closed = DAY + datetime.timedelta(days=min(rng.randrange(30), rng.randrange(30)))
        win = rng.random() < share and closed.day % 5 != 0
        rows.append((rng.choice("AB"), closed - datetime.timedelta(days=rng.randrange(1, 8)), closed, rng.randrange(numbers), f"u{i}", 1 if win else -1, rng.randrange(50, 90) / 100))
    return rows


def loop(rows):
    out = {}
    for t in "AB":
        own = sorted((r for r in rows if r[0] == t), key=lambda r: r[2:5])
        run = 0
        for i, r in enumerate(own):
            run = 0 if r[5] > 0 else run + 1
            ten = own[max(0, i - 9) : i + 1]
            out[t, r[2]] = (round(sum(x[5] > 0 for x in ten) / len(ten), 4), round(sum(x[6] for x in ten) / len(ten), 6), run)
    return out


@pytest.mark.parametrize(("share", "numbers"), [(0.5, 400), (0.01, 400), (0.0, 400), (0.5, 3), (0.5, 10**6)])
def test_form_of_the_days_newest_trades_is_that_of_all(spark, share, numbers):
    rows = trades(1, share, numbers=numbers)
    led = spark.createDataFrame(rows, DDL).cache()
    floors = lq.day_floors(led).cache()
    least = {(r.ticker, r.close_date): r._floor for r in floors.collect()}
    kept = spark.createDataFrame([r for r in rows if r[3] >= least[r[0], r[2]]], DDL)
    for got in (lq.day_state(led), lq.day_state(led, floors=floors), lq.day_state(kept, floors=floors)):
        assert {(r.ticker, r.close_date): (r.rolling_accuracy_10, r.avg_model_confidence, r.losing_streak) for r in got.collect()} == loop(rows)


def test_only_the_newest_trades_of_a_large_day_are_put_in_order(spark):
    led = spark.createDataFrame([("A", DAY, DAY, i, f"u{i}", 1 if i % 3 else -1, 0.5) for i in range(20000)], DDL)
    assert lq.day_floors(led).collect()[0]._floor >= 19800


def test_orders_below_every_floor_of_their_day_are_left_out(spark, sf_dir):
    led = src.ledger(spark, sf_dir)
    floors = lq.day_floors(led).cache()
    since = src.ledger_since(spark, sf_dir, floors)
    cols = ["ticker", "close_date", "trade_no", "signal_uuid"]
    least = {(r.ticker, r.close_date): r._floor for r in floors.collect()}
    want = [tuple(r) for r in led.select(*cols).collect() if r.trade_no >= least[r.ticker, r.close_date]]
    assert set(want) <= {tuple(r) for r in since.select(*cols).collect()}


def test_groups_share_the_small_tables_made_of_lines_and_orders(spark, sf_dir):
    """Before, the chain was made again wherever it is used, and so were meetings, rates, holidays and block deals."""
    token = src._kept.set({})
    try:
        for name in ("options_row", "calendar_row", "macro_row", "ownership_row"):
            plan = assembly.GROUPS[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
            assert "l_shipdate" not in plan, name
            assert plan.count("o_orderdate#") == 0 or name == "ownership_row", name  # its shares of orders are read once
    finally:
        src._kept.reset(token)


def test_bars_series_and_ratios_come_from_one_reading_of_the_lines(spark, sf_dir, monkeypatch):
    """Before, each of the three read the lines anew."""
    apart = [sorted(f.collect()) for f in (src.bars(spark, sf_dir), src.bars(spark, sf_dir, by="series"), src.fundamentals(spark, sf_dir))]
    read, table = [], src.table
    monkeypatch.setattr(src, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    token = src._kept.set({})
    try:
        shared = [sorted(f.collect()) for f in (src.bars(spark, sf_dir), src.bars(spark, sf_dir, by="series"), src.fundamentals(spark, sf_dir))]
    finally:
        src._kept.reset(token)
    assert shared == apart and read.count("lineitem") == 1
