"""Runs of wins and losses and trades after a loss, over days, against the plain loop."""

import datetime
import random

import pytest

from barflow.operators import ledger as lq

DAY = datetime.date(2024, 1, 1)
DDL = "ticker string, opened_at date, close_date date, trade_no long, signal_uuid string, pnl_points long, pnl_e4 long"


def trades(seed, share, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        closed = DAY + datetime.timedelta(days=rng.randrange(40))
        p = 1 if rng.random() < share else -1
        rows.append((rng.choice("AB"), closed - datetime.timedelta(days=rng.randrange(3)), closed, i, f"u{i}", p, p * 10000))
    return rows


@pytest.mark.parametrize("share", [0.5, 0.97, 0.03, 1.0])
def test_runs_and_revenge_equal_the_loop(spark, share):
    rows = trades(1, share)
    led = spark.createDataFrame(rows, DDL)
    want_runs, want_revenge = {}, {}
    for t in "AB":
        own = sorted((r for r in rows if r[0] == t), key=lambda r: r[2:5])
        best, run, last, hits = {True: 0, False: 0}, 0, None, 0
        for prev, r in zip([None, *own], own):
            w = r[5] > 0
            run = run + 1 if w == last else 1
            last, best[w] = w, max(best[w], run)
            hits += prev is not None and prev[5] <= 0 and (r[1] - prev[2]).days == 0
        want_runs[t], want_revenge[t] = (best[True], best[False]), hits
    assert {r.ticker: (r.max_consec_wins, r.max_consec_losses) for r in lq.runs(led).collect()} == want_runs
    assert {r.ticker: r.revenge_trades for r in lq.revenge(led).collect()} == want_revenge


def test_behaviour_reads_the_trades_twice(spark, sf_dir):
    """Before, each of the detectors joined lines with orders anew."""
    from barflow.sources import adapters as src

    plan = lq.behaviour(src.ledger(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") and sum("Relation" in x and "l_orderkey" in x for x in plan.splitlines()) == 2


def test_metrics_read_the_trades_twice(spark, sf_dir):
    from barflow.sources import adapters as src

    plan = lq.metrics(src.ledger(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in x and "l_orderkey" in x for x in plan.splitlines()) == 2
