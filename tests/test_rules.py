import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.operators import gates as sg
from barflow.operators import ledger as lq
from barflow.operators import regime as rg
from barflow.operators import risk as rk
from barflow.streaming.jobs import dedup_step, stabilise_step


def cycles(spark, n=1500, seed=3):
    """Random probabilities for a hot key and a few small ones, as (row, event) pairs."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = "hot" if rng.random() < 0.7 else f"k{rng.integers(0, 5)}"
        p = rng.dirichlet([1, 0.7, 1])
        rows.append((k, i, f"2024-02-{1 + i * 28 // n:02d} 00:00:00", *[round(float(x), 6) for x in p]))
    return spark.createDataFrame(rows, "skey string, event_id long, t string, prob_long double, prob_flat double, prob_short double").withColumn("ts", F.col("t").cast("timestamp"))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_stabilise_equals_state_machine(spark, n):
    got = sg.stabilise(cycles(spark).withColumn("confirm", F.lit(n)), rows=8).orderBy("ts", "event_id").toPandas()
    assert len(got) == 1500
    for _, g in got.groupby("skey"):
        state = None
        for dec, com in zip(g["decisive"], g["committed"]):
            (want,), state = stabilise_step(state, n, dec)
            assert com == want


def test_alert_dedup_equals_state_machine(spark):
    x = sg.decisive(cycles(spark)).withColumn("confidence", F.round(F.greatest("prob_long", "prob_flat", "prob_short"), 2))
    got = sg.alert_dedup(x.select("skey", "ts", "event_id", "decisive", "confidence"), direction="decisive", rows=8).orderBy("ts", "event_id").toPandas()
    for _, g in got.groupby("skey"):
        state = None
        for d, c, s in zip(g["decisive"], g["confidence"], g["sent"]):
            (want,), state = dedup_step(state, d, c)
            assert s == want


def test_regime_persistence_equals_state_machine(spark):
    rng = np.random.default_rng(5)
    rows = [("A", i, str(rng.choice(rg.REGIMES, p=[0.4, 0.3, 0.05, 0.25]))) for i in range(400)]
    got = rg.persist(spark.createDataFrame(rows, "ticker string, ts int, regime string")).orderBy("ts").toPandas()
    committed, hist = None, []
    for raw, c in zip(got["regime"], got["committed_regime"]):
        hist.append(raw)
        if committed is None or raw == committed or raw == rg.HIGH_VOL or hist[-3:] == [raw] * 3:
            committed = raw
        assert c == committed


def admit(cands, cfg, capital):
    opened = []
    for c in sorted(cands, key=lambda c: (-c["confidence"], c["ticker"], c["category"], c["direction"])):
        v, sign = c["position_value"], lambda o: o["position_value"] if o["direction"] == "LONG" else -o["position_value"]
        if any(o["ticker"] == c["ticker"] and o["category"] == c["category"] for o in opened) or len(opened) >= cfg["max_positions"]:
            continue
        if sum(o["position_value"] for o in opened if o["ticker"] == c["ticker"]) + v > 0.4 * capital or sum(o["position_value"] for o in opened) + v > 0.8 * capital:
            continue
        if len({o["ticker"] for o in opened if o["direction"] == c["direction"] and o["ticker"] != c["ticker"]}) + 1 > cfg["max_same_dir_cluster"]:
            continue
        if abs(sum(map(sign, opened)) + sign(c)) > 0.6 * capital:
            continue
        opened.append(c)
    return {(c["ticker"], c["category"]) for c in opened}


@pytest.mark.parametrize("mode", ["SMALL", "GROWING", "FULL"])
def test_admission_equals_sequential_rule(spark, mode):
    rng = np.random.default_rng(9)
    rows = []
    for day in range(25):
        for t in "ABCDE":
            for c in ("swing", "intraday", "positional"):
                if rng.random() < 0.6:
                    rows.append((day, t, c, str(rng.choice(["LONG", "SHORT"])), round(float(rng.random()), 4), float(rng.integers(1, 6) * 10000)))
    df = spark.createDataFrame(rows, "ts int, ticker string, category string, direction string, confidence double, position_value double")
    got = rk.admission(df, mode=mode).toPandas()
    for day in range(25):
        cands = [dict(zip(df.columns, r)) for r in rows if r[0] == day]
        assert {(r.ticker, r.category) for r in got[got["ts"] == day].itertuples()} == admit(cands, rk.MODES[mode], 100_000)


def size(spark, **kw):
    row = dict(direction="LONG", capital=100000.0, current_price=1842.0, atr=28.4, size_mult=1.0, capital_mode="FULL", category="swing", monthly_dd_pct=0.0, event_mult=1.0) | kw
    return rk.position_size(spark.createDataFrame([tuple(row.values())], list(row))).head()


def test_position_size(spark):
    long, short = size(spark), size(spark, direction="SHORT")
    assert long.stop_loss < 1842 < long.target and short.target < 1842 < short.stop_loss
    assert long.position_value <= 40000 and long.shares >= 1 and long.reward_risk == 2.5
    assert size(spark, current_price=0.0).shares == 0 and size(spark, atr=0.0).shares == 0
    assert size(spark, monthly_dd_pct=-0.07).dd_mult == 0.25


def test_breaker_levels(spark):
    def level(**kw):
        row = dict(capital_mode="FULL", monthly_dd_pct=-0.01, consecutive_losses=0, severity="LOW", model_accuracy_10=0.55) | kw
        return rk.breaker(spark.createDataFrame([tuple(row.values())], list(row))).head().breaker_level

    assert level() == "OK" and level(monthly_dd_pct=-0.16) == "HALT" and level(consecutive_losses=3) == "PAUSE" and level(consecutive_losses=5) == "HALT"
    assert level(monthly_dd_pct=0.2) == "OK" and level(model_accuracy_10=0.3) == "HALT" and level(severity="HIGH") == "PAUSE"


def test_gate1_and_alignment(spark):
    rows = [("BULL_TRENDING", 0.8, 0), ("CHOPPY_SIDEWAYS", 0.8, 0), ("BULL_TRENDING", 0.2, 0), ("BULL_TRENDING", 0.3, 2)]
    g = sg.gate1(rg.with_rules(spark.createDataFrame(rows, "regime string, stability double, regime_changes int"))).collect()
    assert [r.g1_passed for r in g] == [True, False, False, True] and g[3].g1_mult == pytest.approx(1.2 * 0.75 * 0.65)
    votes = [("LONG", "LONG", "LONG", "A+"), ("LONG", "LONG", "FLAT", "A"), ("LONG", "FLAT", "LONG", "B"), ("LONG", "LONG", "SHORT", "B-"), ("LONG", "SHORT", "FLAT", "F"), ("FLAT", "LONG", "FLAT", "C")]
    x = sg.alignment(spark.createDataFrame(votes, "positional string, swing string, intraday string, want string"), regime_aware=False).collect()
    assert all(r.alignment == r.want for r in x)


def test_five_seeded_trades(spark):
    """500, -250, 400, 400, -250 over January and February."""
    pnl, days = [500, -250, 400, 400, -250], ["2026-01-10", "2026-01-15", "2026-01-20", "2026-02-01", "2026-02-05"]
    rows = [("T", i, str(i), d, 1 if p > 0 else -1, p * 10000) for i, (p, d) in enumerate(zip(pnl, days))]
    led = spark.createDataFrame(rows, "ticker string, trade_no long, signal_uuid string, d string, pnl_points long, pnl_e4 long").withColumn("close_date", F.col("d").cast("date"))
    assert lq.total_pnl(led).head().total_pnl == 800
    assert lq.consecutive_losses(led).head().consecutive_losses == 1
    curve = lq.equity_curve(led).orderBy("close_date").collect()
    assert len(curve) == 5 and curve[-1].equity == 100800
    r = lq.runs(led).head()
    assert (r.max_consec_wins, r.max_consec_losses) == (2, 1)
