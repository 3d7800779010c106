"""The full feature row: point-in-time joins against brute force, no look-ahead, registries."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from barflow.operators.assembly import Slow, point_in_time
from barflow.operators.registries import REGISTRIES, Registry
from barflow.plans import registry
from barflow.plans.assembly import NAMES, SETS

DAY = datetime.date(2024, 1, 1)


def days(n):
    return DAY + datetime.timedelta(n)


@pytest.mark.parametrize("seed", range(3))
def test_point_in_time_is_the_newest_row_of_each_table(spark, seed):
    rng = random.Random(seed)
    base = [(t, days(i)) for t in "ABC" for i in range(40) if rng.random() < 0.8]
    tables = {n: [(rng.choice("ABD"), datetime.datetime(2023, 12, 25) + datetime.timedelta(hours=rng.randrange(24 * 60)), rng.randrange(1000)) for _ in range(25)] for n in ("one", "two", "all")}
    frame = lambda rows: spark.createDataFrame(rows, "ticker string, at timestamp_ntz, v int")
    slow = {
        "one": Slow(frame(tables["one"]), "at", {"v1": "v"}), "two": Slow(frame(tables["two"]), F.col("at") + F.expr("interval 2 days"), {"v2": "v", "w2": F.col("v") * 2}, max_age=5),
        "all": Slow(frame(tables["all"]), "at", {"v3": "v"}, key=None), "none": Slow(frame([]), "at", {"v4": "v"}),
    }
    got = {(r.ticker, r.ts): tuple(r)[2:] for r in point_in_time(spark.createDataFrame(base, "ticker string, ts date"), slow).collect()}

    def newest(rows, day, key=None, age=None, shift=0):
        known = [(at + datetime.timedelta(shift), v) for k, at, v in rows if key in (None, k)]
        known = [(at, v) for at, v in known if at.date() <= day]
        at, v = max(known, default=(None, None))
        return None if at is None or (age and (day - at.date()).days >= age) else v

    assert len(got) == len(base)
    for t, d in base:
        v2 = newest(tables["two"], d, t, 5, 2)
        assert got[t, d] == (newest(tables["one"], d, t), v2, None if v2 is None else 2 * v2, newest(tables["all"], d), None)


def test_point_in_time_joins_the_base_twice_whatever_the_tables(spark):
    t = spark.createDataFrame([("A", DAY, 1)], "ticker string, at date, v int")
    base = spark.createDataFrame([("A", DAY)], "ticker string, ts date")
    out = point_in_time(base, {f"t{i}": Slow(t, "at", {f"v{i}": "v"}, key="ticker" if i % 2 else None) for i in range(8)})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and len(out.collect()) == 1


def test_registries_have_their_sizes_and_vectors_keep_order(spark):
    assert {k: len(r.names) for k, r in REGISTRIES.items()} == {
        ("swing", "full"): 83, ("swing", "prod"): 58, ("intraday", "full"): 42, ("intraday", "prod"): 33, ("positional", "full"): 59, ("positional", "prod"): 39,
    }
    r = Registry("m", "v", ("b", "missing", "a", "c"))
    df = spark.createDataFrame([(1, 2.5, float("nan")), (None, float("inf"), 3.0)], "a int, b double, c double")
    assert [x.v for x in df.select(r.vector(df).alias("v")).collect()] == [[2.5, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 3.0]]
    assert r.of({"c", "b"}).names == ("b", "c")
    with pytest.raises(ValueError):
        Registry("m", "v", ("a", "a"))


def test_every_feature_of_the_registries_but_one_is_assembled():
    """The agreement of earlier signals needs signal cycles, which the tables don't have; it is 0, as in any training set."""
    assert {n for r in SETS.values() for n in r.names} - set(NAMES) == {"tf_alignment_score"}
    assert len(NAMES) >= 83


#: Known ahead by schedule: result dates and what is counted to them, meetings, holidays.
SCHEDULED = {"earnings_proximity", "earnings_risk_flag", "pre_earnings_drift", "earnings_beat_prob", "rbi_proximity_norm", "holiday_proximity", "macro_score", "intermarket_score"}


def test_no_feature_of_a_bar_changes_with_what_comes_later(spark, sf_dir, tmp_path):
    cut = "1998-03-31"
    for name in os.listdir(sf_dir):
        df = spark.read.parquet(f"{sf_dir}/{name}")
        for stamp in ("l_shipdate", "o_orderdate"):
            if stamp in df.columns:
                df = df.where(F.col(stamp).cast("date") <= cut)
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    query = registry.queries()["feature_wide"]
    early, whole = ({(r.ticker, r.ts): r.asDict() for r in query(spark, d).where(F.col("ts") <= cut).collect()} for d in (str(tmp_path), sf_dir))
    assert early.keys() == whole.keys() and len(early) > 1000
    # trades closed until the cut may belong to order lines shipped after it
    form = {"rolling_accuracy_10", "losing_streak_norm", "model_health_score", "avg_model_confidence"}
    moved = {c for k, r in early.items() for c, v in r.items() if c not in ("ticker", "ts") and abs(v - whole[k][c]) > 1e-9}
    assert not moved - SCHEDULED - form
