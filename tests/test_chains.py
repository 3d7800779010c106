"""Paths along pointers against walking them, and the rules built on them on one hot key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.functions import chains
from barflow.operators import gates, outcomes


def walk(nxt):
    on, i = [], 0
    while i is not None and i < len(nxt):
        on.append(i)
        i = nxt[i]
    return on


@pytest.mark.parametrize("rows", [4, 16, 4096])
def test_path_is_the_walk(spark, rows):
    rng = random.Random(rows)
    keys = {k: [rng.choice((None, *[i + 1 + rng.randrange(1 + rng.choice((1, 3, 40)))] * 9)) for i in range(n)] for k, n in (("a", 1), ("b", 300), ("c", 77), (None, 0))}
    keys = {k: [None if x is None or x >= len(v) else x for x in v] for k, v in keys.items()}
    nodes = spark.createDataFrame([(k, i, x) for k, v in keys.items() for i, x in enumerate(v)], "key string, i long, nxt long").repartition(5)
    for got in (chains.path(nodes, rows), chains.doubled(nodes)):
        assert sorted(map(tuple, got.collect())) == sorted((k, i) for k, v in keys.items() for i in walk(v) if v)
    assert chains.path(nodes.limit(0), rows).collect() == []


def test_a_path_without_shortcuts_is_solved_too(spark):
    """Every row follows the one before: no level is smaller than the last."""
    nodes = spark.range(400).select(F.lit(7).alias("key"), F.col("id").alias("i"), F.when(F.col("id") < 398, F.col("id") + 2).alias("nxt"))
    assert sorted(r.i for r in chains.path(nodes, 8).collect()) == list(range(0, 400, 2))


def test_blocks_by_numpy():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n, base = int(rng.integers(1, 60)), int(rng.integers(0, 1000))
        nxt = base + np.arange(n) + rng.integers(1, 9, n)
        nxt[rng.random(n) < 0.05] = chains.END
        for entry in range(base, base + n):
            on, i = [], entry
            while i < base + n:
                on.append(i)
                i = int(nxt[i - base])
            assert chains.block_path(nxt, base, entry).tolist() == on and chains.block_exits(nxt, base)[entry - base] == i


def test_cool_down_of_a_million_rows_of_one_key(spark, monkeypatch):
    """A row every few seconds, never a gap that long: blocks stay at their size and the result is that of a loop."""
    n, seen = 1_000_000, []
    ts = (F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 7_000_000 + F.pmod(F.xxhash64("id"), F.lit(6_000_000))))
    df = spark.range(n).select(F.lit("hot").alias("skey"), ts.cast("timestamp_ntz").alias("ts"), F.col("id").alias("event_id"))
    real = chains._largest
    monkeypatch.setattr(chains, "_largest", lambda x: seen.append(real(x)) or seen[-1])
    got = gates.cooldown(df, seconds=1800).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "emitted").toPandas().sort_values("event_id")
    want, last = np.zeros(n, int), None
    for i, t in enumerate(got["us"].tolist()):
        if last is None or t - last >= 1_800_000_000:
            want[i], last = 1, t
    assert (got["emitted"].to_numpy() == want).all()
    assert seen[0] == n and seen[1] < n / 8  # far fewer rows may begin a block's path


def test_non_overlapping_trades_of_one_hot_key(spark):
    rng = random.Random(8)
    rows = [("hot", i, i + rng.randrange(1, 30)) for i in range(20_000) if rng.random() < 0.7] + [("cold", 5, None), ("cold", 9, 12)]
    got = sorted(map(tuple, outcomes.non_overlapping(spark.createDataFrame(rows, "ticker string, i long, exit_i long"), rows=512).collect()))
    want, busy = [], -1
    for k, i, x in rows[:-2]:
        if i > busy:
            want.append((k, i, x))
            busy = x
    assert got == sorted([*want, ("cold", 5, None)])
