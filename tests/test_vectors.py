"""The query of vectors gives every value of each registry, in its order."""

import random

from barflow.operators.registries import REGISTRIES
from barflow.plans import assembly


def test_vectors_are_whole(spark, monkeypatch):
    rng = random.Random(1)
    rows = [{n: round(rng.uniform(-1, 1), 6) for n in assembly.NAMES} for _ in range(3)]
    rows[1]["rsi_14"] = -0.0
    rows[2]["rsi_14"] = None
    frame = spark.createDataFrame([(f"T{i}", i, *r.values()) for i, r in enumerate(rows)], "ticker string, ts int, " + ", ".join(f"{n} double" for n in assembly.NAMES))
    monkeypatch.setattr(assembly, "wide", lambda spark, d: frame)
    got = {r.ts: r.asDict() for r in assembly.vectors(spark, "").collect()}
    assert len(got) == 3
    for i, row in enumerate(rows):
        for (m, v), r in REGISTRIES.items():
            want = [round((row.get(n) or 0.0) * 1_000_000) for n in r.names]
            assert [int(x) for x in got[i][f"vector_{m}_{v}"].split(" ")] == want
            assert got[i][f"n_{m}_{v}"] == len(r.names) and got[i][f"sum_{m}_{v}"] == sum(k * x for k, x in enumerate(want, 1))
