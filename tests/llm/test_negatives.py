"""Hard negatives against scoring every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.llm import negatives, queries
from barflow.llm.negatives import augmented, cover_tree, hard_negatives

from ..oracle_check import compare, duck

VECTORS = "id long, vector array<long>, label int, tree int, piece string, score long"


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "p", 2) for r in rows], VECTORS).repartition(3)


def brute(rows, is_anchor, positives=5, negatives_=3, low=50, high=95):
    by = {}
    for i, v, y in rows:
        if i is not None and v is not None and y is not None and None not in v:
            by[i] = min(by.get(i, (y, v)), (y, v))
    dot = lambda a, b: sum(x * z for x, z in zip(a, b))
    out = set()
    for i, (y, v) in by.items():
        if not is_anchor(i):
            continue
        scored = sorted((-dot(v, w), j, x) for j, (x, w) in by.items() if j != i)
        for s, j, _ in [r for r in scored if r[2] == y][:positives]:
            fits = [(n, k) for n, k, x in scored if x != y and low * -s <= 100 * -n <= high * -s]
            out |= {(i, j, rank, k, -s, -n) for rank, (n, k) in enumerate(fits[:negatives_], 1)}
    return out


def clustered(seed, n, width=6, labels=3, copies=0.3, spread=9):
    rng = random.Random(seed)
    centers = [[rng.randrange(-60, 61) for _ in range(width)] for _ in range(8)]
    rows = []
    for i in range(n):
        v = [x + rng.randrange(-spread, spread + 1) for x in rng.choice(centers)]
        rows.append((i, rows[-1][1] if rows and rng.random() < copies else v, rng.randrange(labels)))
    return rows


def test_every_point_lies_within_its_nodes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 400):
        v = rng.integers(-50, 50, (n, 5)) // rng.integers(1, 20, (n, 1))
        bound = math.sqrt((v * v).sum(1).max()) or 0.0
        points = augmented(v, bound)
        labels = rng.integers(0, 2, n)
        nodes, order = cover_tree(points, labels, bound)
        assert sorted(order.tolist()) == list(range(n))

        def below(k):
            node = nodes[k]
            own = order[node["point"] : node["point"] + node["points"]].tolist()
            return own + [x for c in range(node["child"], node["child"] + node["children"]) for x in below(c)]

        assert sorted(below(0)) == list(range(n))
        for k, node in enumerate(nodes):
            own = below(k)
            assert node["center"] in own and np.linalg.norm(points[own] - points[node["center"]], axis=1).max() <= node["radius"] + 1e-9
            assert node["label"] == (labels[own[0]] if len(set(labels[own])) == 1 else negatives.MIXED)
            kids = nodes[node["child"] : node["child"] + node["children"]]["center"]
            apart = np.linalg.norm(points[kids][:, None] - points[kids][None], axis=2)
            assert len(kids) < 2 or apart[~np.eye(len(kids), dtype=bool)].min() > (node["radius"] - 1e-7 * bound) / 2 - 1e-6


def test_bounds_hold_and_leave_out_subtrees():
    rows = clustered(3, 1500, spread=3)
    v, labels, ids = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    bound = math.sqrt((v * v).sum(1).max())
    nodes, order = cover_tree(augmented(v, bound), labels, bound)
    tree = negatives.Tree({"nodes": nodes.tobytes(), "order": order.tobytes(), "ids": ids[order].tobytes(), "labels": labels[order].astype(np.int64).tobytes(), "vectors": v[order].astype(np.int64).tobytes(), "bound": bound, "exact": True})
    least, most = tree.bounds(v[:50])
    scores = v[:50] @ v[order].T
    for k, node in enumerate(nodes):
        own = slice(node["point"], node["point"] + node["points"])
        if node["points"]:
            assert (scores[:, own] >= least[:, [k]]).all() and (scores[:, own] <= most[:, [k]]).all()
    top = np.sort(scores, 1)[:, -5]
    assert (most < top[:, None]).mean() > 0.5  # more than half of all nodes need no visit


@pytest.mark.parametrize("seed", range(4))
def test_same_as_scoring_every_pair(make, monkeypatch, seed):
    monkeypatch.setattr(negatives, "TREE", 40)
    monkeypatch.setattr(negatives, "PIECE", 7)
    monkeypatch.setattr(negatives, "LEAF", 3)
    rows = clustered(seed, 260, labels=2 + seed, spread=(1, 4, 20, 60)[seed])
    got = hard_negatives(make(rows), F.col("id") % 5 == 0).collect()
    assert set(map(tuple, got)) == brute(rows, lambda i: i % 5 == 0) and len(got) == len(set(got))


def test_other_bounds(make):
    rows = clustered(9, 200)
    got = hard_negatives(make(rows), F.col("id") % 4 == 0, positives=2, negatives=7, low=0, high=100).collect()
    assert set(map(tuple, got)) == brute(rows, lambda i: i % 4 == 0, 2, 7, 0, 100)


def test_a_vector_that_a_third_shares(make, monkeypatch):
    monkeypatch.setattr(negatives, "TREE", 32)
    rows = clustered(5, 300)
    rows = [(i, rows[0][1], y) if i % 3 == 0 else (i, v, y) for i, v, y in rows]
    assert set(map(tuple, hard_negatives(make(rows), F.col("id") % 10 == 0).collect())) == brute(rows, lambda i: i % 10 == 0)


def test_odd_rows(make):
    rows = [
        (0, [5, 5], 1), (0, [5, 6], 1), (0, [5, 5], 1), (1, [5, 4], 1), (2, [3, 3], 2), (3, [3, 3], 2), (4, None, 1), (5, [None, 3], 2), (6, [9], 1), (7, [4, 1, 7], 2),
        (8, [], 1), (None, [5, 5], 2), (9, [5, 4], None), (10, [-5, -5], 1), (20, [-1, 0, 0], 2), (30, [0, 0], 2), (40, [0], 1),
    ]
    filled = [(i, None if v is None else [*v, *[0] * (3 - len(v))], y) for i, v, y in rows]
    assert set(map(tuple, hard_negatives(make(rows), F.col("id") % 10 == 0).collect())) == brute(filled, lambda i: i % 10 == 0)
    nothing = [make([]), make([(1, [1], 1)]), make([(0, None, 1)]), make([(0, [], 1), (10, [], 1)])]
    assert [hard_negatives(d, F.col("id") % 10 == 0).collect() for d in nothing] == [[]] * 4
    assert {tuple(r) for r in hard_negatives(make([(0, [], 1), (10, [], 1), (3, [], 2)]), F.col("id") == 0).collect()} == {(0, 10, 1, 3, 0, 0)}


def test_large_whole_numbers_are_exact_and_too_large_ones_refused(make):
    big = 1 << 27
    rows = [(0, [big, 1], 1), (1, [big, 3], 1), (2, [big - 11_000_000, 2], 2), (3, [big - 11_000_000, 1], 2), (4, [big // 3, 0], 2)]
    assert set(map(tuple, hard_negatives(make(rows), F.col("id") == 0).collect())) == brute(rows, lambda i: i == 0)
    with pytest.raises(ArithmeticError):
        hard_negatives(make([(0, [1 << 40], 1)]), F.col("id") == 0)


def test_training_rows_with_other_outcomes(spark, sf_dir):
    """Feature vectors of bars with their forward label, as the training sets hold them."""
    from barflow.plans import registry

    rows = registry.queries()["training_set_swing"](spark, sf_dir).orderBy("ticker", "ts").limit(400).withColumn("id", F.monotonically_increasing_id())
    features = [c for c in rows.columns if c not in ("ticker", "ts", "label", "id")][:8]
    taken = rows.select("id", F.array(*[F.floor(256 * F.col(c)).cast("long") for c in features]).alias("vector"), "label").collect()
    got = hard_negatives(spark.createDataFrame(taken, "id long, vector array<long>, label int"), F.col("id") % 20 == 0).collect()
    assert set(map(tuple, got)) == brute([tuple(r) for r in taken], lambda i: i % 20 == 0)


def test_the_query_equals_its_sql(spark, sf_dir):
    assert compare(spark, duck(sf_dir), sf_dir, queries.QUERIES["op13_hard_negatives"], queries.ORACLES["op13_hard_negatives"])[0] == "ok"
