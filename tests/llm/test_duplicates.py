"""Exact and near duplicates, repeated passages and components against brute force."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from barflow.llm import exact, neardup, passages
from barflow.llm.components import components
from barflow.llm.exact import exact_duplicates
from barflow.llm.neardup import near_duplicates
from barflow.llm.passages import repeated_passages

from .conftest import ODD, prose
from .test_kernels import plain_words


def test_exact_groups(make_news):
    long = "A sentence of some length. " * 2_000
    rows = [(i, t) for i, t in enumerate(["a", "b", "a", long, long + " ", long, "a", ""])] + [(i + 20 if i else None, t) for i, t in ODD]
    got = exact_duplicates(make_news(rows)).collect()
    size = Counter((t or "") for _, t in rows)
    keep = {}
    for i, t in rows:
        if i is not None:
            keep[t or ""] = max(keep.get(t or "", -1), i)
    text = defaultdict(set)
    for i, t in rows:
        text[sha256((t or "").encode()).hexdigest()].add(t or "")
    assert len(got) == len(rows)
    for r in got:
        (t,) = text[r.text_sha256]
        assert (r.keep_id, r.group_size, r.kept) == (keep.get(t), size[t], r.id == keep.get(t))


def test_exact_of_nothing(make_news):
    assert exact_duplicates(make_news([])).collect() == []


def test_chunks_join_to_the_text_and_stay_in_bounds(spark):
    texts = ["", "no stop " * 3_000, "Stop. " * 4_000, "\n" * 9_000, "x" * 4096, "x" * 4097]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", exact.chunks("text").alias("c"))
    for r in df.collect():
        assert "".join(r.c) == r.text and all(0 < len(c) <= exact.LONGEST for c in r.c)


def test_colliding_digests_are_found_and_another_seed_taken(make_news, monkeypatch):
    from pyspark.sql import functions as F

    real, seeds = exact.digest, []

    def weak(chunk, seed):
        seeds.append(seed)
        return F.struct(F.length(chunk).cast("long").alias("a"), F.lit(0).cast("long").alias("b")) if seed == 0 else real(chunk, seed)

    monkeypatch.setattr(exact, "digest", weak)
    got = {r.id: r.group_size for r in exact_duplicates(make_news([(1, "ab"), (2, "cd"), (3, "ab")])).collect()}
    assert got == {1: 2, 2: 1, 3: 2} and set(seeds) == {0, 1}


def test_exact_runs_without_python(make_news):
    plan = exact_duplicates(make_news([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "Cartesian", "NestedLoop"))


def brute_near(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = plain_words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((root(a), root(b)))
                low[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_rows():
    rng, rows = random.Random(3), []
    for g in range(12):
        base = prose(g, rng.choice([3, 12, 60, 400]))
        for c in range(9):
            w = list(base)
            for _ in range(c * len(w) // 60):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 997, " ".join(w)))
    # A chain: each is like the next, the ends are not like each other.
    chain = prose(99, 300)
    for c in range(6):
        rows.append((2000 - c, " ".join(chain[c * 20 :] + [f"tail{c}"])))
    return rows + [(3000, ""), (3001, None), (3002, " \n"), (3003, "Aa b"), (3004, "aA\tB"), (3005, "é b"), (3006, "É b")]


@pytest.mark.parametrize("k", [2, 5])
def test_near_components(make_news, k):
    rows = near_rows()
    got = {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(make_news(rows), shingle=k).collect()}
    assert got == brute_near(rows, k)


def test_near_links_between_others_than_the_centre(make_news, monkeypatch):
    """One band of one row puts unlike articles in a bucket; their links must not depend on its centre."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    common = prose(1, 30)
    rows = [(0, " ".join(common + prose(50, 30)))]
    for g in range(4):
        own = prose(100 + g, 50)
        rows += [(10 * g + i + 1, " ".join(common + own + [f"end{i}"])) for i in range(5)]
    got = {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(make_news(rows), shingle=2).collect()}
    assert got == brute_near(rows, 2)


def test_near_odd_rows(make_news):
    got = near_duplicates(make_news(ODD)).collect()
    assert len(got) == len(ODD) and near_duplicates(make_news([])).collect() == []
    by = defaultdict(list)
    for r in got:
        by[r.id].append(r)
    assert all(r.component_id is None and r.kept for r in by[None])
    assert all((r.n_shingles, r.component_id, r.kept) == (0, i, True) for i in (1, 2, 3) for r in by[i])
    assert len(by[4]) == 2 and all(r.kept for r in by[4])
    with pytest.raises(ValueError):
        near_duplicates(make_news([]), percent=70)


def test_minima_estimate_similarity():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 1 << 63, 4000, dtype=np.int64).astype(np.uint64)
    a, b = neardup.minima(items[:3600]), neardup.minima(items[400:])
    assert abs((a == b).mean() - 0.8) < 0.13


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7), (None, 3), (3, None), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def passage_rows():
    rows, planted = [], defaultdict(set)
    for p in range(5):
        passage = prose(500 + p, 55)
        for c in range(4):
            i = len(rows)
            rows.append((i, " ".join(prose(1000 + i, 30 * c) + passage + prose(2000 + i, 90))))
            planted[p].add(i)
    shared = prose(600, 40)  # too short
    rows += [(len(rows) + c, " ".join(prose(3000 + c, 60) + shared + prose(4000 + c, 60))) for c in range(3)]
    rows += [(100 + c, " ".join(prose(5000 + c, 200))) for c in range(5)]
    edited = prose(700, 120)
    changed = list(edited)
    changed[40] = changed[90] = "changed"
    rows += [(200, " ".join(prose(1, 20) + edited)), (201, " ".join(changed + prose(2, 20)))]
    return rows, [*planted.values(), {200, 201}]


def test_passages_that_repeat(make_news):
    rows, planted = passage_rows()
    got = repeated_passages(make_news(rows)).collect()
    groups = [set(g) for g in planted]
    linked = {}
    for r in got:
        assert any({r.id, r.first_id} <= g for g in groups) and r.end_word - r.start_word >= 50 and r.similarity >= 0.8
        whole = linked.get(r.id, {r.id}) | linked.get(r.first_id, {r.first_id})
        linked.update(dict.fromkeys(whole, whole))
    assert sorted(map(sorted, {frozenset(g) for g in linked.values()})) == sorted(map(sorted, groups))
    text = dict(rows)
    for r in got:
        if r.similarity == 1:
            assert text[r.id].split()[r.start_word : r.end_word] == text[r.first_id].split()[r.first_start : r.first_end]


def test_passages_their_first_article_lacks(make_news, monkeypatch):
    """The smallest id shares a key with all others but no passage; the others are linked through blocks."""
    monkeypatch.setattr(passages, "BLOCK", 2)
    passage = prose(1, 80)
    rows = [(0, " ".join(prose(2, 60) + passage[10:50] + prose(3, 60)))] + [(i, " ".join(prose(10 + i, 70) + passage + prose(20 + i, 70))) for i in range(1, 7)]
    pairs = {(r.first_id, r.id) for r in repeated_passages(make_news(rows)).collect()}
    assert all(0 not in p for p in pairs) and {x for p in pairs for x in p} == set(range(1, 7))


def test_passages_whose_keys_are_quoted_elsewhere(make_news):
    """Keys lie in a stretch that a third text quotes, or that one of the two quotes before the whole passage: no pair is lost."""
    rows, want = [], set()
    for g in range(0, 400, 10):
        passage = prose(1000 + g, 54)
        quote, text = passage[8:46], lambda n, *parts: " ".join(w for i, x in enumerate(parts) for w in (prose(n + i, 60) if x is None else x))  # noqa: B023
        rows += [(g, text(50_000 + 10 * g, None, quote, None)), (g + 1, text(60_000 + 10 * g, None, passage, None)), (g + 2, text(70_000 + 10 * g, None, passage, None))]
        want.add((g + 1, g + 2))
        passage = prose(3000 + g, 54)
        rows += [(g + 3, text(80_000 + 10 * g, None, passage[8:46], None, passage, None)), (g + 4, text(90_000 + 10 * g, None, passage, None))]
        want.add((g + 3, g + 4))
    got = {(r.first_id, r.id) for r in repeated_passages(make_news(rows)).collect()}
    assert {tuple(sorted(p)) for p in got} == want


def test_passages_of_odd_rows(make_news):
    assert repeated_passages(make_news([])).collect() == []
    assert {(r.first_id, r.id) for r in repeated_passages(make_news(ODD + [(9, " ".join(prose(1, 60))), (9, " ".join(prose(1, 60)))])).collect()} == set()
    with pytest.raises(ValueError):
        repeated_passages(make_news([]), least_words=20)


def test_a_large_group_of_one_passage_has_about_one_link_a_member(make_news, monkeypatch):
    """All members lack the passage of their smallest id's first place; links grow with the members, and all of them are linked."""
    monkeypatch.setattr(passages, "BLOCK", 64)
    passage = prose(1, 90)
    rows = [(0, " ".join(prose(2, 60) + passage[20:60] + prose(3, 60)))] + [(i, " ".join(prose(10 + i, 70) + passage + prose(2_000 + i, 70))) for i in range(1, 160)]
    edited = [(1_000 + i, " ".join(prose(5_000 + i, 40) + [("edit" if k == 7 * i % 50 + 20 else w) for k, w in enumerate(passage)])) for i in range(20)]
    got = repeated_passages(make_news(rows + edited)).collect()
    linked = {r.id for r in got} | {r.first_id for r in got}
    assert linked >= {i for i, _ in rows[1:]} | {i for i, _ in edited}
    assert len(got) < 12 * (len(rows) + len(edited))
    text = dict(rows + edited)
    for r in got:
        a, b = text[r.first_id].split()[r.first_start : r.first_end], text[r.id].split()[r.start_word : r.end_word]
        assert len(a) >= 50 and (a == b if r.similarity == 1 else r.similarity >= 0.8)
    assert max(r.end_word - r.start_word for r in got) >= 88
