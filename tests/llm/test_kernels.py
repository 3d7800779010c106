"""The vector parts against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barflow.llm import common, passages
from barflow.llm.passages import compact_windows

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\t\x0bé漢.x ", max_size=40)), max_size=8)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    hashes, counts = common.words(pa.array(texts, pa.string()))
    want = [plain_words(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    same = {}
    for w, h in zip(flat, hashes.tolist(), strict=True):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


@pytest.mark.parametrize("step", [7, 64, 1 << 17])
def test_long_texts_are_hashed_in_pieces(monkeypatch, step):
    texts = pa.array(["short one", "long " * 500 + "y" * 300 + " end", "", None, "a b c"])
    whole = common.words(texts)
    monkeypatch.setattr(common, "STEP", step)
    cut = common.words(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_shingles(texts, k):
    runs, counts = common.shingles(*common.words(pa.array(texts, pa.string())), k)
    want = [[tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))] if w else [] for w in map(plain_words, texts)]
    assert counts.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(zip(flat, runs.tolist(), strict=True))) == len(set(flat)) == len(set(runs.tolist()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 6), max_size=14), max_size=5), st.integers(1, 5))
def test_compact_windows_are_the_nodes_of_the_trees(texts, least):
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = ends - np.array([len(t) for t in texts], np.int64)
    order = np.array([x for t in texts for x in t], np.uint64)
    want = set()
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        open_ = [(s, e)]
        while open_:
            a, b = open_.pop()
            if b - a >= least:
                c = a + int(np.argmin(order[a:b]))
                want.add((a, c, b))
                open_ += [(a, c), (c + 1, b)]
    assert set(zip(*(x.tolist() for x in compact_windows(order, starts, ends, least)), strict=True)) == want


def test_bit_filter_lets_all_members_pass(spark):
    df = spark.createDataFrame([(x,) for x in [5, -7, 1 << 62, -(1 << 63), None, 5]], "h long")
    bitmap = common.bit_filter(df, "h", 12)
    assert common.passes(bitmap, np.array([5, -7, 1 << 62, -(1 << 63)], np.int64).view(np.uint64)).all()
    assert not common.passes(bitmap, np.array([6], np.uint64)).any()
    assert not common.bit_filter(df.limit(0), "h", 12).any()


def test_noted_tables_go_when_the_next_stage_begins_unless_it_reads_them(spark):
    import os

    from barflow.llm.common import noted, written

    df = spark.range(5)
    with noted(df):
        a = written(df)
    files = [f.removeprefix("file://") for f in a.inputFiles()]
    outside = written(df)
    with noted(a):
        b = written(a)
    assert all(map(os.path.exists, files)) and b.count() == 5
    with noted(b):
        pass
    assert not any(map(os.path.exists, files)) and b.count() == 5 and outside.count() == 5


def edited(rng, base):
    """The runs with a few stretches replaced, cut off at the front; and how many went there."""
    out, cut = base.copy(), int(rng.integers(0, 6))
    for _ in range(rng.integers(0, 7)):
        i, n = rng.integers(0, len(out)), rng.integers(1, 7)
        out[i : i + n] = rng.integers(1 << 20, 1 << 30, len(out[i : i + n]))
    return out[cut:], cut


def test_passage_around_one_anchor_as_the_general_search_finds_it():
    rng, found = np.random.default_rng(3), []
    for _ in range(600):
        a = rng.integers(0, rng.choice([40, 1 << 20]), rng.integers(46, 92)).astype(np.uint32)
        b, cut = edited(rng, a)
        for x in np.flatnonzero(a[cut:] == b)[::9] + cut:
            general = bool(passages.shared_passages(a, b, np.array([x]), np.array([x - cut]), 46, 80))
            assert passages.passage_around(a.tolist(), b.tolist(), int(x), int(x - cut), 46, 80) == general
            found.append(general)
    assert 0.1 < np.mean(found) < 0.9


def test_block_pairs_of_one_anchor_need_no_general_search(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 20, 91).astype(np.uint32)
    rows = [base.copy() for _ in range(6)]
    for k, r in enumerate(rows[1:]):
        r[10 + 3 * k] = r[80 - 3 * k] = 1 << 25
    n = len(rows)
    batch = pa.RecordBatch.from_pydict({
        "key": pa.array([7] * n), "i": pa.array([0] * n), "j": pa.array([0] * n), "block": pa.array([0] * n, pa.int32()), "id": pa.array(range(n)),
        "at": pa.array([45 << 32] * n), "around": pa.array([r.tobytes() for r in rows], pa.binary()),
    })
    monkeypatch.setattr(passages, "shared_passages", None)
    got = pa.Table.from_batches(passages._block_pairs(46, 80)(iter([batch])))
    assert set(zip(got["first_id"].to_pylist(), got["id"].to_pylist(), strict=True)) == {(0, k) for k in range(1, n)}


def test_membership_by_search():
    rng = np.random.default_rng(9)
    for n, m in ((0, 5), (5, 0), (1, 1), (300, 200)):
        a, b = (rng.integers(0, 250, k).astype(np.uint64) for k in (n, m))
        assert (passages._isin(a, b) == np.isin(a, b)).all()


def test_block_pairs_left_open_are_one_row_a_member():
    """Members that are alike near the key, but not similar enough there, left a row for every two of them."""
    rng, n = np.random.default_rng(7), 60
    base = rng.integers(0, 1 << 20, 91).astype(np.uint32)
    rows = []
    for k in range(n):
        edits = np.concatenate((rng.choice(22, 11, replace=False), [24 + k % 15, 39 + k // 15, 50 + k % 15], 69 + rng.choice(22, 11, replace=False)))
        rows.append(base.copy())
        rows[-1][edits] = (1 << 25) + 100 * k + np.arange(len(edits))
    batch = pa.RecordBatch.from_pydict({
        "key": pa.array([7] * n), "i": pa.array([0] * n), "j": pa.array([0] * n), "block": pa.array([0] * n, pa.int32()), "id": pa.array(range(n)),
        "at": pa.array([45 << 32] * n), "around": pa.array([r.tobytes() for r in rows], pa.binary()),
    })
    got = pa.Table.from_batches(passages._block_pairs(46, 80)(iter([batch]))).to_pylist()
    assert len(got) <= 2 * n
    waiting = [r for r in got if r["open"] is not None]
    assert len(waiting) <= n and sum(len(r["open"]) // 4 for r in waiting) > 5 * n
    assert {(r["key"], r["i"], r["j"], r["at"]) for r in waiting} == {(7, 0, 0, 45 << 32)}


def test_open_pairs_are_verified_on_whole_texts(monkeypatch):
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(12):
        own = [f"w{i}" for i in range(300)]
        for i in rng.choice([k for k in range(300) if not 100 <= k < 105], rng.integers(0, 14), replace=False):
            own[i] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(own))
    n, at = len(texts), 100 << 32
    seconds = [np.arange(k + 1, n, dtype=np.uint32).tobytes() for k in range(n)]
    batch = pa.RecordBatch.from_pydict({"key": [7] * n, "i": [0] * n, "j": [0] * n, "id": list(range(n)), "at": [at] * n, "open": pa.array(seconds, pa.binary()), "text": texts})
    runs = [common.shingles(*common.words(pa.array([t])), 5)[0] for t in texts]
    want = {
        (f, z, at, at, s, e + 4, s2, e2 + 4, alike)
        for f in range(n) for z in range(f + 1, n) for s, e, s2, e2, alike in passages.shared_passages(runs[f], runs[z], np.array([100]), np.array([100]), 46, 80)
    }
    assert 5 < len(want)
    for short in (passages.SHORT, 0):
        monkeypatch.setattr(passages, "SHORT", short)
        got = pa.Table.from_batches(passages._verify_waiting(46, 80)(iter([batch.slice(0, 5), batch.slice(5)]))).to_pylist()
        assert {tuple(r.values()) for r in got} == want and len(got) == len(want)
