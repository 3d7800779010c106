"""Periodic runs of words against plain search."""

import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barflow.llm import queries
from barflow.llm.records import table
from barflow.llm.runs import Extensions, _batch, lyndon_array, runs_of, word_runs

from .conftest import ODD


def plain_runs(s, exponent, least):
    n, out = len(s), set()
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= exponent * p and size >= least and not any(all(s[k] == s[k + q] for k in range(i, i + size - q)) for q in range(1, p)):
                out.add((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(s, runs):
    drop = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(w for i, w in enumerate(s) if i not in drop)


def looping(rng, n, kinds):
    s = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(2):
        if n > 8:
            a, p = rng.randrange(n), rng.randrange(1, 6)
            size = rng.randrange(n - a + 1)
            s[a : a + size] = [s[a + i % p] if a + i % p < n else 0 for i in range(size)]
    return s


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30))
def test_lyndon_array(s):
    want = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        want.append(j - i)
    assert lyndon_array(s) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=40), st.data())
def test_extensions(s, data):
    b = data.draw(st.integers(1, len(s) - 1))
    a = data.draw(st.integers(0, b - 1))
    ahead, back = 0, 0
    while b + ahead < len(s) and s[a + ahead] == s[b + ahead]:
        ahead += 1
    while a - back > 0 and s[a - back - 1] == s[b - back - 1]:
        back += 1
    e = Extensions(np.array(s))
    assert (e.ahead(np.array([a]), np.array([b]))[0], e.back(np.array([a]), np.array([b]))[0]) == (ahead, back)


def test_all_runs_of_two_periods_and_more():
    rng = random.Random(1)
    for _ in range(400):
        some = [looping(rng, rng.randrange(50), rng.choice((2, 3, 6))) for _ in range(3)]
        which, start, length, period = (x.tolist() for x in runs_of(some, 2, 2))
        for k, s in enumerate(some):
            assert [x[1:] for x in zip(which, start, length, period) if x[0] == k] == plain_runs(s, 2, 2)
    assert all(len(x) == 0 for x in runs_of([], 2, 2)) and all(len(x) == 0 for x in runs_of([[]], 2, 2))


@pytest.mark.parametrize("exponent, least", [(3, 4), (4, 6), (5, 12)])
def test_articles_in_batches(exponent, least):
    rng = random.Random(exponent)
    for _ in range(150):
        texts = [[f"w{x}" for x in looping(rng, rng.randrange(90), rng.choice((2, 3, 8)))] for _ in range(4)]
        found, kept = _batch(pa.array([" ".join(t) for t in texts]), exponent, least)
        for t, runs, text in zip(texts, found, kept):
            want = plain_runs(t, exponent, least)
            assert [(r["start"], r["length"], r["period"]) for r in runs] == want and text == collapsed(t, want)


def test_long_loops_take_linear_time(make_news):
    loop = [f"k{i}" for i in range(1_000)] * 60
    rows = [(1, " ".join(loop)), (2, "na " * 100_000), (3, " ".join(f"u{i}" for i in range(100_000)))]
    got = {r.id: (list(map(tuple, r.runs)), len(r.collapsed.split())) for r in word_runs(make_news(rows)).collect()}
    assert got == {1: ([(0, 60_000, 1_000)], 1_000), 2: ([(0, 100_000, 1)], 1), 3: ([], 100_000)}


def test_letters_of_another_case_or_script_are_other_words(make_news):
    rows = [(1, "a A a A a A a A"), (2, "No NO no No NO no"), (3, "x y x y\tx y\nx y x y  x y z")]
    got = {r.id: (list(map(tuple, r.runs)), r.collapsed) for r in word_runs(make_news(rows)).collect()}
    assert got == {1: ([(0, 8, 2)], "a A"), 2: ([], "No NO no No NO no"), 3: ([(0, 6, 1)], "x y z")}


def test_odd_articles(make_news):
    got = sorted(((str(r.id), len(r.runs), len(r.collapsed)) for r in word_runs(make_news(ODD)).collect()))
    words = {t: re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in ODD}
    runs = {t: plain_runs(w, 4, 6) if len(w) < 1_000 else [(0, len(w), 1)] for t, w in words.items()}
    assert got == sorted((str(i), len(runs[t]), len(collapsed(words[t], runs[t]))) for i, t in ODD)
    assert word_runs(make_news([])).collect() == []
    with pytest.raises(ValueError):
        word_runs(make_news([]), exponent=2)


def plain_query(doc_id, text):
    """The contract, word by word."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 4, 6)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda s: sha256(s.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, digest("".join(f"{a},{m},{p}\n" for a, m, p in runs)), digest(collapsed(w, runs)))


def test_the_query_follows_the_contract(spark, sf_dir, tmp_path):
    docs = [r for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect() if len(r.text or "") < 6_000]
    extra = [(10**6 + i, t) for i, (_, t) in enumerate(ODD) if len(t or "") < 1_000] + [(-5, "a b " * 9), (-6, "q"), (None, "z z z z z z z")]
    rows = [tuple(r) for r in docs] + extra
    spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_word_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    want = [plain_query(i, t) if i is not None else (None, 1, 0, 7, 1, 7000, *plain_query(3, t)[-2:]) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[1] > 0 for r in got) > 5
