"""Periodic runs of words in articles: Lyndon arrays by suffix grouping, roots extended by longest common extensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, mix, shingles, slices, words
from .records import article_text

#: Words in a row that have to recur before a stretch is looked at.
GRAM = 3


def lyndon_array(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by the first phase of grouping suffix sorting.

    Suffixes start in groups by their first word. From the highest group down, every member points to the nearest place
    before it whose group is lower; places with more pointers, and of each group apart, move into new groups right above
    their own, whose common word grows by that of the pointing group once a pointer. When a group's turn comes, its
    common word is the longest Lyndon word of its members. Every place is pointed from and moved at most once per
    member, and skipped places are never met again, so the time is linear.
    """
    kinds = sorted(set(codes))
    first = {c: k for k, c in enumerate(kinds)}
    group = [first[c] for c in codes]
    members: list[list[int]] = [[] for _ in kinds]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above, length = list(range(-1, len(kinds) - 1)), list(range(1, len(kinds) + 1)), [1] * len(kinds)
    above[-1:] = [-1]
    out, before, done = [0] * len(codes), [-1] * len(codes), bytearray(len(codes))
    g = len(kinds) - 1
    while g >= 0:
        size, hits = length[g], {}
        for i in members[g]:
            if group[i] != g:  # moved up since
                continue
            out[i] = size
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i], done[i] = j, 1
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        members[g] = []
        if hits:
            fresh: dict[tuple[int, int], int] = {}
            ordered = hits.items() if max(hits.values()) == 1 else sorted(hits.items(), key=lambda x: -x[1])
            for j, n in ordered:
                old = group[j]
                new = fresh.get((n, old))
                if new is None:
                    new = fresh[n, old] = len(members)
                    up = above[old]
                    members.append([])
                    length.append(length[old] + n * size)
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                members[new].append(j)
                group[j] = new
        g = below[g]
    return out


class Extensions:
    """Longest common extensions in both directions, by names of all stretches of 2, 4, 8 ... places (equal names, equal stretches)."""

    def __init__(self, codes: np.ndarray):
        self.n = n = len(codes)
        self.names = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
        alone = -1 - np.arange(n, dtype=np.int64)  # of places too near to the end
        h = 1
        while 2 * h <= n:
            last = self.names[-1]
            pairs = last[: n - 2 * h + 1] * n + last[h : n - h + 1]
            name = alone.copy()
            name[: n - 2 * h + 1] = np.unique(pairs, return_inverse=True)[1]
            self.names.append(name)
            h *= 2

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the places from ``a`` on equal those from ``b`` on (a < b)."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            at = b + out
            fits = np.flatnonzero(at + (1 << k) <= self.n)
            same = self.names[k][a[fits] + out[fits]] == self.names[k][at[fits]]
            out[fits[same]] += 1 << k
        return out

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the places before ``a`` equal those before ``b`` (a < b)."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            at = a - out - (1 << k)
            fits = np.flatnonzero(at >= 0)
            same = self.names[k][at[fits]] == self.names[k][b[fits] - out[fits] - (1 << k)]
            out[fits[same]] += 1 << k
        return out


def runs_of(stretches: list[list[int]], exponent: int = 2, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, length, period) of every run with at least ``exponent`` periods and ``least`` places, in order of stretch, start and period.

    The stretches lie behind one another with a mark of its own after each, so one pass of extensions serves all. By the
    runs theorem a run has, under one of the two orders of words, roots that are the longest Lyndon words at their places.
    """
    sizes = np.array([len(s) for s in stretches], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    total = int((sizes + 1).sum())
    codes = np.arange(total, dtype=np.int64) - total  # marks: all different, below every word
    root = np.zeros((2, total), np.int64)
    for s, a in zip(stretches, begin.tolist(), strict=True):
        codes[a : a + len(s)] = s
        root[0, a : a + len(s)] = lyndon_array(s)
        root[1, a : a + len(s)] = lyndon_array([-c for c in s])
    none = np.zeros(0, np.int64)
    at = np.concatenate([np.flatnonzero(r) for r in root]) if total else none
    period = np.concatenate([r[r > 0] for r in root]) if total else none
    if not len(at):
        return none, none, none, none
    both = Extensions(codes)
    back = both.back(at, at + period)
    length = back + period + both.ahead(at, at + period)
    ok = (length >= exponent * period) & (length >= least)
    found = np.unique(np.stack([at[ok] - back[ok], period[ok], length[ok]], 1), axis=0)
    which = np.searchsorted(begin, found[:, 0], "right") - 1
    return which, found[:, 0] - begin[which], found[:, 2], found[:, 1]


def _live(texts: pa.Array, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, word after the last) of the stretches in which every GRAM words in a row occur ``exponent - 1`` times in the text.

    A run with ``exponent`` periods has each of its GRAM words in a row that often, so it lies in one stretch; words whose hashes collide only make it longer.
    """
    hashes, counts = words(texts)
    grams, n = shingles(hashes, counts, GRAM)
    text = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        key = mix(grams + (text.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(key) else np.zeros(0, np.int64)
    often = np.zeros(len(key), bool)
    often[order] = np.repeat(np.diff(np.append(edge, len(key))) >= exponent - 1, np.diff(np.append(edge, len(key))))
    often &= (counts >= GRAM)[text]
    joined = often[1:] & often[:-1] & (text[1:] == text[:-1])
    starts = np.flatnonzero(often & ~np.concatenate(([False], joined))) if len(key) else np.zeros(0, np.int64)
    ends = np.flatnonzero(often & ~np.concatenate((joined, [False]))) if len(key) else starts
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    return text[starts], starts - first[text[starts]], ends - first[text[ends]] + GRAM


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batch(texts: pa.Array, exponent: int, least: int) -> tuple[list[list[dict]], list[str]]:
    split = [(t or "").encode().split() for t in texts.to_pylist()]  # at ASCII white space, as words()
    where = [x for x in zip(*(x.tolist() for x in _live(texts, exponent)), strict=True) if x[2] - x[1] >= least]
    stretches = []
    for t, a, b in where:
        code: dict[bytes, int] = {}
        stretches.append([code.setdefault(w, len(code)) for w in split[t][a:b]])
    found: list[list[dict]] = [[] for _ in split]
    dropped: dict[int, np.ndarray] = {}
    for s, start, length, period in zip(*(x.tolist() for x in runs_of(stretches, exponent, least)), strict=True):
        t, a, _ = where[s]
        found[t].append({"start": a + start, "length": length, "period": period})
        if t not in dropped:
            dropped[t] = np.zeros(len(split[t]) + 1, np.int64)
        dropped[t][a + start + period] += 1
        dropped[t][a + start + length] -= 1
    kept = []
    for t, own in enumerate(split):
        if t in dropped:
            own = [own[i] for i in np.flatnonzero(np.cumsum(dropped[t][:-1]) == 0).tolist()]
        kept.append(b" ".join(own).decode())
    return found, kept


def _map(exponent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "text")):
            found, kept = _batch(batch.column("text"), exponent, least)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(RUN)), pa.array(kept, pa.string())], ["id", "runs", "collapsed"])

    return run


def word_runs(news: DataFrame, exponent: int = 4, least: int = 6, id_col: str = "id") -> DataFrame:
    """Every periodic run of words of every whole article, and the article with each run collapsed to its first period.

    news: ``id``, ``title``, ``summary``; more columns are ignored. Words are the stretches without ASCII white space,
    equal only if all characters are, numbered from 0. A run is a stretch of words with smallest period ``period`` (words
    that far apart are equal), at least ``exponent`` periods (3 or more) and ``least`` words (more than ``exponent``),
    that no neighbouring word extends. Returns one row per input row: ``id``, ``runs`` (array of start, length, period, by
    start and period; empty if none) and ``collapsed`` (the words outside all runs and of the first period of each,
    joined by one blank).

    One map pass. Stretches in which every three words in a row recur in the article, and only they can hold a run, are grouped as
    suffixes under both orders of words; the longest Lyndon words so found are extended to both sides. Time is
    n log n in the words of such stretches and linear in all others.

    Null title and summary count as empty (no runs, empty text). Rows with null or repeated ids are treated like others. No rows give no rows.
    """
    if exponent < 3 or least <= exponent:
        raise ValueError("a run has at least 3 periods and more words than periods")
    texts = news.select(F.col(id_col).alias("id"), article_text(news).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_map(exponent, least), f"id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
