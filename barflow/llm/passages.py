"""Passages that repeat across articles, by compact windows over the min-hashes of their word runs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import accumulate, takewhile
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, U, bit_filter, distinct, mix, passes, shingles, slices, text_bytes, texts_of, words, written
from .records import article_text

#: Words of a run (a token of the windows), hash functions, and hits that a pair needs from them to be verified at first.
RUN, FUNCTIONS, ENOUGH = 5, 2, 2
#: A window's key also has the run this far before or after its smallest one; a passage of 50 words has one of the two.
BESIDE = 12
#: Runs that may be missing in a row within a passage (two words changed close together); where the whole is not similar enough, fewer may, at last none.
GAPS = (12, 5, 0)
#: About so many members of a key are a block of the exhaustive pass, in which two blocks meet at once.
BLOCK = 512
#: Runs of a text up to which a pair with a single anchor is verified with plain sets.
SHORT = 1 << 11
_SALTS = np.array([0x9E3779B97F4A7C15 * (i + 1) % (1 << 64) | 1 for i in range(FUNCTIONS)], U)
_FAR = (1 << 16) - 1


def _nearest(order: np.ndarray, step: int, strict: bool) -> np.ndarray:
    """For every item the nearest one in a direction that is smaller (or equal, unless ``strict``); ends are smaller than all.

    Pointers jump over what the item they point to has jumped over, all at once, so few rounds are needed whatever the order.
    """
    at = np.arange(len(order)) + step
    at[0], at[-1] = 0, len(order) - 1
    larger = np.greater_equal if strict else np.greater
    open_ = np.arange(1, len(order) - 1)
    open_ = open_[larger(order[at[open_]], order[open_]) & (order[open_] > 0)]
    while len(open_):
        at[open_] = at[at[open_]]
        open_ = open_[larger(order[at[open_]], order[open_])]
    return at


def compact_windows(order: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, smallest, end) of the nodes of the Cartesian trees over ``order[start:end]`` that span ``least`` items or more.

    Every stretch of ``least`` items or more has its leftmost smallest item at ``smallest`` of just one window around it.
    A node spans what lies between its nearest smaller neighbours. Texts follow each other, with a smallest end between them.
    """
    row = np.repeat(np.arange(len(starts)), ends - starts)
    place = np.arange(len(row)) + row + 1
    fenced = np.zeros(len(row) + len(starts) + 1, U)
    fenced[place] = np.maximum(order, U(1))
    # A node that spans so many items is smallest among ``half`` items before or after it, and so are its nearest smaller neighbours.
    half = least // 2
    some = _smallest(fenced, half)
    order = fenced[some]
    before, after = some[_nearest(order, -1, False)], some[_nearest(order, 1, True)]
    wide = (after - before - 1 >= least) & (order > 0)
    c = some[wide]
    row = np.cumsum(fenced == 0)[c] - 1
    return before[wide] - row, c - row - 1, after[wide] - row - 1


def _smallest(fenced: np.ndarray, half: int) -> np.ndarray:
    """The fences (0), and the items without a smaller or equal one among the ``half`` before them or a smaller one among the ``half`` after."""
    n, low, width = len(fenced), fenced, 1
    while 2 * width <= half:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if half > width:
        low = np.minimum(low[: width - half], low[half - width :])
    keep = fenced == 0
    if len(low) > 1 and half:  # low[i] is the smallest of the ``half`` from i on
        keep[half:] |= low[: n - half] > fenced[half:]
        keep[: n - half] |= low[1 : n - half + 1] >= fenced[: n - half]
    else:
        keep[:] = True
    return np.flatnonzero(keep)


def _pack(c: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (c.astype(np.int64) << 32) | (np.minimum(left, _FAR).astype(np.int64) << 16) | np.minimum(right, _FAR)


def _first_of_repeats(key: np.ndarray, row: np.ndarray, packed: np.ndarray, least: int) -> np.ndarray:
    """Of places with one key in one text that follow each other within ``least`` runs (looping text) the first."""
    order = np.lexsort((packed, row, key))
    k, r, c = key[order], row[order], packed[order] >> 32
    again = (k[1:] == k[:-1]) & (r[1:] == r[:-1]) & (c[1:] - c[:-1] < least)
    return order[np.concatenate(([True], ~again))] if len(order) else order


def _keys(least: int, bitmap=None, known=None):
    """Keys of the compact windows of each text: which function and side (top bits) and the hash of the two runs. With a bitmap, those it lets pass.

    ``known``: two bitmaps; a row whose ``tag`` is in the first and whose ``other_tag`` is not in the second has a text that another row gives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if known is None or not batch.num_rows:
                yield from of(batch)
                continue
            tag, other = (batch.column(c).to_numpy().view(U) for c in ("tag", "other_tag"))
            yield from of(batch.filter(pa.array(~passes(known[0].value, tag) | passes(known[1].value, other))))

    def of(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for batch in slices(whole, "text", 1 << 18):
            runs, counts = shingles(*words(batch.column("text")), RUN)
            ends = np.cumsum(counts)
            starts = ends - counts
            out: list[tuple] = []
            for f in range(FUNCTIONS):
                a, c, b = compact_windows(mix(runs * _SALTS[f]), starts, ends, least)
                row = np.searchsorted(ends, c, "right")
                packed = _pack(c - starts[row], c - a, b - 1 - c)
                for side, beside in enumerate((c - BESIDE, c + BESIDE)):
                    ok = np.flatnonzero((beside >= starts[row]) & (beside < ends[row]))
                    key = (mix(runs[c[ok]] * _SALTS[f] + mix(runs[beside[ok]] + U(side))) >> U(3)) | U(2 * f + side) << U(61)
                    if bitmap is not None:
                        past = passes(bitmap.value, key)
                        key, ok = key[past], ok[past]
                    out.append((key.view(np.int64), row[ok], packed[ok]))
            key, row, packed = (np.concatenate(x) for x in zip(*out, strict=True))
            keep = _first_of_repeats(key, row, packed, least)
            key, row, packed = key[keep], row[keep], packed[keep]
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("h").take(pa.array(row, pa.int64())), pa.array(packed)], ["key", "h", "at"])

    return run


def _isin(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which items of ``a`` are in ``b``, by one sort and a binary search: many short arrays are asked."""
    if not len(b):
        return np.zeros(len(a), bool)
    b = np.sort(b)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def _stretches(hit: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of hits without more than ``gap`` misses in a row."""
    at = np.flatnonzero(hit)
    cut = np.flatnonzero(at[1:] - at[:-1] > gap + 1)
    return (at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + 1) if len(at) else (at, at)


def _around_anchor(hit: np.ndarray, anchor: int, gap: int) -> tuple[int, int]:
    first, last = _stretches(hit, gap)
    if not len(first):
        return anchor, anchor
    i = max(int(np.searchsorted(first, anchor, "right")) - 1, 0)
    return int(first[i]), int(last[i])


def _refined(a: np.ndarray, b: np.ndarray, s: int, e: int, s2: int, e2: int, x: int, y: int, gap: int) -> tuple[int, int, int, int, float]:
    """Two stretches less what one has in common with other parts of the other text only, and the similarity of their sets."""
    for _ in range(3):
        was = (s, e, s2, e2)
        u, v = _around_anchor(_isin(a[s:e], b[s2:e2]), x - s, gap)
        s, e = s + u, s + v
        u, v = _around_anchor(_isin(b[s2:e2], a[s:e]), y - s2, gap)
        s2, e2 = s2 + u, s2 + v
        if (s, e, s2, e2) == was:
            break
    p, q = distinct(a[s:e]), distinct(b[s2:e2])
    both = int(_isin(p, q).sum())
    return s, e, s2, e2, both / max(len(p) + len(q) - both, 1)


def shared_passages(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Stretches of runs around anchors (x[i] and y[i] hold one run) whose sets are similar enough: begin and end in both, similarity.

    For each gap allowed, every pair of stretches that an anchor joins is looked at once; anchors in no passage go on to the next gap.
    """
    in_a, in_b = _isin(a, b), _isin(b, a)
    out: list[tuple[int, int, int, int, float]] = []
    for gap in GAPS:
        (first, last), (first2, last2) = _stretches(in_a, gap), _stretches(in_b, gap)
        i, j = np.searchsorted(first, x, "right") - 1, np.searchsorted(first2, y, "right") - 1
        long_enough = (last[i] - first[i] >= least) & (last2[j] - first2[j] >= least)
        x, y, i, j = x[long_enough], y[long_enough], i[long_enough], j[long_enough]
        if not len(x):
            break
        _, picked = np.unique(i * (len(first2) + 1) + j, return_index=True)
        for n in picked:
            s, e, s2, e2, alike = _refined(a, b, int(first[i[n]]), int(last[i[n]]), int(first2[j[n]]), int(last2[j[n]]), int(x[n]), int(y[n]), gap)
            if min(e - s, e2 - s2) >= least and 100 * alike >= percent:
                out.append((s, e, s2, e2, alike))
        free = np.ones(len(x), bool)
        for s, e, s2, e2, _ in out:
            free &= ~((x >= s) & (x < e) & (y >= s2) & (y < e2))
        x, y = x[free], y[free]
    return out


def _reach(row: list[int], other: set[int], at: int, first: int, last: int, gap: int) -> tuple[int, int]:
    """Begin and end of the stretch around ``at``, itself a hit, of items of ``row[first:last]`` that the other has, without more than ``gap`` misses in a row."""
    begin = end = at
    for i in range(at - 1, max(first, 0) - 1, -1):
        if row[i] in other:
            begin = i
        elif begin - i > gap:
            break
    for i in range(at + 1, last):
        if row[i] in other:
            end = i
        elif i - end > gap:
            break
    return begin, end + 1


def passage_around(a: list[int], b: list[int], x: int, y: int, least: int, percent: int) -> bool:
    """Whether ``shared_passages`` finds one around a single anchor, a run that both have at ``x`` and ``y``: for a few runs plain sets are quicker than arrays."""
    return passage_at(a, b, set(a), set(b), x, y, least, percent) is not None


def passage_at(a: list[int], b: list[int], all_a: set[int], all_b: set[int], x: int, y: int, least: int, percent: int) -> tuple[int, int, int, int, float] | None:
    """What ``shared_passages`` finds around a single anchor, from the runs of both in order and as sets."""
    for gap in GAPS:
        s, e = _reach(a, all_b, x, 0, len(a), gap)
        s2, e2 = _reach(b, all_a, y, 0, len(b), gap)
        if min(e - s, e2 - s2) < least:
            return None
        for _ in range(3):
            was = (s, e, s2, e2)
            s, e = _reach(a, set(b[s2:e2]), x, s, e, gap)
            s2, e2 = _reach(b, set(a[s:e]), y, s2, e2, gap)
            if (s, e, s2, e2) == was:
                break
        p, q = set(a[s:e]), set(b[s2:e2])
        both = len(p & q)
        alike = both / max(len(p) + len(q) - both, 1)
        if min(e - s, e2 - s2) >= least and 100 * alike >= percent:
            return s, e, s2, e2, alike
    return None


def _verify(least: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "text", 1 << 20)):
            sides = []
            for c in ("first_text", "text"):
                runs, counts = shingles(*words(batch.column(c)), RUN)
                ends = np.cumsum(counts)
                sides.append((runs, ends - counts, ends))
            hits, rows = batch.column("hits"), []
            for i in range(batch.num_rows):
                a, b = (runs[s[i] : e[i]] for runs, s, e in sides)
                own = hits[i].values
                x, y = (own.field(k).to_numpy() >> 32 for k in ("f", "a"))
                if len(x) == 1 and a[x[0]] == b[y[0]] and max(len(a), len(b)) <= SHORT:
                    p, q = a.tolist(), b.tolist()
                    one = passage_at(p, q, set(p), set(q), int(x[0]), int(y[0]), least, percent)
                    rows += [(i, *one)] if one else []
                else:
                    rows += [(i, *p) for p in shared_passages(a, b, x, y, least, percent)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("first_id").take(at), batch.column("id").take(at), *(pa.array([r[k] + (RUN - 1) * (k in (2, 4)) for r in rows], pa.int64()) for k in (1, 2, 3, 4)), pa.array([r[5] for r in rows], pa.float64())],
                ["first_id", "id", "first_start", "first_end", "start_word", "end_word", "similarity"],
            )

    return run


_FOUND = "first_id long, id long, first_start long, first_end long, start_word long, end_word long, similarity double"


def _around(least: int):
    """The runs that a passage of ``least`` runs with a key's place in it may have, in order, as 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "text", 1 << 20)):
            runs, counts = shingles(*words(batch.column("text")), RUN)
            ends = np.cumsum(counts)
            places = batch.column("places")
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(places).to_numpy())
            flat = places.flatten()
            out = []
            for i, at in zip(row, flat.field("at").to_numpy(), strict=True):
                own, c = runs[ends[i] - counts[i] : ends[i]], int(at) >> 32
                out.append((own[max(0, c - least + 1) : c + least] >> U(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([flat.field("key"), batch.column("id").take(pa.array(row, pa.int64())), flat.field("at"), pa.array(out, pa.binary())], ["key", "id", "at", "around"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each (key, i, j), of batches sorted by it; those that a batch completes come together."""
    held = None
    for batch in batches:
        held = batch if held is None or not held.num_rows else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not held.num_rows:
            continue
        keys = np.stack([held.column(c).to_numpy() for c in ("key", "i", "j")])
        starts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1))
        yield [held.slice(a, b - a) for a, b in zip(starts[:-1], starts[1:], strict=True) if b - a > 1]
        held = held.slice(starts[-1])
    yield [held] if held is not None and held.num_rows > 1 else []


_PAIRS = "key long, i int, j int, first_id long, id long, first_at long, at long, back long, alike long, open binary"


def _block_pairs(least: int, percent: int):
    """Links of members of a key, of rows sorted by (key, i, j, id): pairs of which one has ``least`` runs around the key that the other mostly has.

    Of two sets with the similarity s, the smaller shares 2 s / (1 + s) of its items with the other at least. Within a
    block the first member without a link represents those with which it shares a passage around the key; they are linked with it and
    met as seconds only. Where two blocks meet, a member is linked with the first one of the other block that it shares a passage with.
    A later member that fits members of a group, but not the one that represents it, gets one link with the group. So there is
    about one link a member, however large the group. Pairs that share no passage that near to the key, but may farther out, are
    no links yet. Up to one for each member of such pairs, they are rows as they are; beyond, each of these members has
    one row with its (key, i, j), and in ``open`` the places of its seconds among these rows in order of (id, at).
    """
    need = int(least * 2 * percent / (100 + percent))

    def mostly(own: list[int], other: set[int]) -> bool:
        """Whether ``least`` runs in a row hold ``need`` that the other has."""
        if len(own) < least:
            return False
        upto = [0, *accumulate(r in other for r in own)]
        return max(map(sub, upto[least:], upto)) >= need

    def of_two(rows: pa.RecordBatch) -> np.ndarray:
        """The link of two members: with a pair or none open, what whole texts decide is a row as well, so only equal words have to be known."""
        (f, z), blocks, at = (rows.column(c).to_pylist() for c in ("id", "block", "at"))
        if f == z or (blocks[0] == blocks[1] and rows.column("i")[0].as_py() != rows.column("j")[0].as_py()):
            return _links([], None, None)
        a, b = (np.frombuffer(s, np.uint32).tolist() for s in rows.column("around").to_pylist())
        if not mostly(a, set(b)) and not mostly(b, set(a)):
            return _links([], None, None)
        x, y = (min(k >> 32, least - 1) for k in at)
        equal = lambda pairs: sum(1 for _ in takewhile(lambda r: r[0] == r[1], pairs))
        u, v = equal(zip(a[x::-1], b[y::-1])), equal(zip(a[x:], b[y:]))
        whole = (u - 1, u + v - 1) if u + v - 1 >= least else (0, 0)
        return np.array([[f, z, *at, *whole] if f < z else [z, f, *at[::-1], *whole]], np.int64).T

    def of(rows: pa.RecordBatch) -> tuple[np.ndarray, list[tuple]]:
        if rows.num_rows == 2:
            return of_two(rows), []
        ids, block, at = (rows.column(c).to_numpy() for c in ("id", "block", "at"))
        runs = [np.frombuffer(s, np.uint32) for s in rows.column("around").to_pylist()]
        items: dict[int, tuple[list[int], set[int]]] = {}

        def share(x: int, z: int) -> bool:
            if runs[x][key[x]] != runs[z][key[z]]:  # two runs with one key
                return bool(shared_passages(runs[x], runs[z], key[[x]], key[[z]], least, percent))
            for k in (x, z):
                if k not in items:
                    own = runs[k].tolist()
                    items[k] = own, set(own)
            return passage_at(items[x][0], items[z][0], items[x][1], items[z][1], int(key[x]), int(key[z]), least, percent) is not None

        key = np.minimum(at >> 32, least - 1)
        _, column = np.unique(np.concatenate(runs), return_inverse=True)
        ends = np.cumsum([len(r) for r in runs])
        has = np.zeros((len(runs), column.max() + 1), np.uint8)
        has[np.repeat(np.arange(len(runs)), [len(r) for r in runs]), column] = 1
        split = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        beside = np.zeros((len(runs), 2 * least - 1), np.int64)  # the runs with the key's in the middle; nothing is 0, and never like another nothing
        beside[:] = -1 - np.arange(len(runs))[:, None]
        for k, r in enumerate(runs):
            beside[k, least - 1 - key[k] : least - 1 - key[k] + len(r)] = r
        group = np.full(len(runs), -1)  # the member that a member is linked with
        found, late = [], []
        for x, end in enumerate(ends):
            if not split and group[x] >= 0:
                continue
            y = np.flatnonzero((ids != ids[x]) & ((block != block[x]) | (not split)))
            own = column[end - len(runs[x]) : end]
            if not len(y) or len(own) < least:
                continue
            upto = np.zeros((len(y), len(own) + 1), np.int16)
            np.cumsum(has[np.ix_(y, own)], axis=1, out=upto[:, 1:])
            y = y[(upto[:, least:] - upto[:, :-least]).max(axis=1) >= need]
            like = beside[y] == beside[x]
            before = np.cumprod(like[:, least - 1 :: -1], axis=1).sum(axis=1)
            after = np.cumprod(like[:, least - 1 :], axis=1).sum(axis=1)
            met: set[int] = set()
            for z, u, v in zip(y.tolist(), before.tolist(), after.tolist(), strict=True):
                if group[z] >= 0 and group[z] in met:
                    continue
                whole = u + v - 1 >= least  # word for word
                if not whole and not share(x, z):
                    if group[z] < 0:
                        late.append((x, z))
                    continue
                found.append((x, z, u - 1, u + v - 1) if whole else (x, z, 0, 0))
                if group[z] < 0:
                    group[z] = x
                met.add(int(group[z]))
        late = list({(min(x, z), max(x, z)) for x, z in late})
        if len(late) <= len({x for pair in late for x in pair}):  # no more rows than members
            return _links(found + [(x, z, 0, 0) for x, z in late], ids, at), []
        return _links(found, ids, at), _waiting(late, ids, at, [rows.column(c)[0].as_py() for c in ("key", "i", "j")])

    def _links(found: list[tuple], ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not found:
            return np.zeros((6, 0), np.int64)
        x, z, u, n = np.array(found).T
        a, b = np.where(ids[x] < ids[z], x, z), np.where(ids[x] < ids[z], z, x)
        pairs = np.stack((ids[a], ids[b], at[a], at[b], u, n))
        pairs = pairs[:, np.lexsort((pairs[3], pairs[2], -pairs[5], pairs[1], pairs[0]))]
        return pairs[:, np.concatenate(([True], (pairs[:2, 1:] != pairs[:2, :-1]).any(axis=0)))]  # one place of a key is enough for two articles

    def _waiting(late: list[tuple], ids: np.ndarray, at: np.ndarray, of_block: list[int]) -> list[tuple]:
        own = sorted({x for pair in late for x in pair}, key=lambda x: (ids[x], at[x]))
        place = {x: n for n, x in enumerate(own)}
        seconds: dict[int, list[int]] = {x: [] for x in own}
        for x, z in sorted(late):
            seconds[x].append(place[z])
        return [(*of_block, int(ids[x]), int(at[x]), np.array(seconds[x], np.uint32).tobytes()) for x in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _groups(x.slice(i, 2000) for x in batches for i in range(0, x.num_rows, 2000)):
            both = [of(g) for g in groups]
            links = np.concatenate([np.zeros((6, 0), np.int64), *(x for x, _ in both)], axis=1)
            waiting = [r for _, x in both for r in x]
            n, m = links.shape[1], len(waiting)
            link = lambda k: pa.array(links[k], pa.int64())  # noqa: E731, B023
            wait = lambda k, kind: pa.array([r[k] for r in waiting], kind)  # noqa: E731, B023
            joined = lambda x, y: pa.concat_arrays([x, y])
            int32, int64 = pa.int32(), pa.int64()
            columns = [
                joined(pa.nulls(n, int64), wait(0, int64)), joined(pa.nulls(n, int32), wait(1, int32)), joined(pa.nulls(n, int32), wait(2, int32)), joined(link(0), pa.nulls(m, int64)),
                joined(link(1), wait(3, int64)), joined(link(2), pa.nulls(m, int64)), joined(link(3), wait(4, int64)), joined(link(4), pa.nulls(m, int64)), joined(link(5), pa.nulls(m, int64)),
                joined(pa.nulls(n, pa.binary()), wait(5, pa.binary())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PAIRS.split(", ")])

    return run


def _verify_waiting(least: int, percent: int):
    """Passages of the pairs that a block left open, of rows sorted by (key, i, j, id, at): verified on whole texts where these meet, so only passages leave the task."""

    def of(rows: pa.RecordBatch) -> list[tuple]:
        ids, at = (rows.column(c).to_numpy() for c in ("id", "at"))
        runs, counts = shingles(*words(rows.column("text")), RUN)
        ends = np.cumsum(counts)
        plain: dict[int, tuple[list[int], set[int]]] = {}
        out = []
        for n, seconds in enumerate(rows.column("open").to_pylist()):
            for m in np.frombuffer(seconds, np.uint32).tolist():
                f, z = (n, m) if ids[n] < ids[m] else (m, n)
                a, b = (runs[ends[k] - counts[k] : ends[k]] for k in (f, z))
                x, y = int(at[f]) >> 32, int(at[z]) >> 32
                if a[x] == b[y] and max(len(a), len(b)) <= SHORT:
                    for k, r in ((f, a), (z, b)):
                        if k not in plain:
                            own = r.tolist()
                            plain[k] = own, set(own)
                    one = passage_at(plain[f][0], plain[z][0], plain[f][1], plain[z][1], x, y, least, percent)
                    passages = [one] if one else []
                else:
                    passages = shared_passages(a, b, np.array([x]), np.array([y]), least, percent)
                out += [(int(ids[f]), int(ids[z]), int(at[f]), int(at[z]), s, e + RUN - 1, s2, e2 + RUN - 1, alike) for s, e, s2, e2, alike in passages]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _groups(x for b in batches for x in slices(b, "text")):
            rows = [r for g in groups for r in of(g)]
            columns = [pa.array([r[k] for r in rows], pa.float64() if k == 8 else pa.int64()) for k in range(9)]
            yield pa.RecordBatch.from_arrays(columns, ["first_id", "id", "first_at", "at", "first_start", "first_end", "start_word", "end_word", "similarity"])

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame, least: int, percent: int) -> DataFrame:
    both = pairs.join(texts.select(F.col("id").alias("first_id"), F.col("text").alias("first_text")), "first_id").join(texts, "id")
    return both.select("first_id", "id", "first_text", "text", "hits").mapInArrow(_verify(least, percent), _FOUND)


def repeated_passages(news: DataFrame, least_words: int = 50, percent: int = 80, id_col: str = "id") -> DataFrame:
    """Passages of ``least_words`` words or more that occur, with small changes, in several articles.

    news: ``id`` (long), ``title``, ``summary``; more columns are ignored. Returns pairs of a passage and the one that
    represents it: ``id``, ``start_word``, ``end_word`` (after the last), ``first_id``, ``first_start``, ``first_end`` and
    ``similarity`` of their sets of 5-word runs (``percent`` or more). Articles without a shared passage have no row.

    For each of FUNCTIONS hash functions, the Cartesian tree over the hashes of an article's runs gives its compact
    windows: all stretches long enough that share their smallest run. Windows of several texts under one key (the
    smallest run and the one BESIDE runs before or after it) may hold a common passage. One text represents a key; the
    windows' common intervals must be long enough, and a pair hit by ENOUGH keys is verified on whole texts: stretches
    of common runs around the hits, with gaps of GAPS, similar enough as sets.
    Key members not linked so, those whose windows have too little in common with the representative's first place among them,
    are met in blocks with all others of their key that were not and with all places of the representative, compared by
    the runs around the key, and verified in turn, so a representative that does not share the passage costs no link. There the first
    member without a link represents those that share its passage, so a group has about one link a member; what is equal
    word for word is known there already, and only other pairs go on to the whole texts. Pairs that these runs leave open
    are no rows where they are more than the members: these meet once more, with their whole texts, and only passages leave the task.
    A member that is linked with the representative is not met again under that key. Articles with the same text are
    one text; each has a row for its whole length with the smallest id among them. Keys are counted before they are shuffled;
    only those of several articles come back, in a second pass over the texts, through a bitmap of fixed size.

    Texts come into play only for articles with a hit, which a bitmap of fixed size lets through. Null title and summary
    are empty. Rows with a null id are left out. Rows with one id are one article. Shorter articles have no passages. No rows give no rows.
    """
    least = least_words - RUN + 1
    if least < 2 * BESIDE:
        raise ValueError(f"keys need passages of {2 * BESIDE + RUN - 1} words or more")
    texts = news.select(F.col(id_col).cast("long").alias("id"), article_text(news).alias("text")).where("id is not null")
    tagged = texts.select("id", F.xxhash64("text").alias("h"), "text")
    ids = written(tagged.select("id", "h"))
    copies, again = _copies(tagged, ids, least_words)
    # A copy has the places of the text that it repeats: only one of them is split into runs.
    known = _known(ids, again)
    keys = lambda bitmap=None: tagged.select("h", "text", *_tags()).mapInArrow(_keys(least, bitmap, known), "key long, h long, at long")
    shared = written(keys().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    bitmap = news.sparkSession.sparkContext.broadcast(bit_filter(shared, "key"))
    hits = written(keys(bitmap).join(shared, "key", "left_semi").distinct())
    firsts = written(hits.groupBy("key").agg(F.min(F.struct("h", "at")).alias("first"), F.max("h").alias("last")).where("first.h <> last").select("key", F.col("first.h").alias("first_h"), F.col("first.at").alias("first_at")))
    # One article stands for all with its text.
    classes = written(_holders(tagged, hits.join(firsts, "key", "left_semi").select("h").distinct()))
    # Every place of every member of a key, the representative's own among them.
    members = written(hits.join(firsts, "key").join(classes, "h").join(classes.select(F.col("h").alias("first_h"), F.col("id").alias("first_id")), "first_h").select("key", "id", "at", "first_id", "first_at"))
    others = members.where("id <> first_id")
    field = lambda c, shift: F.shiftright(c, shift).bitwiseAND(_FAR)
    common = F.least(field("at", 16), field("first_at", 16)) + F.least(field("at", 0), field("first_at", 0)) + 1
    met = others.where(common * 100 >= least * percent)
    pairs = met.groupBy("first_id", "id").agg(
        F.collect_set(F.struct(F.col("first_at").alias("f"), F.col("at").alias("a"))).alias("hits"), F.countDistinct(F.shiftrightunsigned("key", 61)).alias("kinds"),
    ).where(F.col("kinds") >= ENOUGH).drop("kinds")
    kept = texts_of(texts, classes)
    found = written(_with_texts(pairs, kept, least, percent))
    # Key members whose place lies in no passage found with the representative, met with its first place or not, in blocks with each other.
    done = found.select("first_id", "id", "start_word", "end_word")
    place = F.shiftright("at", 32)
    left = others.join(done, ["first_id", "id"], "left").groupBy("key", "id", "at").agg(
        F.max(F.coalesce((place >= F.col("start_word")) & (place < F.col("end_word")), F.lit(False))).alias("linked")
    ).where("not linked").select("key", "id", "at")
    left = written(left)
    # The representative of such a key is among them with all its places: too few keys may have led to it, or another place.
    of_key = members.where("id = first_id").join(left.select("key").distinct(), "key", "left_semi").select("key", "id", "at").distinct()
    rest = written(_rest(left.union(of_key), kept, least, percent))
    exact = written(_joined(rest.where("alike > 0")))
    found = found.unionByName(exact)
    # The rest is verified on whole texts, but for places that lie in a passage which is known by now.
    spans = exact.select(F.col("first_id").alias("_f"), F.col("id").alias("_i"), F.col("start_word").alias("_start"), F.col("end_word").alias("_end"))
    inside = (F.col("first_id") == F.col("_f")) & (F.col("id") == F.col("_i")) & (place >= F.col("_start")) & (place < F.col("_end"))
    waiting = rest.where("open is not null").select("key", "i", "j", "id", "at", "open")
    if not waiting.isEmpty():
        met_again = waiting.join(kept, "id").select("key", "i", "j", "id", "at", "open", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id", "at")
        farther = met_again.mapInArrow(_verify_waiting(least, percent), f"first_id long, id long, first_at long, at long, {_FOUND.split(', ', 2)[2]}")
        found = found.unionByName(written(farther.join(spans, inside, "left_anti").drop("first_at", "at").distinct()))
    open_ = written(rest.where("alike = 0").select("first_id", "id", "first_at", "at").distinct().join(spans, inside, "left_anti"))
    if not open_.isEmpty():
        more = open_.groupBy("first_id", "id").agg(F.collect_set(F.struct(F.col("first_at").alias("f"), F.col("at").alias("a"))).alias("hits"))
        found = found.union(_with_texts(more, kept, least, percent))
    return found.select(*copies.columns).distinct().union(copies)


def _joined(alike: DataFrame) -> DataFrame:
    """Passages that are equal word for word, from the stretches found around several keys: those of one pair that overlap at one distance are one."""
    start = F.shiftright("at", 32) - F.col("back")
    first = F.shiftright("first_at", 32) - F.col("back")
    x = alike.select("first_id", "id", first.alias("s"), (first + F.col("alike")).alias("e"), (start - first).alias("by"))
    w = Window.partitionBy("first_id", "id", "by").orderBy("s", "e")
    x = x.withColumn("_until", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("part", F.sum(F.when(F.col("s") <= F.col("_until"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy("first_id", "id", "by", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    end = F.col("e") + RUN - 1
    return runs.select("first_id", "id", F.col("s").alias("first_start"), end.alias("first_end"), (F.col("s") + F.col("by")).alias("start_word"), (end + F.col("by")).alias("end_word"), F.lit(1.0).alias("similarity"))


def _copies(tagged: DataFrame, ids: DataFrame, least_words: int) -> tuple[DataFrame, DataFrame]:
    """Whole articles of ``least_words`` words or more whose text another article with a smaller id has, and the id and hash of each. Only texts whose hash several articles have are counted."""
    several = written(ids.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("h"))
    signed = written(_with_hash(tagged, several, _signed, "id long, h long, same binary, n long").where(F.col("n") >= least_words))
    first = written(signed.groupBy("same").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id").drop("last_id"))
    zero = F.lit(0).cast("long")
    again = signed.join(first, "same").where("id <> first_id")
    return again.select(
        "id", zero.alias("start_word"), F.col("n").alias("end_word"), "first_id", zero.alias("first_start"), F.col("n").alias("first_end"), F.lit(1.0).alias("similarity")
    ).distinct(), again.select("id", "h")


def _tags() -> tuple[Column, Column]:
    """Two hashes of a row's id and text."""
    return F.xxhash64("id", "h").alias("tag"), F.xxhash64("h", "id").alias("other_tag")


def _known(ids: DataFrame, again: DataFrame) -> tuple | None:
    """Bitmaps of fixed size by which a row (id, h) of ``again`` is passed by: that of these rows, and that of the others which it lets through.

    So every other row is read; with very many rows some of ``again`` are read as well.
    """
    again = written(again.distinct())
    if again.isEmpty():
        return None
    context = ids.sparkSession.sparkContext
    first = context.broadcast(bit_filter(again.select(_tags()[0]), "tag"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(passes(first.value, batch.column("tag").to_numpy().view(U))))

    let_through = ids.select("id", "h", _tags()[0]).mapInArrow(run, "id long, h long, tag long").join(again, ["id", "h"], "left_anti")
    return first, context.broadcast(bit_filter(let_through.select(_tags()[1]), "other_tag"))


def _signed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A digest and the number of words of each text."""
    data, ends = text_bytes(batch.column("text"))
    a, b = int(ends[0]), int(ends[-1])
    gap = SPACE[data[a:b]]
    begin = ~gap
    begin[1:] &= gap[:-1]
    first = (ends[:-1] - a)[ends[1:] > ends[:-1]]
    begin[first] = ~gap[first]  # the words of a text begin anew
    total = np.concatenate(([0], np.cumsum(begin)))
    same = [hashlib.sha256(data[i:j]).digest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(same, pa.binary()), pa.array(np.diff(total[ends - a]))], ["id", "h", "same", "n"])


def _with_hash(tagged: DataFrame, wanted: DataFrame, of: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, ddl: str | None = None) -> DataFrame:
    """The rows whose hash is wanted, and perhaps a few more: a bitmap of fixed size lets them through. With ``of`` (and its ``ddl``), what it makes of them."""
    bitmap = tagged.sparkSession.sparkContext.broadcast(bit_filter(wanted, "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                some = batch.filter(pa.array(passes(bitmap.value, batch.column("h").to_numpy().view(U))))
                yield from (some,) if of is None else map(of, slices(some, "text"))

    return tagged.mapInArrow(run, ddl or tagged.schema)


def _holders(tagged: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, id: the smallest id of each text whose hash is wanted (two texts with one hash give two rows)."""
    some = _with_hash(tagged.select("h", "id", F.sha2("text", 256).alias("same")), wanted)
    return some.groupBy("h", "same").agg(F.min("id").alias("id")).join(wanted, "h", "left_semi").select("h", "id")


def _rest(left: DataFrame, texts: DataFrame, least: int, percent: int) -> DataFrame:
    """Links among members of a key, from every pair of its blocks, and the members of pairs that only their whole texts decide."""
    several = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # Each text is split into runs once, whatever number of keys it has.
    places = left.join(several, "key", "left_semi").groupBy("id").agg(F.collect_list(F.struct("key", "at")).alias("places"))
    around = places.join(texts, "id").select("id", "places", "text").mapInArrow(_around(least), "key long, id long, at long, around binary").join(several, "key")
    members = around.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "at", "around",
    )
    dealt = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return dealt.mapInArrow(_block_pairs(least, percent), _PAIRS)
