"""Copies of a text are not split into runs again."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barflow.llm import passages
from barflow.llm.passages import repeated_passages

from .conftest import prose


def test_one_row_of_each_text_gives_keys(spark):
    long = [" ".join(prose(i, 200)) for i in range(12)]
    rows = [(i, long[i % 12]) for i in range(60)] + [(3, long[5]), (70, "short text"), (71, "short text"), (59, " ".join(prose(99, 200)))]
    random.Random(2).shuffle(rows)
    tagged = spark.createDataFrame(rows, "id long, text string").select("id", F.xxhash64("text").alias("h"), "text")
    ids = tagged.select("id", "h")
    copies, again = passages._copies(tagged, ids, 50)
    known = passages._known(ids, again)
    batches = tagged.select("h", "text", *passages._tags()).toArrow().to_batches()
    got = pa.Table.from_batches(passages._keys(46, None, known)(iter(batches)))
    whole = pa.Table.from_batches(passages._keys(46)(iter(batches)))
    rows_of = lambda t: sorted(zip(*(t.column(c).to_pylist() for c in ("key", "h", "at")), strict=True))
    # id 3 has two texts, its own and that of id 5, which is then a copy of it
    assert rows_of(got) == sorted(set(rows_of(whole))) and got.num_rows * 4 < whole.num_rows
    assert {r.id for r in copies.collect()} == set(range(12, 60)) | {5}


def test_passages_between_copied_texts(make_news):
    """A passage of two texts that have many copies each: one row for the pair, and one for every copy."""
    common = " ".join(prose(1, 80))
    texts = [f"{' '.join(prose(10, 60))} {common} {' '.join(prose(11, 60))}", f"{' '.join(prose(12, 40))} {common} {' '.join(prose(13, 90))}"]
    got = [(r.id, r.start_word, r.end_word, r.first_id, r.first_start, r.first_end) for r in repeated_passages(make_news([(i, texts[i % 2]) for i in range(40)])).collect()]
    assert sorted(got) == sorted([(1, 40, 120, 0, 60, 140)] + [(i, 0, [200, 210][i % 2], i % 2, 0, [200, 210][i % 2]) for i in range(2, 40)])


def _block(rows, ids, at, j=0, blocks=None):
    n = len(rows)
    return pa.RecordBatch.from_pydict({
        "key": pa.array([7] * n), "i": pa.array([0] * n), "j": pa.array([j] * n), "block": pa.array(blocks or [0] * n, pa.int32()), "id": pa.array(ids),
        "at": pa.array([c << 32 for c in at]), "around": pa.array([r.tobytes() for r in rows], pa.binary()),
    })


def test_two_members_have_the_links_of_a_larger_group():
    """A third member that has nothing in common with them sends the pair the general way."""
    rng, seen = np.random.default_rng(4), set()
    for n in range(300):
        a = rng.integers(0, 1 << 20, 91).astype(np.uint32)
        b = a.copy()
        edits = rng.integers(0, 91, rng.integers(0, 45))
        b[edits] = (1 << 25) + np.arange(len(edits))
        cut = int(rng.integers(0, 46))
        rows, at = [a, b[cut : cut + int(rng.integers(46, 92))]], [45, 45 - cut]
        ids, (j, blocks) = [[3, 5], [5, 3], [4, 4]][n % 3], [(0, [0, 0, 0]), (1, [0, 1, 1]), (1, [1, 1, 0])][n // 3 % 3]
        stranger = rng.integers(1 << 26, 1 << 27, 91).astype(np.uint32)
        links = [pa.Table.from_batches(passages._block_pairs(46, 80)(iter([x]))).to_pylist() for x in (_block(rows, ids, at, j, blocks[:2]), _block([*rows, stranger], [*ids, 9], [*at, 45], j, blocks))]
        assert links[0] == links[1]
        seen.add((n % 3, len(links[0]), bool(links[0] and links[0][0]["alike"])))
    assert {(0, 1, True), (0, 1, False), (0, 0, False), (1, 1, True), (2, 0, False)} <= seen
