"""Near duplicates of articles: many universal hash minima in bands, verified links, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, distinct, mix, shingles, slices, texts_of, words, written
from .components import components
from .records import article_text

BANDS, ROWS = 24, 4
#: Least share of equal minima for a pair to be verified: at a similarity of 0.8, 96 minima agree less often once in a million pairs.
AGREEMENT = 0.58
#: About so many members of a bucket are a block of the exhaustive pass, in which two blocks meet at once.
BLOCK = 512
_DRAWS = np.random.default_rng(20)
MULTIPLIERS = _DRAWS.integers(0, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _DRAWS.integers(0, 1 << 32, BANDS * ROWS).astype(np.uint32)
_AT_ONCE = 1024
_values = np.empty((BANDS * ROWS, _AT_ONCE), np.uint32)


def minima(items: np.ndarray) -> np.ndarray:
    """Smallest value of each universal hash function (multiply, add, modulo 2**32) over the items, which are hashes already."""
    out, low = np.full(len(MULTIPLIERS), ~np.uint32(0), np.uint32), (items >> U(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(low), _AT_ONCE):
            part = low[None, i : i + _AT_ONCE]
            values = _values[:, : part.shape[1]]
            np.multiply(MULTIPLIERS[:, None], part, out=values)
            np.add(values, OFFSETS[:, None], out=values)
            np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A hash for each band of each row of minima."""
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, BANDS + 1, dtype=U), (len(least), 1))
        for r in range(ROWS):
            key = mix(key * U(0x9E3779B97F4A7C15) + least[:, r::ROWS])
    return key.view(np.int64)


def _sets(batch: pa.RecordBatch, column: str, k: int) -> Iterator[np.ndarray]:
    """The set of shingles of each row, sorted."""
    for part in slices(batch, column, 1 << 20):
        runs, counts = shingles(*words(part.column(column)), k)
        at = np.concatenate(([0], np.cumsum(counts)))
        for i in range(part.num_rows):
            yield distinct(runs[at[i] : at[i + 1]])


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "text")):
            n, same, least = [], [], []
            for items in _sets(batch, "text", k):
                n.append(len(items))
                same.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                least.append(minima(items))
            empty = np.array(n) == 0
            keys, least = band_keys(np.array(least)), np.array(least)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()), mask=pa.array(empty))
            signature = pa.array([None if e else s.tobytes() for e, s in zip(empty, least, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(same, pa.binary()), bands, signature],
                ["id", "n_shingles", "same", "bands", "signature"],
            )

    return run


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "text_a", 1 << 20)):
            linked = [100 * (i := len(np.intersect1d(a, b, assume_unique=True))) >= percent * (len(a) + len(b) - i) for a, b in zip(_sets(batch, "text_a", k), _sets(batch, "text_b", k), strict=True)]
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _items(k: int):
    """The set of each text as 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "text")):
            items = [distinct((s >> U(32)).astype(np.uint32)).tobytes() for s in _sets(batch, "text", k)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(items, pa.binary())], ["id", "items"])

    return run


def _pairs_of_blocks(percent: int):
    """Pairs in sorted runs of rows with one (band_key, i, j) that are in different components and similar enough by their hashed sets.

    A pair is looked at only in the first band that it shares. Cheap tests come first: sizes, then signatures, then sets.
    """

    def of(rows: pa.RecordBatch) -> list[np.ndarray]:
        ids, comps, n, block = (rows.column(c).to_numpy() for c in ("id", "component", "n_shingles", "block"))
        signs = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(len(ids), -1)
        bands = np.array(rows.column("bands").to_pylist())
        items = [np.frombuffer(s, np.uint32) for s in rows.column("items").to_pylist()]
        band = int(np.argmax(bands[0] == rows.column("band_key")[0].as_py()))
        same_block = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        out = []
        for x in range(len(ids) - 1):
            y = np.arange(x + 1, len(ids))
            y = y[(comps[y] != comps[x]) & ((block[y] != block[x]) | same_block) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            y = y[~(bands[y, :band] == bands[x, :band]).any(axis=1)]
            y = y[(signs[y] == signs[x]).mean(axis=1) >= AGREEMENT]
            if len(y):
                sizes = np.array([len(items[z]) for z in y])
                flat = np.concatenate([items[z] for z in y])
                at = np.minimum(np.searchsorted(items[x], flat), len(items[x]) - 1)
                both = np.add.reduceat((items[x][at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))[:-1])
                y = y[100 * both >= percent * (sizes + len(items[x]) - both)]
                out += [np.stack((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])))] if len(y) else []
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = np.stack([held.column(c).to_numpy() for c in ("band_key", "i", "j")])
            starts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1))
            found = [p for a, b in zip(starts[:-1], starts[1:], strict=True) if b - a > 1 for p in of(held.slice(a, b - a))]
            held = held.slice(starts[-1])
            yield _pair_batch(found)
        if held is not None and held.num_rows > 1:
            yield _pair_batch(of(held))

    return run


def _pair_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], ["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough. Each side of a pair fetches its text by a shuffled join."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(k, percent), "a long, b long")


def near_duplicates(news: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "id") -> DataFrame:
    """Articles linked by similar sets of word shingles: 100 * intersection >= ``percent`` * union of whole texts (80 or more).

    news: ``id`` (long), ``title``, ``summary``; more columns are ignored. Returns one row per input row: ``id``,
    ``n_shingles``, ``component_id`` (smallest id reachable over links, its own included), ``kept`` (``id`` equals it).

    Words are runs outside ASCII white space with A-Z lower-cased, a set has the distinct runs of ``shingle`` words (fewer
    words make one run). Articles with equal sets are a class first, and one of them stands for it. Of each, the minima
    of 96 universal hash functions are cut into 24 bands; at a similarity of 0.8 three pairs in a million share none.

    Candidates are found without all pairs of a bucket: (1) every member is paired with one centre per bucket, pairs with
    like signatures are verified on their full sets, and the links give first components; (2) buckets that still hold
    several of them are cut into blocks of about BLOCK members; two blocks meet in a task, where members of different
    components are compared by size, signature and hashed set, and only pairs similar enough leave it, again verified. So no link between components is lost and groups that
    have grown together cost no second look. A hot bucket is split by the sort-merge join (1) and by blocks (2). Texts
    are fetched only for members of shared buckets, which a bitmap of fixed size lets through.

    Articles without words have 0 shingles and are linked with nothing. Rows with a null id have no component and are kept.
    Rows with one id are one article, which has the links of each of its texts. No rows give no rows.
    """
    if percent < 80:
        raise ValueError("the bands are made for 80 percent or more")
    texts = news.select(F.col(id_col).cast("long").alias("id"), article_text(news).alias("text"))
    signed = written(texts.mapInArrow(_sign(shingle), "id long, n_shingles long, same binary, bands array<long>, signature binary"))
    classes = signed.where("id is not null and same is not null").groupBy("same").agg(F.min("id").alias("first_id"))
    rows = signed.where("id is not null and same is not null").select("id", "n_shingles", "same", "bands", "signature")
    first = (F.col("id") == F.col("first_id")) & (F.col("same") == F.col("class"))
    firsts = written(rows.join(classes.select("first_id", F.col("same").alias("class")), first).select("id", "n_shingles", "bands", "signature"))
    banded = firsts.select("id", F.explode("bands").alias("band_key"))
    centres = banded.groupBy("band_key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = written(banded.join(centres, "band_key").where("id <> a").select("a", F.col("id").alias("b")).distinct())
    kept = texts_of(texts, stars.select(F.col("a").alias("id")).union(stars.select("b")))
    links = written(_links(_alike(stars, firsts.select("id", "n_shingles", "signature"), percent), kept, shingle, percent))
    grown = components(links)
    labelled = firsts.join(grown.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    more = written(_rest(written(labelled), kept, shingle, percent))
    if not more.isEmpty():
        grown = components(links.union(_links(more, kept, shingle, percent)))
    of_class = classes.join(grown, F.col("first_id") == F.col("node"), "left").select("same", F.coalesce("component", "first_id").alias("component"))
    found = signed.where("id is not null and same is not null").join(of_class, "same").select("id", "n_shingles", F.col("component").alias("component_id"))
    alone = signed.where("id is null or same is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _alike(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs with near sizes and signatures that agree often enough."""
    side = lambda c: signs.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("s_a", "s_b"))
            keep = pa.array((x == y).mean(axis=1) >= AGREEMENT)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _rest(labelled: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs between different components in one bucket, from every pair of its blocks."""
    banded = labelled.select("id", "component", F.explode("bands").alias("band_key"))
    mixed = banded.groupBy("band_key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    members = banded.join(mixed.select("band_key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "band_key").withColumn("block", F.pmod(F.xxhash64("id", "band_key"), F.col("blocks")).cast("int"))
    members = written(members.select("id", "band_key", "blocks", "block"))
    sets = texts.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(_items(k), "id long, items binary")
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "band_key", F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j"), "block",
    )
    full = spread.join(labelled.join(sets, "id"), "id")
    dealt = full.repartition("band_key", "i", "j").sortWithinPartitions("band_key", "i", "j", "id")
    return dealt.select("band_key", "i", "j", "block", "id", "component", "n_shingles", "bands", "signature", "items").mapInArrow(_pairs_of_blocks(percent), "a long, b long").distinct()
