"""Mixing news sources to target weights by a low-discrepancy schedule over equal-token blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, getcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import article_text

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 1024
MOST_SOURCES = 100_000
MOST_REPEATS = 3
_SLOTS_A_ROW = 1 << 16
_BUCKET_DIGITS = 3  # of the hexadecimal shuffle key: 4,096 buckets a source

getcontext().prec = 60
_GOLDEN = (Decimal(5).sqrt() - 1) / 2


@dataclass(frozen=True)
class Share:
    """What the mix takes from a source: ``target`` is the exact share, ``words`` the whole words, from ``blocks`` blocks over and over."""

    source: str | None
    size: int
    weight: int
    target: float
    words: int
    blocks: int

    @property
    def slots(self) -> float:
        return self.words * self.blocks / self.size if self.size else 0.0


def shares(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS) -> list[Share]:
    """Targets of the sources in code point order, null last; they share all words by weight, none above MOST_REPEATS times its size.

    What a capped source leaves is shared by weight among the others, again and again; in the end every source has the
    smaller of its cap and ``level * weight`` with one level, which is found in the order of cap by weight.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, total = sum(weight.values()), sum(sizes.values())
    level = total / rest if rest else 0.0
    for s in sorted(names, key=lambda s: MOST_REPEATS * sizes[s] / weight[s]):
        level = total / rest
        if MOST_REPEATS * sizes[s] > level * weight[s]:
            break
        total, rest = total - MOST_REPEATS * sizes[s], rest - weight[s]
        if not rest:
            break
    out = []
    for s in names:
        target = min(float(MOST_REPEATS * sizes[s]), level * weight[s])
        out.append(Share(s, sizes[s], weight[s], target, int(np.floor(target + 0.5)), -(-sizes[s] // block_words)))
    return out


def _schedule(parts: list[Share]) -> tuple[np.ndarray, int]:
    """Upper ends of the sources on [0, 1) and the number of slots after which each has had all it needs."""
    need = np.array([p.slots for p in parts])
    if not need.sum():
        return np.ones(len(parts)), 0
    ends = np.cumsum(need) / need.sum()
    ends[-1] = 1.0
    # Of n golden-ratio points an interval of length p holds n * p less a few times log n at most; each source needs its last slot as well.
    least = need[need > 0].min() / need.sum()
    return ends, int(np.ceil(need.sum() + (4 * np.log2(need.sum() + 2) + 4) / least))


def _slot_rows(ends: list[float], slots: int):
    one, many = float(_GOLDEN), float(_GOLDEN * _SLOTS_A_ROW % 1)
    upper = np.array(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0).to_pylist():
                k = np.arange(row * _SLOTS_A_ROW, min(slots, (row + 1) * _SLOTS_A_ROW), dtype=np.int64)
                point = (row * many + (k - row * _SLOTS_A_ROW + 1) * one) % 1
                source = np.minimum(np.searchsorted(upper, point, "right"), len(upper) - 1)
                order = np.argsort(source, kind="stable")
                first = np.searchsorted(source[order], source[order])
                rank = np.empty(len(k), np.int64)
                rank[order] = np.arange(len(k)) - first
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), row)), pa.array(k), pa.array(source), pa.array(rank)], ["row", "slot", "source_no", "rank"])

    return run


def _by_number(parts: list[Share], value, kind: str) -> Column:
    """A value of the source with the row's ``source_no``, from a literal list (at most MOST_SOURCES)."""
    return F.lit([value(p) for p in parts]).cast(f"array<{kind}>")[F.col("source_no")]


def mixture(
    news: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS, seed: str = "mix", id_col: str = "id", source_col: str = "source",
) -> DataFrame:
    """How many words of each article a mix of the sources takes, repeats counted.

    news: ``id``, ``title``, ``summary``, ``source``; more columns are ignored. Returns one row per input row: ``id``,
    ``source``, ``size`` (words of the whole text), ``source_size``, ``target``, ``taken``.

    The articles of a source are shuffled by a keyed hash and laid end to end, then cut into blocks of equal word counts
    (to within one, at most ``block_words``). Golden-ratio points mapped through the sources' cumulative weights say
    which source fills which slot; the r-th slot of a source takes its block r, beginning again after the last, until its
    target is met (the last slot is cut to the word). Slots and blocks meet in a join on (source, block), of which no key is hot.

    Positions in a source are two-level sums over hash buckets, so a hot source is no single task. Only the sizes of the
    sources come to the driver, MOST_SOURCES at most (else ValueError). Articles without words take 0. Null
    sources are one source, last in order. Repeated rows are articles of their own. No rows give no rows.
    """
    sized = news.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(article_text(news), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
    ).withColumn("bucket", F.substring("key", 1, _BUCKET_DIGITS))
    totals = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    parts = shares({r["source"]: r["size"] for r in totals}, weights, block_words)
    ends, slots = _schedule(parts)
    spark = news.sparkSession
    numbers = spark.createDataFrame([(p.source, i, p.size, p.target) for i, p in enumerate(parts)], "source string, source_no int, source_size long, target double")
    # Where each article begins in its source: words of the buckets before, then of the articles before in its own bucket.
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        sized.join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("begin", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(F.broadcast(numbers.withColumnRenamed("source", "s2")), F.col("source").eqNullSafe(F.col("s2")))
        .select("id", "source", "size", "source_size", "target", "source_no", "begin")
    )
    if not slots:
        return laid.select("id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    taken = _taken_blocks(news, parts, ends, slots)
    held = laid.where("size > 0").withColumn("blocks", _by_number(parts, lambda p: p.blocks, "bigint"))
    quotient, longer = F.expr("source_size div blocks"), F.expr("source_size % blocks")
    edge = lambda at: F.when(  # noqa: E731  block of a word; the first ``longer`` blocks have a word more
        at < F.col("longer") * (F.col("quotient") + 1), F.floor(at / (F.col("quotient") + 1))
    ).otherwise(F.col("longer") + F.floor((at - F.col("longer") * (F.col("quotient") + 1)) / F.greatest(F.col("quotient"), F.lit(1))))
    segments = (
        held.withColumns({"quotient": quotient, "longer": longer})
        .withColumn("block", F.explode(F.sequence(edge(F.col("begin")), edge(F.col("begin") + F.col("size") - 1))))
        .withColumn("at", F.col("block") * F.col("quotient") + F.least("block", "longer"))
        .withColumn("from", F.greatest(F.col("begin") - F.col("at"), F.lit(0)))
        .withColumn("to", F.least(F.col("begin") + F.col("size") - F.col("at"), F.col("quotient") + (F.col("block") < F.col("longer")).cast("long")))
    )
    whole = F.coalesce(F.col("whole"), F.lit(0)) * (F.col("to") - F.col("from"))
    cut = F.greatest(F.least(F.coalesce(F.col("cut"), F.lit(0)), F.col("to")) - F.col("from"), F.lit(0))
    mixed = (
        segments.join(taken, ["source_no", "block"], "left")
        .groupBy("id", "source", "source_no", "begin", "size", "source_size", "target").agg(F.sum(whole + cut).cast("long").alias("taken"))
        .select("id", "source", "size", "source_size", "target", "taken")
    )
    return mixed.unionByName(laid.where("size = 0").select("id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def slot_schedule(news: DataFrame, parts: list[Share], ends: np.ndarray, slots: int) -> DataFrame:
    """slot, source_no, epoch, block and the words it takes (``words`` of a cut slot, else null); surplus slots are left out."""
    spark = news.sparkSession
    rows = spark.range(0, -(-slots // _SLOTS_A_ROW), 1, max(1, min(-(-slots // _SLOTS_A_ROW), 4 * spark.sparkContext.defaultParallelism)))
    points = rows.mapInArrow(_slot_rows(ends.tolist(), slots), "row long, slot long, source_no long, rank long")
    counts = points.groupBy("row", "source_no").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source_no").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("row", "source_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("past"))
    ranked = points.join(counts, ["row", "source_no"]).select("slot", "source_no", (F.col("past") + F.col("rank")).alias("rank"))
    blocks, size, quota = (_by_number(parts, f, "bigint") for f in (lambda p: p.blocks, lambda p: p.size, lambda p: p.words))
    epoch, block = F.expr("rank div greatest(blocks, 1)"), F.expr("rank % greatest(blocks, 1)")
    at = F.col("epoch") * F.col("size") + F.col("block") * F.expr("size div greatest(blocks, 1)") + F.least(F.col("block"), F.expr("size % greatest(blocks, 1)"))
    length = F.expr("size div greatest(blocks, 1)") + (F.col("block") < F.expr("size % greatest(blocks, 1)")).cast("long")
    return (
        ranked.withColumns({"blocks": blocks, "size": size, "quota": quota}).where("blocks > 0")
        .withColumns({"epoch": epoch, "block": block}).withColumn("left", F.col("quota") - at).where("left > 0")
        .select("slot", "source_no", "epoch", "block", F.when(F.col("left") < length, F.col("left")).alias("words"))
    )


def _taken_blocks(news: DataFrame, parts: list[Share], ends: np.ndarray, slots: int) -> DataFrame:
    """How often each block is taken whole, and the words of its cut turn (a source has one cut slot at most)."""
    chosen = slot_schedule(news, parts, ends, slots)
    return chosen.groupBy(F.col("source_no").cast("int").alias("source_no"), "block").agg(
        F.sum(F.col("words").isNull().cast("long")).alias("whole"), F.sum("words").alias("cut"),
    )
