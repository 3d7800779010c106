"""Shared parts: words and shingles of Arrow text columns as 64-bit hashes, reliable cuts of lineage, bounded filters."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import local

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
ASCII_SPACE = bytes([0x20, *range(0x09, 0x0E)])
ASCII_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STEP = 1 << 17  # bytes hashed at once: the arrays for them stay in the cache


def byte_set(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SPACE = byte_set(ASCII_SPACE)
SPACE_OR_PUNCTUATION = byte_set(ASCII_SPACE + ASCII_PUNCTUATION)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = LOWER.astype(U) + U(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_scratch: dict[str, str] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        with np.errstate(over="ignore"):
            step = np.full(max(n, STEP + 1), base, U)
            step[0] = 1
            got = _powers[base] = np.cumprod(step, dtype=U)
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _pieces(data: np.ndarray, ends: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text + 1, from byte, to byte) of at most about STEP bytes; a longer text is cut between words."""
    i, n, at = 0, len(ends) - 1, int(ends[0])
    while i < n:
        j = int(np.searchsorted(ends, at + STEP, "right")) - 1
        if j > i:
            yield i, j, at, int(ends[j])
            i, at = j, int(ends[j])
            continue
        stop, end = at + STEP, int(ends[i + 1])
        while stop < end and not sep[data[stop]]:  # to the next gap between words
            ahead = np.flatnonzero(sep[data[stop : min(end, stop + STEP)]])
            stop = stop + int(ahead[0]) if len(ahead) else min(end, stop + STEP)
        yield i, i + 1, at, min(stop, end)
        at = min(stop, end)
        i += at >= end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends


def _values(part: np.ndarray, latin: bool) -> np.ndarray:
    out = _VALUE[part]
    if latin:
        capital = np.flatnonzero(part[:-1] == 0xC3) + 1
        capital = capital[(part[capital] >= 0x80) & (part[capital] <= 0x9E) & (part[capital] != 0x97)]
        out[capital] += U(32)
    return out


def words(texts: pa.Array, sep: np.ndarray = SPACE, spans: list | None = None, latin: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of bytes outside ``sep``, A-Z lower-cased) in order, and the words of each text.

    ``latin`` lower-cases the capitals of Latin-1 as well. ``spans``, if given, gets pairs of arrays with the first byte of each word and the byte after it, in ``text_bytes``.

    Works on bytes, whole texts, with a few vector operations a byte: a polynomial over the bytes is summed up
    once and the hash of a word is the difference at its ends.
    """
    data, ends = text_bytes(texts)
    counts, out = np.zeros(len(ends) - 1, np.int64), []
    with np.errstate(over="ignore"):
        for i, j, a, b in _pieces(data, ends, sep):
            if a == b:
                continue
            part = data[a:b]
            gap = sep[part]
            fresh = np.zeros(b - a + 1, bool)  # a text starts here
            starts_at = ends[i:j] - a
            fresh[starts_at[(starts_at >= 0) & (starts_at <= b - a)]] = True
            before = np.empty(b - a, bool)
            before[0] = True
            before[1:] = gap[:-1]
            begin = np.flatnonzero(~gap & (before | fresh[:-1]))
            after = np.empty(b - a, bool)
            after[-1] = True
            after[:-1] = gap[1:] | fresh[1:-1]
            end = np.flatnonzero(~gap & after) + 1
            if spans is not None:
                spans.append((begin + a, end + a))
            value = _values(part, latin)
            value *= _power(_BASE, b - a)[: b - a]
            total = np.zeros(b - a + 1, U)
            np.cumsum(value, out=total[1:])
            out.append(mix((total[end] - total[begin]) * _power(_INVERSE, b - a)[begin]))
            if j - i == 1:
                counts[i] += len(begin)
            else:
                counts[i:j] += np.diff(np.searchsorted(begin, np.append(starts_at, b - a)))
    return (np.concatenate(out) if out else np.zeros(0, U)), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words and the runs of each text; a text with fewer words is one run."""
    n = len(hashes)
    starts = np.concatenate(([0], np.cumsum(counts)))
    short = np.flatnonzero((counts > 0) & (counts < k))
    many = np.maximum(counts - k + 1, 0)
    out_counts = many.copy()
    out_counts[short] = 1
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(n - k + 1, 0), U)
        for j in range(k if len(rolled) else 0):
            rolled += hashes[j : n - k + 1 + j] * _power(_BASE, k + 1)[j + 1]
        rolled = mix(rolled)
        if not len(short) and len(counts) == 1:
            return rolled, out_counts
        out = np.empty(int(out_counts.sum()), U)
        at = np.concatenate(([0], np.cumsum(out_counts)))
        full = np.flatnonzero(many)
        if len(full):
            source = np.repeat(starts[full] - np.concatenate(([0], np.cumsum(many[full])))[:-1], many[full]) + np.arange(int(many[full].sum()))
            target = np.repeat(at[full] - np.concatenate(([0], np.cumsum(many[full])))[:-1], many[full]) + np.arange(int(many[full].sum()))
            out[target] = rolled[source]
        for i in short:
            own = hashes[starts[i] : starts[i + 1]]
            out[at[i]] = mix(np.array([(own * _power(_BASE, k + 1)[1 : len(own) + 1]).sum() + U(len(own))], U))[0]
    return out, out_counts


def distinct(items: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    items = np.sort(items)
    return items[np.concatenate(([True], items[1:] != items[:-1]))] if len(items) else items


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most about ``most`` bytes of text each, so that memory doesn't grow with a batch."""
    _, ends = text_bytes(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names. Unset, a scratch folder serves a session that is one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _scratch.get("path") or _scratch.setdefault("path", f"file://{tempfile.mkdtemp(prefix='barflow-llm-')}")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


_noted = local()


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def noted(docs: DataFrame) -> Iterator[None]:
    """Notes the folders that ``written`` makes within it, and first deletes those noted by the one before it in this thread.

    So what was computed from those has to be written by then; folders that ``docs`` itself is read from stay.
    """
    spark, files = docs.sparkSession, docs.inputFiles()
    before = getattr(_noted, "paths", [])
    kept = [p for p in before if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in files)]
    for path in before:
        if path not in kept:
            delete(spark, path)
    _noted.paths, _noted.on = kept, True
    try:
        yield
    finally:
        _noted.on = False


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there and lost executors cost no recomputation."""
    path = shared_folder(df.sparkSession)
    if getattr(_noted, "on", False):
        _noted.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bit_filter(df: DataFrame, column: str, bits: int = 25) -> np.ndarray:
    """A bitmap of ``2 ** bits`` cells that has the cell of every value of a long column set.

    Its size is fixed, whatever the rows: at most ``2 ** (bits - 6)`` longs come to the driver. A full map lets all
    pass, so it only ever saves work; an exact join has to follow.
    """
    rows = (
        df.where(F.col(column).isNotNull()).select(F.expr(f"{column} & {(1 << bits) - 1}L").alias("cell"))
        .select(F.shiftright("cell", 6).alias("at"), F.expr("shiftleft(1L, cast(cell & 63 as int))").alias("bit"))
        .groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    )
    out = np.zeros(1 << (bits - 6), "<i8")
    out[rows.column("at").to_numpy()] = rows.column("bit").to_numpy()
    return out.view(np.uint8)


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes & U(len(bitmap) * 8 - 1)
    return (bitmap[(cell >> U(3)).astype(np.int64)] >> (cell & U(7)).astype(np.uint8)) & 1 == 1


def _id_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column("id").to_numpy().view(U)).view(np.int64))], ["cell"])


def _those_in(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(passes(bitmap.value, mix(batch.column("id").to_numpy().view(U)))))

    return run


def texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text) whose id is among ``ids``, and perhaps a few more, written; texts of others are not shuffled.

    The ids are known by a bitmap of fixed size, so nothing that grows is broadcast; with very many ids it lets more texts pass.
    """
    bitmap = texts.sparkSession.sparkContext.broadcast(bit_filter(ids.select("id").where("id is not null").mapInArrow(_id_cells, "cell long"), "cell"))
    return written(texts.where("id is not null").mapInArrow(_those_in(bitmap), "id long, text string"))
