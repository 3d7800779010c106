"""Quality of articles by votes of their nearest labelled neighbours in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, slices, shingles, text_bytes, words
from .records import article_text

#: Labelled articles that vote, at most (those with the smallest hash of their id); latent dimensions; neighbours with a vote.
MOST_LABELLED, DIMENSIONS, NEIGHBOURS = 4_000, 48, 25
#: Articles that meet the labelled ones in one matrix product.
BLOCK_ROWS = 512
_CLASSES = 16
_SHAPES = _CLASSES**3
_BINS = 16  # of the share of distinct word pairs, and of distinct words


def _shape_of_bytes() -> np.ndarray:
    """Space, line end, lower, upper, digit, beyond ASCII, and ten groups of signs."""
    out = np.array([6 + b % 10 for b in range(256)], np.int64)
    out[[0x20, 0x09, 0x0B, 0x0C]], out[[0x0A, 0x0D]] = 0, 1
    out[97:123], out[65:91], out[48:58], out[128:] = 2, 3, 4, 5
    return out


_SHAPE = _shape_of_bytes()
TERMS = _SHAPES + 2 * _BINS


def term_rows(texts: pa.Array) -> np.ndarray:
    """Terms of each whole text: runs of three byte shapes (log of their share), and how far words and word pairs repeat. Rows have length 1."""
    data, ends = text_bytes(texts)
    hashes, counts = words(texts)
    pairs, n_pairs = shingles(hashes, counts, 2)
    at, at2 = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(n_pairs)))
    out = np.zeros((len(counts), TERMS), np.float32)
    for i in range(len(counts)):
        c = _SHAPE[data[ends[i] : ends[i + 1]]]
        if len(c) >= 3:
            seen = np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=_SHAPES)
            out[i, :_SHAPES] = np.log1p(seen * (1000.0 / len(c)))
            out[i, :_SHAPES] /= np.linalg.norm(out[i, :_SHAPES])
        if counts[i]:
            own = hashes[at[i] : at[i + 1]][:]
            for k, (items, base) in enumerate(((pairs[at2[i] : at2[i + 1]], _SHAPES), (own, _SHAPES + _BINS))):
                share = len(distinct(items)) / len(items)
                out[i, base + min(_BINS - 1, int(share * _BINS))] = 0.5 if k == 0 else 0.2
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


@dataclass
class Voters:
    """``project``: terms to latent dimensions; ``vectors`` of length 1 and ``labels`` of the labelled articles."""

    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def latent(terms: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Terms by dimensions: the leading right singular vectors of the matrix, by subspace iteration."""
    width = min(dimensions + 8, *terms.shape)
    q = np.random.default_rng(7).standard_normal((terms.shape[1], width)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(terms.T @ (terms @ q))
    _, _, v = np.linalg.svd(terms @ q, full_matrices=False)
    return (q @ v.T)[:, :dimensions]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for b in batches for x in slices(b, "text", 1 << 20)):
        for i in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(i, BLOCK_ROWS)
            terms = term_rows(part.column("text"))
            at = [np.flatnonzero(r).astype(np.int32) for r in terms]
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(terms, at, strict=True)], pa.list_(pa.float32()))], ["label", "at", "value"],
            )


def fit(news: DataFrame, labels: DataFrame, label_col: str = "label", id_col: str = "id", most: int = MOST_LABELLED) -> Voters:
    """Latent space and labelled vectors of ``most`` labelled articles at most, which alone reach the driver, as their few terms."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").dropDuplicates(["id"])
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = news.select(F.col(id_col).alias("id"), article_text(news).alias("text")).join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    table = rows.orderBy("id").select("label", "text").mapInArrow(_rows, "label int, at array<int>, value array<float>").toArrow()
    terms = np.zeros((table.num_rows, TERMS), np.float32)
    for i, (at, value) in enumerate(zip(table.column("at"), table.column("value"), strict=True)):
        terms[i, at.values.to_numpy()] = value.values.to_numpy()
    if not len(terms):
        return Voters(np.zeros((TERMS, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    project = latent(terms)
    return Voters(project, _unit(terms @ project), table.column("label").to_numpy().astype(np.float32))


def vote(voters: Voters, terms: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the nearest labelled articles, each with its cosine (at least 0) as its weight; an even vote if none has any."""
    if not len(voters.labels):
        return np.full(len(terms), 0.5)
    near = _unit(terms @ voters.project) @ voters.vectors.T
    k = min(neighbours, near.shape[1])
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64)
    total = weight.sum(axis=1)
    return np.where(total > 0, (weight * voters.labels[at]).sum(axis=1) / np.maximum(total, 1e-12), 0.5)


def quality_votes(news: DataFrame, labels: DataFrame, label_col: str = "label", id_col: str = "id", most: int = MOST_LABELLED) -> DataFrame:
    """Score (0 to 1, higher: label 1 likelier) of every whole article by votes of its nearest labelled neighbours.

    news: ``id``, ``title``, ``summary``; labels: ``id`` and a 0/1 column; more columns are ignored, and neither label,
    id nor source is part of a vector. Returns one row per input row: ``id``, ``score``, ``predicted`` (1 if score >= 0.5).

    The vectors are latent-semantic ones over terms of writing style (byte shapes and repetition, not the words, most of
    which occur once), so that neighbours are written alike. The ``most`` labelled vectors (0.8 MB at most) are broadcast; every
    article meets all of them in exact products, a block of rows at a time, in one map pass over the text.

    Null title and summary count as empty; empty articles are scored like others. Of repeated label rows one is used. Null
    and repeated ids are scored like others. Without labels all scores are 0.5. No rows give no rows.
    """
    voters = fit(news, labels, label_col, id_col, most)
    shared = news.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "text", 1 << 20)):
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                p = vote(shared.value, term_rows(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    texts = news.select(F.col(id_col).alias("id"), article_text(news).alias("text"))
    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, score double, predicted int")
