"""Toxicity of social posts by a chain of linear classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_OR_PUNCTUATION, U, distinct, slices, text_bytes, words

#: Labelled posts the chain is fitted on, at most (those with the smallest hash of their id), and word features of each category.
MOST_LABELLED, FEATURES, LEAST_POSTS = 20_000, 128, 4
FOLDS, PENALTY, THRESHOLD = 5, 0.2, 0.5
_DENSE = 3


@dataclass
class Chain:
    """``features``: sorted hashes of the words that count; ``weights``: of each category, over words, dense values, bias and earlier categories."""

    categories: tuple[str, ...]
    features: np.ndarray
    weights: list[np.ndarray]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-4, 1 - 1e-4) / np.clip(1 - p, 1e-4, 1))


def fit_linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the last column is the bias, which is not penalised. One class gives its smoothed rate."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = _logit(np.array([(y.sum() + 0.01) / (len(y) + 0.02 if len(y) else 1)]))[0]
        return w
    penalty = np.full(len(w), PENALTY)
    penalty[-1] = 1e-6
    for _ in range(12):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _with(x: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([x, *(_logit(p) for p in earlier), np.ones(len(x))])


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """Weights of each category in turn; the later models are fitted on probabilities of the earlier ones for posts these have not seen."""
    weights, earlier = [], []
    for y in labels.T:
        z = _with(x, earlier)
        unseen = np.empty(len(y))
        for f in range(FOLDS):
            held = folds == f
            if held.any():
                unseen[held] = _sigmoid(z[held] @ fit_linear(z[~held], y[~held]))
        weights.append(fit_linear(z, y))
        earlier.append(unseen)
    return weights


def predict(chain: Chain, x: np.ndarray) -> np.ndarray:
    earlier: list[np.ndarray] = []
    for w in chain.weights:
        earlier.append(_sigmoid(_with(x, earlier) @ w))
    return np.column_stack(earlier) if earlier else np.zeros((len(x), 0))


def _dense(texts: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Of each text: log of its words, share of upper-case letters, share of ASCII punctuation."""
    data, ends = text_bytes(texts)
    part = data[ends[0] : ends[-1]]
    size = np.maximum(np.diff(ends), 1)
    upto = lambda hit: np.diff(np.concatenate(([0], np.cumsum(hit)))[ends - ends[0]])
    return np.column_stack([np.log1p(counts) / 10, upto((part >= 65) & (part <= 90)) / size, upto(SPACE_OR_PUNCTUATION[part] & (part > 32)) / size])


def feature_rows(texts: pa.Array, features: np.ndarray) -> np.ndarray:
    """Which features each whole text has, and its dense values."""
    hashes, counts = words(texts, SPACE_OR_PUNCTUATION, latin=True)
    x = np.zeros((len(counts), len(features) + _DENSE))
    if len(features) and len(hashes):
        near = np.zeros(1 << 16, bool)
        near[(features & U(0xFFFF)).astype(np.int64)] = True
        hit = np.flatnonzero(near[(hashes & U(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(features, hashes[hit]), len(features) - 1)
        exact = features[at] == hashes[hit]
        row = np.searchsorted(np.cumsum(counts), hit[exact], "right")
        x[row, at[exact]] = 1
    x[:, len(features) :] = _dense(texts, counts)
    return x


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for b in batches for x in slices(b, "text_snippet", 1 << 20)):
        hashes, counts = words(batch.column("text_snippet"), SPACE_OR_PUNCTUATION, latin=True)
        at = np.concatenate(([0], np.cumsum(counts)))
        own = [distinct(hashes[at[i] : at[i + 1]]).view(np.int64) for i in range(batch.num_rows)]
        rest = [c for c in batch.schema.names if c != "text_snippet"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(own, pa.list_(pa.int64()))], [*rest, "words"])


def fit(posts: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_col: str = "id", most: int = MOST_LABELLED) -> Chain:
    """The chain fitted on ``most`` labelled posts at most; only their word features reach the driver.

    Word features are those in LEAST_POSTS labelled posts at least with the largest chi-square for a category.
    """
    known = labels.select(F.col(id_col).alias("id"), *(F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in categories)).where("id is not null").dropDuplicates(["id"])
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = posts.select(F.col(id_col).alias("id"), "text_snippet").join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    kinds = ", ".join(f"`{c}` int" for c in categories)
    kind = rows.schema["id"].dataType.simpleString()
    own = rows.select("id", *categories, "text_snippet").mapInArrow(_distinct_words, f"id {kind}, {kinds}, words array<long>")
    totals = own.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in categories)).first()
    n = totals["n"]
    counts = own.select(F.explode("words").alias("word"), *categories).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in categories)).where(F.col("n") >= LEAST_POSTS)
    chosen_words: set[int] = set()
    for c in categories:
        m = totals[c] or 0
        expected = F.col("n") * (m / max(n, 1))
        score = (F.col(c) - expected) * (F.col(c) - expected) / (expected * (1 - m / max(n, 1)) * (1 - F.col("n") / max(n, 1)) + 1e-6)
        if 0 < m < n:
            chosen_words |= {r["word"] for r in counts.orderBy(F.desc(score), "word").select("word").limit(FEATURES).collect()}
    features = np.sort(np.array(sorted(chosen_words), np.int64).view(U))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "text_snippet", 1 << 20)):
            x = feature_rows(batch.column("text_snippet"), features)
            hits = [np.flatnonzero(r[: len(features)]).astype(np.int32) for r in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(batch.column(c) for c in categories), pa.array(hits, pa.list_(pa.int32())), pa.array(x[:, len(features) :].tolist(), pa.list_(pa.float64()))],
                ["id", *categories, "hits", "dense"],
            )

    table = rows.select("id", *categories, "text_snippet").mapInArrow(of, f"id {kind}, {kinds}, hits array<int>, dense array<double>").withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS))).orderBy("id").toArrow()
    x = np.zeros((table.num_rows, len(features) + _DENSE))
    for i, (hits, dense) in enumerate(zip(table.column("hits").to_pylist(), table.column("dense").to_pylist(), strict=True)):
        x[i, hits] = 1
        x[i, len(features) :] = dense
    y = np.column_stack([table.column(c).to_numpy() for c in categories]).astype(float).reshape(-1, len(categories))
    return Chain(tuple(categories), features, fit_chain(x, y, table.column("fold").to_numpy()))


def score(posts: DataFrame, chain: Chain, threshold: float = THRESHOLD, id_col: str = "id") -> DataFrame:
    """id, a probability for each category (``p_<category>``) and ``rejected`` (one of them is ``threshold`` or more) of every whole post.

    posts: ``id``, ``text_snippet``; more columns are ignored. One row per input row, in one map pass over the text. A
    null snippet counts as empty. Null and repeated ids are scored like others. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "text_snippet", 1 << 20)):
            p = predict(chain, feature_rows(batch.column("text_snippet"), chain.features))
            rejected = (p >= threshold).any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c) for c in p.T), pa.array(rejected)], ["id", *(f"p_{c}" for c in chain.categories), "rejected"])

    texts = posts.select(F.col(id_col).alias("id"), "text_snippet")
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, {', '.join(f'`p_{c}` double' for c in chain.categories)}, rejected boolean")


def toxicity(posts: DataFrame, labels: DataFrame, categories: tuple[str, ...], threshold: float = THRESHOLD, id_col: str = "id", most: int = MOST_LABELLED) -> DataFrame:
    """Fits the chain on the labelled posts and scores all posts: see ``fit`` and ``score``.

    labels: ``id`` and a 0/1 column for each category, in the order of the chain; a null label counts as 0, of repeated
    ids one row is used. Without labels every probability is that of an even guess below the threshold.
    """
    return score(posts, fit(posts, labels, categories, id_col, most), threshold, id_col)
