"""Hard negatives of labelled vectors: cover trees over norm-augmented candidates, searched best first within windows of scores."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of one tree and anchors of one piece at about, most rows whose vectors deal the candidates to trees, and points below which a node isn't divided.
TREE, PIECE, MOST_PIVOTS, LEAF = 2048, 4096, 4096, 24
MIXED = np.iinfo(np.int64).min

NODE = np.dtype([("center", "<i4"), ("child", "<i4"), ("children", "<i4"), ("point", "<i4"), ("points", "<i4"), ("radius", "<f8"), ("label", "<i8")])


def augmented(vectors: np.ndarray, bound: float) -> np.ndarray:
    """The vectors with one more component, after which all have the norm ``bound``: the nearest to an anchor (with 0 there) is the one of the largest product."""
    v = vectors.astype(float)
    return np.concatenate([v, np.sqrt(np.maximum(bound * bound - (v * v).sum(1), 0))[:, None]], 1)


def cover_tree(points: np.ndarray, labels: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, order of the points): every node's points lie within its radius around its center.

    From the root down, the points of a node go to children: its own center again, then any point that no child covers
    yet, each covering the rest within half the node's radius. So centers of one node are further apart than that. Single
    points, and all points of a small node, are kept at the node itself.
    """
    gram = points @ points.T
    order, nodes, queue = [], [], [(0, np.arange(len(points)))]
    at = 1  # next free node
    for center, own in queue:  # grows while it is walked: children of a node are next to each other
        radius = math.sqrt(max(2 * bound * bound - 2 * float(gram[center, own].min()), 0)) + 1e-7 * bound
        kinds = labels[own]
        node = [center, at, 0, len(order), 0, radius, kinds[0] if (kinds == kinds[0]).all() else MIXED]
        if len(own) <= LEAF or radius <= 1e-6 * bound:
            order.extend(own.tolist())
        else:
            near = bound * bound - radius * radius / 8  # product of two augmented points half a radius apart
            rest, first = own, center
            while len(rest):
                covered = gram[first, rest] >= near
                covered |= rest == first
                part = rest[covered]
                if len(part) == 1:
                    order.append(int(part[0]))
                else:
                    queue.append((first, part))
                    node[2] += 1
                rest = rest[~covered]
                first = int(rest[0]) if len(rest) else -1
            at += node[2]
        node[4] = len(order) - node[3]
        nodes.append(tuple(node))
    return np.array(nodes, NODE), np.array(order, np.int64)


class Tree:
    """A cover tree with the rows in its order; products are those of whole numbers, exact in doubles where ``exact``."""

    def __init__(self, row: dict):
        self.nodes = np.frombuffer(row["nodes"], NODE)
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        vectors = np.frombuffer(row["vectors"], "<i8").reshape(len(self.ids), -1)
        self.vectors = vectors.astype(float) if row["exact"] else vectors
        self.centers = augmented(vectors[np.argsort(np.frombuffer(row["order"], "<i8"))[self.nodes["center"]]], row["bound"])
        self.bound = row["bound"]

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest product of each anchor with any row of each node: the angle to the center, less or more the node's radius as an angle."""
        norm = np.sqrt((anchors.astype(float) ** 2).sum(1))[:, None] * self.bound
        cosine = (anchors.astype(float) @ self.centers[:, :-1].T) / np.where(norm > 0, norm, 1)
        angle = np.arccos(np.clip(cosine, -1, 1))
        wide = 2 * np.arcsin(np.clip(self.nodes["radius"] / (2 * self.bound or 1), 0, 1))
        slack = 1e-7 * norm + 0.5
        return norm * np.cos(np.minimum(angle + wide, np.pi)) - slack, norm * np.cos(np.maximum(angle - wide, 0)) + slack

    def search(self, anchor: np.ndarray, own_id: int, label: int, same: bool, windows: list[tuple[int, int]], k: int, least: np.ndarray, most: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each window of scores the first ``k`` rows in it, as (-score, id), with the anchor's label or with others.

        Nodes come in the order of the largest product they may hold. One is left out if, for every window, all its
        products lie above it, below it, or below the k rows found so far; what is met is scored exactly.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        floor = [lo for lo, _ in windows]
        nodes, product = self.nodes, self.vectors.dtype.type
        anchor = anchor.astype(product)

        def outside(n: int) -> bool:
            only = int(nodes["label"][n])
            if only != MIXED and (only == label) is not same:
                return True
            return all(most[n] < f or least[n] > hi for f, (_, hi) in zip(floor, windows, strict=True))

        heap = [] if outside(0) else [(-most[0], 0)]
        while heap:
            top, n = heapq.heappop(heap)
            if -top < min(floor):
                break
            if outside(n):
                continue
            node = nodes[n]
            a = int(node["point"])
            b = a + int(node["points"])
            if b > a:
                scores = self.vectors[a:b] @ anchor
                fits = (self.labels[a:b] == label) == same
                if same:
                    fits &= self.ids[a:b] != own_id
                for w, (_, hi) in enumerate(windows):
                    at = np.flatnonzero(fits & (scores >= floor[w]) & (scores <= hi))
                    if len(at) > k:
                        s = scores[at]
                        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
                    if len(at):
                        if len(at) > 4 * k:  # many of one score
                            at = at[np.lexsort((self.ids[a:b][at], -scores[at]))[:k]]
                        found[w] = sorted(found[w] + [(-int(scores[i]), int(self.ids[a + i])) for i in at.tolist()])[:k]
                        if len(found[w]) == k:
                            floor[w] = max(floor[w], -found[w][-1][0])
            for c in range(int(node["child"]), int(node["child"]) + int(node["children"])):
                if not outside(c):
                    heapq.heappush(heap, (-most[c], c))
        return found


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Whole-number vectors as rows; shorter ones are filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (ends == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(ends)), ends), np.concatenate([np.arange(n) for n in ends] or [np.zeros(0, int)])] = flat
    return out


def _nearest(pivots, width: int, bound: float):
    def run(batches):
        centers = augmented(pivots.value, bound)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                near = (augmented(_matrix(part.column("vector"), width), bound) @ centers.T).argmax(1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), part.column("vector"), pa.array(near.astype(np.int32))], ["id", "label", "vector", "pivot"])

    return run


def _plant(width: int, bound: float, exact: bool):
    def run(group: pa.Table) -> pa.Table:
        ids, labels = group.column("id").to_numpy(), group.column("label").to_numpy()
        vectors = _matrix(group.column("vector"), width)
        nodes, order = cover_tree(augmented(vectors, bound), labels, bound)
        out = {
            "nodes": [nodes.tobytes()], "order": [order.tobytes()], "ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()],
            "vectors": [vectors[order].tobytes()], "bound": [bound], "exact": [exact],
        }
        return pa.table(out)

    return run


_TREE = "nodes binary, order binary, ids binary, labels binary, vectors binary, bound double, exact boolean"


def _searching(width: int, same: bool, k: int):
    """Answers of one tree to one piece of anchors."""

    def run(key: tuple, trees: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if trees.num_rows and anchors.num_rows:
            tree = Tree(trees.to_pylist()[0])
            vectors = _matrix(anchors.column("vector"), width)
            ids, labels = anchors.column("id").to_pylist(), anchors.column("label").to_pylist()
            everything = [[(-(1 << 62), 1 << 62)]] * len(ids)
            windows = everything if same else [[(w["low"], w["high"]) for w in ws] for ws in anchors.column("windows").to_pylist()]
            for at in range(0, len(ids), 256):
                least, most = tree.bounds(vectors[at : at + 256])
                for i in range(at, min(at + 256, len(ids))):
                    got = tree.search(vectors[i], ids[i], labels[i], same, windows[i], k, least[i - at], most[i - at])
                    out += [(ids[i], *w, x, -s) for w, rows in zip(windows[i], got, strict=True) for s, x in rows]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["anchor_id", "low", "high", "id", "score"])

    return run


def _first(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k rows of each group by score and id, with their rank; all but k a task are left out before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _answers(trees: DataFrame, anchors: DataFrame, n_trees: int, n_pieces: int, width: int, same: bool, k: int) -> DataFrame:
    """Each tree meets each piece of anchors once; what moves is the trees once a piece and the anchors once a tree."""
    left = trees.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(n_pieces - 1))))
    right = anchors.withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(n_pieces)).cast("int")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    return left.groupBy("tree", "piece").cogroup(right.groupBy("tree", "piece")).applyInArrow(_searching(width, same, k), "anchor_id long, low long, high long, id long, score long")


def _grow(rows: DataFrame, width: int, bound: float, exact: bool, n: int) -> tuple[DataFrame, int]:
    """The candidates as trees of about TREE rows, numbered from 0, and their count.

    Rows go to the nearest of at most MOST_PIVOTS rows (those with the smallest hash of the id), and a pivot's rows, if they are too many, by a
    hash of the id to several trees: so a vector that a third of all rows share is many trees.
    """
    spark = rows.sparkSession
    few = rows.orderBy(F.xxhash64("id"), "id").select("vector").limit(max(1, min(MOST_PIVOTS, n // TREE))).toArrow()
    pivots = spark.sparkContext.broadcast(_matrix(few.column("vector"), width))
    dealt = written(rows.mapInArrow(_nearest(pivots, width, bound), "id long, label long, vector array<long>, pivot int"))
    sizes = [(r["pivot"], max(1, -(-r["n"] // TREE))) for r in dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).orderBy("pivot").collect()]  # MOST_PIVOTS rows at most
    first = np.concatenate(([0], np.cumsum([k for _, k in sizes])))
    places = F.broadcast(spark.createDataFrame([(p, k, int(f)) for (p, k), f in zip(sizes, first, strict=False)], "pivot int, parts int, first int"))
    numbered = dealt.join(places, "pivot").select("id", "label", "vector", (F.col("first") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))).cast("int").alias("tree"))
    planted = numbered.groupBy("tree").applyInArrow(_numbered_plant(width, bound, exact), f"tree int, {_TREE}")
    return written(planted), int(first[-1])


def _numbered_plant(width: int, bound: float, exact: bool):
    plant = _plant(width, bound, exact)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        return plant(group).add_column(0, "tree", pa.array([key[0].as_py()], pa.int32()))

    return run


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "id") -> DataFrame:
    """For each anchor and each of its nearest rows of the same label, rows of other labels that score close below them.

    vectors: feature vectors as the training sets hold them: ``id`` (long), ``vector`` (array of whole numbers; fractions
    are scaled and floored before) and ``label`` (class number); more columns are ignored. ``anchor`` tells which rows are
    anchors. A score is the inner product with the anchor; higher ones come first, ties by smaller id. An anchor's
    positives are its first ``positives`` other rows of its label. For each, the first ``negatives`` rows of other labels
    with ``low`` to ``high`` percent of the positive's score are returned (of negative scores there are none): ``anchor_id``,
    ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    All candidates are indexed: dealt to trees of bounded size, a cover tree each in the space in which all have the same
    norm, stored in the shared folder. Every tree answers every piece of anchors, best first, with whole subtrees left out
    by their radius; the answers, ``positives`` or ``negatives`` a window and tree at most, are merged by rank. Results are
    exact. Without structure in the vectors no subtree can be left out, and each anchor is scored against every row, in blocks.

    Rows with a null id, label, vector or component take no part. Of rows with one id the one with the smallest label and vector counts. Shorter vectors are
    filled with 0. Equal vectors under different ids are different rows. Scores of which 100 times, or ``high`` times, is beyond a long raise ArithmeticError. No anchors, or no rows, give no rows.
    """
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("is_anchor")).where(usable)
    one = own.groupBy("id").agg(F.min(F.struct("label", "vector", "is_anchor")).alias("r")).select("id", "r.label", "r.vector", "r.is_anchor")
    rows = written(one)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("anchors"), F.max(F.size("vector")).alias("width"), F.max(square).alias("square")).first()
    spark = rows.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts["anchors"]:
        return spark.createDataFrame([], result)
    if facts["square"] * max(low, high, 100) >= 2.0**63:
        raise ArithmeticError("percentages of scores beyond a long")
    width, bound = max(1, facts["width"]), math.sqrt(facts["square"]) * (1 + 1e-12)
    trees, n_trees = _grow(rows.select("id", "label", "vector"), width, bound, facts["square"] < 2.0**52, facts["n"])
    anchors = rows.where("is_anchor").select("id", "label", "vector")
    pieces = -(-facts["anchors"] // PIECE)
    found = written(_first(_answers(trees, anchors, n_trees, pieces, width, True, positives), positives, "anchor_id").select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    edges = found.selectExpr("*", f"(positive_score * {low} + 99) div 100 AS low", f"(positive_score * {high}) div 100 AS high")
    windows = edges.where("positive_score >= 0 AND low <= high").groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set(F.struct("low", "high")).alias("windows"))
    asked = anchors.join(windows, "id")
    worse = _first(_answers(trees, asked, n_trees, pieces, width, False, negatives), negatives, "anchor_id", "low", "high")
    out = edges.join(worse, ["anchor_id", "low", "high"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
