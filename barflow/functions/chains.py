"""Paths along next-pointers: which rows a rule takes when each taken row names the next one that may be taken.

A rule such as "not before half an hour after the last one" looks sequential, but a row's successor depends on that row
alone. So every row gets a pointer, blocks of rows are passed through by jumping twice as far each time, and only the rows
at which a path may enter a block go to the next level, where they form blocks again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from . import windows as fw

END = 1 << 62


def block_exits(nxt: np.ndarray, base: int) -> np.ndarray:
    """For each row of a block the first row of its path behind the block."""
    out = nxt.copy()
    while True:
        inside = np.flatnonzero(out < base + len(out))
        if not len(inside):
            return out
        out[inside] = out[out[inside] - base]


def block_path(nxt: np.ndarray, base: int, entry: int) -> np.ndarray:
    """The rows of a block on the path that enters it at ``entry``."""
    n = len(nxt)
    jump = np.append(np.minimum(nxt - base, n), n)
    on, more = np.array([entry - base]), True
    while more:
        ahead = jump[on]
        ahead = ahead[ahead < n]
        more = len(ahead) > 0
        on, jump = np.concatenate([on, ahead]), jump[jump]
    return np.unique(on) + base


def _written(df: DataFrame) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/chain"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _exits(group: pa.Table) -> pa.Table:
    order = np.argsort(group.column("i").to_numpy())
    i, nxt = group.column("i").to_numpy()[order], group.column("nxt").to_numpy()[order]
    return pa.table({"key": group.column("key").take(pa.array(order)), "i": i, "nxt": block_exits(nxt, int(i[0]))})


def _marks(group: pa.Table) -> pa.Table:
    order = np.argsort(group.column("i").to_numpy())
    i, nxt = group.column("i").to_numpy()[order], group.column("nxt").to_numpy()[order]
    on = block_path(nxt, int(i[0]), int(group.column("entry")[0].as_py()))
    return pa.table({"key": group.column("key").slice(0, 1).take(pa.array(np.zeros(len(on), np.int64))), "i": on})


def path(nodes: DataFrame, rows: int = 4096) -> DataFrame:
    """(key, i) of the rows on the path from each key's row 0.

    nodes: ``key``, ``i`` (0, 1, 2 ... in each key) and ``nxt``, a later ``i`` or NULL at the end. No task holds more than
    ``rows`` rows of a key at once; a level's rows go through two passes, and the next level has only those rows that are the first of
    some path in their block. If that level isn't half as large, it is solved by joins that double the length of the jumps.
    """
    kind = nodes.schema["key"].dataType.simpleString()
    x = _written(nodes.select("key", F.col("i").cast("long").alias("i"), F.coalesce(F.col("nxt").cast("long"), F.lit(END)).alias("nxt")))
    if not (most := _largest(x)):
        return x.select("key", "i")
    block = F.floor(F.col("i") / rows)
    if most <= rows:
        return x.withColumn("entry", F.lit(0).cast("long")).groupBy("key").applyInArrow(_marks, f"key {kind}, i long")
    exits = _written(x.groupBy("key", block.alias("b")).applyInArrow(_exits, f"key {kind}, i long, nxt long"))
    entries = exits.where(F.col("nxt") < END).select("key", F.col("nxt").alias("i")).union(exits.where("i = 0").select("key", "i")).distinct()
    heads = _written(fw.index_rows(exits.join(entries, ["key", "i"]), "key", ["i"], block, "j"))
    to = heads.select("key", F.col("i").alias("nxt"), F.col("j").alias("to"))
    level = heads.join(to, ["key", "nxt"], "left").select("key", F.col("j").alias("i"), F.col("to").alias("nxt"))
    taken = path(level, rows) if _largest(heads) * 2 <= most else doubled(level)
    at = taken.withColumnRenamed("i", "j").join(heads.select("key", "i", "j"), ["key", "j"]).select("key", F.col("i").alias("entry"), block.alias("b"))
    own = x.withColumn("b", block).join(at, ["key", "b"])
    return own.groupBy("key", "b").applyInArrow(_marks, f"key {kind}, i long")


def _largest(x: DataFrame) -> int:
    return x.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0


def doubled(nodes: DataFrame) -> DataFrame:
    """The same by joins alone: what is reached within 2, 4, 8 ... jumps."""
    jump = _written(nodes.where("nxt is not null").select("key", "i", "nxt"))
    on = nodes.where("i = 0").select("key", F.col("i").cast("long").alias("i"))
    while not jump.isEmpty():
        on = _written(on.union(on.join(jump, ["key", "i"]).select("key", F.col("nxt").alias("i"))).distinct())
        far = jump.select("key", F.col("i").alias("nxt"), F.col("nxt").alias("far"))
        jump = _written(jump.join(far, ["key", "nxt"]).select("key", "i", F.col("far").alias("nxt")))
    return on
