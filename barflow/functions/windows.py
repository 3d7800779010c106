"""Window building blocks: guarded rolling frames, EMA, pivots, streaks, blocked series.

Bars are already aggregated to one row per (ticker, interval), so a window partitioned by
ticker holds at most the calendar's intervals.  Raw event series have no such bound: they go
through :func:`blocked`, which cuts each key into row-indexed blocks with an overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from .scalars import col

EMA_BLOCK = 256
EMA_CARRY_BLOCKS = 8


def series(key: str | Sequence[str] = "ticker", order: str | Column | Sequence[str | Column] = "ts") -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, (str, Column)) else list(order)
    return W.partitionBy(*keys).orderBy(*orders)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(W.unboundedPreceding, 0)


def roll(agg: Callable[[Column], Column], c: Column | str, w: WindowSpec, n: int, min_rows: int | None = None) -> Column:
    """Rolling aggregate that stays NULL until ``min_rows`` (default ``n``) values are in the frame."""
    frame = trailing(w, n)
    x = col(c)
    return F.when(F.count(x).over(frame) >= (n if min_rows is None else min_rows), agg(x).over(frame))


def pct_change(c: Column | str, w: WindowSpec, k: int = 1) -> Column:
    x = col(c)
    return F.try_divide(x, F.lag(x, k).over(w)) - 1


def ewm(df: DataFrame, specs: dict[str, tuple[Column | str, int, bool]], key: str = "ticker", order: str = "ts") -> DataFrame:
    """Exponential means ``{name: (value, span, adjust)}`` without a row loop.

    Rows are cut into blocks of 256.  Inside a block the recurrence is a scaled prefix sum; the
    value at a block's end is carried into the next one, damped by (1-a)^256 per block, so eight
    terms reach double precision for every span up to 50.  Values must not be NULL.
    """
    w = series(key, order)
    out = df.withColumn("_i", F.row_number().over(w) - 1)
    out = out.withColumns({"_b": F.floor(F.col("_i") / EMA_BLOCK), "_j": F.col("_i") % EMA_BLOCK})
    inside = running(series([key, "_b"], "_i"))
    local, ends, full = {}, {}, {}
    for name, (value, span, adjust) in specs.items():
        a = 2.0 / (span + 1)
        keep = F.lit(1.0 - a)
        weight = F.lit(a) if adjust else F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(a))
        scaled = weight * col(value) * F.pow(keep, -F.col("_j"))
        local[f"_l_{name}"] = F.sum(scaled).over(inside) * F.pow(keep, F.col("_j"))
        block_decay = (1.0 - a) ** EMA_BLOCK
        end = F.col(f"_l_{name}")
        for m in range(1, EMA_CARRY_BLOCKS):
            end = end + F.coalesce(F.lag(f"_l_{name}", EMA_BLOCK * m).over(w), F.lit(0.0)) * F.lit(block_decay**m)
        ends[f"_e_{name}"] = F.when(F.col("_j") == EMA_BLOCK - 1, end)
        carry = F.last(f"_e_{name}", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
        y = F.col(f"_l_{name}") + F.coalesce(carry, F.lit(0.0)) * F.pow(keep, F.col("_j") + 1)
        full[name] = y / (1 - F.pow(keep, F.col("_i") + 1)) if adjust else y
    out = out.withColumns(local).withColumns(ends).withColumns(full)
    return out.drop("_i", "_b", "_j", *local, *ends)


def pivot(c: Column | str, w: WindowSpec, order: int, high: bool = True, confirmed: bool = True) -> Column:
    """Strict local extremum over ``order`` rows each side, frames cut off at the series' edges.

    ``confirmed``: the value appears ``order`` rows later, when it can first be known; otherwise
    on the extremum's own row.  A row without neighbours on one side is never a pivot.
    """
    x = col(c)
    best = F.max if high else F.min
    if confirmed:
        here = F.lag(x, order).over(w)
        left = best(x).over(w.rowsBetween(-2 * order, -order - 1))
        right = best(x).over(w.rowsBetween(-order + 1, 0))
    else:
        here = x
        left = best(x).over(w.rowsBetween(-order, -1))
        right = best(x).over(w.rowsBetween(1, order))
    hit = (here > left) & (here > right) if high else (here < left) & (here < right)
    return F.when(hit, here)


def streak_length(df: DataFrame, state: Column, name: str, key: str | Sequence[str] = "ticker", order: str | Sequence[str] = "ts") -> DataFrame:
    """Position inside the current run of equal ``state`` values (1 on the first row of a run)."""
    w = series(key, order)
    keys = [key] if isinstance(key, str) else list(key)
    out = df.withColumn("_state", state)
    out = out.withColumn("_grp", F.sum(F.when(F.col("_state").eqNullSafe(F.lag("_state").over(w)), 0).otherwise(1)).over(running(w)))
    out = out.withColumn(name, F.row_number().over(series([*keys, "_grp"], order)))
    return out.drop("_state", "_grp")


def index_rows(df: DataFrame, key: str, order: Sequence[str], bucket: Column, name: str = "i") -> DataFrame:
    """Exact 0-based row index per key without putting a whole key into one task.

    Rows are numbered inside (key, bucket) and shifted by the number of rows in earlier buckets;
    only the bucket counts, one row per bucket, are ordered per key.
    """
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = W.partitionBy(key, "_bucket").orderBy(*order)
    return (
        tagged.join(offsets, [key, "_bucket"])
        .withColumn(name, F.col("_off") + F.row_number().over(inner) - 1)
        .drop("_bucket", "_off")
    )


def blocked(df: DataFrame, index: str = "i", lookback: int = 1, rows: int = 4096) -> DataFrame:
    """Cut an indexed series into blocks, each preceded by ``lookback`` warm-up rows.

    Adds ``_blk`` (window on key and ``_blk``) and ``_warm``; callers compute, then drop warm rows
    with :func:`unblock`.  No window holds more than ``rows + lookback`` rows however hot the key.
    """
    if lookback > rows:
        raise ValueError("lookback must fit in one block")
    own = F.floor(F.col(index) / rows).cast("long")
    spill = (F.col(index) % rows) >= rows - lookback
    targets = F.when(spill, F.array(own, own + 1)).otherwise(F.array(own))
    out = df.withColumn("_blk", F.explode(targets))
    return out.withColumn("_warm", F.floor(F.col(index) / rows).cast("long") != F.col("_blk"))


def unblock(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_warm")).drop("_blk", "_warm")


def prefix(df: DataFrame, key: str, cols: dict[str, tuple[str, Column | str]], index: str = "i", rows: int = 65536) -> DataFrame:
    """Running ``sum`` / ``max`` / ``last`` (non-NULL) of an indexed series in two levels.

    Each block of ``rows`` is folded on its own; only the block totals are ordered per key, and
    their running value is joined back.  A hot key is spread over all its blocks.
    """
    out = df.withColumn("_pb", F.floor(F.col(index) / rows))
    inside = running(W.partitionBy(key, "_pb").orderBy(index))
    before = W.partitionBy(key).orderBy("_pb").rowsBetween(W.unboundedPreceding, -1)
    ends, carry, local, full = [], [], {}, {}
    for name, (kind, value) in cols.items():
        v = col(value)
        if kind == "sum":
            ends.append(F.sum(v).alias(f"_e_{name}"))
            carry.append(F.sum(f"_e_{name}").over(before).alias(f"_c_{name}"))
            local[f"_l_{name}"] = F.sum(v).over(inside)
            full[name] = F.coalesce(F.col(f"_l_{name}"), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
        elif kind == "max":
            ends.append(F.max(v).alias(f"_e_{name}"))
            carry.append(F.max(f"_e_{name}").over(before).alias(f"_c_{name}"))
            local[f"_l_{name}"] = F.max(v).over(inside)
            full[name] = F.greatest(f"_l_{name}", f"_c_{name}")
        else:
            ends.append(F.max_by(v, F.when(v.isNotNull(), F.col(index))).alias(f"_e_{name}"))
            carry.append(F.last(f"_e_{name}", ignorenulls=True).over(before).alias(f"_c_{name}"))
            local[f"_l_{name}"] = F.last(v, ignorenulls=True).over(inside)
            full[name] = F.coalesce(f"_l_{name}", f"_c_{name}")
    carried = out.groupBy(key, "_pb").agg(*ends).select(key, "_pb", *carry)
    out = out.withColumns(local).join(carried, [key, "_pb"], "left").withColumns(full)
    return out.drop("_pb", *local, *[f"_c_{n}" for n in cols])
