"""Time-aware joins: as-of, forward, fill, window slots, barriers.

Every ordered pass runs inside (key, time bucket); only one row per bucket crosses buckets, so a
key that holds a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows as fw


def asof(
    left: DataFrame,
    right: DataFrame,
    take: Sequence[str],
    key: str | None = "ticker",
    left_ts: str = "ts",
    right_ts: str = "ts",
    unit: str = "month",
    inclusive: bool = True,
    forward: bool = False,
) -> DataFrame:
    """Adds ``take`` from the newest right row at or before (``forward``: oldest at or after) each left row.

    Union, one ordered pass per (key, bucket), and a carry of each bucket's last right row into the
    later buckets.  ``key=None`` matches on time alone.  Right timestamps must be unique per key.
    """
    k = F.lit(0) if key is None else F.col(key)
    stamp = lambda c: F.col(c).cast("timestamp_ntz")
    tie = (1 if inclusive else -1) if not forward else (-1 if inclusive else 1)
    lrows = left.select(k.alias("_k"), stamp(left_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    rrows = right.select(k.alias("_k"), stamp(right_ts).alias("_t"), F.lit(-tie).alias("_side"), F.struct(*[F.col(c) for c in take]).alias("_right"))
    both = lrows.unionByName(rrows, allowMissingColumns=True).withColumn("_bucket", F.date_trunc(unit, "_t"))
    order = [F.desc("_t"), F.desc("_side")] if forward else [F.col("_t"), F.col("_side")]
    local = F.last("_right", ignorenulls=True).over(fw.running(W.partitionBy("_k", "_bucket").orderBy(*order)))
    both = both.withColumn("_local", local).where(F.col("_left").isNotNull())
    pick = F.min_by if forward else F.max_by
    ends = rrows.groupBy("_k", F.date_trunc(unit, "_t").alias("_bucket")).agg(pick("_right", "_t").alias("_end"))
    slots = lrows.select("_k", F.date_trunc(unit, "_t").alias("_bucket")).distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    line = ends.withColumn("_l", F.lit(0)).unionByName(slots.withColumn("_l", F.lit(1))).groupBy("_k", "_bucket").agg(F.first("_end", ignorenulls=True).alias("_end"), F.max("_l").alias("_l"))
    by_bucket = W.partitionBy("_k").orderBy(F.desc("_bucket") if forward else F.col("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    carry = line.select("_k", "_bucket", "_l", F.last("_end", ignorenulls=True).over(by_bucket).alias("_carry")).where(F.col("_l") == 1).drop("_l")
    out = both.join(carry, ["_k", "_bucket"], "left")
    hit = F.coalesce("_local", "_carry")
    return out.select("_left.*", *[hit[c].alias(c) for c in take])


def asof_day(
    left: DataFrame,
    right: DataFrame,
    take: Sequence[str],
    key: str | None = "ticker",
    left_ts: str = "ts",
    right_ts: str = "ts",
    forward: bool = False,
) -> DataFrame:
    """As-of (``forward``: next-on-or-after) at day grain, as one equi-join.

    The right side is a slow dimension (quarterly, monthly or daily rows): each row is expanded to
    the days it is valid for, so the left side, however large, is neither sorted nor unioned, and
    Catalyst may broadcast the dimension when it is small.  Left days outside the right side's
    span are moved to its edge first.  Of several right rows on one day the last by ``right_ts``
    counts (``forward``: the first), then the last (first) by the taken columns.
    """
    keys = [] if key is None else [key]
    day = F.col(right_ts).cast("date")
    w = W.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("_day", "_time", *take)
    r = right.select(*keys, day.alias("_day"), F.col(right_ts).cast("timestamp_ntz").alias("_time"), *take)
    r = r.withColumn("_near", (F.lag if forward else F.lead)("_day").over(w)).where(F.col("_near").isNull() | (F.col("_near") != F.col("_day")))
    if forward:
        edge = r.select(F.min("_day")).scalar()
        valid = F.sequence(F.coalesce(F.date_add("_near", 1), edge), F.col("_day"))
        at = F.greatest(F.col(left_ts).cast("date"), edge)
    else:
        edge = r.select(F.max("_day")).scalar()
        valid = F.sequence(F.col("_day"), F.coalesce(F.date_sub("_near", 1), edge))
        at = F.least(F.col(left_ts).cast("date"), edge)
    days = r.withColumn("_valid", valid).select(*keys, F.explode("_valid").alias("_at"), *take)
    return left.withColumn("_at", at).join(days, [*keys, "_at"], "left").select(*left.columns, *take)


def ffill_reindex(series: DataFrame, calendar: DataFrame, value: Sequence[str], key: str = "ticker", ts: str = "ts") -> DataFrame:
    """Every key on every calendar date, values carried forward, nothing before a key's first value."""
    month = lambda c: F.trunc(c, "month")
    end = calendar.select(F.max(month(ts))).scalar()
    span = series.groupBy(key).agg(F.min(ts).alias("_from"))
    months = span.select(key, "_from", F.explode(F.sequence(month("_from"), end, F.expr("interval 1 month"))).alias("_m"))
    dates = calendar.select(F.col(ts), month(ts).alias("_m")).distinct()
    grid = months.join(dates, "_m").where(F.col(ts) >= F.col("_from")).select(key, ts)
    w = fw.running(fw.series(key, ts))
    return grid.join(series.select(key, ts, *value), [key, ts], "left").select(key, ts, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in value])


def slot_windows(items: DataFrame, measures: dict[str, Column], horizons: Sequence[int], key: str = "ticker", ts: str = "created_at") -> DataFrame:
    """Trailing sums at every full hour ``t``: items in (t-h, t] for each horizon ``h`` hours.

    Items are first summed per (key, hour); each hour then adds to the hours it is visible from.
    Two hash aggregates with map-side combine, no range join and no ordered pass.
    """
    hour = F.date_trunc("hour", F.col(ts))
    up = F.when(hour == F.col(ts), hour).otherwise(hour + F.expr("interval 1 hour"))
    hourly = items.groupBy(key, up.alias("_h")).agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    k = F.posexplode(F.sequence(F.col("_h"), F.col("_h") + F.expr(f"interval {max(horizons) - 1} hours"), F.expr("interval 1 hour")))
    spread = hourly.select(key, *measures, k.alias("_age", "slot"))
    sums = [F.coalesce(F.sum(F.when(F.col("_age") < h, F.col(n))), F.lit(0)).alias(f"{n}_{h}h") for h in horizons for n in measures]
    return spread.groupBy(key, "slot").agg(*sums)


def lineage(snapshots: DataFrame, opened: DataFrame, closed: DataFrame, outcomes: DataFrame, uuid: str = "signal_uuid") -> DataFrame:
    """Snapshot to open, closed and outcome rows; the newest closed row per signal."""
    last_close = closed.groupBy(uuid).agg(F.max_by(F.struct(*[c for c in closed.columns if c != uuid]), "close_date").alias("_c"))
    rest = [c for c in closed.columns if c != uuid]
    flat = last_close.select(uuid, *[F.col(f"_c.{c}").alias(c) for c in rest])
    return snapshots.join(opened, uuid, "left").join(flat, uuid, "left").join(outcomes, uuid, "left")


def barrier(entries: DataFrame, bars: DataFrame, max_hold: str = "max_hold", bucket: int = 30) -> DataFrame:
    """Entries (ticker, i, max_hold) with the bars ``i < b <= i + max_hold`` they can see.

    Both sides carry a bucket of ``bucket`` bars; an entry is in every bucket that its hold spans,
    however long, so the match is an equi-join on (ticker, bucket).
    """
    held = F.when(F.col(max_hold) > 0, F.sequence(F.floor((F.col("i") + 1) / bucket), F.floor((F.col("i") + F.col(max_hold)) / bucket)))
    e = entries.withColumn("_bk", F.explode(held))
    b = bars.select(F.col("ticker"), F.col("i").alias("bar_i"), F.col("ts").alias("bar_ts"), F.col("open").alias("bar_open"), F.col("high").alias("bar_high"),
                    F.col("low").alias("bar_low"), F.col("close").alias("bar_close"), F.floor(F.col("i") / bucket).alias("_bk"))
    hit = (F.col("bar_i") > F.col("i")) & (F.col("bar_i") <= F.col("i") + F.col(max_hold))
    return e.join(b, ["ticker", "_bk"]).where(hit).drop("_bk")


def upsert_fill_only(existing: DataFrame, incoming: DataFrame, key: str, value: str, tiny: float = 0.01) -> DataFrame:
    """Fill NULL or near-zero values, insert missing keys, leave the rest; with a status per row."""
    e = existing.select(key, F.col(value).alias("_old"), F.lit(True).alias("_has"))
    n = incoming.select(key, F.col(value).alias("_new"))
    x = e.join(n, key, "full_outer")
    empty = F.col("_old").isNull() | (F.abs("_old") <= tiny)
    status = F.when(F.col("_has").isNull(), "inserted").when(F.col("_new").isNotNull() & empty, "updated").otherwise("skipped")
    return x.select(key, F.when(status == "skipped", F.col("_old")).otherwise(F.col("_new")).alias(value), status.alias("status"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Insert-ignore: the first row per key.  A min aggregate, so copies collapse before the shuffle."""
    return _extreme(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _extreme(df, keys, order, F.max_by)


def _extreme(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)])
    top = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return top.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def trailing_sums(items: DataFrame, moments: DataFrame, measures: dict[str, Column], horizons: Sequence[int], key: str = "ticker", ts: str = "created_at", at: str = "ts") -> DataFrame:
    """Sums over the items in (t - h, t] for every moment ``t``, of any fraction of an hour, and every horizon ``h`` in hours.

    Adds ``{measure}_{h}h`` to ``moments`` (one row per ``key`` and ``at``; 0 where nothing lies in the window). A sum is the
    difference of two running totals, so a moment asks for one total per horizon and one for itself, whatever the windows
    hold. Totals have two levels: hours are summed by a hash aggregate and carried by day, then along the few days of a key;
    only inside one hour are items and questions put in order. So the largest ordered piece is one hour of one key.
    """
    stamp = F.col(at).cast("timestamp_ntz")
    ages = F.explode(F.array(*[F.lit(h) for h in (0, *horizons)])).alias("_age")
    asked = moments.select(key, stamp.alias("_t"), ages).distinct().withColumn("_x", F.col("_t") - F.make_dt_interval(hours=F.col("_age")))
    hour = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz")
    rows = items.select(key, F.col(ts).cast("timestamp_ntz").alias("_x"), F.lit(0).alias("_side"), *[m.alias(n) for n, m in measures.items()])
    both = rows.unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True).withColumn("_h", hour("_x"))
    inside = fw.running(W.partitionBy(key, "_h").orderBy("_x", "_side"))
    local = both.withColumns({f"_l_{n}": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in measures}).where(F.col("_side") == 1)
    hours = both.groupBy(key, "_h").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in measures]).withColumn("_d", F.col("_h").cast("date"))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    day = earlier(W.partitionBy(key, "_d").orderBy("_h"))
    days = hours.groupBy(key, "_d").agg(*[F.sum(n).alias(n) for n in measures])
    carried = days.select(key, "_d", *[F.coalesce(F.sum(n).over(earlier(W.partitionBy(key).orderBy("_d"))), F.lit(0)).alias(f"_c_{n}") for n in measures])
    before = hours.select(key, "_d", "_h", *[F.coalesce(F.sum(n).over(day), F.lit(0)).alias(f"_b_{n}") for n in measures])
    before = before.join(carried, [key, "_d"]).select(key, "_h", *[(F.col(f"_b_{n}") + F.col(f"_c_{n}")).alias(f"_b_{n}") for n in measures])
    totals = local.join(before, [key, "_h"]).select(key, "_t", "_age", *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in measures])
    upto = lambda n, h: F.max(F.when(F.col("_age") == h, F.col(n)))
    sums = totals.groupBy(key, F.col("_t")).agg(*[(upto(n, 0) - upto(n, h)).alias(f"{n}_{h}h") for h in horizons for n in measures])
    keyed = moments.withColumn("_t", stamp)
    return keyed.join(sums, [key, "_t"]).select(*moments.columns, *[f"{n}_{h}h" for h in horizons for n in measures])


def latest_within(left: DataFrame, right: DataFrame, take: Sequence[str], days: int, key: str = "ticker", left_ts: str = "ts", right_ts: str = "ts", unit: str = "month") -> DataFrame:
    """As-of values no older than ``days``; older ones are NULL."""
    x = asof(left, right.withColumn("_seen", F.col(right_ts).cast("timestamp_ntz")), [*take, "_seen"], key, left_ts, right_ts, unit)
    fresh = F.col("_seen") > F.col(left_ts).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    return x.select(*left.columns, *[F.when(fresh, F.col(c)).alias(c) for c in take])
