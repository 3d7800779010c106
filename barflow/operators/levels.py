"""Support/resistance levels from the newest ``lookback`` bars of every ticker.

The frame is bounded (252 bars), so per-ticker arrays of it are bounded too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..functions.scalars import flag

LOOKBACK = 252
TOLERANCE = 0.005
QUALITY_SCORE = {"A": 1.0, "B": 0.6, "C": 0.2, "D": -0.2}


def recent(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    w = fw.series("ticker", F.desc("ts"))
    return bars.withColumn("_age", F.row_number().over(w)).where(F.col("_age") <= lookback).drop("_age")


def snapshot(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """One row per ticker: last close and volume, frame range, mean true range over 14 bars."""
    w = fw.series()
    frame = recent(bars, lookback)
    prev = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    df = frame.withColumn("_tr", tr)
    df = df.withColumns({"_atr": fw.roll(F.avg, "_tr", w, 14), "_v10": fw.roll(F.avg, "volume", w, 10), "_n": F.row_number().over(w)})
    last = F.max_by(F.struct("ts", "close", "volume", "_atr", "_v10"), "ts").alias("z")
    agg = df.groupBy("ticker").agg(last, F.min("low").alias("frame_low"), F.max("high").alias("frame_high"), F.count(F.lit(1)).alias("n_bars"))
    return agg.select(
        "ticker", F.col("z.ts").alias("ts"), F.col("z.close").alias("current"), F.col("z.volume").alias("volume"), F.col("z._v10").alias("avg_vol10"),
        F.when(F.col("n_bars") >= 15, F.coalesce(F.col("z._atr") / F.col("z.close"), F.lit(0.0))).otherwise(0.0).alias("atr_pct"),
        "frame_low", "frame_high", "n_bars",
    )


def swing(bars: DataFrame, order: int = 8, lookback: int = LOOKBACK) -> DataFrame:
    """Pivot highs/lows of the frame; strength = bars whose extreme came within 0.5 %, at most 5."""
    w = fw.series()
    df = recent(bars, lookback).withColumns(
        {"_hi": fw.pivot("high", w, order, True, False), "_lo": fw.pivot("low", w, order, False, False)}
    )
    arrays = df.groupBy("ticker").agg(
        F.collect_list("high").alias("highs"), F.collect_list("low").alias("lows"), F.collect_list("_hi").alias("hp"), F.collect_list("_lo").alias("lp")
    )
    touches = lambda arr, p: F.greatest(F.lit(1), F.size(F.filter(arr, lambda x: F.abs(x - p) / p < TOLERANCE)))

    def side(points: str, arr: str, kind: str, method: str) -> DataFrame:
        x = arrays.select("ticker", arr, F.explode(points).alias("price"))
        return x.select("ticker", "price", F.lit(kind).alias("type"), F.lit(method).alias("method"), F.least(touches(arr, F.col("price")), F.lit(5)).alias("strength"))

    return side("hp", "highs", "RESISTANCE", "swing_high").unionByName(side("lp", "lows", "SUPPORT", "swing_low"))


def round_numbers(snap: DataFrame, intervals: tuple[int, ...] = (50, 100), reach: int = 8, span: float = 0.15) -> DataFrame:
    """Multiples of each interval within ±15 % of the last close and ±8 steps."""
    parts = []
    for step in intervals:
        base = F.bround(F.col("current") / step) * step
        x = snap.select("ticker", "current", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("k"))
        x = x.withColumn("price", (base + F.col("k") * step).cast("double"))
        x = x.where((F.col("price") > 0) & (F.abs(F.col("price") - F.col("current")) / F.col("current") <= span))
        parts.append(
            x.select("ticker", "price", F.when(F.col("price") > F.col("current"), "RESISTANCE").otherwise("SUPPORT").alias("type"),
                     F.lit("round_number").alias("method"), F.lit(3 if step == 100 else 2).alias("strength"))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def volume_nodes(bars: DataFrame, bins: int = 25, lookback: int = LOOKBACK) -> DataFrame:
    """Price buckets holding at least the 80th percentile of occupied buckets' volume."""
    frame = recent(bars, lookback)
    span = snapshot(bars, lookback).where((F.col("frame_high") > F.col("frame_low")) & (F.col("n_bars") >= 20))
    x = frame.join(span.select("ticker", "current", "frame_low", ((F.col("frame_high") - F.col("frame_low")) / bins).alias("size")), "ticker")
    bucket = F.least(F.greatest(F.floor((F.col("close") - F.col("frame_low")) / (F.col("size") + 1e-8)), F.lit(0)), F.lit(bins - 1)).cast("int")
    hist = x.groupBy("ticker", "current", "frame_low", "size", bucket.alias("bucket")).agg(F.sum("volume").alias("vol"))
    cut = F.percentile("vol", F.lit(0.8)).over(fw.W.partitionBy("ticker"))
    keep = hist.withColumn("_cut", cut).where(F.col("vol") >= F.col("_cut"))
    price = F.round(F.col("frame_low") + (F.col("bucket") + 0.5) * F.col("size"), 2)
    return keep.select("ticker", price.alias("price"), F.when(price > F.col("current"), "RESISTANCE").otherwise("SUPPORT").alias("type"),
                       F.lit("volume_node").alias("method"), F.lit(4).alias("strength"))


def oi_levels(max_oi: DataFrame) -> DataFrame:
    """(ticker, max_call_oi_strike, max_put_oi_strike) to levels of strength 4."""
    x = max_oi.select("ticker", F.explode(F.array(
        F.struct(F.col("max_call_oi_strike").cast("double").alias("price"), F.lit("RESISTANCE").alias("type")),
        F.struct(F.col("max_put_oi_strike").cast("double").alias("price"), F.lit("SUPPORT").alias("type")),
    )).alias("z"))
    return x.where(F.col("z.price") > 0).select("ticker", "z.price", "z.type", F.lit("options_oi").alias("method"), F.lit(4).alias("strength"))


def cluster(levels: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Chain-merge levels whose gap to the previous one is within ``tolerance``."""
    w = fw.series("ticker", ["price", "type", "method"])
    prev = F.lag("price").over(w)
    new = F.when(F.abs(F.col("price") - prev) / F.greatest(prev, F.lit(1.0)) <= tolerance, 0).otherwise(1)
    df = levels.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(fw.running(w)))
    return df.groupBy("ticker", "cluster").agg(
        F.avg("price").alias("price"),
        F.least(F.sum("strength"), F.lit(8)).cast("int").alias("strength"),
        F.when(F.count_if(F.col("type") == "RESISTANCE") >= F.count_if(F.col("type") == "SUPPORT"), "RESISTANCE").otherwise("SUPPORT").alias("type"),
        F.array_join(F.array_sort(F.collect_set("method")), "+").alias("method"),
        F.count(F.lit(1)).alias("touches"),
    )


def all_levels(bars: DataFrame, max_oi: DataFrame | None = None) -> DataFrame:
    out = swing(bars).unionByName(round_numbers(snapshot(bars))).unionByName(volume_nodes(bars))
    if max_oi is not None:
        out = out.unionByName(oi_levels(max_oi))
    return cluster(out)


def nearest(snap: DataFrame, levels: DataFrame) -> DataFrame:
    """Nearest and second levels each side, distances, runway grades for both directions, breakout flag."""
    cur, price = F.col("current"), F.col("price")
    x = snap.join(levels.select("ticker", "price", "strength"), "ticker", "left")
    below, above = price < cur, price > cur
    wall = F.col("strength") >= 6
    agg = x.groupBy(*snap.columns).agg(
        F.sort_array(F.collect_list(F.when(below, F.struct("price", "strength"))), asc=False).alias("sup"),
        F.sort_array(F.collect_list(F.when(above, F.struct("price", "strength")))).alias("res"),
        F.min(F.when(above & wall, (price - cur) / cur)).alias("wall_up"),
        F.min(F.when(below & wall, (cur - price) / cur)).alias("wall_down"),
    )
    at = lambda arr, i, field: F.try_element_at(arr, F.lit(i + 1))[field]
    sup_dist = F.coalesce(F.abs(cur - at("sup", 0, "price")) / F.greatest(at("sup", 0, "price"), F.lit(1.0)), F.lit(0.05))
    res_dist = F.coalesce(F.abs(at("res", 0, "price") - cur) / F.greatest(cur, F.lit(1.0)), F.lit(0.05))
    agg = agg.withColumns({"_sd": sup_dist, "_rd": res_dist})

    def grade(wall_col: str):
        reward = F.least(5.0 * F.col("atr_pct"), F.coalesce(F.col(wall_col), F.lit(99.0)))
        rr = reward / F.greatest(2.0 * F.col("atr_pct"), F.lit(1e-9))
        return F.when(F.col("atr_pct") <= 0, "C").when(rr >= 2.0, "A").when(rr >= 1.5, "B").when(rr >= 1.0, "C").otherwise("D")

    out = agg.select(
        *snap.columns,
        F.coalesce(at("sup", 0, "price"), cur * 0.95).alias("nearest_support"),
        F.coalesce(at("res", 0, "price"), cur * 1.05).alias("nearest_resistance"),
        F.coalesce(at("sup", 1, "price"), cur * 0.90).alias("second_support"),
        F.coalesce(at("res", 1, "price"), cur * 1.10).alias("second_resistance"),
        F.coalesce(at("sup", 0, "strength"), F.lit(1)).alias("support_strength"),
        F.coalesce(at("res", 0, "strength"), F.lit(1)).alias("resistance_strength"),
        (F.col("_sd") * 100).alias("support_distance_pct"),
        (F.col("_rd") * 100).alias("resistance_distance_pct"),
        flag(F.col("_sd") < 0.012).alias("near_support"),
        flag(F.col("_rd") < 0.012).alias("near_resistance"),
        grade("wall_up").alias("entry_quality"),
        grade("wall_down").alias("entry_quality_short"),
        F.lit(2.5).alias("reward_risk_sr"),
        flag((F.col("_rd") < 0.005) & (F.col("volume") > F.col("avg_vol10") * 1.5)).alias("near_breakout"),
    )
    score = None
    for g, v in QUALITY_SCORE.items():
        score = F.when(F.col("entry_quality") == g, v) if score is None else score.when(F.col("entry_quality") == g, v)
    return out.withColumn("entry_quality_score", score)
