"""Order-flow inference from bars: signed volume, absorption, large-bar bias, composite score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..functions.scalars import clamp, flag

LOOKBACK = 252


def delta(df: DataFrame) -> DataFrame:
    """Volume split by where the close sits in the bar, its running sum, and the 4-bar trend."""
    w = fw.series()
    pos = F.coalesce(F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))
    df = df.withColumns({"buy_vol": pos * F.col("volume"), "sell_vol": (1 - pos) * F.col("volume"), "avg_vol20": fw.roll(F.avg, "volume", w, 20)})
    df = df.withColumn("delta", F.col("buy_vol") - F.col("sell_vol"))
    # Rounded, so that addition noise is never read as a rise or fall.
    df = df.withColumn("cum_delta", F.round(F.sum("delta").over(fw.running(w)), 6))
    base = F.sum("avg_vol20").over(fw.running(w))
    older = F.lag("cum_delta", 4).over(w)
    return df.withColumns(
        {
            "cum_delta_norm": F.when(F.col("avg_vol20").isNotNull(), F.col("cum_delta") / (base + 1)),
            "delta_trend": F.when(older.isNull(), "FLAT").when(F.col("cum_delta") > older, "RISING").otherwise("FALLING"),
        }
    )


def divergence(df: DataFrame) -> DataFrame:
    w = fw.series()
    price_up, delta_up = F.col("close") > F.lag("close", 2).over(w), F.col("cum_delta") > F.lag("cum_delta", 2).over(w)
    kind = (
        F.when(F.row_number().over(w) < 5, "NONE")
        .when(price_up & ~delta_up, "BEARISH_DIVERGENCE")
        .when(~price_up & delta_up, "BULLISH_DIVERGENCE")
        .otherwise("CONFIRMED")
    )
    return df.withColumn("delta_divergence", kind)


def vwap_signal(df: DataFrame, session=None) -> DataFrame:
    """Three-way position against the session VWAP with a 0.3 % dead band."""
    w = fw.running(fw.series(["ticker", "_session"], "ts"))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumn("_session", F.trunc("ts", "month") if session is None else session)
    df = df.withColumn("_vwap", F.sum(typical * F.col("volume")).over(w) / (F.sum("volume").over(w) + 1e-8))
    df = df.withColumn("vwap_distance", (F.col("close") - F.col("_vwap")) / (F.col("_vwap") + 1e-8))
    label = F.when(F.col("vwap_distance") > 0.003, "ABOVE_VWAP").when(F.col("vwap_distance") < -0.003, "BELOW_VWAP").otherwise("AT_VWAP")
    return df.withColumn("vwap_signal", label).drop("_session", "_vwap")


def absorption(df: DataFrame, atr: str | None = None) -> DataFrame:
    """Heavy volume in a small bar.  ``atr`` names a column; otherwise the 14-bar mean range."""
    w = fw.series()
    span = F.col("high") - F.col("low")
    typical = F.col(atr) if atr else fw.roll(F.avg, span, w, 14)
    ratio = F.col("volume") / F.greatest(fw.roll(F.avg, "volume", w, 20), F.lit(1.0))
    df = df.withColumns({"vol_ratio20": ratio, "_typical": typical})
    hit = F.coalesce((F.col("vol_ratio20") > 2.5) & (span < F.col("_typical") * 0.3), F.lit(False))
    strength = F.when(hit & (F.col("vol_ratio20") > 5), "STRONG").when(hit, "MODERATE").otherwise("NONE")
    return df.withColumns({"absorption_detected": hit.cast("int"), "absorption_strength": strength}).drop("_typical")


def institutional_bias(df: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Direction of the bars with more than twice average volume over the trailing frame."""
    w = fw.series()
    frame = fw.trailing(w, lookback)
    df = df.withColumn("_large", F.coalesce(F.col("volume") > fw.roll(F.avg, "volume", w, 20) * 2, F.lit(False)))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).over(frame)
    df = df.withColumns(
        {
            "bull_large": count(F.col("_large") & (F.col("close") > F.col("open"))),
            "bear_large": count(F.col("_large") & (F.col("close") < F.col("open"))),
            "large_candle_ratio": F.round(count(F.col("_large")) / F.count(F.lit(1)).over(frame), 4),
        }
    )
    bull, bear = F.col("bull_large"), F.col("bear_large")
    side = F.when(bull > bear * 1.5, "INSTITUTIONAL_BUYING").when(bear > bull * 1.5, "INSTITUTIONAL_SELLING").otherwise("NEUTRAL")
    strong = F.when(F.col("inst_bias") == "NEUTRAL", "LOW").when(F.greatest(bull, bear) > F.least(bull, bear) * 2, "HIGH").otherwise("MEDIUM")
    return df.withColumn("inst_bias", side).withColumn("inst_conviction", strong).drop("_large")


def score(df: DataFrame) -> DataFrame:
    pick = lambda c, plus, minus, v: F.when(F.col(c) == plus, v).when(F.col(c) == minus, -v).otherwise(0.0)
    conviction = F.when(F.col("inst_conviction") == "HIGH", 0.20).otherwise(0.10)
    raw = (
        pick("delta_trend", "RISING", "FALLING", 0.25)
        + pick("vwap_signal", "ABOVE_VWAP", "BELOW_VWAP", 0.20)
        + pick("delta_divergence", "BULLISH_DIVERGENCE", "BEARISH_DIVERGENCE", 0.25)
        + F.when(F.col("inst_bias") == "INSTITUTIONAL_BUYING", conviction).when(F.col("inst_bias") == "INSTITUTIONAL_SELLING", -conviction).otherwise(0.0)
    )
    damped = raw * F.when(F.col("absorption_detected") == 1, 0.5).otherwise(1.0)
    df = df.withColumn("order_flow_score", F.round(clamp(damped, -1.0, 1.0), 3))
    s = F.col("order_flow_score")
    label = (
        F.when(s > 0.4, "STRONG_BUYING_PRESSURE").when(s > 0.15, "MILD_BUYING_PRESSURE")
        .when(s < -0.4, "STRONG_SELLING_PRESSURE").when(s < -0.15, "MILD_SELLING_PRESSURE").otherwise("BALANCED_FLOW")
    )
    return df.withColumns({"order_flow_signal": label, "delta_divergence_flag": flag(F.col("delta_divergence").endswith("DIVERGENCE"))})


def order_flow(bars: DataFrame) -> DataFrame:
    return score(institutional_bias(absorption(vwap_signal(divergence(delta(bars))))))


def bar_deltas(bars: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` bars per ticker with their buy/sell split, oldest first by ``age``."""
    w = fw.series("ticker", F.desc("ts"))
    df = delta(bars).withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)
    return df.select("ticker", "ts", "age", "buy_vol", "sell_vol", (F.col("close") >= F.col("open")).alias("bull"))
