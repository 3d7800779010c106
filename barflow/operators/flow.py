"""Institutional and ownership flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..functions.scalars import clamp, clip, ladder

MARKET = "market"


def rolling(flows: DataFrame) -> DataFrame:
    """Trailing sums per trade date (short frames allowed at the start), trend, confluence, surprise.

    One row per calendar day in one market, so the ordered pass is bounded by the calendar.
    """
    w = fw.series(MARKET, "trade_date")
    df = flows.withColumns({MARKET: F.lit("all"), "dii_net_cr": F.coalesce("dii_net_cr", F.lit(0.0))})
    cols = {f"fii_net_{n}d_cr": F.sum("fii_net_cr").over(fw.trailing(w, n)) for n in (1, 3, 5, 10)}
    cols |= {f"dii_net_{n}d_cr": F.sum("dii_net_cr").over(fw.trailing(w, n)) for n in (1, 3)}
    base = w.rowsBetween(-19, -1)
    n = F.count("fii_net_cr").over(base)
    sd = F.stddev_pop("fii_net_cr").over(base)
    z = F.when((n >= 5) & (sd > 0), clamp((F.col("fii_net_cr") - F.avg("fii_net_cr").over(base)) / sd, -3, 3)).otherwise(0.0)
    cols |= {"fii_trend": _trend("fii_net_cr", w), "dii_trend": _trend("dii_net_cr", w), "fii_flow_surprise": z}
    df = df.withColumns({k: F.round(c, 6) if k.endswith(("_cr", "surprise")) else c for k, c in cols.items()})
    f5, d3 = F.col("fii_net_5d_cr"), F.col("dii_net_3d_cr")
    return df.withColumns(
        {
            "flow_confluence": F.when((f5 > 500) & (d3 > 0), "BOTH_BUYING").when((f5 < -500) & (d3 < 0), "BOTH_SELLING").otherwise("MIXED"),
            "fii_signal": norm(f5),
            "dii_signal": norm(d3),
            "fii_signal_text": F.when(f5 > 2000, "STRONG BUY").when(f5 > 500, "BUYING").when(f5 < -2000, "STRONG SELL").when(f5 < -500, "SELLING").otherwise("NEUTRAL"),
        }
    ).drop(MARKET)


def _trend(c: str, w):
    last3 = fw.trailing(w, 3)
    pos, n = F.sum((F.col(c) > 0).cast("int")).over(last3), F.count(c).over(last3)
    return F.when(n < 3, "NEUTRAL").when(pos == 3, "BUYING").when(pos == 0, "SELLING").otherwise("MIXED")


def norm(c, full: float = 5000.0):
    return clamp(c / full, -1.0, 1.0)


def bulk_summary(deals: DataFrame) -> DataFrame:
    """Buy and sell value per date, net, direction."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("trade_type") == s, F.col("value_cents"))), F.lit(0)) / 1e6
    x = deals.groupBy("trade_date").agg(side("BUY").alias("buy_cr"), side("SELL").alias("sell_cr"), F.count(F.lit(1)).alias("n_deals"))
    return x.withColumns({"bulk_net_cr": F.round(F.col("buy_cr") - F.col("sell_cr"), 6), "bulk_is_buying": F.col("buy_cr") > F.col("sell_cr"), "bulk_deal_detected": F.col("n_deals") > 0})


def block_features(deals: DataFrame, days: int = 5) -> DataFrame:
    """Net deal value per name: the day's and the trailing ``days`` calendar days'."""
    signed = F.when(F.col("buy_sell") == "BUY", F.col("value_cents")).otherwise(-F.col("value_cents"))
    daily = deals.groupBy("ticker", "trade_date").agg(F.sum(signed).alias("_net"), F.count(F.lit(1)).alias("n_deals"))
    span = fw.series("ticker", F.unix_date("trade_date")).rangeBetween(-days, 0)
    return daily.select("ticker", "trade_date", "n_deals", (F.col("_net") / 1e6).alias("block_net_cr"), (F.sum("_net").over(span) / 1e6).alias("block_5d_net_cr"), (F.col("_net") > 0).alias("block_is_buying"))


def promoter_trend(holding: DataFrame) -> DataFrame:
    w = fw.series("ticker", "quarter")
    p, p1, p2 = F.col("promoter_pct"), F.lag("promoter_pct").over(w), F.lag("promoter_pct", 2).over(w)
    label = F.when((p > p1) & (p1 > p2), "INCREASING").when((p < p1) & (p1 < p2), "DECREASING").otherwise("STABLE")
    return holding.withColumns({"promoter_qoq": F.round(F.coalesce(p - p1, F.lit(0.0)), 4), "promoter_trend": label})


def holding_breakdown(holding: DataFrame) -> DataFrame:
    w = fw.series("ticker", "quarter")
    return holding.withColumns(
        {"dii_qoq": F.round(F.coalesce(F.col("dii_pct") - F.lag("dii_pct").over(w), F.lit(0.0)), 4), "total_institutional": F.round(F.col("fii_pct") + F.col("dii_pct"), 4)}
    )


def insider_score(df: DataFrame, block_5d: str = "block_5d_net_cr") -> DataFrame:
    """Conviction from promoter trend, its quarterly change, pledges and recent block deals."""
    score = (
        F.when(F.col("promoter_trend") == "INCREASING", 0.4).when(F.col("promoter_trend") == "DECREASING", -0.4).otherwise(0.0)
        + clamp(F.col("promoter_qoq") * 10, -0.3, 0.3)
        + F.when(F.col("pledge_pct") > 20, -0.3).when(F.col("pledge_pct") > 10, -0.1).otherwise(0.0)
        + F.when(F.coalesce(F.col(block_5d), F.lit(0.0)) > 200, 0.2).when(F.coalesce(F.col(block_5d), F.lit(0.0)) < -200, -0.2).otherwise(0.0)
    )
    df = df.withColumn("insider_score", F.round(clamp(score, -1, 1), 3))
    s = F.col("insider_score")
    label = F.when(s > 0.4, "STRONG_BULL").when(s > 0.1, "MILD_BULL").when(s < -0.4, "STRONG_BEAR").when(s < -0.1, "MILD_BEAR").otherwise("NEUTRAL")
    return df.withColumn("insider_signal", label)


def features(df: DataFrame) -> DataFrame:
    """14 model columns from flow, ownership and order-flow inputs on one row."""
    c10 = lambda c: clip(c, digits=10)
    either = lambda c, plus, minus: F.when(F.col(c) == plus, 1.0).when(F.col(c) == minus, -1.0).otherwise(0.0)
    out = {
        "fii_5d_norm": c10(F.col("fii_net_5d_cr") / 5000),
        "fii_signal": F.round("fii_signal", 10),
        "fii_flow_surprise": c10(F.col("fii_flow_surprise") / 3.0),
        "dii_3d_norm": c10(F.col("dii_net_3d_cr") / 2000),
        "bulk_deal_norm": c10(F.col("bulk_net_cr") / 200),
        "flow_confluence_score": either("flow_confluence", "BOTH_BUYING", "BOTH_SELLING"),
        "insider_score": clip("insider_score"),
        "promoter_change": clip(F.col("promoter_qoq") * 20),
        "block_5d_norm": c10(F.col("block_5d_net_cr") / 500),
        "block_is_buying": F.coalesce(F.col("block_is_buying").cast("double"), F.lit(0.0)),
        "order_flow_score": clip("order_flow_score"),
        "delta_divergence": F.coalesce(F.col("delta_divergence_flag").cast("double"), F.lit(0.0)),
        "absorption_flag": F.coalesce(F.col("absorption_detected").cast("double"), F.lit(0.0)),
        "institutional_bias": either("inst_bias", "INSTITUTIONAL_BUYING", "INSTITUTIONAL_SELLING"),
    }
    return df.select("ticker", "ts", *[c.alias(n) for n, c in out.items()])


FEATURES = (
    "fii_5d_norm", "fii_signal", "fii_flow_surprise", "dii_3d_norm", "bulk_deal_norm", "flow_confluence_score", "insider_score", "promoter_change",
    "block_5d_norm", "block_is_buying", "order_flow_score", "delta_divergence", "absorption_flag", "institutional_bias",
)
