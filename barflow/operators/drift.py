"""Drift: training distributions, population stability, rolling Brier score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as fw
from .ml import melt

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def distribution(df: DataFrame, names: list[str], min_rows: int = 10) -> DataFrame:
    x = melt(df, names, [])
    agg = x.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.percentile("value", F.array(*[F.lit(q) for q in QUANTILES])).alias("q"),
    )
    return agg.where(F.col("n") >= min_rows).select("feature", "n", "mean", "std", "min", "max", *[F.col("q")[i].alias(f"p{int(q * 100)}") for i, q in enumerate(QUANTILES)])


def psi(train: DataFrame, live: DataFrame, names: list[str], bins: int = 10) -> DataFrame:
    """Sum of (a - e) ln(a / e) over the training deciles, half-count smoothed; OK / WARN / ALERT."""
    t, l = melt(train, names, []), melt(live, names, [])
    edges = t.groupBy("feature").agg(F.array_distinct(F.percentile("value", F.array(*[F.lit(k / bins) for k in range(1, bins)]))).alias("edges"))
    both = t.withColumn("_live", F.lit(0)).unionByName(l.withColumn("_live", F.lit(1))).join(edges, "feature")
    both = both.withColumn("bin", F.size(F.filter("edges", lambda e: F.col("value") > e)))
    h = both.groupBy("feature", "bin").agg(F.count_if(F.col("_live") == 0).alias("e"), F.count_if(F.col("_live") == 1).alias("a"))
    part = fw.W.partitionBy("feature")
    k = F.count(F.lit(1)).over(part)
    h = h.withColumns({"pe": (F.col("e") + 0.5) / (F.sum("e").over(part) + 0.5 * k), "pa": (F.col("a") + 0.5) / (F.sum("a").over(part) + 0.5 * k)})
    out = h.groupBy("feature").agg(F.round(F.sum((F.col("pa") - F.col("pe")) * F.log(F.col("pa") / F.col("pe"))), 6).alias("psi"))
    return out.withColumn("status", F.when(F.col("psi") >= 0.25, "ALERT").when(F.col("psi") >= 0.10, "WARN").otherwise("OK"))


def psi_proxy(live: DataFrame, dist: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Step function of one value's distance from the training mean, for single readings."""
    x = melt(live, names, keep).join(dist.select("feature", "mean", "std"), "feature")
    z = F.abs((F.col("value") - F.col("mean")) / F.greatest("std", F.lit(0.001)))
    return x.select(*keep, "feature", F.when(z < 1, 0.0).when(z < 2, 0.05).when(z < 3, 0.15).otherwise(0.30).alias("psi_proxy"))


def brier_rolling(ledger: DataFrame, days: int = 30, min_rows: int = 10) -> DataFrame:
    """Mean squared gap between confidence and win over the trailing ``days``: daily integer sums first."""
    miss = F.round(F.col("confidence") * 100).cast("long") - F.when(F.col("pnl_points") > 0, 100).otherwise(0)
    daily = ledger.groupBy("category", "close_date").agg(F.sum(miss * miss).alias("_s"), F.count(F.lit(1)).alias("_n"))
    span = fw.series("category", F.unix_date("close_date")).rangeBetween(-(days - 1), 0)
    n = F.sum("_n").over(span)
    return daily.select("category", "close_date", n.alias("n"), F.when(n >= min_rows, F.round(F.sum("_s").over(span) / n / 10000, 6)).alias("brier"))


def brier_drift(rolling: DataFrame, base: DataFrame, worse: float = 0.20) -> DataFrame:
    """Degraded where the rolling score exceeds the training score by more than a fifth."""
    x = rolling.join(base.withColumnRenamed("brier", "train_brier"), "category")
    return x.withColumn("degraded", F.coalesce(F.col("brier") > F.col("train_brier") * (1 + worse), F.lit(False)).cast("int"))
