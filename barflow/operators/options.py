"""Option-chain analytics per (ticker, fetched_at) snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..functions.scalars import clip, monthly_expiry, scale_linear

SNAP = ["ticker", "fetched_at"]


def latest_snapshot(chain: DataFrame) -> DataFrame:
    newest = chain.groupBy("ticker").agg(F.max("fetched_at").alias("fetched_at"))
    return chain.join(newest, SNAP, "left_semi")


def pcr(chain: DataFrame) -> DataFrame:
    out = chain.groupBy(*SNAP).agg(F.sum("ce_oi").alias("total_call_oi"), F.sum("pe_oi").alias("total_put_oi"))
    return out.withColumn("pcr", F.round(F.when(F.col("total_call_oi") == 0, 1.0).otherwise(F.try_divide("total_put_oi", "total_call_oi")), 3))


def pcr_roc(snapshots: DataFrame) -> DataFrame:
    """Current ratio minus the mean of the previous five snapshots; 0 without history or a zero mean."""
    older = F.avg("pcr").over(fw.series("ticker", "fetched_at").rowsBetween(-5, -1))
    return snapshots.withColumn("pcr_roc", F.round(F.when(older.isNull() | (older == 0), 0.0).otherwise(F.col("pcr") - older), 3))


def max_pain(chain: DataFrame) -> DataFrame:
    """Strike with the least total pay-out, the lowest on ties.

    Running sums of OI and strike*OI below and above each strike give every pay-out in one sorted
    pass, no strike-by-strike pairing.
    """
    order = W.partitionBy(*SNAP).orderBy("strike")
    below, above = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    pain = (
        F.col("strike") * zero(F.sum("ce_oi").over(below)) - zero(F.sum(F.col("strike") * F.col("ce_oi")).over(below))
        + zero(F.sum(F.col("strike") * F.col("pe_oi")).over(above)) - F.col("strike") * zero(F.sum("pe_oi").over(above))
    )
    x = chain.groupBy(*SNAP, "strike").agg(F.sum("ce_oi").alias("ce_oi"), F.sum("pe_oi").alias("pe_oi")).withColumn("pain", pain)
    return x.groupBy(*SNAP).agg(F.min(F.struct("pain", "strike")).alias("z")).select(*SNAP, F.col("z.strike").alias("max_pain"), F.col("z.pain").alias("pain"))


def max_oi_strikes(chain: DataFrame) -> DataFrame:
    top = lambda oi: F.max(F.when(F.col(oi) > 0, F.struct(F.col(oi), (-F.col("strike")).alias("neg"))))
    x = chain.groupBy(*SNAP).agg(top("ce_oi").alias("c"), top("pe_oi").alias("p"))
    return x.select(*SNAP, F.coalesce(-F.col("c.neg"), F.lit(0)).alias("max_call_oi_strike"), F.coalesce(-F.col("p.neg"), F.lit(0)).alias("max_put_oi_strike"))


def at_the_money(spotted: DataFrame) -> DataFrame:
    """Nearest strike to spot (lower on ties), its vol, and the straddle's implied move."""
    x = spotted.groupBy(*SNAP, "spot").agg(
        F.min(F.struct(F.round(F.abs(F.col("strike") - F.col("spot")), 9).alias("d"), "strike", "iv", "ce_price", "pe_price")).alias("z")
    )
    move = F.when(F.col("spot") > 0, F.round((F.col("z.ce_price") + F.col("z.pe_price")) / F.col("spot") * 100, 4)).otherwise(0.0)
    return x.select(*SNAP, "spot", F.col("z.strike").alias("atm_strike"), F.col("z.iv").alias("atm_iv"), move.alias("implied_move_pct"))


def iv_percentile(atm: DataFrame, lookback: int = 252, min_rows: int = 10) -> DataFrame:
    """Share of the trailing positive readings below the current one, in percent; 50 while history is short."""
    frame = fw.trailing(fw.series("ticker", "fetched_at"), lookback)
    x = atm.withColumn("_ivs", F.collect_list(F.when(F.col("atm_iv") > 0, F.col("atm_iv"))).over(frame))
    below = F.size(F.filter("_ivs", lambda v: v < F.col("atm_iv")))
    short = (F.col("atm_iv") == 0) | (F.size("_ivs") < min_rows)
    return x.withColumn("iv_percentile", F.when(short, 50.0).otherwise(F.round(F.try_divide(below, F.size("_ivs")) * 100, 4))).drop("_ivs")


def pain_distance(df: DataFrame) -> DataFrame:
    dist = F.when((F.col("spot") == 0) | (F.col("max_pain") == 0), 0.0).otherwise(F.round((F.col("spot") - F.col("max_pain")) / F.col("spot") * 100, 4))
    df = df.withColumn("max_pain_distance", dist)
    d = F.col("max_pain_distance")
    return df.withColumn("max_pain_direction", F.when(d > 0.5, "ABOVE_MAX_PAIN").when(d < -0.5, "BELOW_MAX_PAIN").otherwise("AT_MAX_PAIN"))


def expiry(df: DataFrame, day: str = "fetched_at") -> DataFrame:
    days = F.datediff(monthly_expiry(day), F.col(day))
    return df.withColumns({"days_to_monthly_expiry": F.greatest(days, F.lit(0)), "is_expiry_week": days.between(0, 5).cast("int"), "is_expiry_day": (days == 0).cast("int")})


def snapshot_frame(chain: DataFrame, spotted: DataFrame) -> DataFrame:
    """All per-snapshot columns; every part is keyed by (ticker, fetched_at) so the joins share one partitioning."""
    out = pcr_roc(pcr(chain)).join(max_pain(chain), SNAP).join(max_oi_strikes(chain), SNAP).join(iv_percentile(at_the_money(spotted)), SNAP)
    return expiry(pain_distance(out))


def features(df: DataFrame, price: str = "spot") -> DataFrame:
    p, call, put = F.col(price), F.col("max_call_oi_strike"), F.col("max_put_oi_strike")
    days = F.col("days_to_monthly_expiry")
    return df.withColumns(
        {
            "pcr_norm": scale_linear("pcr", 0.7, 1.3),
            "pcr_roc_norm": clip(-F.col("pcr_roc") / 0.3),
            "max_pain_dist_norm": F.when((p > 0) & (F.col("max_pain") > 0), clip(-((p - F.col("max_pain")) / p) / 0.03)).otherwise(0.0),
            "iv_percentile_norm": scale_linear("iv_percentile", 20, 80, invert=True),
            "implied_move_norm": clip(-F.col("implied_move_pct") / 5.0),
            "expiry_proximity": F.when(days <= 5, F.round(F.greatest(1 - days / 5, F.lit(0.0)), 4)).otherwise(0.0),
            "call_wall_dist_norm": F.when((p > 0) & (call > p), clip((call - p) / p / 0.05)).otherwise(0.0),
            "put_wall_dist_norm": F.when((p > 0) & (put > 0) & (put < p), clip((p - put) / p / 0.05)).otherwise(0.0),
        }
    )
