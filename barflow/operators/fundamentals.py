"""Quarterly fundamentals, earnings events and alternative-data trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..functions.scalars import clamp, clip, flag, ladder, scale_linear
from .joins import asof_day

QUARTERS = 8


def trend(c: str, w, inverted: bool = False):
    """OLS slope over the last eight non-zero values, oldest first, over their mean; +1 = improving."""
    frame = fw.trailing(w, QUARTERS)
    x = F.when(F.col(c) != 0, F.col(c))
    # Positions among the non-zero values: a running count, so zeros leave no gap in x.
    slope = F.regr_slope(x, F.col(f"_q_{c}")).over(frame)
    mean = F.avg(x).over(frame)
    value = F.when(F.count(x).over(frame) < 2, 0.0).otherwise(F.coalesce((-slope if inverted else slope) / (F.abs(mean) + 1e-6), F.lit(0.0)))
    return F.round(clamp(value, -1, 1), 4)


def frame(fundamentals: DataFrame) -> DataFrame:
    """Trends, valuation against five years, beat streak, grade; one row per (ticker, quarter)."""
    w = fw.series("ticker", "fetched_at")
    df = fundamentals.withColumns({f"_q_{c}": F.sum((F.col(c) != 0).cast("int")).over(fw.running(w)) for c in ("nim", "npa_gross", "loan_growth", "casa_ratio")})
    five = fw.series("ticker", F.unix_date("fetched_at")).rangeBetween(-5 * 365, 0)
    df = df.withColumns(
        {
            "nim_trend": trend("nim", w),
            "npa_trend": trend("npa_gross", w, inverted=True),
            "loan_trend": trend("loan_growth", w),
            "casa_trend": trend("casa_ratio", w),
            "pb_vs_5yr_avg": F.round(F.col("pb_ratio") / F.greatest(F.coalesce(F.avg(F.when(F.col("pb_ratio") > 0, F.col("pb_ratio"))).over(five), F.lit(3.0)), F.lit(0.1)), 4),
            "eps_surprise": F.round(F.coalesce(F.col("eps") - F.lag("eps").over(w), F.lit(0.0)), 4),
        }
    )
    return grade(beat_streak(df)).drop("_q_nim", "_q_npa_gross", "_q_loan_growth", "_q_casa_ratio")


def beat_streak(df: DataFrame, surprise: str = "eps_surprise", order: str = "fetched_at", limit: int = QUARTERS) -> DataFrame:
    """Consecutive positive surprises ending at this quarter, at most ``limit``."""
    w = fw.series("ticker", order)
    n = F.row_number().over(w)
    df = df.withColumn("_n", n)
    last_miss = F.last(F.when(~(F.coalesce(F.col(surprise), F.lit(0.0)) > 0), F.col("_n")), ignorenulls=True).over(fw.running(w))
    return df.withColumn("beat_streak", F.least(F.col("_n") - F.coalesce(last_miss, F.lit(0)), F.lit(limit))).drop("_n")


def grade(df: DataFrame) -> DataFrame:
    npa = F.when(F.coalesce(F.col("npa_gross"), F.lit(0.0)) == 0, 1.3).otherwise(F.col("npa_gross"))
    nim, roe, casa = F.col("nim"), F.col("roe"), F.col("casa_ratio")
    s = (
        F.when(nim > 4.0, 0.2).when(nim > 3.5, 0.1).when(nim < 3.0, -0.2).otherwise(0.0)
        + F.when(npa < 1.0, 0.2).when(npa < 2.0, 0.1).when(npa > 3.0, -0.3).otherwise(0.0)
        + F.col("nim_trend") * 0.15 + F.col("npa_trend") * 0.15
        + F.when(roe > 18, 0.1).when(roe > 15, 0.05).when(roe < 12, -0.1).otherwise(0.0)
        + F.when(casa > 48, 0.1).when(casa < 40, -0.1).otherwise(0.0)
    )
    df = df.withColumn("fundamental_score", F.round(clamp(s, -1, 1), 3))
    return df.withColumn("fundamental_grade", ladder("fundamental_score", [(0.4, "EXCELLENT"), (0.1, "GOOD"), (-0.1, "AVERAGE"), (-0.4, "WEAK")], "POOR"))


def latest_non_null(df: DataFrame, metrics: list[str], order: str = "fetched_at") -> DataFrame:
    """Newest positive value of each metric per ticker."""
    return df.groupBy("ticker").agg(*[F.max_by(F.when(F.col(m) > 0, F.col(m)), F.when(F.col(m) > 0, F.col(order))).alias(m) for m in metrics])


def features(df: DataFrame) -> DataFrame:
    out = {
        "nim_norm": scale_linear("nim", 2.5, 4.5),
        "nim_trend_f": clip("nim_trend"),
        "npa_norm": scale_linear("npa_gross", 4.0, 0.5),
        "npa_trend_f": clip("npa_trend"),
        "casa_norm": scale_linear("casa_ratio", 30, 52),
        "loan_growth_norm": scale_linear("loan_growth", 5, 22),
        "roe_norm": scale_linear("roe", 10, 20),
        "pb_vs_avg_norm": scale_linear("pb_vs_5yr_avg", 1.5, 0.7),
        "beat_streak_norm": F.round(F.least(F.col("beat_streak") / 6, F.lit(1.0)), 4),
        "fundamental_score_f": clip("fundamental_score"),
    }
    return df.select("ticker", "fetched_at", *[c.alias(n) for n, c in out.items()])


FEATURES = ("nim_norm", "nim_trend_f", "npa_norm", "npa_trend_f", "casa_norm", "loan_growth_norm", "roe_norm", "pb_vs_avg_norm", "beat_streak_norm", "fundamental_score_f")


def surprise(earnings: DataFrame) -> DataFrame:
    pct = (F.col("actual_eps") - F.col("estimated_eps")) / F.greatest(F.abs("estimated_eps"), F.lit(0.01)) * 100
    return earnings.withColumns({"surprise_pct": F.round(pct, 4), "beat_estimates": (F.col("actual_eps") >= F.col("estimated_eps")).cast("int")})


def history(results: DataFrame, last: int = 12) -> DataFrame:
    """Per result: beat rate, mean positive surprise and beat run over the last ``last`` results."""
    w = fw.series("ticker", "result_date")
    fr = fw.trailing(w, last)
    beat = F.col("beat_estimates") == 1
    df = results.withColumns(
        {
            "hist_beat_rate": F.round(F.avg(beat.cast("double")).over(fr), 4),
            "hist_avg_gap_up": F.round(F.coalesce(F.avg(F.when(beat & (F.col("surprise_pct") != 0), F.col("surprise_pct") / 100)).over(fr), F.lit(0.025)), 4),
        }
    )
    return beat_streak(df.withColumn("_s", F.col("beat_estimates").cast("double")), "_s", "result_date", last).withColumnRenamed("beat_streak", "consecutive_beats").drop("_s")


def peer_signal(results: DataFrame, days: int = 90) -> DataFrame:
    """Per result: share of the other names whose newest result within ``days`` was a beat.

    Names are spread over the results they can see with a date range keyed by quarter; each name's
    newest result per quarter is one row, so the pairing is names x names per quarter.
    """
    a = results.select("ticker", "result_date")
    r = results.select(F.col("ticker").alias("peer"), F.col("result_date").alias("_rd"), "surprise_pct")
    # A result is visible for ``days`` days: it belongs to at most two consecutive 90-day slots.
    slot = lambda c: F.floor(F.unix_date(c) / days)
    r = r.withColumn("_s", F.explode(F.array(slot("_rd"), slot("_rd") + 1)))
    x = a.withColumn("_s", slot("result_date")).join(r, "_s").where((F.col("peer") != F.col("ticker")) & F.col("_rd").between(F.date_sub("result_date", days), F.col("result_date")))
    newest = x.groupBy("ticker", "result_date", "peer").agg(F.max_by("surprise_pct", "_rd").alias("s"))
    agg = newest.groupBy("ticker", "result_date").agg(F.round(F.avg((F.col("s") > 0).cast("double")), 4).alias("beat_ratio"))
    out = a.join(agg, ["ticker", "result_date"], "left")
    ratio = F.coalesce("beat_ratio", F.lit(0.5))
    label = F.when(F.col("beat_ratio").isNull(), "UNKNOWN").when(ratio >= 0.67, "SECTOR_STRONG").when(ratio <= 0.33, "SECTOR_WEAK").otherwise("SECTOR_MIXED")
    return out.select("ticker", "result_date", ratio.alias("peer_beat_ratio"), label.alias("peer_signal"))


def days_to_earnings(days: DataFrame, results: DataFrame) -> DataFrame:
    nxt = asof_day(days, results.withColumn("_next", F.col("result_date")), ["_next"], right_ts="result_date", forward=True)
    prev = asof_day(nxt, results.withColumn("_prev", F.col("result_date")), ["_prev"], right_ts="result_date")
    return prev.withColumns(
        {"days_to_earnings": F.coalesce(F.datediff("_next", "ts"), F.lit(99)), "days_since_earnings": F.datediff("ts", "_prev")}
    ).drop("_next", "_prev")


def pre_drift(df: DataFrame) -> DataFrame:
    """Change over min(5, days+1) bars inside ten days of a result."""
    w = fw.series()
    n = F.least(F.col("days_to_earnings") + 1, F.lit(5))
    base = F.when(n == 2, F.lag("close", 1).over(w)).when(n == 3, F.lag("close", 2).over(w)).when(n == 4, F.lag("close", 3).over(w)).otherwise(F.lag("close", 4).over(w))
    near = (F.col("days_to_earnings") <= 10) & (n >= 2) & (F.row_number().over(w) >= 10)
    return df.withColumn("pre_earnings_drift", F.when(near, F.round(F.coalesce(F.col("close") / base - 1, F.lit(0.0)), 4)).otherwise(0.0))


def event_size(df: DataFrame) -> DataFrame:
    d = F.col("days_to_earnings")
    return df.withColumn("earnings_size_mult", F.when(d == 0, 0.0).when(d == 1, 0.3).when(d == 2, 0.5).when(d == 3, 0.7).when(F.col("days_since_earnings") == 1, 0.8).otherwise(1.0))


def beat_probability(df: DataFrame) -> DataFrame:
    drift = F.when(F.col("pre_earnings_drift") > 0.02, 0.1).when(F.col("pre_earnings_drift") < -0.02, -0.1).otherwise(0.0)
    peers = F.when(F.col("peer_signal") == "SECTOR_STRONG", 0.08).when(F.col("peer_signal") == "SECTOR_WEAK", -0.08).otherwise(0.0)
    return df.withColumn("beat_probability", F.round(clamp(F.coalesce("hist_beat_rate", F.lit(0.62)) + drift + peers, 0.1, 0.9), 3))


# Strategy texts.
STRATEGIES = (
    "WAIT_FOR_RESULTS — too close, avoid new positions",
    "REDUCE_SIZE_50% — earnings risk, cap exposure",
    "SMALL_LONG_OK — high beat probability, but size small",
    "AVOID_LONGS — low beat probability approaching",
    "NORMAL_TRADING — earnings not imminent",
)


def strategy(df: DataFrame) -> DataFrame:
    d, p = F.col("days_to_earnings"), F.col("beat_probability")
    wait, reduce, small, avoid, normal = STRATEGIES
    return df.withColumn("earnings_strategy", F.when(d <= 2, wait).when(d <= 5, reduce).when((d <= 10) & (p > 0.70), small).when((d <= 10) & (p < 0.40), avoid).otherwise(normal))


def earnings_frame(bars: DataFrame, earnings: DataFrame) -> DataFrame:
    """Every bar with the earnings columns as of its date."""
    res = surprise(earnings)
    x = days_to_earnings(bars.select("ticker", "ts", "close"), res)
    x = asof_day(x, history(res), ["hist_beat_rate", "hist_avg_gap_up", "consecutive_beats"], right_ts="result_date")
    x = asof_day(x, peer_signal(res), ["peer_beat_ratio", "peer_signal"], right_ts="result_date")
    x = strategy(beat_probability(event_size(pre_drift(x))))
    d, drift = F.col("days_to_earnings"), F.col("pre_earnings_drift")
    return x.withColumns(
        {"is_earnings_week": (d <= 5).cast("int"), "is_earnings_day": (d == 0).cast("int"), "pre_earnings_bullish": flag(drift > 0.015), "pre_earnings_bearish": flag(drift < -0.015)}
    )


def alt_slopes(counts: DataFrame) -> DataFrame:
    """(keyword, group_name, period, value): mean of the last four against the four before."""
    w = fw.series("keyword", "period")
    recent, older = F.avg("value").over(fw.trailing(w, 4)), F.avg("value").over(w.rowsBetween(-7, -4))
    enough = F.count("value").over(fw.trailing(w, 8)) >= 8
    older = F.when(enough, older).otherwise(recent)
    return counts.withColumns({"recent_avg": F.round(recent, 4), "older_avg": F.round(older, 4), "slope": F.round((recent - older) / F.greatest(older, F.lit(1.0)), 4)})


def alt_score(slopes: DataFrame) -> DataFrame:
    """Group means per period, weighted .5 product, .3 hiring, -.2 concern."""
    g = slopes.groupBy("period").agg(*[F.coalesce(F.avg(F.when(F.col("group_name") == n, F.col("slope"))), F.lit(0.0)).alias(n) for n in ("product", "hiring", "concern")])
    df = g.withColumns({"demand_trend_score": F.round("product", 4), "hiring_trend_score": F.round("hiring", 4), "concern_trend_score": F.round(-F.col("concern"), 4)})
    s = F.col("demand_trend_score") * 0.5 + F.col("hiring_trend_score") * 0.3 + F.col("concern_trend_score") * 0.2
    df = df.withColumn("alt_data_score", F.round(clamp(s, -1, 1), 5)).drop("product", "hiring", "concern")
    h, a = F.col("hiring_trend_score"), F.col("alt_data_score")
    return df.withColumns(
        {
            "hiring_trend": F.when(h > 0.15, "STRONG_EXPANSION").when(h > 0.05, "EXPANSION").when(h < -0.15, "STRONG_CONTRACTION").when(h < -0.05, "CONTRACTION").otherwise("STABLE"),
            "alt_data_signal": F.when(a > 0.3, "BULLISH_FUNDAMENTAL").when(a > 0.1, "MILD_POSITIVE").when(a < -0.3, "BEARISH_FUNDAMENTAL").when(a < -0.1, "MILD_NEGATIVE").otherwise("NEUTRAL"),
        }
    )


#: Keywords whose own trend is a column.
LOANS = {"home_loan_trend": "home_loan", "personal_loan_trend": "personal_loan", "credit_card_trend": "credit_card"}


def alt_features(score: DataFrame, slopes: DataFrame | None = None, loans: dict[str, str] = LOANS) -> DataFrame:
    """Group trends per period; with ``slopes`` also the trend of each keyword of ``loans`` (0 where it has no row)."""
    out = score.select(
        "period", clip(F.col("demand_trend_score") * 3).alias("demand_trend"), clip(F.col("hiring_trend_score") * 4).alias("hiring_trend_f"),
        clip("concern_trend_score").alias("concern_trend"), clip("alt_data_score").alias("alt_data_score_f"),
    )
    if slopes is None:
        return out
    own = slopes.groupBy("period").agg(*[F.max(F.when(F.col("keyword") == k, F.col("slope"))).alias(n) for n, k in loans.items()])
    return out.join(own, "period", "left").withColumns({n: clip(F.coalesce(n, F.lit(0.0)) * 5) for n in loans})


def ownership_features(df: DataFrame) -> DataFrame:
    """The ownership half of the alternative-data columns."""
    promoter = F.when(F.col("promoter_trend") == "INCREASING", 1.0).when(F.col("promoter_trend") == "DECREASING", -1.0).otherwise(0.0)
    return df.select(
        "ticker", "quarter", clip("insider_score").alias("insider_score_f"), promoter.alias("promoter_trend_score"), clip(-F.col("pledge_pct") / 20).alias("pledge_risk"), clip(F.col("dii_qoq") * 5).alias("dii_accumulation")
    )
