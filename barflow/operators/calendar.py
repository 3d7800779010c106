"""Calendar dimensions and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..functions.scalars import clamp, lookup
from .joins import asof_day

# Mean monthly bias.
MONTH_BIAS = {1: 0.6, 2: 0.2, 3: -0.3, 4: 0.4, 5: 0.1, 6: 0.0, 7: 0.3, 8: 0.1, 9: 0.0, 10: 0.5, 11: 0.7, 12: 0.3}


def trading_calendar(dates: DataFrame, holidays: DataFrame, ts: str = "ts") -> DataFrame:
    """Every day between the first and last date: trading flag and the next trading day.

    A day-level dimension: its size is the calendar's, whatever the data's.
    """
    span = dates.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"), F.lit("all").alias("market"))
    days = days.join(holidays.select(F.col("holiday").alias("day"), F.lit(True).alias("_h")), "day", "left")
    weekday = (F.dayofweek("day") + 5) % 7
    days = days.withColumns({"is_holiday": F.col("_h").isNotNull(), "is_trading_day": (weekday < 5) & F.col("_h").isNull()})
    later = fw.series("market", "day").rowsBetween(1, fw.W.unboundedFollowing)
    nxt = F.min(F.when(F.col("is_trading_day"), F.col("day"))).over(later)
    return days.withColumn("next_trading_day", nxt).drop("_h", "market")


def session(bars: DataFrame) -> DataFrame:
    """Session flags of a local timestamp: pre-open, open, closing half hour."""
    clock = F.hour("ts") * 60 + F.minute("ts")
    weekday = F.dayofweek("ts").between(2, 6)
    return bars.withColumns(
        {
            "is_pre_market": (weekday & clock.between(9 * 60, 9 * 60 + 14)).cast("int"),
            "is_market_open": (weekday & clock.between(9 * 60 + 15, 15 * 60 + 30)).cast("int"),
            "is_closing": (weekday & clock.between(15 * 60, 15 * 60 + 30)).cast("int"),
        }
    )


def features(df: DataFrame, holidays: DataFrame, ts: str = "ts") -> DataFrame:
    """17 columns from the date, expiry and earnings inputs on the row.

    Expects days_to_earnings, pre_earnings_drift, beat_probability, days_to_monthly_expiry,
    is_expiry_week, is_expiry_day, max_pain_distance.
    """
    x = asof_day(df, holidays.withColumn("_next", F.col("holiday")), ["_next"], key=None, left_ts=ts, right_ts="holiday", forward=True)
    dow, month = (F.dayofweek(ts) + 5) % 7, F.month(ts)
    d_earn, d_exp = F.col("days_to_earnings"), F.col("days_to_monthly_expiry")
    hol = F.coalesce(F.datediff("_next", F.to_date(ts)), F.lit(99))
    out = {
        "earnings_proximity": F.round(F.greatest(1 - F.least(d_earn, F.lit(90)) / 90, F.lit(0.0)), 4),
        "earnings_risk_flag": (d_earn <= 5).cast("double"),
        "pre_earnings_drift_norm": F.round(clamp(F.col("pre_earnings_drift") / 0.03, -1, 1), 4),
        "earnings_beat_prob": F.round("beat_probability", 4),
        "expiry_proximity": F.round(F.greatest(1 - F.least(d_exp, F.lit(15)) / 15, F.lit(0.0)), 4),
        "is_expiry_week_f": F.col("is_expiry_week").cast("double"),
        "is_expiry_day_f": F.col("is_expiry_day").cast("double"),
        "max_pain_dist_norm": F.round(clamp(F.col("max_pain_distance") / 3, -1, 1), 4),
        "is_monday": (dow == 0).cast("double"),
        "is_friday": (dow == 4).cast("double"),
        "is_midweek": dow.between(1, 3).cast("double"),
        "day_of_week_norm": F.round((dow - 2) / 2, 4),
        "month_seasonality": lookup(month, MONTH_BIAS, 0.0),
        "is_q4_india": (month == 3).cast("double"),
        "is_oct_nov": month.isin(10, 11).cast("double"),
        "quarter_norm": F.round((F.quarter(ts) - 2.5) / 1.5, 4),
        "holiday_proximity": F.when(hol <= 2, F.round(F.greatest(1 - hol / 3, F.lit(0.0)), 4)).otherwise(0.0),
    }
    return x.select("ticker", ts, *[c.alias(n) for n, c in out.items()])


FEATURES = (
    "earnings_proximity", "earnings_risk_flag", "pre_earnings_drift_norm", "earnings_beat_prob", "expiry_proximity", "is_expiry_week_f", "is_expiry_day_f", "max_pain_dist_norm",
    "is_monday", "is_friday", "is_midweek", "day_of_week_norm", "month_seasonality", "is_q4_india", "is_oct_nov", "quarter_norm", "holiday_proximity",
)
