"""Global, macro and intermarket features.

Series are long (name, ts, close).  Changes are computed per series, carried onto the market
calendar per series, then laid side by side with one conditional aggregate per date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..functions.scalars import clamp, clip, flag, scale_linear
from .joins import asof_day, ffill_reindex

FIELDS = ("level", "p1", "p5", "p20", "chg5", "above20", "rank20")

# Output column -> (series, field).
GLOBAL = {
    "sp500_1d_pct": ("sp500", "p1"), "sp500_5d_pct": ("sp500", "p5"), "nasdaq_1d_pct": ("nasdaq", "p1"), "dow_1d_pct": ("dow", "p1"),
    "us_vix_level": ("us_vix", "level"), "us_vix_1d_pct": ("us_vix", "p1"), "india_vix_level": ("india_vix", "level"), "india_vix_1d_pct": ("india_vix", "p1"),
    "india_vix_pct20": ("india_vix", "rank20"), "crude_1d_pct": ("crude", "p1"), "crude_5d_pct": ("crude", "p5"), "crude_20d_pct": ("crude", "p20"), "crude_level": ("crude", "level"),
    "gold_1d_pct": ("gold", "p1"), "copper_5d_pct": ("copper", "p5"), "dxy_level": ("dxy", "level"), "dxy_5d_pct": ("dxy", "p5"), "dxy_above_20ma": ("dxy", "above20"),
    "usdinr_level": ("usdinr", "level"), "usdinr_1d_pct": ("usdinr", "p1"), "usdinr_5d_pct": ("usdinr", "p5"), "usdinr_20d_pct": ("usdinr", "p20"),
    "us_10y_level": ("us_10y", "level"), "us_10y_5d_chg": ("us_10y", "chg5"), "us_2y_level": ("us_2y", "level"), "nifty_1d_pct": ("nifty", "p1"), "nifty_5d_pct": ("nifty", "p5"),
    "banknifty_1d_pct": ("banknifty", "p1"), "banknifty_5d_pct": ("banknifty", "p5"), "jpmorgan_1d_pct": ("jpmorgan", "p1"), "jpmorgan_5d_pct": ("jpmorgan", "p5"), "hsbc_5d_pct": ("hsbc", "p5"),
}
VERDICT_SCORE = {"STRONG_BULL": 1.0, "BULL": 0.6, "NEUTRAL": 0.0, "BEAR": -0.6, "STRONG_BEAR": -1.0}


def percentile_rank(c: str, w, n: int = 20):
    """Percent of the last ``n`` values strictly below the current one; 50 while history is short."""
    values = F.collect_list(c).over(fw.trailing(w, n))
    below = F.size(F.filter(values, lambda v: v < F.col(c)))
    return F.when(F.size(values) < n, 50.0).otherwise(F.round(below / n * 100, 1))


def series_features(series: DataFrame) -> DataFrame:
    w = fw.series("name", "ts")
    pct = lambda k: F.round(F.coalesce(fw.pct_change("close", w, k) * 100, F.lit(0.0)), 4)
    ma = fw.roll(F.avg, "close", w, 20)
    return series.select(
        "name", "ts", F.round("close", 4).alias("level"), pct(1).alias("p1"), pct(5).alias("p5"), pct(20).alias("p20"),
        F.round(F.coalesce(F.col("close") - F.lag("close", 5).over(w), F.lit(0.0)), 4).alias("chg5"),
        flag(F.col("close") > ma).cast("double").alias("above20"), percentile_rank("close", w).alias("rank20"),
    )


def global_features(series: DataFrame) -> DataFrame:
    """One row per date with every global column, each as of that date."""
    filled = ffill_reindex(series_features(series), series, FIELDS, key="name")
    pick = lambda name, f: F.max(F.when(F.col("name") == name, F.col(f)))
    wide = filled.groupBy("ts").agg(*[F.coalesce(pick(n, f), F.lit(0.0)).alias(c) for c, (n, f) in GLOBAL.items()])
    return wide.withColumn("yield_spread", F.round(F.col("us_10y_level") - F.col("us_2y_level"), 4))


def verdict(df: DataFrame) -> DataFrame:
    """Bull minus bear points to five labels, a score and an opening bias."""
    pts = lambda c, hi, up, lo, dn: F.when(F.col(c) > hi, up).when(F.col(c) < lo, dn).otherwise(0)
    net = (
        pts("sp500_1d_pct", 0.8, 2, -0.8, -2) + pts("dxy_5d_pct", 0.8, -2, -0.8, 2) + pts("usdinr_5d_pct", 1.0, -2, -0.5, 1) + pts("crude_5d_pct", 4.0, -1, -4.0, 1)
        + pts("india_vix_level", 22, -2, 13, 1) + pts("us_10y_5d_chg", 0.15, -1, -0.15, 1) + pts("jpmorgan_5d_pct", 1.5, 1, -1.5, -1) + pts("banknifty_1d_pct", 0.5, 1, -0.5, -1)
    )
    df = df.withColumn("net_points", net)
    n = F.col("net_points")
    label = F.when(n >= 4, "STRONG_BULL").when(n >= 2, "BULL").when(n <= -4, "STRONG_BEAR").when(n <= -2, "BEAR").otherwise("NEUTRAL")
    bias = F.when(F.col("india_vix_level") > 25, "AVOID").when(F.col("sp500_1d_pct") > 0.8, "BULLISH_OPEN").when(F.col("sp500_1d_pct") < -0.8, "BEARISH_OPEN").otherwise("NEUTRAL_OPEN")
    df = df.withColumns({"verdict": label, "intraday_bias": bias})
    score = None
    for k, v in VERDICT_SCORE.items():
        score = F.when(F.col("verdict") == k, v) if score is None else score.when(F.col("verdict") == k, v)
    return df.withColumn("global_score", score)


def dollar(df: DataFrame) -> DataFrame:
    d, r = F.col("dxy_5d_pct"), F.col("usdinr_5d_pct")
    return df.withColumns({"dollar_stress": flag((d > 1.0) & (r > 0.5)), "dollar_ease": flag((d < -1.0) & (r < -0.3))})


def yields(df: DataFrame) -> DataFrame:
    df = df.withColumn("us_10y_bp_5d", F.round(F.col("us_10y_5d_chg") * 100, 1))
    return df.withColumns({"yield_headwind": flag(F.col("us_10y_bp_5d") > 15), "yield_tailwind": flag(F.col("us_10y_bp_5d") < -15)})


def crude(df: DataFrame) -> DataFrame:
    level, p5 = F.col("crude_level"), F.col("crude_5d_pct")
    return df.withColumns({"crude_risk": flag((level > 90) | (p5 > 5)), "crude_benign": flag((level < 75) & (p5 < 2))})


def global_banks(df: DataFrame) -> DataFrame:
    return df.withColumns({"global_banks_bullish": flag(F.col("jpmorgan_5d_pct") > 2.0), "global_banks_bearish": flag(F.col("jpmorgan_5d_pct") < -2.0)})


def rotation(df: DataFrame) -> DataFrame:
    df = df.withColumn("bank_vs_nifty_rs", F.round(F.col("banknifty_5d_pct") - F.col("nifty_5d_pct"), 4))
    return df.withColumns({"banks_outperforming": flag(F.col("bank_vs_nifty_rs") > 0.5), "banks_underperforming": flag(F.col("bank_vs_nifty_rs") < -0.5)})


def relative_strength(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Each name's 5-bar change against the index, the mean of the other names and its rank per date."""
    w = fw.series()
    x = bars.withColumns({f"p{k}": F.coalesce(fw.pct_change("close", w, k) * 100, F.lit(0.0)) for k in (1, 5, 20)})
    day = fw.W.partitionBy("ts")
    total, n = F.sum("p5").over(day), F.count(F.lit(1)).over(day)
    peers = F.when(n > 1, (total - F.col("p5")) / (n - 1)).otherwise(0.0)
    rank = F.row_number().over(day.orderBy(F.desc(F.round("p5", 6)), F.asc("ticker")))
    x = x.withColumns({"_peers": peers, "peer_rank": rank})
    x = x.join(market.select("ts", "banknifty_5d_pct"), "ts", "left")
    x = x.withColumns(
        {
            "rs_vs_banknifty_5d": F.round(F.col("p5") - F.coalesce("banknifty_5d_pct", F.lit(0.0)), 6),
            "rs_vs_peers_5d": F.round(F.col("p5") - F.col("_peers"), 6),
        }
    )
    return x.withColumns({"outperforming_sector": flag(F.col("rs_vs_banknifty_5d") > 0.5), "outperforming_peers": flag(F.col("rs_vs_peers_5d") > 0.5)}).drop("_peers", "banknifty_5d_pct")


def intermarket_score(df: DataFrame) -> DataFrame:
    on = lambda c, v: F.when(F.col(c) == 1, v).otherwise(0.0)
    s = (
        on("outperforming_sector", 0.25) + on("outperforming_peers", 0.15) + on("peer_rank", 0.10) - on("yield_headwind", 0.15) + on("yield_tailwind", 0.10)
        - on("dollar_stress", 0.20) + on("dollar_ease", 0.15) - on("crude_risk", 0.10) + on("crude_benign", 0.05) + on("global_banks_bullish", 0.10)
        - on("global_banks_bearish", 0.10) + on("banks_outperforming", 0.10) - on("banks_underperforming", 0.10)
    )
    df = df.withColumn("intermarket_score", F.round(clamp(s, -1, 1), 3))
    v = F.col("intermarket_score")
    label = (
        F.when(v > 0.4, "STRONG_INTERMARKET_BULL").when(v > 0.15, "MILD_INTERMARKET_BULL").when(v < -0.4, "STRONG_INTERMARKET_BEAR")
        .when(v < -0.15, "MILD_INTERMARKET_BEAR").otherwise("INTERMARKET_NEUTRAL")
    )
    return df.withColumn("intermarket_signal", label)


def rate_direction(rates: DataFrame) -> DataFrame:
    """Each rate decision with the direction against the one before."""
    w = fw.series("market", "effective_date")
    x = rates.where(F.col("rbi_rate") > 0).withColumn("market", F.lit("all"))
    prev = F.lag("rbi_rate").over(w)
    label = F.when(F.col("rbi_rate") < prev, "CUTTING").when(F.col("rbi_rate") > prev, "HIKING").otherwise("HOLDING")
    return x.withColumn("rbi_direction", label).drop("market")


def rate_asof(days: DataFrame, rates: DataFrame) -> DataFrame:
    return asof_day(days, rate_direction(rates), ["rbi_rate", "rbi_direction", "credit_growth"], key=None, right_ts="effective_date")


def meeting_proximity(days: DataFrame, meetings: DataFrame) -> DataFrame:
    """Days to the next and since the last meeting, week flag, size multiplier."""
    nxt = asof_day(days, meetings.withColumn("next_meeting", F.col("event_date")), ["next_meeting"], key=None, right_ts="event_date", forward=True)
    both = asof_day(nxt, meetings.withColumn("last_meeting", F.col("event_date")), ["last_meeting"], key=None, right_ts="event_date")
    to, since = F.coalesce(F.datediff("next_meeting", "ts"), F.lit(30)), F.datediff("ts", "last_meeting")
    mult = F.when(to == 0, 0.40).when(to == 1, 0.50).when(since == 1, 0.80).otherwise(1.0)
    return both.withColumns({"days_to_rbi": to, "is_rbi_week": (to <= 5).cast("int"), "macro_event_mult": mult}).drop("next_meeting", "last_meeting")


def vix(df: DataFrame) -> DataFrame:
    return df.withColumns({"india_vix_high": flag(F.col("india_vix_level") > 20), "india_vix_panic": flag(F.col("india_vix_level") > 25)})


def currency(df: DataFrame) -> DataFrame:
    return df.withColumn("rupee_stress", flag(F.col("usdinr_5d_pct") > 1.0))


def credit(df: DataFrame) -> DataFrame:
    g = F.coalesce("credit_growth", F.lit(15.0))
    return df.withColumns({"system_credit_growth": g, "credit_strong": flag(g > 14.0), "credit_weak": flag(g < 8.0)})


def macro_score(df: DataFrame) -> DataFrame:
    v, r = F.col("india_vix_level"), F.col("usdinr_5d_pct")
    s = (
        F.when(F.col("rbi_direction") == "CUTTING", 0.2).when(F.col("rbi_direction") == "HIKING", -0.2).otherwise(0.0)
        - F.when(F.col("is_rbi_week") == 1, 0.1).otherwise(0.0)
        + F.when(v < 13, 0.1).when(v > 22, -0.3).when(v > 18, -0.1).otherwise(0.0)
        + F.when(r > 1.5, -0.2).when(r < -0.5, 0.1).otherwise(0.0)
    )
    df = df.withColumn("macro_score", F.round(clamp(s, -1, 1), 3))
    return df.withColumn("macro_signal", F.when(F.col("macro_score") > 0.3, "MACRO_BULLISH").when(F.col("macro_score") < -0.3, "MACRO_BEARISH").otherwise("MACRO_NEUTRAL"))


def market_frame(series: DataFrame, rates: DataFrame, meetings: DataFrame) -> DataFrame:
    """Per date: global columns with verdict, yields, dollar, crude, banks, rotation, rates, meetings, macro score."""
    g = rotation(global_banks(crude(yields(dollar(verdict(global_features(series)))))))
    return macro_score(credit(currency(vix(meeting_proximity(rate_asof(g, rates), meetings)))))


def name_frame(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Per (ticker, ts): relative strength beside the market columns, with the intermarket score."""
    rs = relative_strength(bars, market)
    return intermarket_score(rs.join(market, "ts", "left"))


def features(df: DataFrame) -> DataFrame:
    """14 model columns."""
    out = {
        "india_vix_norm": scale_linear("india_vix_level", 10, 30, invert=True),
        "india_vix_trend": clip(F.col("india_vix_1d_pct") / 20),
        "rbi_proximity_norm": F.round(F.greatest(1 - F.least("days_to_rbi", F.lit(30)) / 30, F.lit(0.0)), 4),
        "rbi_cutting_cycle": F.when(F.col("rbi_direction") == "CUTTING", 1.0).when(F.col("rbi_direction") == "HIKING", -1.0).otherwise(0.0),
        "dollar_stress_f": F.coalesce(F.col("dollar_stress").cast("double"), F.lit(0.0)),
        "rupee_stress_f": clip(-F.col("usdinr_5d_pct") / 2),
        "yield_headwind_f": clip(-F.col("us_10y_bp_5d") / 30),
        "crude_risk_f": clip(-F.col("crude_5d_pct") / 10),
        "macro_score_f": clip("macro_score"),
        "intermarket_score_f": clip("intermarket_score"),
        "rs_vs_banknifty": clip(F.col("rs_vs_banknifty_5d") / 3),
        "banks_outperforming_nifty": F.coalesce(F.col("banks_outperforming").cast("double"), F.lit(0.0)),
        "banknifty_relative_momentum_5d": clip(clamp(F.coalesce(F.col("banknifty_5d_pct") - F.col("nifty_5d_pct"), F.lit(0.0)), -10, 10) / 5.0),
        "peer_rank_norm": F.round(1 - (F.col("peer_rank") - 1) / 5, 3),
    }
    return df.select("ticker", "ts", *[c.alias(n) for n, c in out.items()])


FEATURES = (
    "india_vix_norm", "india_vix_trend", "rbi_proximity_norm", "rbi_cutting_cycle", "dollar_stress_f", "rupee_stress_f", "yield_headwind_f", "crude_risk_f",
    "macro_score_f", "intermarket_score_f", "rs_vs_banknifty", "banks_outperforming_nifty", "banknifty_relative_momentum_5d", "peer_rank_norm",
)


def staleness(latest: DataFrame, as_of) -> DataFrame:
    """(source, last_update, limit_hours) rows with age and stale flag."""
    hours = F.round((F.unix_timestamp(as_of) - F.unix_timestamp(F.col("last_update").cast("timestamp"))) / 3600, 1)
    return latest.withColumn("hours_ago", hours).withColumn("stale", F.coalesce(F.col("hours_ago") > F.col("limit_hours"), F.lit(True)))
