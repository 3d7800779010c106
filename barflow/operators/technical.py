"""Technical features per (ticker, ts); every column looks backward only.

All windows share one partitioning (ticker) so the frame costs a single shuffle; unused columns
are pruned by Catalyst when a caller selects a few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..functions.scalars import clamp, finite_or, flag, safe_div

EPS, EPS8 = 1e-10, 1e-8

# Per-feature bounds used when features leave the frame for a model.
WINSOR_BOUNDS = {
    "rsi_14": (0, 100),
    "stoch_rsi": (0, 1),
    "macd_hist_roc": (-5, 5),
    "ema_spread": (-0.15, 0.15),
    "ema_spread_roc": (-2, 2),
    "adx": (0, 100),
    "bb_pct_b": (-0.5, 1.5),
    "atr_ratio": (0, 0.1),
    "hv_ratio": (0, 5),
    "obv_roc": (-3, 3),
    "volume_ratio": (0, 10),
    "returns_1d": (-0.15, 0.15),
    "returns_5d": (-0.25, 0.25),
    "returns_20d": (-0.40, 0.40),
    "gap_pct": (-0.10, 0.10),
}


def clean_bars(bars: DataFrame, max_move: float = 0.26) -> DataFrame:
    """Forward-fill gaps, drop unfilled rows and rows whose move from the previous bar is too large.

    The first bar has no move and is dropped as well.
    """
    w = fw.series()
    filled = bars.withColumns(
        {c: F.last(c, ignorenulls=True).over(fw.running(w)).cast("double") for c in ("open", "high", "low", "close", "volume")}
    ).dropna(subset=["open", "high", "low", "close", "volume"])
    move = F.abs(fw.pct_change("close", w))
    return filled.withColumn("_move", move).where(F.col("_move") < max_move).drop("_move")


def momentum(df: DataFrame) -> DataFrame:
    w = fw.series()
    delta = F.col("close") - F.lag("close").over(w)
    df = df.withColumns({"_up": F.greatest(delta, F.lit(0.0)), "_dn": F.greatest(-delta, F.lit(0.0)), "_delta": delta})
    # greatest() skips NULL: the first row has no delta and must stay NULL.
    df = df.withColumns({c: F.when(F.col("_delta").isNotNull(), F.col(c)) for c in ("_up", "_dn")})
    gain, loss = fw.roll(F.avg, "_up", w, 14), fw.roll(F.avg, "_dn", w, 14)
    df = df.withColumn("rsi_14", 100 - 100 / (1 + gain / (loss + EPS)))
    lo, hi = fw.roll(F.min, "rsi_14", w, 14), fw.roll(F.max, "rsi_14", w, 14)
    df = df.withColumn("stoch_rsi", (F.col("rsi_14") - lo) / (hi - lo + EPS))
    return df.drop("_up", "_dn", "_delta")


def rsi_divergence(df: DataFrame, order: int = 10, mode: str = "confirmed") -> DataFrame:
    """-1 price pivot high without an RSI pivot high, +1 likewise for lows.

    ``confirmed`` reports ``order`` bars later; ``legacy`` looks both ways on the pivot's own row.
    """
    w = fw.series()
    late = mode == "confirmed"
    df = df.withColumn("_rsi50", F.coalesce("rsi_14", F.lit(50.0)))
    piv = lambda c, high: fw.pivot(c, w, order, high, late).isNotNull()
    df = df.withColumns({"_ph": piv("close", True), "_pl": piv("close", False), "_rh": piv("_rsi50", True), "_rl": piv("_rsi50", False)})
    at = F.row_number().over(w) - 1 - (order if late else 0)
    value = F.when(at < order, 0.0).when(F.col("_ph") & ~F.col("_rh"), -1.0).when(F.col("_pl") & ~F.col("_rl"), 1.0).otherwise(0.0)
    return df.withColumn("rsi_divergence", value).drop("_rsi50", "_ph", "_pl", "_rh", "_rl")


def true_range(df: DataFrame) -> DataFrame:
    prev = F.lag("close").over(fw.series())
    return df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def trend(df: DataFrame) -> DataFrame:
    """MACD, EMAs, ATR, ADX, supertrend: two EMA passes."""
    w = fw.series()
    df = true_range(df)
    up = F.greatest(F.coalesce(F.col("high") - F.lag("high").over(w), F.lit(0.0)), F.lit(0.0))
    down = F.greatest(F.coalesce(F.lag("low").over(w) - F.col("low"), F.lit(0.0)), F.lit(0.0))
    df = df.withColumns({"_up": up, "_down": down})
    df = df.withColumn("_up", F.when(F.col("_up") > F.col("_down"), F.col("_up")).otherwise(0.0))
    df = df.withColumn("_down", F.when(F.col("_down") > F.col("_up"), F.col("_down")).otherwise(0.0))
    df = fw.ewm(
        df,
        {
            "_e12": ("close", 12, False), "_e26": ("close", 26, False), "ema_20": ("close", 20, False), "ema_50": ("close", 50, False),
            "atr_14": ("true_range", 14, False), "_atr10": ("true_range", 10, False), "_dmp": ("_up", 14, False), "_dmm": ("_down", 14, False),
        },
    )
    dip, dim = 100 * F.col("_dmp") / (F.col("atr_14") + EPS), 100 * F.col("_dmm") / (F.col("atr_14") + EPS)
    df = df.withColumns({"macd": F.col("_e12") - F.col("_e26"), "_dx": 100 * F.abs(dip - dim) / (dip + dim + EPS)})
    df = fw.ewm(df, {"_sig": ("macd", 9, False), "adx": ("_dx", 14, False)})
    hl2 = (F.col("high") + F.col("low")) / 2
    df = df.withColumns(
        {
            "macd_hist": F.col("macd") - F.col("_sig"),
            "ema_spread": (F.col("ema_20") - F.col("ema_50")) / F.col("ema_50"),
            "_upper": hl2 + 3.0 * F.col("_atr10"),
            "_lower": hl2 - 3.0 * F.col("_atr10"),
        }
    )
    df = df.withColumns(
        {
            "_event": F.when(F.row_number().over(w) == 1, 1.0)
            .when(F.col("close") > F.lag("_upper").over(w), 1.0)
            .when(F.col("close") < F.lag("_lower").over(w), -1.0),
            "macd_hist_roc": F.coalesce(fw.pct_change("macd_hist", w, 3), F.lit(0.0)),
            "ema_spread_roc": F.coalesce(fw.pct_change("ema_spread", w, 5), F.lit(0.0)),
            "atr_ratio": F.col("atr_14") / F.col("close"),
        }
    )
    df = df.withColumn("supertrend", F.last("_event", ignorenulls=True).over(fw.running(w)))
    return df.drop("_up", "_down", "_e12", "_e26", "_atr10", "_dmp", "_dmm", "_dx", "_sig", "_upper", "_lower", "_event")


def volatility(df: DataFrame) -> DataFrame:
    w = fw.series()
    df = df.withColumn("_ret", fw.pct_change("close", w))
    mid, sigma = fw.roll(F.avg, "close", w, 20), fw.roll(F.stddev_samp, "close", w, 20)
    df = df.withColumns({"bb_mid": mid, "bb_sigma": sigma})
    upper, lower = F.col("bb_mid") + 2 * F.col("bb_sigma"), F.col("bb_mid") - 2 * F.col("bb_sigma")
    df = df.withColumns(
        {
            "bb_width": (upper - lower) / (F.col("bb_mid") + EPS),
            "bb_pct_b": (F.col("close") - lower) / (upper - lower + EPS),
            "hv_ratio": F.coalesce(
                fw.roll(F.stddev_samp, "_ret", w, 10) * F.sqrt(F.lit(252.0)) / (fw.roll(F.stddev_samp, "_ret", w, 30) * F.sqrt(F.lit(252.0)) + EPS),
                F.lit(1.0),
            ),
        }
    )
    p10 = fw.roll(lambda x: F.percentile(x, F.lit(0.1)), "bb_width", w, 126)
    # Beyond rounding noise: a width may itself be the percentile.
    return df.withColumn("bb_squeeze", flag(F.col("bb_width") < p10 - 1e-12).cast("double")).drop("_ret")


def volume(df: DataFrame) -> DataFrame:
    w = fw.series()
    step = F.signum(F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0))) * F.col("volume")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    spread = F.col("high") - F.col("low") + EPS
    df = df.withColumns(
        {
            "_step": step,
            "_tp": typical,
            "_mfv": ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / spread * F.col("volume"),
            "volume_ratio": F.try_divide(F.col("volume"), fw.roll(F.avg, "volume", w, 10)),
            "vol_roc": F.coalesce(fw.pct_change("volume", w, 5), F.lit(0.0)),
        }
    )
    prev_tp, raw = F.lag("_tp").over(w), F.col("_tp") * F.col("volume")
    df = df.withColumns(
        {
            "obv": F.sum("_step").over(fw.running(w)),
            "_pos": F.when(F.col("_tp") > prev_tp, raw).otherwise(0.0),
            "_neg": F.when(F.col("_tp") < prev_tp, raw).otherwise(0.0),
            "cmf": fw.roll(F.sum, "_mfv", w, 20) / (fw.roll(F.sum, "volume", w, 20) + EPS),
        }
    )
    ratio = fw.roll(F.sum, "_pos", w, 14) / (fw.roll(F.sum, "_neg", w, 14) + EPS)
    df = df.withColumns({"mfi": 100 - 100 / (1 + ratio), "obv_roc": F.coalesce(fw.pct_change("obv", w, 5), F.lit(0.0))})
    return df.drop("_step", "_tp", "_mfv", "_pos", "_neg")


def price_action(df: DataFrame) -> DataFrame:
    w = fw.series()
    lo = fw.roll(F.min, "close", w, 252, 20)
    hi = fw.roll(F.max, "close", w, 252, 20)
    prev = F.lag("close").over(w)
    day = (F.dayofweek("ts") + 5) % 7
    cols = {f"returns_{k}d": F.coalesce(fw.pct_change("close", w, k), F.lit(0.0)) for k in (1, 3, 5, 20)}
    cols |= {
        "close_pct_range": (F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + EPS8),
        "gap_pct": (F.col("open") - prev) / prev,
        "range_pct_52w": (F.col("close") - lo) / (hi - lo + EPS),
        "_dir": F.signum(F.coalesce(F.col("close") - prev, F.lit(0.0))),
        "day_of_week": day.cast("double"),
        "month": F.month("ts").cast("double"),
        "is_monday": (day == 0).cast("double"),
        "is_friday": (day == 4).cast("double"),
        "intraday_mom_30m": F.coalesce(fw.pct_change("close", w, 6), F.lit(0.0)),
    }
    df = df.withColumns(cols)
    df = fw.streak_length(df, F.col("_dir"), "_len")
    return df.withColumn("consec_days", F.col("_dir") * F.col("_len")).drop("_dir", "_len")


def vwap_distance(df: DataFrame, session=None) -> DataFrame:
    """Close against the volume-weighted price accumulated since the session's start."""
    df = df.withColumn("_session", F.to_date("ts") if session is None else session)
    w = fw.running(fw.series(["ticker", "_session"], "ts"))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    vwap = F.sum(typical * F.col("volume")).over(w) / (F.sum("volume").over(w) + EPS)
    df = df.withColumn("vwap", vwap)
    return df.withColumn("vwap_dist", (F.col("close") - F.col("vwap")) / (F.col("vwap") + EPS)).drop("_session")


def level_distances(df: DataFrame, order: int = 10, lookback: int = 252) -> DataFrame:
    """Distance to the nearest confirmed swing low below / swing high above, ±5 % if none."""
    w = fw.series()
    frame = fw.trailing(w, lookback)
    df = df.withColumns({"_pl": fw.pivot("low", w, order, high=False), "_ph": fw.pivot("high", w, order, high=True)})
    df = df.withColumns({"_lows": F.collect_list("_pl").over(frame), "_highs": F.collect_list("_ph").over(frame)})
    below = F.array_max(F.filter("_lows", lambda x: x < F.col("close")))
    above = F.array_min(F.filter("_highs", lambda x: x > F.col("close")))
    df = df.withColumns({"_sup": F.coalesce(below, F.col("close") * 0.95), "_res": F.coalesce(above, F.col("close") * 1.05)})
    df = df.withColumns({"support_dist": (F.col("close") - F.col("_sup")) / F.col("close"), "resistance_dist": (F.col("_res") - F.col("close")) / F.col("close")})
    return df.drop("_pl", "_ph", "_lows", "_highs", "_sup", "_res")


def poc_distance(bars: DataFrame, bins: int = 20, lookback: int = 252) -> DataFrame:
    """Distance from the most-traded of ``bins`` price buckets of the trailing frame.

    Each bar contributes to the ``lookback`` frames that contain it; the buckets are then counted
    by a hash aggregate, so no array of the frame is ever built.
    """
    w = fw.series()
    frame = fw.trailing(w, lookback)
    base = bars.select("ticker", "ts", "close", "volume", F.row_number().over(w).alias("i"), F.min("low").over(frame).alias("_lo"), F.max("high").over(frame).alias("_hi"))
    parts = base.select("ticker", F.col("close").alias("_c"), F.col("volume").alias("_v"), F.explode(F.sequence(F.col("i"), F.col("i") + lookback - 1)).alias("i"))
    target = base.select("ticker", "ts", "i", "close", "_lo", ((F.col("_hi") - F.col("_lo")) / bins).alias("_size"))
    bucket = F.floor((F.col("_c") - F.col("_lo")) / (F.col("_size") + EPS)).cast("int")
    hist = parts.join(target, ["ticker", "i"]).groupBy("ticker", "ts", "close", "_lo", "_size", bucket.alias("bucket")).agg(F.sum("_v").alias("vol"))
    # Most volume wins, the lowest bucket on ties.
    poc = hist.groupBy("ticker", "ts", "close", "_lo", "_size").agg(F.max(F.struct("vol", (-F.col("bucket")).alias("neg"))).alias("top"))
    price = F.col("_lo") + (-F.col("top.neg") + 0.5) * F.col("_size")
    return poc.select("ticker", "ts", ((F.col("close") - price) / (price + EPS)).alias("poc_distance"))


def atr_percentile(df: DataFrame, lookback: int = 252, min_rows: int = 20) -> DataFrame:
    """Share of the trailing ATRs at or below the current one; 0.5 while history is short."""
    frame = fw.trailing(fw.series(), lookback)
    values = F.collect_list("atr_14").over(frame)
    df = df.withColumn("_atrs", values)
    share = F.size(F.filter("_atrs", lambda x: x <= F.col("atr_14"))) / F.size("_atrs")
    return df.withColumn("atr_percentile_252", F.when(F.size("_atrs") >= min_rows, share).otherwise(0.5)).drop("_atrs")


def technical_frame(bars: DataFrame) -> DataFrame:
    df = price_action(volume(volatility(trend(rsi_divergence(momentum(bars))))))
    return level_distances(vwap_distance(df, F.trunc("ts", "month")))


FEATURES = (
    "rsi_14", "stoch_rsi", "rsi_divergence", "macd", "macd_hist", "macd_hist_roc", "ema_20", "ema_50", "ema_spread", "ema_spread_roc",
    "adx", "supertrend", "bb_pct_b", "bb_squeeze", "bb_width", "atr_14", "atr_ratio", "hv_ratio", "volume_ratio", "vol_roc", "obv", "obv_roc",
    "mfi", "cmf", "returns_1d", "returns_3d", "returns_5d", "returns_20d", "close_pct_range", "gap_pct", "range_pct_52w", "consec_days",
    "support_dist", "resistance_dist", "vwap_dist", "day_of_week", "month", "is_monday", "is_friday",
)


def zero_filled(df: DataFrame, names=FEATURES) -> DataFrame:
    return df.withColumns({c: finite_or(c) for c in names})


def winsorise(df: DataFrame, bounds: dict = WINSOR_BOUNDS) -> DataFrame:
    return df.withColumns({c: clamp(finite_or(c), lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns})


def latest(df: DataFrame, key: str = "ticker", order: str = "ts") -> DataFrame:
    """The newest row per key: one struct per key and task after the map side."""
    rest = [c for c in df.columns if c != key]
    top = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return top.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def breadth(bars: DataFrame, span: int = 50) -> DataFrame:
    """Per date: share of names above their own moving average."""
    w = fw.series()
    df = bars.withColumn("_sma", fw.roll(F.avg, "close", w, span)).where(F.col("_sma").isNotNull())
    return df.groupBy("ts").agg(F.avg((F.col("close") > F.col("_sma")).cast("double")).alias("breadth_50dma"), F.count(F.lit(1)).alias("n_names"))


def forward_label(bars: DataFrame, horizon: int, threshold: float, warmup: int = 60) -> DataFrame:
    """2 up / 1 flat / 0 down by the return ``horizon`` bars ahead, known at ``label_until``; warm-up and open-ended rows dropped."""
    w = fw.series()
    df = bars.withColumns({"label_until": F.lead("ts", horizon).over(w), "_fwd": F.lead("close", horizon).over(w) / F.col("close") - 1, "_i": F.row_number().over(w) - 1})
    df = df.where((F.col("_i") >= warmup) & F.col("_fwd").isNotNull())
    label = F.when(F.col("_fwd") > threshold, 2).when(F.col("_fwd") < -threshold, 0).otherwise(1)
    return df.withColumns({"forward_return": F.col("_fwd"), "label": label}).drop("_fwd", "_i")


def feature_sequence(df: DataFrame, names: list[str], lookback: int) -> DataFrame:
    """The last ``lookback`` feature rows as a matrix (only once that many exist)."""
    frame = fw.trailing(fw.series(), lookback)
    rows = F.collect_list(F.array(*[F.round(finite_or(c), 6) for c in names])).over(frame)
    return df.withColumn("sequence", rows).where(F.size("sequence") == lookback)


def drop_forming(bars: DataFrame, as_of, minutes: int) -> DataFrame:
    """Bars whose interval has ended by ``as_of``."""
    return bars.where(F.col("ts") + F.expr(f"interval {minutes} minutes") <= as_of)


def resample(bars: DataFrame, unit: str = "week") -> DataFrame:
    """Coarser OHLCV by calendar unit; bars have unique timestamps per ticker."""
    slot = F.date_trunc(unit, F.col("ts").cast("timestamp")).cast("date")
    return bars.groupBy("ticker", slot.alias("slot")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("slot", "ts")


def market_hours(bars: DataFrame, zone: str = "Asia/Kolkata", start: str = "09:15", end: str = "15:30") -> DataFrame:
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    clock = F.date_format(local, "HH:mm")
    return bars.withColumn("local_ts", local.cast("timestamp_ntz")).where(clock.between(start, end))


def price_metadata(bars: DataFrame) -> DataFrame:
    """Latest bar per ticker with previous close, change, volume ratio and 52-week range."""
    w = fw.series()
    df = bars.withColumns(
        {
            "prev_close": F.lag("close").over(w),
            "vol_ratio": safe_div(F.col("volume"), F.avg("volume").over(fw.trailing(w, 10))),
            "high_52w": F.max("high").over(fw.trailing(w, 252)),
            "low_52w": F.min("low").over(fw.trailing(w, 252)),
        }
    )
    df = df.withColumn("change_pct", F.try_divide(F.col("close") - F.col("prev_close"), F.col("prev_close")) * 100)
    return latest(df)
