"""Candlestick and chart patterns for every bar, as lag expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..functions.scalars import clamp, flag

# Pattern weights.
WEIGHTS = {
    "engulfing": 3.0,
    "morning_star": 3.0,
    "evening_star": 3.0,
    "three_soldiers": 2.5,
    "three_crows": 2.5,
    "hammer": 2.0,
    "shooting_star": 2.0,
    "doji": 1.5,
    "harami": 1.5,
    "marubozu": 2.0,
    "spinning_top": 1.0,
}
NAMES = tuple(WEIGHTS)


def candles(df: DataFrame, classical_triples: bool = False) -> DataFrame:
    """``pat_*`` columns.  Three-soldiers/crows stay 0 unless ``classical_triples`` asks for the 3-bar rule."""
    w = fw.series()
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    df = df.withColumns(
        {"_body": F.abs(c - o), "_range": h - l, "_bull": c > o, "_top": F.greatest(o, c), "_bot": F.least(o, c)}
    )
    back = lambda name, k: F.lag(name, k).over(w)
    df = df.withColumns(
        {f"_{n}{k}": back(src, k) for n, src in (("o", "open"), ("c", "close"), ("b", "_body"), ("u", "_bull"), ("t", "_top"), ("f", "_bot")) for k in (1, 2)}
    )
    body, rng, bull = F.col("_body"), F.col("_range"), F.col("_bull")
    upper, lower = h - F.col("_top"), F.col("_bot") - l
    ratio = F.try_divide(body, rng)
    mid2 = (F.col("_o2") + F.col("_c2")) / 2
    small1 = F.col("_b1") < F.col("_b2") * 0.3
    some = rng != 0
    pats = {
        "engulfing": F.when(
            (body > F.col("_b1")) & ~F.col("_u1") & bull & (o <= F.col("_c1")) & (c >= F.col("_o1")), 1.0
        ).when((body > F.col("_b1")) & F.col("_u1") & ~bull & (o >= F.col("_c1")) & (c <= F.col("_o1")), -1.0),
        "hammer": F.when(some & (body > 0) & (lower > 2 * body) & (upper < body * 0.3), 1.0),
        "shooting_star": F.when(some & (body > 0) & (upper > 2 * body) & (lower < body * 0.3), -1.0),
        "doji": F.when(ratio < 0.1, 0.5),
        "morning_star": F.when(~F.col("_u2") & small1 & bull & (c > mid2), 1.0),
        "evening_star": F.when(F.col("_u2") & small1 & ~bull & (c < mid2), -1.0),
        "marubozu": F.when((ratio > 0.92) & bull, 1.0).when(ratio > 0.92, -1.0),
        "harami": F.when((F.col("_top") < F.col("_t1")) & (F.col("_bot") > F.col("_f1")), F.when(bull, 0.5).otherwise(-0.5)),
        "spinning_top": F.when((ratio < 0.3) & (upper > body) & (lower > body), 0.3),
        "three_soldiers": F.lit(None),
        "three_crows": F.lit(None),
    }
    if classical_triples:
        pats["three_soldiers"] = F.when(bull & F.col("_u1") & F.col("_u2") & (c > F.col("_c1")) & (F.col("_c1") > F.col("_c2")), 1.0)
        pats["three_crows"] = F.when(~bull & ~F.col("_u1") & ~F.col("_u2") & (c < F.col("_c1")) & (F.col("_c1") < F.col("_c2")), -1.0)
    df = df.withColumns({f"pat_{n}": F.coalesce(p.cast("double"), F.lit(0.0)) for n, p in pats.items()})
    return df.drop(*[x for x in df.columns if x.startswith("_")])


def pattern_score(df: DataFrame) -> DataFrame:
    total, bulls, bears = F.lit(0.0), F.lit(0), F.lit(0)
    for n in NAMES:
        p = F.col(f"pat_{n}")
        total, bulls, bears = total + p * WEIGHTS[n] * 20, bulls + (p > 0).cast("int"), bears + (p < 0).cast("int")
    df = df.withColumn("pattern_score", F.round(clamp(total, -100, 100), 1))
    s = F.col("pattern_score")
    label = F.when(s > 60, "STRONG_BULL_PATTERN").when(s > 30, "BULL_PATTERN").when(s < -60, "STRONG_BEAR_PATTERN").when(s < -30, "BEAR_PATTERN").otherwise("NO_PATTERN")
    return df.withColumns({"pattern_signal": label, "pattern_bull_count": bulls, "pattern_bear_count": bears})


def crosses(df: DataFrame) -> DataFrame:
    w = fw.series()
    df = fw.ewm(df, {"_fast": ("close", 20, True), "_slow": ("close", 50, True)})
    # Both means start at the first close: compare beyond rounding noise only.
    df = df.withColumns({c: F.round(c, 8) for c in ("_fast", "_slow")})
    pf, ps = F.lag("_fast").over(w), F.lag("_slow").over(w)
    return df.withColumns(
        {
            "chart_golden_cross": flag((pf < ps) & (F.col("_fast") > F.col("_slow"))),
            "chart_death_cross": flag((pf > ps) & (F.col("_fast") < F.col("_slow"))),
        }
    ).drop("_fast", "_slow")


def breakouts(df: DataFrame) -> DataFrame:
    w = fw.series()
    width = 4 * fw.roll(F.stddev_samp, "close", w, 20) / fw.roll(F.avg, "close", w, 20)
    # Windows with the same closes in another order are equally wide: compare beyond rounding noise only.
    df = df.withColumns({"_w": F.round(width, 12), "_h20": fw.roll(F.max, "high", w, 20), "_v10": fw.roll(F.avg, "volume", w, 10)})
    df = df.withColumn("_p15", fw.roll(lambda x: F.percentile(x, F.lit(0.15)), "_w", w, 60))
    squeezed = F.lag("_w", 4).over(w) < F.lag("_p15", 4).over(w)
    return df.withColumns(
        {
            "chart_volume_breakout": flag((F.col("close") > F.lag("_h20").over(w)) & (F.col("volume") > F.col("_v10") * 1.5)),
            "chart_bb_breakout": flag(squeezed & (F.col("_w") > F.lag("_w", 2).over(w))),
            "chart_inside_bar": flag((F.col("high") < F.lag("high").over(w)) & (F.col("low") > F.lag("low").over(w))),
        }
    ).drop("_w", "_h20", "_v10", "_p15")
