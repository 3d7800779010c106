"""News and social text: lexicon and model scores, trailing windows, backlogs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..functions.scalars import clamp, clip, html_clean, keyword_any, keyword_count
from .joins import latest_within, slot_windows, trailing_sums

# News lexicon.
BULLISH = (
    "profit", "growth", "surge", "beat", "record", "rally", "strong",
    "upgrade", "outperform", "buy", "positive", "gain", "rise", "boost",
    "increase", "expand", "recovery", "momentum", "bullish", "upside",
    "npa declining", "margin expansion", "loan growth", "rate cut",
    "net interest income", "roe improving", "dividend", "acquisition win",
)
BEARISH = (
    "loss", "decline", "fall", "drop", "miss", "weak", "concern",
    "downgrade", "underperform", "sell", "negative", "risk", "sell-off",
    "decrease", "contract", "slump", "bearish", "downside", "npa",
    "margin pressure", "npa rising", "bad loan", "default", "rbi action",
    "fraud", "penalty", "investigation", "rate hike hurt", "credit cost",
)
# Social lexicon.
SOCIAL_BULLISH = (
    "buy", "long", "bullish", "upside", "target", "accumulate",
    "strong", "outperform", "breakout", "support", "bounce",
    "rally", "good results", "beat", "positive", "upgrade",
)
SOCIAL_BEARISH = (
    "sell", "short", "bearish", "downside", "overvalued", "expensive",
    "weak", "underperform", "breakdown", "resistance", "fall",
    "dump", "miss", "negative", "downgrade", "avoid",
)
# Importance keywords.
IMPORTANT = (
    "quarterly results", "q1 results", "q2 results", "q3 results", "q4 results",
    "earnings", "profit", "revenue", "npa", "nim", "dividend",
    "acquisition", "merger", "board meeting", "rbi penalty",
    "bulk deal", "block deal", "promoter", "stake sale",
    "guidance", "analyst upgrade", "analyst downgrade",
)

SCORERS: dict[str, Callable[[Iterator[pd.Series]], Iterator[pd.Series]]] = {}


def register_scorer(name: str, fn: Callable[[Iterator[pd.Series]], Iterator[pd.Series]]) -> None:
    """``fn`` maps batches of text to batches of p_positive - p_negative; it may load a model once per worker."""
    SCORERS[name] = fn


def lexicon_score(df: DataFrame, text: str, bull: tuple = BULLISH, bear: tuple = BEARISH, weight: float = 0.75, cap: float = 0.8, digits: int = 4) -> DataFrame:
    """(bull - bear) / (bull + bear) hits, damped and capped; whole text, all expressions."""
    df = df.withColumns({"bull_hits": keyword_count(text, bull), "bear_hits": keyword_count(text, bear)})
    b, s = F.col("bull_hits"), F.col("bear_hits")
    return df.withColumn("sentiment_score", F.when(b + s == 0, 0.0).otherwise(F.round(clamp(F.try_divide(b - s, b + s) * weight, -cap, cap), digits)))


def model_score(df: DataFrame, text: str, scorer: str) -> DataFrame:
    fn = SCORERS[scorer]

    def batches(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from fn(it)

    udf = F.pandas_udf(batches, "double")
    return df.withColumn("model_score", F.round(clamp(udf(F.col(text)), -1, 1), 4))


def backlog(df: DataFrame, total: int, unscored, least: int = 5, order: str = "created_at", tie: str = "doc_id") -> DataFrame:
    """Fair share: the newest unscored rows of every ticker, ``total`` in all; a ticker's share is ``total`` by their number, ``least`` at least.

    Ranks inside (ticker, hour) first, so a ticker with very many rows is cut down before its rank.
    """
    x = df.where(unscored)
    per_key = max(least, total // max(1, x.select("ticker").distinct().count()))
    newest = [F.desc(order), F.desc(tie)]
    x = x.withColumn("_h", F.date_trunc("hour", order))
    x = x.withColumn("_r", F.row_number().over(W.partitionBy("ticker", "_h").orderBy(*newest))).where(F.col("_r") <= per_key)
    x = x.withColumn("_r", F.row_number().over(W.partitionBy("ticker").orderBy(*newest))).where(F.col("_r") <= per_key)
    return x.drop("_h", "_r").orderBy(*newest).limit(total)


def newest(df: DataFrame, cond, n: int, order: str = "created_at", tie: str = "doc_id") -> DataFrame:
    return df.where(cond).orderBy(F.desc(order), F.desc(tie)).limit(n)


def rescore_stale(df: DataFrame, new_score, as_of, days: int = 30) -> DataFrame:
    """Near-zero scores of the last ``days`` days get the new score, kept only if it is non-zero."""
    stale = (F.abs("sentiment_score") < 0.001) & (F.col("created_at") > as_of - F.expr(f"interval {days} days"))
    hit = F.coalesce(stale & (F.abs(new_score) >= 0.001), F.lit(False))
    return df.withColumns({"sentiment_score": F.when(hit, new_score).otherwise(F.col("sentiment_score")), "rescored": hit.cast("int")})


def _measures(score: str, unit: float) -> dict:
    s = F.col(score).cast("long")
    return {"n": F.lit(1), "s": s, "ss": s * s, "pos": (F.col(score) > 0.2 * unit).cast("int"), "neg": (F.col(score) < -0.2 * unit).cast("int")}


def _readings(x: DataFrame, ts: str, unit: float) -> DataFrame:
    """Means, spread, momentum and spike from the trailing sums of 24, 48, 72 and 168 hours."""
    n, mean = F.col("n_24h"), F.try_divide(F.col("s_24h"), F.col("n_24h"))
    prev_n, prev_s = F.col("n_48h") - n, F.col("s_48h") - F.col("s_24h")
    var = F.try_divide(F.col("ss_24h"), n) - mean * mean
    spike = n / F.greatest(F.col("n_168h") / 7, F.lit(1.0))
    some = n > 0
    out = {
        "score": F.when(some, F.round(mean / unit, 4)).otherwise(0.0),
        "score_3d": F.when(some, F.round(F.try_divide(F.col("s_72h"), F.col("n_72h")) / unit, 4)).otherwise(0.0),
        "momentum": F.when(some & (prev_n > 0), F.round((mean - F.try_divide(prev_s, prev_n)) / unit, 4)).otherwise(0.0),
        "count": n.cast("long"),
        "std": F.when(n > 1, F.round(F.sqrt(F.greatest(var, F.lit(0.0))) / unit, 4)).otherwise(0.0),
        "positive_ratio": F.when(some, F.round(F.try_divide(F.col("pos_24h"), n), 3)).otherwise(0.5),
        "negative_ratio": F.when(some, F.round(F.try_divide(F.col("neg_24h"), n), 3)).otherwise(0.5),
        "news_spike": F.when(some, F.round(spike, 4)).otherwise(1.0),
        "quality": F.when(n >= 3, "GOOD").when(some, "LOW").otherwise("NO_NEWS"),
    }
    x = x.select("ticker", F.col(ts).alias("ts"), *[c.alias(k) for k, c in out.items()])
    v = F.col("score")
    label = F.when(v > 0.5, "VERY_POSITIVE").when(v > 0.2, "POSITIVE").when(v < -0.5, "VERY_NEGATIVE").when(v < -0.2, "NEGATIVE").otherwise("NEUTRAL")
    return x.withColumns({"signal": label, "score_trend": F.round(F.col("score") - F.col("score_3d"), 4)})


HORIZONS = (24, 48, 72, 168)


def window(scored: DataFrame, score: str = "tenths", unit: float = 10.0) -> DataFrame:
    """Sentiment per (ticker, full hour): 24 h mean, 72 h mean, day-on-day momentum, spread, spike.

    ``score`` is an integer in ``1/unit`` steps so that sums are exact in any order.
    """
    return _readings(slot_windows(scored, _measures(score, unit), HORIZONS), "slot", unit)


def window_at(scored: DataFrame, moments: DataFrame, score: str = "tenths", unit: float = 10.0, at: str = "ts") -> DataFrame:
    """The same readings at each (ticker, ``at``) of ``moments``, as of that very time; without news they are neutral."""
    return _readings(trailing_sums(scored, moments, _measures(score, unit), HORIZONS, at=at), at, unit)


def social_label(df: DataFrame, text: str = "text") -> DataFrame:
    x = lexicon_score(df, text, SOCIAL_BULLISH, SOCIAL_BEARISH, 1.0, 1.0, 3)
    s = F.col("sentiment_score")
    return x.withColumn("sentiment_label", F.when(s > 0.2, "BULL").when(s < -0.2, "BEAR").otherwise("NEUTRAL"))


def _social_measures() -> dict:
    return {
        "n": F.lit(1), "bull": (F.col("sentiment_label") == "BULL").cast("int"), "bear": (F.col("sentiment_label") == "BEAR").cast("int"),
        "milli": F.round(F.col("sentiment_score") * 1000).cast("long"),
    }


def _social_readings(x: DataFrame, ts: str) -> DataFrame:
    n = F.col("n_24h")
    bull, bear = F.try_divide(F.col("bull_24h"), n), F.try_divide(F.col("bear_24h"), n)
    contrarian = (
        F.when(bull >= 0.85, "CONTRARIAN_BEAR").when(bear >= 0.80, "CONTRARIAN_BULL").when(bull >= 0.65, "MILD_BULL").when(bear >= 0.65, "MILD_BEAR").otherwise("NEUTRAL")
    )
    return x.select(
        F.col(ts).alias("ts"), n.cast("long").alias("total_posts_24h"), F.col("bull_24h").cast("long").alias("bull_count"), F.col("bear_24h").cast("long").alias("bear_count"),
        F.round(bull, 4).alias("bull_ratio"), F.round(bear, 4).alias("bear_ratio"), F.round(F.try_divide(F.col("milli_24h"), n) / 1000, 4).alias("avg_sentiment_score"),
        F.round(n / F.greatest(F.col("n_168h") / 7, F.lit(1.0)), 4).alias("activity_ratio"), contrarian.alias("contrarian_signal"), F.round(-(bull - 0.5) * 2, 4).alias("social_ml_score"),
    )


def social_window(labelled: DataFrame) -> DataFrame:
    """Per full hour over the last 24 h of posts: ratios, activity against 7 days, contrarian reading."""
    x = slot_windows(labelled.withColumn("_all", F.lit(0)), _social_measures(), (24, 168), key="_all").where(F.col("n_24h") > 0)
    return _social_readings(x, "slot")


def social_window_at(labelled: DataFrame, moments: DataFrame, at: str = "ts") -> DataFrame:
    """The same at each time ``at`` of ``moments``, as of that very time; shares are NULL where 24 h had no post."""
    asked = moments.select(at).distinct().withColumn("_all", F.lit(0))
    return _social_readings(trailing_sums(labelled.withColumn("_all", F.lit(0)), asked, _social_measures(), (24, 168), key="_all", at=at), at)


def text_scores_at(scored: DataFrame, moments: DataFrame, kinds: dict[str, str], days: int = 7, at: str = "ts", score: str = "tenths", unit: float = 10.0) -> DataFrame:
    """For each column of ``kinds`` the newest score of that kind of text at ``at``, if no older than ``days``; 0 otherwise.

    Of several texts at one time the one with the largest id counts.
    """
    out = moments
    for name, kind in kinds.items():
        own = scored.where(F.col("kind") == kind).groupBy("ticker", "created_at").agg((F.max_by(score, "doc_id") / unit).alias(name))
        out = latest_within(out, own, [name], days, left_ts=at, right_ts="created_at")
    return out.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in kinds})


def earnings_decay(df: DataFrame) -> DataFrame:
    """Relevance fades to zero over 90 days; combined score weighs earnings .7, announcement .3."""
    relevance = F.greatest(1 - F.coalesce(F.col("days_since_earnings"), F.lit(90)) / 90.0, F.lit(0.0))
    e, a = F.coalesce("earnings_score", F.lit(0.0)), F.coalesce("announcement_score", F.lit(0.0))
    return df.withColumns({"earnings_relevance": F.round(relevance, 4), "combined_score": F.round(e * 0.7 + a * 0.3, 6), "earnings_effect": F.round(e * relevance, 6)})


def features(df: DataFrame) -> DataFrame:
    """10 model columns from score, score_3d, momentum, news_spike, earnings and social inputs."""
    trend = clip(F.col("score") - F.col("score_3d"), -0.5, 0.5)
    out = {
        "news_score_24h": clip("score"), "news_score_trend": trend, "news_momentum": clip("momentum", -0.5, 0.5), "news_momentum_3d": trend,
        "news_spike_f": F.round(F.least(F.col("news_spike"), F.lit(3.0)) / 3, 4),
        "earnings_effect_f": F.round(clip("earnings_score") * F.col("earnings_relevance"), 4), "earnings_relevance_f": F.round("earnings_relevance", 4),
        "announcement_score_f": clip("announcement_score"), "combined_score_f": clip("combined_score"), "social_contrarian_score": clip("social_ml_score"),
    }
    return df.select("ticker", "ts", *[c.alias(n) for n, c in out.items()])


def empty_cycles(counts: DataFrame, key: str = "source", order: str = "cycle", value: str = "n", need: int = 2) -> DataFrame:
    """Alarm from the ``need``-th consecutive cycle without a row."""
    x = fw.streak_length(counts, F.col(value) == 0, "_run", key, order)
    return x.withColumns({"empty_streak": F.when(F.col(value) == 0, F.col("_run")).otherwise(0), "alarm": ((F.col(value) == 0) & (F.col("_run") >= need)).cast("int")}).drop("_run")


def ingest(articles: DataFrame, keywords: dict[str, tuple[str, ...]], as_of, days: int = 7) -> DataFrame:
    """Articles matched to every name whose keyword occurs: cleaned, recent, flagged.

    ``keywords`` is configuration (name to words), so matching is one expression per article. Words are looked for in
    the whole cleaned text; only the summary that is returned is cut to 1,000 characters.
    """
    x = articles.withColumns({"title": html_clean("title"), "summary": html_clean("summary")})
    x = x.withColumn("_text", F.lower(F.concat_ws(" ", "title", "summary"))).where(F.col("created_at") > as_of - F.expr(f"interval {days} days"))
    names = F.array(*[F.when(keyword_any("_text", words), F.lit(name)) for name, words in keywords.items()])
    x = x.withColumn("ticker", F.explode(F.array_compact(names)))
    return x.withColumns({"is_important": keyword_any("_text", IMPORTANT).cast("int"), "summary": F.substring("summary", 1, 1000)}).drop("_text")
