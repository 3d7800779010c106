"""News, social and sentiment queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import fundamentals as fd
from ..operators import sentiment as tx
from ..sources import adapters as src
from .oracle import define, sql
from .registry import register, wrap


def _hits(terms, text: str) -> str:
    return " + ".join(f"contains(lower({text}), '{t}')::INT" for t in terms)


define("lex", f"SELECT doc_id, {_hits(tx.BULLISH, 'text')} AS b, {_hits(tx.BEARISH, 'text')} AS s FROM documents")
register(
    "lexicon_score",
    lambda spark, d: tx.lexicon_score(src.table(spark, d, "documents"), "text").select("doc_id", "bull_hits", "bear_hits", "sentiment_score"),
    sql("SELECT doc_id, b AS bull_hits, s AS bear_hits, CASE WHEN b + s = 0 THEN 0.0 ELSE round(greatest(-0.8, least(0.8, (b - s) / (b + s) * 0.75)), 4) END::DOUBLE AS sentiment_score FROM lex", "lex"),
)


def length_scorer(batches):
    """Stand-in model: share of long words, centred; real models are registered by users."""
    for s in batches:
        words = (text.split() for text in s.fillna(""))  # the words of one text at a time, not those of the batch
        yield pd.Series([sum(len(w) > 6 for w in ws) / len(ws) * 2 - 1 if ws else 0.0 for ws in words], index=s.index, dtype="float64")


tx.register_scorer("word_length", length_scorer)
register("model_score", lambda spark, d: tx.model_score(src.table(spark, d, "documents"), "text", "word_length").select("doc_id", "model_score"))

define("sn", "SELECT source AS ticker, doc_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, n_chars % 21 - 10 AS tenths FROM documents")
define("sgrid", "SELECT DISTINCT ticker, c + to_hours(k) AS t FROM (SELECT ticker, CASE WHEN date_trunc('hour', created_at) = created_at THEN created_at ELSE date_trunc('hour', created_at) + INTERVAL 1 HOUR END AS c FROM sn), range(0, 168) r(k)", "sn")
_in = lambda h: f"s.created_at > g.t - INTERVAL {h} HOURS"


def _sums(grid: str, items: str) -> str:
    """Counts and moments of the items in the trailing 24, 48, 72 and 168 hours of each (ticker, t); no item, no count."""
    return f"""SELECT g.ticker, g.t, count(s.ticker) FILTER ({_in(24)}) AS n, avg(tenths) FILTER ({_in(24)}) AS m, avg(tenths) FILTER ({_in(72)}) AS m3, avg(tenths) FILTER ({_in(48)} AND NOT {_in(24)}) AS mp, stddev_pop(tenths) FILTER ({_in(24)}) AS sd,
    count(*) FILTER ({_in(24)} AND tenths > 2) AS pos, count(*) FILTER ({_in(24)} AND tenths < -2) AS neg, count(s.ticker) FILTER ({_in(72)}) AS n3, count(s.ticker) AS n7
    FROM {grid} g LEFT JOIN {items} s ON s.ticker = g.ticker AND s.created_at <= g.t AND {_in(168)} GROUP BY 1, 2"""


def _readings(sums: str) -> str:
    return f"""SELECT *, CASE WHEN score > 0.5 THEN 'VERY_POSITIVE' WHEN score > 0.2 THEN 'POSITIVE' WHEN score < -0.5 THEN 'VERY_NEGATIVE' WHEN score < -0.2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS signal, round(score - score_3d, 4) AS score_trend FROM (
    SELECT ticker, t AS ts, CASE WHEN n > 0 THEN round(m / 10, 4) ELSE 0 END AS score, CASE WHEN n > 0 THEN round(m3 / 10, 4) ELSE 0 END AS score_3d, CASE WHEN n > 0 AND mp IS NOT NULL THEN round((m - mp) / 10, 4) ELSE 0 END AS momentum, n AS count,
      CASE WHEN n > 1 THEN round(sd / 10, 4) ELSE 0 END AS std, CASE WHEN n > 0 THEN round(pos / n, 3) ELSE 0.5 END AS positive_ratio, CASE WHEN n > 0 THEN round(neg / n, 3) ELSE 0.5 END AS negative_ratio,
      CASE WHEN n > 0 THEN round(n / greatest(n7 / 7, 1), 4) ELSE 1 END AS news_spike, CASE WHEN n >= 3 THEN 'GOOD' WHEN n > 0 THEN 'LOW' ELSE 'NO_NEWS' END AS quality FROM {sums})"""


define("sw0", _sums("sgrid", "sn"), "sgrid", "sn")
define("sw", _readings("sw0"), "sw0")
_SW = ["ticker", "ts", "score", "score_3d", "momentum", "count", "std", "positive_ratio", "negative_ratio", "news_spike", "quality", "signal"]


def windows(spark, d):
    return tx.window(src.scored_news(spark, d)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


register("sentiment_window", lambda spark, d: windows(spark, d).select(*_SW), sql(f"SELECT {', '.join(_SW)} FROM sw", "sw"))
register("sentiment_ml", lambda spark, d: windows(spark, d).select("ticker", "ts", "score", "score_3d", "score_trend"), sql("SELECT ticker, ts, score, score_3d, score_trend FROM sw", "sw"))
register(
    "window_range_join",
    lambda spark, d: windows(spark, d).select("ticker", "ts", "count"),
    sql("SELECT ticker, t AS ts, n AS count FROM sw0", "sw0"),
)

# Every bar as of its close: daily bars at the end of their day, intraday bars at the end of their half hour.
define("bnews", "SELECT r_name AS ticker, doc_id, TIMESTAMP '1995-01-01' + to_minutes(doc_id * 7919 % 3456000) AS created_at, n_chars % 21 - 10 AS tenths, CASE n_chars % 3 WHEN 0 THEN 'earnings' WHEN 1 THEN 'announcement' ELSE 'news' END AS kind FROM documents JOIN region ON doc_id % 5 = r_regionkey")
define("bgrid", "SELECT ticker, ts AS day, ts + INTERVAL 1 DAY AS t FROM bars", "bars")
define("sb0", _sums("bgrid", "bnews"), "bgrid", "bnews")
define("sb", _readings("sb0"), "sb0")
define("igrid", "SELECT ticker, ts + INTERVAL 30 MINUTES AS t FROM bars_intraday", "bars_intraday")
define("inews", "SELECT ['click', 'error', 'purchase', 'signup', 'view'][doc_id % 5 + 1] AS ticker, TIMESTAMP '2024-01-01' + to_minutes(doc_id) + to_seconds(doc_id % 60) AS created_at, n_chars % 21 - 10 AS tenths FROM documents")
define("si0", _sums("igrid", "inews"), "igrid", "inews")


def closes(spark, d):
    """Daily bars with the moment their day ends."""
    return src.bars(spark, d).select("ticker", "ts", (F.col("ts").cast("timestamp_ntz") + F.expr("interval 1 day")).alias("closed_at"))


def windows_at_bars(spark, d):
    x = tx.window_at(src.bar_news(spark, d), closes(spark, d), at="closed_at")
    return x.withColumn("ts", F.date_sub(F.col("ts").cast("date"), 1))


def intraday_news(spark, d):
    names = F.array(*[F.lit(n) for n in ("click", "error", "purchase", "signup", "view")])
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60 + F.pmod("doc_id", F.lit(60)))
    return src.table(spark, d, "documents").select(F.get(names, F.pmod("doc_id", F.lit(5)).cast("int")).alias("ticker"), at.cast("timestamp_ntz").alias("created_at"))


register("sentiment_at_bars", lambda spark, d: windows_at_bars(spark, d).select(*_SW), sql(f"SELECT {', '.join('CAST(ts - INTERVAL 1 DAY AS DATE) AS ts' if c == 'ts' else c for c in _SW)} FROM sb", "sb"))
register(
    "window_range_join_bars",
    lambda spark, d: tx.trailing_sums(intraday_news(spark, d), src.bars_intraday(spark, d).select("ticker", (F.col("ts").cast("timestamp_ntz") + F.expr("interval 30 minutes")).alias("ts")), {"n": F.lit(1)}, (24, 72, 168)),
    sql("SELECT ticker, t AS ts, n AS n_24h, n3 AS n_72h, n7 AS n_168h FROM si0", "si0"),
)

define("po", f"SELECT conv_id, turn, TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS created_at, {_hits(tx.SOCIAL_BULLISH, 'text')} AS b, {_hits(tx.SOCIAL_BEARISH, 'text')} AS s FROM conversations")
define("po1", "SELECT *, CASE WHEN sc > 0.2 THEN 'BULL' WHEN sc < -0.2 THEN 'BEAR' ELSE 'NEUTRAL' END AS label FROM (SELECT *, CASE WHEN b + s = 0 THEN 0.0 ELSE round((b - s) / (b + s), 3) END::DOUBLE AS sc FROM po)", "po")
define("pgrid", "SELECT DISTINCT c + to_hours(k) AS t FROM (SELECT CASE WHEN date_trunc('hour', created_at) = created_at THEN created_at ELSE date_trunc('hour', created_at) + INTERVAL 1 HOUR END AS c FROM po), range(0, 168) r(k)", "po")
_ip = "p.created_at > g.t - INTERVAL 24 HOURS"
define(
    "pw",
    f"""SELECT g.t AS ts, count(*) FILTER ({_ip}) AS n, count(*) FILTER ({_ip} AND label = 'BULL') AS bu, count(*) FILTER ({_ip} AND label = 'BEAR') AS be, avg(sc) FILTER ({_ip}) AS m, count(*) AS n7
  FROM pgrid g JOIN po1 p ON p.created_at <= g.t AND p.created_at > g.t - INTERVAL 168 HOURS GROUP BY 1""",
    "pgrid", "po1",
)
register(
    "social_label",
    lambda spark, d: tx.social_label(src.posts(spark, d)).select("conv_id", "turn", "sentiment_score", "sentiment_label"),
    sql("SELECT conv_id, turn, sc AS sentiment_score, label AS sentiment_label FROM po1", "po1"),
)
register(
    "social_aggregate",
    lambda spark, d: tx.social_window(tx.social_label(src.posts(spark, d))).withColumn("ts", F.col("ts").cast("timestamp_ntz")),
    sql(
        """SELECT ts, n AS total_posts_24h, bu AS bull_count, be AS bear_count, round(bu / n, 4) AS bull_ratio, round(be / n, 4) AS bear_ratio, round(m, 4) AS avg_sentiment_score, round(n / greatest(n7 / 7, 1), 4) AS activity_ratio,
    CASE WHEN bu / n >= 0.85 THEN 'CONTRARIAN_BEAR' WHEN be / n >= 0.8 THEN 'CONTRARIAN_BULL' WHEN bu / n >= 0.65 THEN 'MILD_BULL' WHEN be / n >= 0.65 THEN 'MILD_BEAR' ELSE 'NEUTRAL' END AS contrarian_signal,
    round(-(bu / n - 0.5) * 2, 4) AS social_ml_score FROM pw WHERE n > 0""",
        "pw",
    ),
)


def unscored(spark, d):
    """Articles without a quality label."""
    return src.news(spark, d).join(src.table(spark, d, "labels").select("doc_id", F.lit(1).alias("processed")), "doc_id", "left")


register(
    "score_backlog",
    lambda spark, d: tx.backlog(unscored(spark, d), 50, F.col("processed").isNull()).select("doc_id", "ticker", "created_at"),
    sql(
        """SELECT doc_id, ticker, created_at FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY created_at DESC, doc_id DESC) AS k FROM news WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE k <= (SELECT greatest(5, 50 // count(DISTINCT ticker)) FROM news WHERE doc_id NOT IN (SELECT doc_id FROM labels))
  ORDER BY created_at DESC, doc_id DESC LIMIT 50""",
        "news",
    ),
)
register(
    "backlogs",
    lambda spark, d: tx.newest(unscored(spark, d), F.col("processed").isNull(), 50).select("doc_id", "ticker", "created_at"),
    sql("SELECT doc_id, ticker, created_at FROM news WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY created_at DESC, doc_id DESC LIMIT 50", "news"),
)
register(
    "rescore_stale",
    lambda spark, d: tx.rescore_stale(
        tx.lexicon_score(src.table(spark, d, "documents"), "text").withColumn("created_at", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)),
        (F.pmod("n_chars", F.lit(21)) - 10) / 10, F.lit("2024-01-30 00:00:00").cast("timestamp"),
    ).select("doc_id", "sentiment_score", "rescored"),
    sql(
        """SELECT doc_id, CASE WHEN hit THEN nw ELSE sc END::DOUBLE AS sentiment_score, hit::INT AS rescored FROM (SELECT *, abs(sc) < 0.001 AND created_at > TIMESTAMP '2024-01-30' - INTERVAL 30 DAYS AND abs(nw) >= 0.001 AS hit FROM (
    SELECT doc_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, (n_chars % 21 - 10) / 10 AS nw, CASE WHEN b + s = 0 THEN 0.0 ELSE round(greatest(-0.8, least(0.8, (b - s) / (b + s) * 0.75)), 4) END AS sc FROM documents JOIN lex USING (doc_id)))""",
        "lex",
    ),
)
define(
    "cyc",
    """SELECT s.ticker AS source, c.cycle, count(n.doc_id) AS n FROM (SELECT DISTINCT ticker FROM news) s CROSS JOIN (SELECT DISTINCT date_trunc('hour', created_at) AS cycle FROM news) c
  LEFT JOIN news n ON n.ticker = s.ticker AND date_trunc('hour', n.created_at) = c.cycle GROUP BY 1, 2""",
    "news",
)


def cycle_counts(spark, d):
    """Articles per source and hourly cycle, zero where a source brought none."""
    n = src.news(spark, d).withColumn("cycle", F.date_trunc("hour", "created_at").cast("timestamp_ntz"))
    counts = n.groupBy(F.col("ticker").alias("source"), "cycle").agg(F.count(F.lit(1)).alias("n"))
    span = n.select(F.min("cycle").alias("a"), F.max("cycle").alias("b"))
    lo, hi = span.select("a").scalar(), span.select("b").scalar()
    grid = counts.select("source").distinct().select("source", F.explode(F.sequence(lo, hi, F.expr("interval 1 hour"))).alias("cycle"))
    return grid.join(counts, ["source", "cycle"], "left").fillna(0, ["n"])


register(
    "empty_cycle_alarm",
    lambda spark, d: tx.empty_cycles(cycle_counts(spark, d)).select("source", "cycle", "n", F.col("empty_streak").cast("long").alias("empty_streak"), "alarm"),
    sql(
        """SELECT source, cycle, n, CASE WHEN n = 0 THEN row_number() OVER (PARTITION BY source, grp, n = 0 ORDER BY cycle) ELSE 0 END AS empty_streak,
    (n = 0 AND row_number() OVER (PARTITION BY source, grp, n = 0 ORDER BY cycle) >= 2)::INT AS alarm FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cycle) - row_number() OVER (PARTITION BY source, n = 0 ORDER BY cycle) AS grp FROM cyc)""",
        "cyc",
    ),
)

_E = [("src0", "the"), ("src1", "and"), ("src2", "les"), ("src3", "und"), ("src4", "que")]


_NW = "trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
define("nin0", f"SELECT doc_id, created_at, {_NW.format('title')} AS title, {_NW.format('summary')} AS summary FROM news", "news")
define(
    "nin",
    f"""SELECT n.doc_id, k.t AS ticker, ({' OR '.join(f"contains(lower(concat_ws(' ', title, summary)), '{t}')" for t in tx.IMPORTANT)})::INT AS is_important FROM nin0 n JOIN (VALUES {', '.join(map(str, _E))}) k(t, w) ON contains(lower(concat_ws(' ', title, summary)), k.w)
  WHERE created_at > TIMESTAMP '2024-01-05' - INTERVAL 7 DAYS""",
    "nin0",
)


def ingested(spark, d):
    return tx.ingest(src.news(spark, d).drop("ticker"), {n: (w,) for n, w in _E}, F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))


register("semi_keywords", lambda spark, d: ingested(spark, d).select("doc_id", "ticker"), sql("SELECT doc_id, ticker FROM nin", "nin"))
register("news_ingest", lambda spark, d: ingested(spark, d).select("doc_id", "ticker", "is_important"), sql("SELECT doc_id, ticker, is_important FROM nin", "nin"))



KINDS = {"earnings_score": "earnings", "announcement_score": "announcement"}
define("epo", "SELECT sc, label, created_at - INTERVAL 26 YEARS AS created_at FROM po1", "po1")
define(
    "esoc",
    """SELECT t, coalesce(round(-(bu / n - 0.5) * 2, 4), 0) AS social FROM (SELECT g.t, count(*) FILTER (label = 'BULL') AS bu, nullif(count(p.label), 0) AS n FROM (SELECT DISTINCT t FROM bgrid) g
    LEFT JOIN epo p ON p.created_at <= g.t AND p.created_at > g.t - INTERVAL 24 HOURS GROUP BY 1)""",
    "bgrid", "epo",
)
_newest = lambda kind: f"(SELECT ticker, created_at, arg_max(tenths, doc_id) AS v FROM bnews WHERE kind = '{kind}' GROUP BY 1, 2)"
define(
    "eff",
    f"""SELECT w.ticker, g.day AS ts, w.score, w.score_3d, w.momentum, w.news_spike, s.social, coalesce(g.day - r.result_date, 90) AS dse,
    CASE WHEN e.created_at > g.t - INTERVAL 7 DAYS THEN e.v / 10 ELSE 0 END AS es, CASE WHEN a.created_at > g.t - INTERVAL 7 DAYS THEN a.v / 10 ELSE 0 END AS an
  FROM sb w JOIN bgrid g ON g.ticker = w.ticker AND g.t = w.ts JOIN esoc s ON s.t = g.t ASOF LEFT JOIN er0 r ON r.ticker = g.ticker AND g.day >= r.result_date
    ASOF LEFT JOIN {_newest('earnings')} e ON e.ticker = g.ticker AND g.t >= e.created_at ASOF LEFT JOIN {_newest('announcement')} a ON a.ticker = g.ticker AND g.t >= a.created_at""",
    "sb", "bgrid", "esoc", "er0", "bnews",
)


def effect_inputs(spark, d):
    """Each bar as of its close: news windows, the newest earnings and announcement scores of 7 days, days since the last result, the social reading."""
    moments = closes(spark, d)
    x = windows_at_bars(spark, d).join(tx.text_scores_at(src.bar_news(spark, d), moments, KINDS, at="closed_at"), ["ticker", "ts"])
    social = tx.social_window_at(tx.social_label(src.earlier_posts(spark, d)), moments, "closed_at").select(F.col("ts").alias("closed_at"), F.coalesce("social_ml_score", F.lit(0.0)).alias("social_ml_score"))
    x = x.join(social, "closed_at")
    return fd.days_to_earnings(x, fd.surprise(src.earnings(spark, d)))


register(
    "earnings_decay",
    lambda spark, d: tx.earnings_decay(effect_inputs(spark, d)).select("ticker", "ts", "earnings_relevance", "combined_score", "earnings_effect"),
    sql("SELECT ticker, ts, round(greatest(1 - dse / 90, 0), 4) AS earnings_relevance, round(es * 0.7 + an * 0.3, 6) AS combined_score, round(es * greatest(1 - dse / 90, 0), 6) AS earnings_effect FROM eff", "eff"),
)
_c = lambda e, lo=-1, hi=1: f"round(greatest({lo}, least({hi}, {e})), 6)"
SENTIMENT = {
    "news_score_24h": _c("score"), "news_score_trend": _c("score - score_3d", -0.5, 0.5), "news_momentum": _c("momentum", -0.5, 0.5), "news_momentum_3d": _c("score - score_3d", -0.5, 0.5),
    "news_spike_f": "round(least(news_spike, 3) / 3, 4)", "earnings_relevance_f": "round(greatest(1 - dse / 90, 0), 4)", "announcement_score_f": _c("an"), "combined_score_f": _c("es * 0.7 + an * 0.3"), "social_contrarian_score": _c("social"),
}
register(
    "sentiment_features",
    lambda spark, d: tx.features(tx.earnings_decay(effect_inputs(spark, d))).drop("earnings_effect_f"),
    sql(f"SELECT ticker, ts, {', '.join(f'{e} AS {n}' for n, e in SENTIMENT.items())} FROM eff", "eff"),
)
wrap(src.once, "earnings_decay", "sentiment_features")
