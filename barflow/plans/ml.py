"""Model and feature-analysis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as fw
from ..operators import assembly as fa
from ..operators import ml
from ..operators import technical as ta
from ..session import scratch
from ..sources import adapters as src
from .assembly import SETS, technical
from .oracle import define, sql
from .registry import register

X = ["returns_1d", "returns_5d", "returns_20d", "close_pct_range", "gap_pct", "range_pct_52w", "volume_ratio", "cmf"]


def labelled(spark, d):
    """Price and volume features with the five-bar label."""
    b = src.bars(spark, d)
    f = ta.price_action(ta.volume(b)).select("ticker", "ts", *X)
    return f.join(ta.forward_label(b, 5, 0.025).select("ticker", "ts", "label", "forward_return"), ["ticker", "ts"])


define("mlx", f"SELECT p.ticker, p.ts, {', '.join(f'coalesce({c}, 0) AS {c}' for c in X)}, label, f FROM tech_price p JOIN tech_volume v USING (ticker, ts) JOIN lab_swing l USING (ticker, ts)", "tech_price", "tech_volume", "lab_swing")
define("mlm", "SELECT label, f, x.feature, x.value FROM mlx, LATERAL (VALUES " + ", ".join(f"('{c}', {c})" for c in X) + ") x(feature, value)", "mlx")

def training_rows(spark, d, model):
    """(rows, names): the history-long training set of a model, with the day on which each label is known; written once, as every fold reads it."""
    names = list(SETS[model, "technical"].names)

    def make():
        horizon, threshold = fa.LABELS[model]
        y = ta.forward_label(src.bars(spark, d), horizon, threshold).select("ticker", "ts", "label", "label_until")
        x = technical(spark, d)
        return x.select("ticker", "ts", *[c for c in names if c in x.columns]).join(y, ["ticker", "ts"])

    rows = src.kept(spark, d, ("training_rows", model), make)
    return rows, [c for c in names if c in rows.columns]


def trained(spark, d):
    """Each model fitted on the first 85 % of the days, with labels known by then, and its confusion on the rest."""
    out = None
    for model in fa.LABELS:
        rows, names = training_rows(spark, d, model)
        past, test = ml.split(rows, ml.hold_out(rows))
        fit = ml.train(past, names, model)
        seen = ml.accuracy(fit.transform(ml.prepare(test, names))).select(F.lit(model).alias("model"), "label", "prediction", "n")
        out = seen if out is None else out.unionByName(seen)
    return out


def validated(spark, d):
    out = None
    for model in fa.LABELS:
        rows, names = training_rows(spark, d, model)
        seen = ml.fold_scores(ml.out_of_fold(rows, names, model)).select(F.lit(model).alias("model"), "fold", "n_train", "n_test", "accuracy")
        out = seen if out is None else out.unionByName(seen)
    return out


def stored(spark, d):
    """A first model of the swing rows, one on more history, and one fitted on shuffled labels, offered to a store in turn: what is stored and what counts."""
    rows, names = training_rows(spark, d, "swing")
    cut, last = ml.stretches(rows, 6)[3:5]
    store, out = ml.ModelStore(spark, scratch(spark)), []
    shuffled = rows.withColumn("label", F.pmod(F.xxhash64("ticker", "ts"), F.lit(3)))
    for name, source, day in (("early", rows, cut), ("later", rows, last), ("shuffled", shuffled, last)):
        fit = ml.train(ml.split(source, day)[0], names, "swing")
        test = ml.split(rows, last)[1]
        score = ml.fold_scores(fit.transform(ml.prepare(test, names)).withColumns({"fold": F.lit(0), "n_train": F.lit(0)})).first()["accuracy"]
        accepted = store.offer(fit, score)
        out.append((name, float(score), accepted, store.current()["version"]))
    return spark.createDataFrame(out, "model string, score double, accepted boolean, current_version int")


register("train_classifier", src.once(trained))
register("time_series_cv", src.once(validated))
register("model_store", src.once(stored))
define("fs0", "SELECT b.ticker, b.ts, l.label, lead(b.ts, 5) OVER (PARTITION BY b.ticker ORDER BY b.ts) AS until FROM bars b LEFT JOIN lab_swing l USING (ticker, ts)", "bars", "lab_swing")
define("fs1", "SELECT CAST(part AS INT) AS fold, min(ts) AS a, max(ts) AS b FROM (SELECT ts, ntile(11) OVER (ORDER BY ts) - 1 AS part FROM (SELECT DISTINCT ts FROM fs0 WHERE label IS NOT NULL)) WHERE part > 0 GROUP BY 1", "fs0")
register(
    "fold_sizes",
    src.once(lambda spark, d: _sizes(spark, d)),
    sql(
        """SELECT fold, count(*) FILTER (t.ts < a AND until < a) AS n_train, count(*) FILTER (t.ts < a AND until >= a) AS kept_out, count(*) FILTER (t.ts BETWEEN a AND b) AS n_test
  FROM fs1, (SELECT * FROM fs0 WHERE label IS NOT NULL) t GROUP BY 1""",
        "fs0", "fs1",
    ),
)


def _sizes(spark, d):
    """Rows that train, are kept out and test in each fold of the swing model."""
    rows, _ = training_rows(spark, d, "swing")
    starts = ml.stretches(rows, ml.FOLDS["swing"])
    folds = [{"fold": k, "a": a, "b": b} for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False), 1)]
    early, known = F.col("ts") < F.col("a"), F.col("label_until") < F.col("a")
    counts = [F.count_if(early & known).alias("n_train"), F.count_if(early & ~known).alias("kept_out"), F.count_if(~early & (F.col("ts") < F.col("b"))).alias("n_test")]
    own = F.array(*[F.struct(F.lit(r["fold"]).alias("fold"), F.lit(r["a"]).alias("a"), F.lit(r["b"]).alias("b")) for r in folds])
    return rows.withColumn("_f", F.explode(own)).select("ts", "label_until", "_f.*").groupBy("fold").agg(*counts)


register(
    "balanced_weights",
    lambda spark, d: ml.balanced_weights(labelled(spark, d)).groupBy("label").agg(F.round(F.max("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n")),
    sql("SELECT label, round(sum(count(*)) OVER () / (3 * count(*)), 6) AS weight, count(*) AS n FROM mlx GROUP BY label", "mlx"),
)


def _calibrated(spark, d):
    rows = src.kept(spark, d, ("labelled",), lambda: labelled(spark, d))  # the forest and the three calibrations read them again and again
    x = ml.prepare(rows, X)
    day = x.agg(F.percentile_approx(F.unix_date("ts"), 0.85).alias("day")).first()["day"]  # the last 15 % calibrate
    cut = F.date_from_unix_date(F.lit(day))
    fit = ml.classifier(X, 20, 4).fit(x.where(F.col("ts") < cut))
    out = ml.calibrate(fit.transform(x.where(F.col("ts") >= cut)))
    return out.select("ticker", "ts", "label", *[F.round(f"cal_{k}", 6).alias(f"cal_{k}") for k in range(3)])


register("calibrate", src.once(_calibrated))


def _scores(spark, d):
    """Share of entries on the right side of each category, in the last year (new) and the one before (old)."""
    x = src.ledger(spark, d).select(F.col("category").alias("model"), F.year("close_date").alias("y"), (F.col("pnl_points") > 0).cast("int").alias("hit"))
    last = x.select(F.max("y")).scalar()
    share = lambda y: F.round(F.avg(F.when(F.col("y") == y, F.col("hit"))), 6)
    return x.groupBy("model").agg(share(last).alias("new"), share(last - 1).alias("old"))


register(
    "replace_if_not_worse",
    lambda spark, d: ml.replacements(_scores(spark, d)),
    sql(
        """SELECT *, old IS NULL OR new >= old - 0.01 AS replaced FROM (SELECT category AS model, round(avg((pnl_points > 0)::INT) FILTER (year(close_date) = (SELECT max(year(close_date)) FROM ledger)), 6) AS new,
    round(avg((pnl_points > 0)::INT) FILTER (year(close_date) = (SELECT max(year(close_date)) FROM ledger) - 1), 6) AS old FROM ledger GROUP BY 1)""",
        "ledger",
    ),
)
register("importance_rank", lambda spark, d: ml.importance(ml.train(labelled(spark, d), X), X, spark))
define("ive", "SELECT feature, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e, count(*) FILTER (label = 2) AS g, count(*) FILTER (label = 0) AS b, count(*) AS n FROM mlm WHERE label <> 1 GROUP BY 1", "mlm")
define("ivb", "SELECT m.feature, e.g, e.b, len(list_filter(e.e, lambda q: m.value > q)) AS bin, count(*) FILTER (label = 2) AS good, count(*) FILTER (label = 0) AS bad FROM mlm m JOIN ive e USING (feature) WHERE label <> 1 GROUP BY ALL", "mlm", "ive")
define("ivv", "SELECT feature, round(sum(((good + 0.5) / (g + 0.5) - (bad + 0.5) / (b + 0.5)) * ln((good + 0.5) / (g + 0.5) / ((bad + 0.5) / (b + 0.5)))), 6) AS iv FROM ivb GROUP BY 1", "ivb")
register(
    "information_value",
    lambda spark, d: ml.information_value(labelled(spark, d), X),
    sql("SELECT feature, iv, CASE WHEN iv < 0.02 THEN 'DROP' WHEN iv < 0.1 THEN 'WEAK' WHEN iv < 0.3 THEN 'MEDIUM' WHEN iv < 0.6 THEN 'STRONG' ELSE 'SUSPICIOUS' END AS grade FROM ivv", "ivv"),
)
register("variance_filter", lambda spark, d: ml.variance_filter(labelled(spark, d), X), sql("SELECT feature, round(var_samp(value), 6) AS variance, var_samp(value) > 0.001 AS keep FROM mlm GROUP BY 1", "mlm"))
define("crp", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c, var_samp({a}) AS va, var_samp({b}) AS vb FROM mlx" for i, a in enumerate(X) for b in X[i + 1:]), "mlx")
register("correlation_filter", lambda spark, d: ml.correlation_pairs(labelled(spark, d), X, 0.3), sql("SELECT a, b, round(c, 6) AS corr, CASE WHEN va >= vb THEN b ELSE a END AS drop FROM crp WHERE abs(c) > 0.3", "crp"))
register(
    "ic_table",
    lambda spark, d: ml.ic_table(labelled(spark, d), X),
    sql("""SELECT feature, round(corr(value, f), 6) AS ic, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(avg((value <> 0)::INT), 6) AS non_zero, round(avg(f) FILTER (value > 0), 6) AS ret_if_positive, round(avg(f) FILTER (value < 0), 6) AS ret_if_negative FROM mlm GROUP BY 1""", "mlm"),
)
define("rp0", "SELECT ticker, ts, close / lag(close) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS r FROM bars", "bars")
register(
    "return_profile",
    lambda spark, d: ml.return_profile(src.bars(spark, d)),
    sql("SELECT ticker, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(skewness(r), 4) AS skew, round(kurtosis(r), 4) AS kurtosis, round(min(r), 6) AS worst, round(max(r), 6) AS best FROM rp0 WHERE r IS NOT NULL GROUP BY 1", "rp0"),
)
register("return_seasonality", lambda spark, d: ml.seasonality(src.bars(spark, d)), sql("SELECT ticker, CAST(month(ts) AS INT) AS month, round(avg(r), 6) AS mean, round(avg((r > 0)::INT), 6) AS up_share, count(r) AS n FROM rp0 WHERE r IS NOT NULL GROUP BY 1, 2", "rp0"))
register(
    "label_sensitivity",
    lambda spark, d: ml.label_sensitivity(src.bars(spark, d), (3, 5, 10), (0.01, 0.025, 0.05)),
    sql("""SELECT horizon, threshold, count(*) AS n, round(avg((r > threshold)::INT), 6) AS long_share, round(avg((r < -threshold)::INT), 6) AS short_share FROM (SELECT h.horizon, CASE h.horizon WHEN 3 THEN f3 WHEN 5 THEN f5 ELSE f10 END AS r FROM (SELECT lead(close, 3) OVER w / close - 1 AS f3, lead(close, 5) OVER w / close - 1 AS f5, lead(close, 10) OVER w / close - 1 AS f10 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
    (VALUES (3), (5), (10)) h(horizon)), (VALUES (0.01::DOUBLE), (0.025), (0.05)) t(threshold) WHERE r IS NOT NULL GROUP BY 1, 2""", "bars"),
)
