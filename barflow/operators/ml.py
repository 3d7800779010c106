"""Model training and feature analysis on MLlib and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import finite_or


def melt(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Wide features to (feature, value) rows, so that one aggregate serves all of them."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), finite_or(n).alias("value")) for n in names])
    return df.select(*keep, F.explode(pairs).alias("z")).select(*keep, "z.feature", "z.value")


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (k * n_class): class counts are one small aggregate joined back."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total, k = counts.select(F.sum("_c")).scalar(), counts.select(F.count(F.lit(1))).scalar()
    return df.join(counts, label).withColumn("weight", total / (k * F.col("_c"))).drop("_c")


def classifier(names: list[str], trees: int = 20, depth: int = 4, seed: int = 42):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(
        stages=[
            VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"),
            RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed),
        ]
    )


# Fixed values: (trees, depth) per model, shallow against over-fitting; folds of its validation.
PARAMETERS = {"swing": (20, 4), "positional": (15, 3), "intraday": (20, 4)}
FOLDS = {"swing": 10, "positional": 5, "intraday": 5}


def prepare(df: DataFrame, names: list[str]) -> DataFrame:
    return balanced_weights(df.withColumns({n: finite_or(n) for n in names}).withColumn("label", F.col("label").cast("double")))


def train(df: DataFrame, names: list[str], model: str = "swing"):
    trees, depth = PARAMETERS[model]
    return classifier(names, trees, depth).fit(prepare(df, names))


def accuracy(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def stretches(df: DataFrame, folds: int, ts: str = "ts") -> list:
    """First day of each of the ``folds`` test stretches, then the day after the last: the days are cut into ``folds`` + 1 equal parts."""
    days = df.select(F.col(ts).cast("date").alias("day")).distinct().withColumn("part", F.ntile(folds + 1).over(W.partitionBy(F.lit(0)).orderBy("day")) - 1)
    rows = days.groupBy("part").agg(F.min("day").alias("a"), F.date_add(F.max("day"), 1).alias("b")).orderBy("part").collect()
    return [r["a"] for r in rows if r["part"] > 0] + [rows[-1]["b"]] if len(rows) > 1 else []


def split(df: DataFrame, start, end=None, ts: str = "ts", until: str = "label_until") -> tuple[DataFrame, DataFrame]:
    """(training, test): test rows lie in [start, end); of the earlier rows those train whose label was known before ``start``."""
    test = df.where(F.col(ts) >= F.lit(start))
    return df.where((F.col(ts) < F.lit(start)) & (F.col(until) < F.lit(start))), test.where(F.col(ts) < F.lit(end)) if end is not None else test


def hold_out(df: DataFrame, share: float = 0.15, ts: str = "ts"):
    """The day from which on the last ``share`` of the days lie."""
    days = stretches(df, round(1 / share) - 1, ts)
    return days[-2] if len(days) > 1 else None


def out_of_fold(df: DataFrame, names: list[str], model: str = "swing", folds: int | None = None, ts: str = "ts", until: str = "label_until") -> DataFrame:
    """Predictions for every row of the test stretches, each by a model that has seen only labels known before its stretch began.

    The training part grows from stretch to stretch and is never shuffled in time; a label looks ahead by its horizon, so rows whose
    label reaches into the stretch are kept out (an embargo of the label's own length). Adds ``fold``, ``n_train``, ``prediction`` and ``probability``.
    """
    starts = stretches(df, folds or FOLDS[model], ts)
    out = None
    for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False), 1):  # a handful of fits
        past, test = split(df, a, b, ts, until)
        n = past.count()
        if not n:
            continue
        fit = train(past, names, model)
        rows = fit.transform(test.withColumns({c: finite_or(c) for c in names}).withColumn("label", F.col("label").cast("double")))
        rows = rows.withColumns({"fold": F.lit(k), "n_train": F.lit(n).cast("long")}).drop("features", "rawPrediction")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else df.limit(0).withColumns({"fold": F.lit(0), "n_train": F.lit(0).cast("long"), "prediction": F.lit(0.0)})


def fold_scores(predicted: DataFrame) -> DataFrame:
    right = (F.col("label") == F.col("prediction")).cast("double")
    return predicted.groupBy("fold").agg(F.max("n_train").alias("n_train"), F.count(F.lit(1)).alias("n_test"), F.round(F.avg(right), 6).alias("accuracy"))


def calibrate(pred: DataFrame, classes: int = 3, method: str = "isotonic") -> DataFrame:
    """Per-class calibration on (label, probability), clipped to 1e-4 and renormalised.

    ``method``: ``isotonic`` (for 150 rows or more) or ``logistic``; the caller decides. The isotonic
    fit sees probabilities in thousandths with their weights, so at most 1,001 rows a class, whatever the input.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    p = vector_to_array("probability")
    x = pred.withColumns({f"raw_{k}": p[k] for k in range(classes)})
    for k in range(classes):
        y = (F.col("label") == k).cast("double")
        if method == "isotonic":
            binned = x.groupBy(F.round(f"raw_{k}", 3).alias(f"raw_{k}")).agg(F.avg(y).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
            fit = IsotonicRegression(featuresCol=f"raw_{k}", labelCol="_y", weightCol="_w", predictionCol=f"cal_{k}").fit(binned)
            x = fit.transform(x)
        else:
            vec = VectorAssembler(inputCols=[f"raw_{k}"], outputCol="_v")
            fit = LogisticRegression(featuresCol="_v", labelCol="_y", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_q").fit(vec.transform(x.withColumn("_y", y)))
            x = fit.transform(vec.transform(x)).withColumn(f"cal_{k}", vector_to_array("_p")[1]).drop("_v", "_p", "_r", "_q")
    clipped = {f"cal_{k}": F.greatest(F.col(f"cal_{k}"), F.lit(1e-4)) for k in range(classes)}
    x = x.withColumns(clipped)
    total = sum((F.col(f"cal_{k}") for k in range(1, classes)), F.col("cal_0"))
    return x.withColumn("_t", total).withColumns({f"cal_{k}": F.col(f"cal_{k}") / F.col("_t") for k in range(classes)}).drop("_t")


def not_worse(new: float, old: float | None, slack: float = 0.01) -> bool:
    """Whether a freshly trained model may replace the stored one."""
    return old is None or new >= old - slack


def replacements(scores: DataFrame, slack: float = 0.01) -> DataFrame:
    """Which freshly trained models replace the stored ones: rows with ``new`` and ``old`` score (null: none stored)."""
    return scores.withColumn("replaced", F.col("old").isNull() | (F.col("new") >= F.col("old") - slack))


class ModelStore:
    """Versions of a model in the shared folder and which one counts.

    A model is written under a number of its own first. Only if its score is not worse than that of the current one does a pointer file with that
    number appear, which is one atomic step; until then, and after a write that broke off, the old model stays current.
    """

    def __init__(self, spark, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        found = self.fs.globStatus(self.path(f"{self.base}/{kind}-*")) or []
        return sorted(int(s.getPath().getName().split("-")[1]) for s in found)

    def current(self) -> dict | None:
        """version, score and path of the model that counts."""
        pointers = self._numbers("current")
        if not pointers:
            return None
        score = self.spark.read.text(f"{self.base}/current-{pointers[-1]}").first()["value"]
        return {"version": pointers[-1], "score": float(score), "path": f"{self.base}/model-{pointers[-1]}"}

    def load(self):
        from pyspark.ml import PipelineModel

        now = self.current()
        return PipelineModel.load(now["path"]) if now else None

    def offer(self, model, score: float, slack: float = 0.01) -> bool:
        """Stores the model if none counts or its score is at most ``slack`` below; whether it now counts."""
        now = self.current()
        if not not_worse(score, now["score"] if now else None, slack):
            return False
        version = max([0, *self._numbers("model"), *self._numbers("current")]) + 1
        model.write().save(f"{self.base}/model-{version}")
        out = self.fs.create(self.path(f"{self.base}/.next-{version}"), True)
        out.write(bytearray(repr(float(score)).encode()))
        out.close()
        return bool(self.fs.rename(self.path(f"{self.base}/.next-{version}"), self.path(f"{self.base}/current-{version}")))

    def forget(self, keep: int = 2) -> None:
        """Deletes all but the newest ``keep`` models that counted, and what never did."""
        counted = self._numbers("current")[-keep:]
        for kind in ("current", "model"):
            for n in self._numbers(kind):
                if n not in counted:
                    self.fs.delete(self.path(f"{self.base}/{kind}-{n}"), True)


def information_value(df: DataFrame, names: list[str], bins: int = 10, min_rows: int = 50) -> DataFrame:
    """IV of LONG against SHORT per feature over quantile bins with half-count smoothing; grade."""
    x = melt(df.where(F.col("label") != 1), names, ["label"])
    probs = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    edges = x.groupBy("feature").agg(
        F.array_distinct(F.percentile("value", probs)).alias("edges"), F.count_if(F.col("label") == 2).alias("good_all"), F.count_if(F.col("label") == 0).alias("bad_all"), F.count_if(F.col("label") >= 0).alias("n_all"), F.min("value").alias("_lo"), F.max("value").alias("_hi"),
    )
    binned = x.join(edges, "feature").withColumn("bin", F.size(F.filter("edges", lambda e: F.col("value") > e)))
    b = binned.groupBy("feature", "bin", "good_all", "bad_all", "n_all", "_lo", "_hi").agg(F.count_if(F.col("label") == 2).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    pg = (F.col("good") + 0.5) / (F.greatest("good_all", F.lit(1)) + 0.5)
    pb = (F.col("bad") + 0.5) / (F.greatest("bad_all", F.lit(1)) + 0.5)
    iv = b.groupBy("feature", "n_all", "_lo", "_hi").agg(F.sum((pg - pb) * F.log(pg / pb)).alias("iv"))
    iv = iv.select("feature", F.round(F.when((F.col("n_all") < min_rows) | (F.col("_lo") == F.col("_hi")), 0.0).otherwise(F.col("iv")), 6).alias("iv"))
    v = F.col("iv")
    return iv.withColumn("grade", F.when(v < 0.02, "DROP").when(v < 0.10, "WEAK").when(v < 0.30, "MEDIUM").when(v < 0.60, "STRONG").otherwise("SUSPICIOUS"))


def variance_filter(df: DataFrame, names: list[str], threshold: float = 0.001) -> DataFrame:
    x = melt(df, names, []).groupBy("feature").agg(F.var_samp("value").alias("variance"))
    return x.select("feature", F.round("variance", 6).alias("variance"), (F.col("variance") > threshold).alias("keep"))


def correlation_pairs(df: DataFrame, names: list[str], threshold: float = 0.85) -> DataFrame:
    """Feature pairs too close to each other, and which one goes: the one with the lower variance.

    All pair correlations come out of one aggregate over the wide rows.
    """
    x = df.select(*[finite_or(n).alias(n) for n in names])
    aggs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb")).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    row = x.agg(*aggs)
    pairs = row.select(F.explode(F.array(*row.columns)).alias("z")).select("z.*").where(F.abs("corr") > threshold)
    return pairs.select("a", "b", F.round("corr", 6).alias("corr"), F.when(F.col("va") >= F.col("vb"), F.col("b")).otherwise(F.col("a")).alias("drop"))


def importance(model, names: list[str], spark, min_share: float = 0.0, cap: int = 50) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, model.stages[-1].featureImportances.toArray())]
    x = spark.createDataFrame(rows, "feature string, importance double").where(F.col("importance") >= min_share)
    return x.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature"))).where(F.col("rank") <= cap)


def ic_table(df: DataFrame, names: list[str], target: str = "forward_return") -> DataFrame:
    """Correlation with the forward return, spread, and the return by the feature's sign."""
    x = melt(df, names, [target])
    y, v = F.col(target), F.col("value")
    return x.groupBy("feature").agg(
        F.round(F.coalesce(F.corr(v, y), F.lit(0.0)), 6).alias("ic"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.round(F.avg((v != 0).cast("double")), 6).alias("non_zero"),
        F.round(F.avg(F.when(v > 0, y)), 6).alias("ret_if_positive"), F.round(F.avg(F.when(v < 0, y)), 6).alias("ret_if_negative"),
    )


def return_profile(bars: DataFrame) -> DataFrame:
    """Moments and extremes of daily returns per name (bias-corrected skewness and excess kurtosis)."""
    from ..functions import windows as fw

    x = bars.withColumn("r", fw.pct_change("close", fw.series())).where(F.col("r").isNotNull())
    n = F.count("r").cast("double")
    skew = F.skewness("r") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.kurtosis("r") + 6) * (n - 1) / ((n - 2) * (n - 3))
    return x.groupBy("ticker").agg(F.count("r").alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.stddev_samp("r"), 6).alias("std"), F.round(skew, 4).alias("skew"), F.round(kurt, 4).alias("kurtosis"), F.round(F.min("r"), 6).alias("worst"), F.round(F.max("r"), 6).alias("best"))


def seasonality(bars: DataFrame) -> DataFrame:
    from ..functions import windows as fw

    x = bars.withColumn("r", fw.pct_change("close", fw.series())).where(F.col("r").isNotNull())
    return x.groupBy("ticker", F.month("ts").alias("month")).agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.avg((F.col("r") > 0).cast("double")), 6).alias("up_share"), F.count("r").alias("n"))


def label_sensitivity(bars: DataFrame, horizons: tuple[int, ...], thresholds: tuple[float, ...]) -> DataFrame:
    """Label shares for every horizon and threshold: the rows are fanned out over the parameters once."""
    from ..functions import windows as fw

    w = fw.series()
    fwd = F.array(*[F.struct(F.lit(h).alias("horizon"), (F.lead("close", h).over(w) / F.col("close") - 1).alias("r")) for h in horizons])
    x = bars.select(fwd.alias("_f")).select(F.explode("_f").alias("z")).select("z.*").where(F.col("r").isNotNull())
    x = x.select("horizon", "r", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return x.groupBy("horizon", "threshold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("r") > F.col("threshold")).cast("double")), 6).alias("long_share"), F.round(F.avg((F.col("r") < -F.col("threshold")).cast("double")), 6).alias("short_share"))
