"""Bar anomalies: fixed rules per bar, a learned outlier score, severity and action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..functions.scalars import flag

# Action texts by severity.
ACTIONS = {
    "NONE": "NORMAL_TRADING",
    "HIGH": "HALT_NEW_TRADES — review anomaly before next entry",
    "MEDIUM": "REDUCE_SIZE_50% — elevated risk detected",
    "LOW": "CAUTION — monitor closely",
}
FEATURES = ("ret_1d", "ret_abs", "vol_ratio", "range_ratio", "gap", "vol_x_ret")


def rules(df: DataFrame) -> DataFrame:
    """Volume, price-shock, absorption and quiet-gap rules; the last matching rule names the type."""
    w = fw.series()
    span = F.col("high") - F.col("low")
    df = df.withColumns(
        {
            "_ret": fw.pct_change("close", w),
            "volume_spike_ratio": F.col("volume") / F.greatest(fw.roll(F.avg, "volume", w, 20), F.lit(1.0)),
            "_atr": fw.roll(F.avg, span, w, 14),
            "_gap": F.abs((F.col("close") - F.lag("close").over(w)) / F.greatest(F.lag("close").over(w), F.lit(1.0))),
        }
    )
    mu, sd = fw.roll(F.avg, "_ret", w, 20), fw.roll(F.stddev_samp, "_ret", w, 20)
    df = df.withColumn("price_sigma", (F.col("_ret") - mu) / F.greatest(sd, F.lit(0.0001)))
    v = F.col("volume_spike_ratio")
    kind = (
        F.when((F.col("_gap") > 0.04) & (v < 1.0), "LOW_VOL_GAP")
        .when((v > 2.5) & (span < F.col("_atr") * 0.3), "ABSORPTION")
        .when(F.abs("price_sigma") > 3.5, "PRICE_SHOCK")
        .when(v > 5.0, "EXTREME_VOLUME")
        .otherwise("NONE")
    )
    return df.withColumn("anomaly_type", kind).withColumn("rule_anomaly", (F.col("anomaly_type") != "NONE").cast("int")).drop("_ret", "_atr", "_gap")


def features(df: DataFrame) -> DataFrame:
    w = fw.series()
    span = F.col("high") - F.col("low")
    df = df.withColumns(
        {
            "ret_1d": fw.pct_change("close", w),
            "vol_ratio": F.try_divide(F.col("volume") * 20, fw.roll(F.sum, "volume", w, 20)),
            "range_ratio": F.try_divide(span * 14, fw.roll(F.sum, span, w, 14)),
            "gap": F.abs(F.col("close") - F.lag("close").over(w)) / F.lag("close").over(w),
        }
    )
    return df.withColumns({"ret_abs": F.abs("ret_1d")}).withColumn("vol_x_ret", F.col("vol_ratio") * F.col("ret_abs"))


def severity(df: DataFrame, ml_flag: str | None = None) -> DataFrame:
    ml = F.coalesce(F.col(ml_flag), F.lit(0)) if ml_flag else F.lit(0)
    flags = F.col("rule_anomaly") + ml
    v, s = F.coalesce("volume_spike_ratio", F.lit(1.0)), F.abs(F.coalesce("price_sigma", F.lit(0.0)))
    level = F.when((flags >= 2) | (v > 8) | (s > 4), "HIGH").when((flags == 1) | (v > 3) | (s > 2.5), "MEDIUM").otherwise("LOW")
    df = df.withColumns({"is_anomaly": (flags > 0).cast("int"), "severity": level})
    hit = F.col("is_anomaly") == 1
    action = F.when(~hit, ACTIONS["NONE"])
    for name in ("HIGH", "MEDIUM"):
        action = action.when(F.col("severity") == name, ACTIONS[name])
    mult = F.when(hit & (F.col("severity") == "HIGH"), 0.5).when(hit, 0.75).otherwise(1.0)
    return df.withColumns({"recommended_action": action.otherwise(ACTIONS["LOW"]), "position_size_mult": mult})


def outlier_score(df: DataFrame, contamination: float = 0.05) -> DataFrame:
    """Mahalanobis distance in the features' space; the top ``contamination`` share is flagged.

    Covariance comes from one MLlib aggregation (a 6x6 matrix), the cut from an approximate
    quantile aggregate; the scoring itself is a column expression.
    """
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation, Summarizer

    x = features(df).dropna(subset=list(FEATURES))
    vec = VectorAssembler(inputCols=list(FEATURES), outputCol="_v").transform(x)
    corr = Correlation.corr(vec, "_v").head()[0].toArray()
    stats = vec.select(Summarizer.metrics("mean", "std").summary(F.col("_v")).alias("s")).select("s.mean", "s.std").head()
    mean, std = np.array(stats[0].toArray()), np.array(stats[1].toArray())
    std[std == 0] = 1.0
    inverse = np.linalg.pinv(corr)
    z = [(F.col(n) - F.lit(float(m))) / F.lit(float(s)) for n, m, s in zip(FEATURES, mean, std)]
    dist = F.lit(0.0)
    for i in range(len(z)):
        for j in range(len(z)):
            dist = dist + z[i] * z[j] * F.lit(float(inverse[i, j]))
    scored = x.withColumn("ml_score", dist)
    cut = scored.select(F.percentile_approx("ml_score", 1 - contamination, 10000)).scalar()
    return scored.withColumn("ml_anomaly", flag(F.col("ml_score") > cut))
