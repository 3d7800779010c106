"""Market regime per bar: one-hot classes, named regime, stability, confirmation, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..functions.scalars import lookup

BULL, BEAR, HIGH_VOL, CHOPPY = "BULL_TRENDING", "BEAR_TRENDING", "HIGH_VOLATILITY", "CHOPPY_SIDEWAYS"
REGIMES = (BULL, BEAR, HIGH_VOL, CHOPPY)

# Classification thresholds.
ADX_TREND, ADX_HIGH_VOL, EMA_TREND, EMA_OVERRIDE, R5_HIGH_VOL = 22.0, 30.0, 0.01, 0.015, 0.025
HOLD_STABILITY = 0.34
CONFIRM = 3

# Trading rules per regime (long, short, size, days, stop).
RULES = {
    BULL: (True, False, 1.2, 21, 1.5),
    BEAR: (False, True, 1.0, 4, 1.2),
    HIGH_VOL: (True, True, 0.5, 2, 2.0),
    CHOPPY: (False, False, 0.0, 0, 1.0),
}


def classify(df: DataFrame, adx: str = "adx", spread: str = "ema_spread", r5: str = "returns_5d") -> DataFrame:
    a, e, r = (F.coalesce(F.col(c), F.lit(0.0)) for c in (adx, spread, r5))
    bear = ((a > ADX_TREND) & (e < -EMA_TREND)) | (e < -EMA_OVERRIDE)
    bull = ((a > ADX_TREND) & (e > EMA_TREND)) | (e > EMA_OVERRIDE)
    hv = (a > ADX_HIGH_VOL) & (F.abs(r) > R5_HIGH_VOL)
    return df.withColumns(
        {
            "regime_bull": bull.cast("int"),
            "regime_bear": bear.cast("int"),
            "regime_high_vol": hv.cast("int"),
            "regime_choppy": (~bull & ~bear & ~hv).cast("int"),
        }
    )


def name(df: DataFrame) -> DataFrame:
    label = (
        F.when(F.col("regime_high_vol") == 1, HIGH_VOL).when(F.col("regime_bear") == 1, BEAR).when(F.col("regime_bull") == 1, BULL).otherwise(CHOPPY)
    )
    return df.withColumn("regime", label)


def stability(df: DataFrame, window: int = 10, min_rows: int = 3) -> DataFrame:
    """Share of the last ``window`` bars in the current regime: one conditional sum per regime."""
    frame = fw.trailing(fw.series(), window)
    same = F.lit(0)
    for r in REGIMES:
        same = same + F.when(F.col("regime") == r, F.sum((F.col("regime") == r).cast("int")).over(frame)).otherwise(0)
    n = F.count(F.lit(1)).over(frame)
    return df.withColumn("stability", F.when(n >= min_rows, same / n).otherwise(0.5))


def persist(df: DataFrame, key: str = "ticker", order: str = "ts", raw: str = "regime") -> DataFrame:
    """Committed regime: a change takes hold after three equal readings, at once into high volatility.

    A reading commits when it is the first, a volatility spike, or equals its two predecessors;
    the committed regime is the last committing reading.  (Equal to the sequential rule: a reading
    equal to the committed one leaves it unchanged either way.)
    """
    w = fw.series(key, order)
    x = F.col(raw)
    commit = F.lag(raw).over(w).isNull() | (x == HIGH_VOL) | ((x == F.lag(raw).over(w)) & (x == F.lag(raw, 2).over(w)))
    df = df.withColumn("_commit", F.when(F.coalesce(commit, F.lit(False)), x))
    df = df.withColumn("committed_regime", F.last("_commit", ignorenulls=True).over(fw.running(w)))
    return df.withColumn("held", (F.col("committed_regime") != x).cast("int")).drop("_commit")


def probabilities(df: DataFrame, regime: str = "regime", mass=None) -> DataFrame:
    m = F.greatest(F.col("stability"), F.lit(0.25)) if mass is None else mass
    rest = F.greatest((1 - m) / 3, F.lit(0.0))
    cols = {"bull_prob": BULL, "bear_prob": BEAR, "high_vol_prob": HIGH_VOL, "choppy_prob": CHOPPY}
    return df.withColumns({c: F.round(F.when(F.col(regime) == r, m).otherwise(rest), 3) for c, r in cols.items()})


def trend(df: DataFrame, days: int = 10) -> DataFrame:
    """Changes, dominant regime and steadiness over the trailing ``days`` calendar days."""
    w = fw.series()
    span = fw.series("ticker", F.unix_date(F.to_date("ts"))).rangeBetween(-days, 0)
    df = df.withColumn("_chg", F.coalesce((F.col("regime") != F.lag("regime").over(w)).cast("int"), F.lit(0)))
    counts = {f"_n{i}": F.sum((F.col("regime") == r).cast("int")).over(span) for i, r in enumerate(REGIMES)}
    first = F.first("_chg").over(span)
    df = df.withColumns({**counts, "regime_changes": F.sum("_chg").over(span) - first, "_n": F.count(F.lit(1)).over(span)})
    top = F.greatest(*counts)
    dominant = None
    for i, r in enumerate(REGIMES):
        hit = F.col(f"_n{i}") == top
        dominant = F.when(hit, r) if dominant is None else dominant.when(hit, r)
    df = df.withColumns({"dominant_regime": dominant, "regime_stable": (F.col("regime_changes") <= 1).cast("int")})
    return df.drop("_chg", "_n", *counts)


def rules_table(spark: SparkSession):
    rows = [(r, *v) for r, v in RULES.items()]
    return spark.createDataFrame(rows, "regime string, trade_long boolean, trade_short boolean, position_mult double, max_hold_days int, stop_mult double")


def with_rules(df: DataFrame, regime: str = "regime") -> DataFrame:
    """Adds the rule columns.  Four fixed rows: a literal lookup, no join."""
    names = ("trade_long", "trade_short", "position_mult", "max_hold_days", "stop_mult")
    return df.withColumns({n: lookup(regime, {r: v[i] for r, v in RULES.items()}, RULES[CHOPPY][i]) for i, n in enumerate(names)})


def rule_fallback(df: DataFrame) -> DataFrame:
    """EMA stack + sign consistency + realised volatility, for series without a trained model."""
    w = fw.series()
    df = fw.ewm(df, {"_e20": ("close", 20, True), "_e50": ("close", 50, True)})
    df = df.withColumn("_ret", fw.pct_change("close", w))
    annual = F.sqrt(F.lit(252.0)) * 100
    df = df.withColumns(
        {
            "consistency": F.abs(fw.roll(F.avg, F.signum("_ret"), w, 14)),
            "hv10": fw.roll(F.stddev_samp, "_ret", w, 10) * annual,
            "hv30": fw.roll(F.stddev_samp, "_ret", w, 30) * annual,
        }
    )
    enough = F.row_number().over(w) >= 31
    high = ((F.col("hv10") > 28) | (F.col("hv10") / F.greatest("hv30", F.lit(1.0)) > 1.6)) & (F.col("hv10") > 30)
    strong = F.col("consistency") > 0.35
    up = (F.col("close") > F.col("_e20")) & (F.col("_e20") > F.col("_e50"))
    down = (F.col("close") < F.col("_e20")) & (F.col("_e20") < F.col("_e50"))
    label = F.when(~enough, CHOPPY).when(high, HIGH_VOL).when(up & strong, BULL).when(down & strong, BEAR).otherwise(CHOPPY)
    return df.withColumn("rule_regime", label).drop("_e20", "_e50", "_ret")


def ml_features(df: DataFrame) -> DataFrame:
    """One-hot, permissions and size multiplier of the named regime."""
    hot = {"is_bull": BULL, "is_bear": BEAR, "is_high_vol": HIGH_VOL, "is_choppy": CHOPPY}
    df = df.withColumns({n: (F.col("regime") == r).cast("int") for n, r in hot.items()})
    df = with_rules(df)
    return df.withColumns({"allows_long": F.col("trade_long").cast("int"), "allows_short": F.col("trade_short").cast("int")})


def clusters(df: DataFrame, k: int = 4, seed: int = 42, confirm: int = 3) -> DataFrame:
    """Gaussian-mixture states on (return, 10-bar vol, vol ratio), named by state mean.

    Highest mean volatility = high volatility; of the rest, the extreme mean returns are bull and
    bear; the remaining state is choppy.  The reported regime is the majority of the last three.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    w = fw.series()
    x = df.withColumn("_ret", F.log(F.col("close") / F.lag("close").over(w)))
    x = x.withColumns({"_vol": fw.roll(F.stddev_samp, "_ret", w, 10), "_vr": F.try_divide(fw.roll(F.avg, "volume", w, 5), fw.roll(F.avg, "volume", w, 20))})
    x = x.dropna(subset=["_ret", "_vol", "_vr"])
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=["_ret", "_vol", "_vr"], outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
            GaussianMixture(k=k, seed=seed, predictionCol="state"),
        ]
    ).fit(x)
    x = model.transform(x)
    means = x.groupBy("state").agg(F.avg("_ret").alias("r"), F.avg("_vol").alias("v")).collect()  # k rows
    by_vol = sorted(means, key=lambda m: -m["v"])
    rest = sorted(by_vol[1:], key=lambda m: m["r"])
    names = {by_vol[0]["state"]: HIGH_VOL}
    if rest:
        names[rest[-1]["state"]] = BULL
    if len(rest) > 1:
        names[rest[0]["state"]] = BEAR
    x = x.withColumn("raw_regime", lookup("state", names, CHOPPY))
    frame = fw.trailing(w, confirm)
    return x.withColumn("regime", F.mode("raw_regime", deterministic=True).over(frame)).select("ticker", "ts", "state", "raw_regime", "regime")
