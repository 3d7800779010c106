"""Feature assembly: groups side by side per (ticker, ts), quality, training sets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import sanitise
from . import technical as ta
from .registries import Registry

INDICATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}

# Names whose zero is information, not a gap.
FLAG_PREFIXES = ("is_", "chart_", "regime_")
FLAG_SUFFIXES = ("_flag",)
FLAG_NAMES = (
    "price_above_vwap", "absorption_flag", "block_is_buying",
    "promoter_change", "pre_earnings_drift", "consecutive_loss_halt",
    "earnings_risk_flag", "macro_stale", "near_breakout",
    "trade_long", "trade_short",
    "day_of_week_norm", "month_seasonality", "holiday_proximity",
    "portfolio_heat", "monthly_pnl_norm", "monthly_dd_pct",
    "signal_streak_norm", "losing_streak_norm",
    "tf_alignment_score", "direction_consensus",
)


def register_indicator(name: str, builder: Callable[[DataFrame], DataFrame]) -> None:
    """User features: ``builder`` adds columns to the bar frame before assembly."""
    INDICATORS[name] = builder


def wide(base: DataFrame, *groups: DataFrame, keys: tuple[str, ...] = ("ticker", "ts")) -> DataFrame:
    """Feature groups joined on the keys, every number finite (missing = 0)."""
    out = base
    for g in groups:
        out = out.join(g, list(keys), "left")
    numeric = [f.name for f in out.schema.fields if f.name not in keys and f.dataType.simpleString() in ("double", "float", "int", "bigint")]
    return out.withColumns({c: sanitise(c) for c in numeric})


@dataclass(frozen=True)
class Slow:
    """A table that changes less often than bars: ``known`` is the time from which a row may be used, ``key`` None for the whole market.

    A row counts until the next one of its key, and no longer than ``max_age`` days if given.
    """

    rows: DataFrame
    known: str | Column
    values: dict[str, Column | str]
    key: str | None = "ticker"
    max_age: int | None = None


def point_in_time(base: DataFrame, tables: dict[str, Slow], key: str = "ticker", ts: str = "ts") -> DataFrame:
    """Each base row (key, day) with the values of every slow table as of that day, all tables at once.

    The rows of all tables become one table of validity intervals keyed by (table, key), each with its values packed in
    its own struct. Intervals are cut to the span of the base, spread over their days and folded to one row for each (key, day) and one
    for each day of the whole market. So the base, however large, takes part in two equi-joins whatever the number of tables,
    is never sorted, and both joined sides are bounded by names x days. Of several rows on one day the last counts.
    """
    parts = None
    for name, t in tables.items():
        known = F.col(t.known) if isinstance(t.known, str) else t.known
        packed = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in t.values.items()])
        own = t.rows.select(
            F.lit(name).alias("_table"), (F.lit(None).cast("string") if t.key is None else F.col(t.key)).alias("_key"), F.lit(t.key is None).alias("_all"),
            known.cast("timestamp_ntz").alias("_known"), F.lit(t.max_age).cast("int").alias("_age"), packed.alias(name),
        ).where(F.col("_known").isNotNull())
        parts = own if parts is None else parts.unionByName(own, allowMissingColumns=True)
    names = list(tables)
    by = ["_table", "_all", "_key"]
    daily = parts.groupBy(*by, F.col("_known").cast("date").alias("_from"), "_age").agg(F.max_by(F.struct(*names), F.struct("_known", *names)).alias("_v"))
    span = base.agg(F.min(F.col(ts).cast("date")).alias("a"), F.max(F.col(ts).cast("date")).alias("b"))
    lo, hi = span.select("a").scalar(), span.select("b").scalar()
    after = F.lead("_from").over(W.partitionBy(*by).orderBy("_from"))
    cut = daily.withColumn("_next", after).select(
        *by, "_v", F.greatest("_from", lo).alias("_a"),
        F.least(F.coalesce(F.date_sub("_next", 1), hi), hi, F.coalesce(F.date_add("_from", F.col("_age") - 1), hi)).alias("_b"),
    )
    days = cut.where(F.col("_a") <= F.col("_b")).withColumn("_day", F.explode(F.sequence("_a", "_b")))
    folded = days.groupBy("_all", "_key", "_day").agg(*[F.first(F.col("_v")[n], ignorenulls=True).alias(n) for n in names])
    out = base.withColumn("_day", F.col(ts).cast("date"))
    named, market = [n for n, t in tables.items() if t.key is not None], [n for n, t in tables.items() if t.key is None]
    if named:
        out = out.join(folded.where(~F.col("_all")).select(F.col("_key").alias(key), "_day", *named), [key, "_day"], "left")
    if market:
        out = out.join(folded.where("_all").select("_day", *market), "_day", "left")
    return out.select(*base.columns, *[F.col(n)[v].alias(v) for n, t in tables.items() for v in t.values])


def is_flag(name: str) -> bool:
    return name in FLAG_NAMES or name.startswith(FLAG_PREFIXES) or name.endswith(FLAG_SUFFIXES)


def data_quality(df: DataFrame, names: list[str], stale: str | None = None) -> DataFrame:
    """Zero share over continuous features, four grades, stale macro data caps at DEGRADED."""
    used = [n for n in names if not is_flag(n)]
    zeros = sum((F.coalesce(F.col(n) == 0, F.lit(True)).cast("int") for n in used), F.lit(0))
    df = df.withColumn("zero_features", zeros)
    miss = F.col("zero_features") / max(len(used), 1)
    raw = F.when(miss < 0.10, "EXCELLENT").when(miss < 0.25, "GOOD").when(miss < 0.50, "DEGRADED").otherwise("POOR")
    capped = F.when((F.col(stale) == 1) & raw.isin("EXCELLENT", "GOOD"), "DEGRADED").otherwise(raw) if stale else raw
    return df.withColumns({"missing_pct": F.round(miss, 4), "quality": capped, "total_features": F.lit(len(used))})


# Horizon in bars and move threshold per model.
LABELS = {"swing": (5, 0.025), "intraday": (6, 0.004), "positional": (3, 0.05)}


def training_set(wide: DataFrame, bars: DataFrame, registry: Registry, since: str | None = None) -> DataFrame:
    """Features of ``registry`` in its order with the forward label of its model; ``since`` keeps the recent part."""
    horizon, threshold = LABELS[registry.model]
    y = ta.forward_label(bars, horizon, threshold).select("ticker", "ts", "label")
    out = wide.select("ticker", "ts", *registry.columns(wide)).join(y, ["ticker", "ts"]).select("ticker", "ts", "label", *registry.names)
    return out.where(F.col("ts") >= since) if since else out
