"""Sizing, exposure, breaker and risk context as expressions; admission as a small ordered fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..functions.scalars import lookup

# Capital modes and ATR geometry.
MODES = {
    "SMALL": {"max_risk_pct": 0.010, "max_positions": 2, "max_same_dir_cluster": 1, "monthly_halt_pct": 0.05},
    "GROWING": {"max_risk_pct": 0.015, "max_positions": 3, "max_same_dir_cluster": 2, "monthly_halt_pct": 0.08},
    "FULL": {"max_risk_pct": 0.020, "max_positions": 5, "max_same_dir_cluster": 3, "monthly_halt_pct": 0.10},
}
CATEGORY_ATR = {"intraday": (1.0, 2.5), "swing": (2.0, 5.0), "positional": (2.5, 6.5)}
DRAWDOWN_STEPS = ((-0.06, 0.25), (-0.04, 0.50), (-0.02, 0.75), (0.00, 1.00))
BREAKER = {"SMALL": (0.02, 0.05, 0.08), "GROWING": (0.03, 0.08, 0.12), "FULL": (0.04, 0.10, 0.15)}
MAX_NET, MAX_NAME, MAX_TOTAL = 0.60, 0.40, 0.80
ROUND_TRIP_COST = 0.002


def capital_mode(capital: Column) -> Column:
    return F.when(capital < 50_000, "SMALL").when(capital < 200_000, "GROWING").otherwise("FULL")


def mode_value(field: str, mode: str = "capital_mode") -> Column:
    return lookup(mode, {m: v[field] for m, v in MODES.items()}, MODES["FULL"][field])


def drawdown_mult(dd: Column) -> Column:
    out = None
    for limit, mult in DRAWDOWN_STEPS:
        out = F.when(dd <= limit, mult) if out is None else out.when(dd <= limit, mult)
    return out.otherwise(1.0)


def position_size(df: DataFrame) -> DataFrame:
    """ATR stop and target, whole shares, 40 % cap.  Invalid price, ATR or risk gives zeros.

    Expects direction, capital, current_price, atr, size_mult, capital_mode, category,
    monthly_dd_pct, event_mult.
    """
    price, atr, cap = F.col("current_price"), F.col("atr"), F.col("capital")
    stop_m, target_m = lookup("category", {k: v[0] for k, v in CATEGORY_ATR.items()}, 2.5), lookup("category", {k: v[1] for k, v in CATEGORY_ATR.items()}, 6.0)
    bound = lambda c, hi: F.least(F.greatest(c, F.lit(0.0)), F.lit(hi))
    df = df.withColumn("dd_mult", drawdown_mult(F.col("monthly_dd_pct")))
    df = df.withColumn("effective_mult", bound(F.col("size_mult"), 1.5) * F.col("dd_mult") * bound(F.col("event_mult"), 1.0))
    df = df.withColumns(
        {
            "_risk": F.round(cap * mode_value("max_risk_pct") * F.col("effective_mult"), 2),
            "stop_distance": F.round(atr * stop_m, 2),
            "target_distance": F.round(atr * target_m, 2),
        }
    )
    ok = (price > 0) & (atr > 0) & (F.col("_risk") > 0) & (F.col("stop_distance") > 0)
    shares = F.greatest(F.lit(1), F.floor(F.try_divide("_risk", "stop_distance")))
    capped = F.when(shares * price > cap * MAX_NAME, F.greatest(F.lit(1), F.floor(F.try_divide(cap * MAX_NAME, price)))).otherwise(shares)
    df = df.withColumn("shares", F.when(ok, capped).otherwise(0).cast("long"))
    s = F.col("shares")
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    live = s > 0
    return df.withColumns(
        {
            "stop_loss": F.when(live, F.round(price - sign * F.col("stop_distance"), 2)).otherwise(0.0),
            "target": F.when(live, F.round(price + sign * F.col("target_distance"), 2)).otherwise(0.0),
            "position_value": F.round(s * price, 2),
            "risk_amount": F.when(live, F.round(s * F.col("stop_distance"), 2)).otherwise(0.0),
            "reward_risk": F.when(live, F.round(F.try_divide("target_distance", "stop_distance"), 2)).otherwise(0.0),
        }
    ).drop("_risk")


def exposure(candidates: DataFrame, open_positions: DataFrame) -> DataFrame:
    """40 % per name, 80 % in all, 60 % net, and the same-direction cluster cap, per proposed position.

    ``open_positions`` (ticker, signal, value) is reduced to one row per (ticker, direction) before
    it meets the candidates.
    """
    by_name = open_positions.groupBy("ticker").agg(
        F.sum("value").alias("_name"), F.sum(F.when(F.col("signal") == "LONG", F.col("value")).otherwise(-F.col("value"))).alias("_net"),
        F.max((F.col("signal") == "LONG").cast("int")).alias("_long"), F.max((F.col("signal") == "SHORT").cast("int")).alias("_short"),
    )
    total = by_name.agg(F.sum("_name").alias("all"), F.sum("_net").alias("net"), F.sum("_long").alias("longs"), F.sum("_short").alias("shorts"))
    one = lambda c: F.coalesce(total.select(c).scalar(), F.lit(0))
    x = candidates.join(by_name, "ticker", "left").fillna(0, ["_name", "_net", "_long", "_short"])
    x = x.withColumns({"_all": one("all"), "_tnet": one("net"), "_tl": one("longs"), "_ts": one("shorts")})
    long = F.col("direction") == "LONG"
    v, cap = F.col("position_value"), F.col("capital")
    cluster = F.when(long, F.col("_tl") - F.col("_long")).otherwise(F.col("_ts") - F.col("_short")) + 1
    x = x.withColumns({"ticker_exposure": F.col("_name"), "total_exposure": F.col("_all"), "cluster": cluster, "new_net": F.col("_tnet") + F.when(long, v).otherwise(-v)})
    reason = (
        F.when(F.col("ticker_exposure") + v > cap * MAX_NAME, "name_cap")
        .when(F.col("total_exposure") + v > cap * MAX_TOTAL, "total_cap")
        .when(F.col("cluster") > mode_value("max_same_dir_cluster"), "cluster_cap")
        .when(F.abs("new_net") > MAX_NET * cap, "net_cap")
    )
    x = x.withColumn("exposure_reason", reason)
    return x.withColumns({"exposure_allowed": F.col("exposure_reason").isNull(), "net_pct": F.round(F.col("new_net") / F.greatest(cap, F.lit(1.0)), 6)}).drop("_name", "_net", "_long", "_short", "_all", "_tnet", "_tl", "_ts")


def admission(candidates: DataFrame, cycle: str = "ts", capital: float = 100_000.0, mode: str = "GROWING") -> DataFrame:
    """Sequential admission inside each cycle: every open changes what the next candidate sees.

    A cycle holds at most one candidate per (name, category) and the fold stops adding at the
    mode's position cap, so it runs over a small array expression per cycle.
    """
    cfg = MODES[mode]
    rank = F.struct((-F.col("confidence")).alias("c"), F.col("ticker").alias("ticker"), F.col("category").alias("category"), F.col("direction").alias("direction"), F.col("position_value").alias("v"))
    cycles = candidates.groupBy(cycle).agg(F.sort_array(F.collect_list(rank)).alias("_cands"))
    zero = F.array().cast("array<struct<ticker:string,category:string,direction:string,v:double>>")

    def step(opened: Column, c: Column) -> Column:
        total = F.aggregate(opened, F.lit(0.0), lambda a, o: a + o["v"])
        name = F.aggregate(opened, F.lit(0.0), lambda a, o: a + F.when(o["ticker"] == c["ticker"], o["v"]).otherwise(0.0))
        net = F.aggregate(opened, F.lit(0.0), lambda a, o: a + F.when(o["direction"] == "LONG", o["v"]).otherwise(-o["v"]))
        same = F.size(F.array_distinct(F.transform(F.filter(opened, lambda o: (o["direction"] == c["direction"]) & (o["ticker"] != c["ticker"])), lambda o: o["ticker"])))
        dup = F.exists(opened, lambda o: (o["ticker"] == c["ticker"]) & (o["category"] == c["category"]))
        new_net = net + F.when(c["direction"] == "LONG", c["v"]).otherwise(-c["v"])
        ok = (
            ~dup & (F.size(opened) < cfg["max_positions"]) & (name + c["v"] <= capital * MAX_NAME) & (total + c["v"] <= capital * MAX_TOTAL)
            & (same + 1 <= cfg["max_same_dir_cluster"]) & (F.abs(new_net) <= MAX_NET * capital)
        )
        item = F.struct(c["ticker"].alias("ticker"), c["category"].alias("category"), c["direction"].alias("direction"), c["v"].alias("v"))
        return F.when(ok, F.concat(opened, F.array(item))).otherwise(opened)

    opened = cycles.select(cycle, F.explode(F.aggregate("_cands", zero, step)).alias("o"))
    return opened.select(cycle, "o.ticker", "o.category", "o.direction", F.col("o.v").alias("position_value"))


def costs(df: DataFrame, gross: str = "pnl_pct", value: str = "position_value") -> DataFrame:
    return df.withColumns({"cost_amount": F.round(F.col(value) * ROUND_TRIP_COST, 4), "net_pnl_pct": F.round(F.col(gross) - ROUND_TRIP_COST, 6)})


def breaker(df: DataFrame) -> DataFrame:
    """Level from drawdown (losses only), loss run, anomaly and recent accuracy; the worst wins."""
    dd = F.greatest(-F.col("monthly_dd_pct"), F.lit(0.0))
    limit = lambda i: lookup("capital_mode", {m: v[i] for m, v in BREAKER.items()}, BREAKER["FULL"][i])
    losses = F.col("consecutive_losses")
    level = (
        F.when((dd >= limit(2)) | (losses >= 5) | (F.col("model_accuracy_10") < 0.40), "HALT")
        .when((dd >= limit(1)) | (losses >= 3) | (F.col("severity") == "HIGH"), "PAUSE")
        .when(dd >= limit(0), "WARN")
        .otherwise("OK")
    )
    df = df.withColumn("breaker_level", level)
    return df.withColumns({"breaker_size_mult": lookup("breaker_level", {"OK": 1.0, "WARN": 0.75}, 0.0), "breaker_allows": F.col("breaker_level").isin("OK", "WARN")})


def on_change(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the previous one of the key."""
    w = fw.series(key, order)
    return df.withColumn("_prev", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_prev"))).drop("_prev")


def vix_spike(df: DataFrame, vix: str = "india_vix_level", prev: str = "prev_vix") -> DataFrame:
    v, p = F.col(vix), F.col(prev)
    spike = (p > 0) & (v > 0) & (F.try_divide(v - p, p) >= 0.30)
    action = F.when((v > 28) | F.coalesce(spike, F.lit(False)), "HALT_AND_FLATTEN").when(v > 22, "PAUSE_NEW_ENTRIES").otherwise("OK")
    return df.withColumn("vix_action", action)


def heat(open_positions: DataFrame, capital: float) -> DataFrame:
    """Risk deployed over capital, per name and in all, with the limit's state."""
    x = open_positions.groupBy("ticker").agg(F.sum("risk_amount").alias("risk"), F.count(F.lit(1)).alias("n_positions"))
    total = x.select(F.sum("risk")).scalar()
    x = x.withColumns({"heat": F.round(F.col("risk") / capital, 6), "total_heat": F.round(total / capital, 6)})
    return x.withColumn("heat_state", F.when(F.col("total_heat") > 0.06, "FULL").when(F.col("total_heat") > 0.04, "HIGH").otherwise("OK"))


def risk_features(df: DataFrame) -> DataFrame:
    """Multipliers from heat, drawdown, anomaly, losses and health, and their product."""
    h, dd, streak = F.col("heat"), F.col("monthly_dd_pct"), F.col("losing_streak")
    limit = lambda i: -lookup("capital_mode", {m: v[i] for m, v in BREAKER.items()}, BREAKER["FULL"][i])
    stopped = F.col("breaker_level").isin("PAUSE", "HALT")
    df = df.withColumns(
        {
            "heat_mult": F.when(h > 0.06, 0.0).when(h > 0.04, 0.5).otherwise(1.0),
            "monthly_dd_flag": (stopped | (dd < limit(2))).cast("int"),
            "monthly_dd_mult": F.when(stopped | (dd < limit(2)), 0.0).when(dd < limit(1), 0.5).when(dd < limit(0), 0.75).otherwise(1.0),
            "loss_mult": F.when(streak >= 3, 0.0).when(streak == 2, 0.5).otherwise(1.0),
            "consecutive_loss_halt": (streak >= 3).cast("int"),
            "sr_mult": lookup("entry_quality", {"A": 1.0, "B": 0.85, "C": 0.65, "D": 0.45}, 0.75),
            "capital_mode_mult": lookup("capital_mode", {"SMALL": 0.5, "GROWING": 0.75, "FULL": 1.0}, 1.0),
        }
    )
    product = F.col("heat_mult") * F.col("monthly_dd_mult") * F.col("position_size_mult") * F.col("loss_mult") * F.col("meta_size_mult")
    df = df.withColumn("final_size_mult", F.round(F.least(F.greatest(product, F.lit(0.0)), F.lit(1.5)), 6))
    return df.withColumn("trading_allowed", (F.col("final_size_mult") > 0).cast("int"))
