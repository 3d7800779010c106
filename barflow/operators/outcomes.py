"""Trade outcome labelling: every candidate entry against its own price path, in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..functions.chains import path
from ..functions.scalars import lookup
from .joins import asof, barrier
from .regime import RULES

SLIPPAGE, TOTAL_COST = 0.0005, 0.002
TRAIL_TRIGGER, TRAIL_DISTANCE = 0.02, 0.015


def indexed(bars: DataFrame) -> DataFrame:
    return bars.withColumn("i", F.row_number().over(fw.series()) - 1)


def entries(bars: DataFrame, signal, max_hold: int = 8, stop_atr: float = 2.0, target_atr: float = 5.0) -> DataFrame:
    """A candidate at every indexed bar whose ``signal`` column is LONG or SHORT, with stop and target."""
    w = fw.series()
    x = bars.withColumns({"signal": signal, "_atr": fw.roll(F.avg, F.col("high") - F.col("low"), w, 14)}).where(F.col("signal").isin("LONG", "SHORT") & F.col("_atr").isNotNull())
    sign = F.when(F.col("signal") == "LONG", 1.0).otherwise(-1.0)
    x = x.withColumns({"sign": sign, "entry_price": F.round(F.col("close") * (1 + sign * SLIPPAGE), 4)})
    return x.select(
        "ticker", "i", "ts", "signal", "sign", "entry_price", (F.col("entry_price") - F.col("sign") * F.col("_atr") * stop_atr).alias("stop_price"),
        (F.col("entry_price") + F.col("sign") * F.col("_atr") * target_atr).alias("target_price"), F.lit(max_hold).alias("max_hold"),
    )


def hold_by_regime(ents: DataFrame, regimes: DataFrame) -> DataFrame:
    """Entries with the hold that the rules of the regime at their bar give; a regime without one leaves the entry's own."""
    hold = lookup("regime", {r: v[3] for r, v in RULES.items()}, 0)
    x = ents.join(regimes.select("ticker", "ts", "regime"), ["ticker", "ts"], "left")
    return x.withColumn("max_hold", F.when(hold > 0, hold).otherwise(F.col("max_hold"))).select(*ents.columns, "regime")


def session_entries(bars: DataFrame, every: int = 4, stop: float = 0.01, target: float = 0.03) -> DataFrame:
    """Intraday candidates at every ``every``-th indexed bar of a session, in the bar's own direction; they may be held to the session's last bar, which closes them."""
    day = F.col("ts").cast("date")
    w = fw.W.partitionBy("ticker", day).orderBy("ts")
    nth, size = F.row_number().over(w), F.count(F.lit(1)).over(fw.W.partitionBy("ticker", day))
    x = bars.withColumns({"_n": nth, "max_hold": (size - nth).cast("int")}).where((F.col("_n") % every == 1) & (F.col("max_hold") > 0))
    sign = F.when(F.col("close") >= F.col("open"), 1.0).otherwise(-1.0)
    x = x.withColumns({"sign": sign, "signal": F.when(sign > 0, "LONG").otherwise("SHORT"), "entry_price": F.round(F.col("close") * (1 + sign * SLIPPAGE), 4)})
    away = lambda share: F.col("entry_price") * (1 + F.col("sign") * share)
    return x.withColumns({"stop_price": away(-stop), "target_price": away(target)}).select(*ENTRY)


ENTRY = ["ticker", "i", "ts", "signal", "sign", "entry_price", "stop_price", "target_price", "max_hold"]


def outcomes(ents: DataFrame, bars: DataFrame) -> DataFrame:
    """First of gap, stop, target, time on each entry's path (in that order on the same bar).

    Gaps fill at the open, the rest at the close with slippage; cost is a share of the entry.
    """
    p = barrier(ents, bars)
    s = F.col("sign")
    gap = s * (F.col("bar_open") - F.col("stop_price")) < 0
    stop = s * (F.col("bar_close") - F.col("stop_price")) <= 0
    target = s * (F.col("bar_close") - F.col("target_price")) >= 0
    timed = F.col("bar_i") - F.col("i") >= F.col("max_hold")
    kind = F.when(gap, 0).when(stop, 1).when(target, 2).when(timed, 3)
    fill = F.when(gap, F.col("bar_open")).otherwise(F.col("bar_close") * (1 - s * SLIPPAGE))
    hit = p.withColumn("_k", kind).where(F.col("_k").isNotNull())
    first = hit.groupBy(*ENTRY).agg(F.min(F.struct("bar_i", F.col("_k").alias("kind"), fill.alias("exit_price"), F.col("bar_ts").alias("exit_ts"))).alias("z"))
    gross = F.col("sign") * (F.col("z.exit_price") - F.col("entry_price")) / F.col("entry_price")
    reason = F.when(F.col("z.kind") == 0, "GAP_FILL").when(F.col("z.kind") == 1, "STOP_LOSS").when(F.col("z.kind") == 2, "TARGET").otherwise("TIME_EXIT")
    return first.select(
        *ENTRY, F.col("z.bar_i").alias("exit_i"), F.col("z.exit_ts").alias("exit_ts"), F.col("z.exit_price").alias("exit_price"), reason.alias("exit_reason"),
        (F.col("z.bar_i") - F.col("i")).alias("days_held"), (gross - TOTAL_COST).alias("net_pnl_pct"), F.try_divide(F.col("sign") * (F.col("z.exit_price") - F.col("entry_price")), F.abs(F.col("entry_price") - F.col("stop_price"))).alias("r_multiple"),
    )


def excursions(done: DataFrame, bars: DataFrame) -> DataFrame:
    """Best and worst move from entry over the bars up to the exit."""
    p = barrier(done, bars).where(F.col("bar_i") <= F.col("exit_i"))
    agg = p.groupBy("ticker", "i", "signal", "entry_price").agg(F.max("bar_high").alias("hi"), F.min("bar_low").alias("lo"))
    e, up, dn = F.col("entry_price"), F.col("hi") / F.col("entry_price") - 1, 1 - F.col("lo") / F.col("entry_price")
    long = F.col("signal") == "LONG"
    return agg.select("ticker", "i", F.when(long, up).otherwise(dn).alias("mfe"), F.when(long, -dn).otherwise(-up).alias("mae"))


# Legs of the ladder (share of the position, multiple of risk).
LADDER = (("TARGET_1R", 0.5, 1.0), ("TARGET_2R", 0.3, 2.0))


def ladder(ents: DataFrame, bars: DataFrame, limit: str = "TIME_EXIT") -> DataFrame:
    """Half out at 1R, three tenths at 2R, the rest trails; a stop or the time limit, named ``limit``, closes what is left.

    Each leg is a barrier of its own, so it books once.  The trailing high is a running maximum
    over at most ``max_hold`` path rows of one entry.
    """
    p = barrier(ents, bars)
    s, c, e = F.col("sign"), F.col("bar_close"), F.col("entry_price")
    risk = F.abs(e - F.col("stop_price"))
    w = fw.W.partitionBy("ticker", "i").orderBy("bar_i").rowsBetween(fw.W.unboundedPreceding, 0)
    peak = F.greatest(F.max(s * c).over(w), s * e)
    p = p.withColumns({"_gain": s * (c / e - 1), "_peak": peak})
    stop = s * (c - F.col("stop_price")) <= 0
    timed = F.col("bar_i") - F.col("i") >= F.col("max_hold")
    trail = (F.col("_gain") >= TRAIL_TRIGGER) & (s * c <= F.col("_peak") - F.abs(F.col("_peak")) * TRAIL_DISTANCE)
    done = s * (c - F.col("target_price")) >= 0
    legs, shares = [], {}
    for name, share, mult in LADDER:
        kind = F.when(stop, "STOP_LOSS").when(s * (c - e) >= risk * mult, name).when(timed, limit)
        legs.append(F.min(F.when(kind.isNotNull(), F.struct("bar_i", kind.alias("reason"), c.alias("price")))).alias(name))
        shares[name] = share
    rest = F.when(stop, "STOP_LOSS").when(done, "TARGET").when(trail, "TRAILING_STOP").when(timed, limit)
    legs.append(F.min(F.when(rest.isNotNull(), F.struct("bar_i", rest.alias("reason"), c.alias("price")))).alias("REST"))
    shares["REST"] = 1 - sum(shares.values())
    agg = p.groupBy("ticker", "i", "signal", "sign", "entry_price").agg(*legs)
    one = lambda n: F.struct(F.lit(n).alias("leg"), F.lit(round(shares[n], 4)).alias("share"), F.col(n).alias("z"))
    x = agg.withColumn("_l", F.explode(F.array(*[one(n) for n in shares])))
    z = F.col("_l.z")
    pnl = F.col("_l.share") * F.col("sign") * (z["price"] - F.col("entry_price")) / F.col("entry_price")
    return x.where(z.isNotNull()).select("ticker", "i", F.col("_l.leg").alias("leg"), F.col("_l.share").alias("share"), z["bar_i"].alias("exit_i"), z["reason"].alias("exit_reason"), pnl.alias("leg_pnl_pct"))


def non_overlapping(done: DataFrame, key: str = "ticker", rows: int = 4096) -> DataFrame:
    """One trade at a time: an entry counts only after the previously taken trade has closed.

    The first entry past a trade's exit is the one that may follow it; the trades taken are those on the path from a key's
    first entry. An entry without an exit blocks all that come after it.
    """
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    x = fw.index_rows(done, key, ["i"], F.floor(F.col("i") / rows), "_n")
    starts = x.groupBy(key, at(F.col("i")).alias("_at")).agg(F.min("_n").alias("nxt"))
    due = x.where("exit_i is not null").select(key, "_n", at(F.col("exit_i") + 1).alias("_due"))
    to = asof(due, starts, ["nxt"], key, "_due", "_at", "hour", forward=True).select(key, "_n", "nxt")
    nodes = x.join(to, [key, "_n"], "left").select(F.col(key).alias("key"), F.col("_n").alias("i"), "nxt")
    taken = path(nodes, rows).select(F.col("key").alias(key), F.col("i").alias("_n"))
    return x.join(taken, [key, "_n"]).select(*done.columns)


def walk_forward(bars: DataFrame, train: int = 504, test: int = 126, min_test: int = 20) -> DataFrame:
    """Fold boundaries per ticker: train then test, stepping by the test length."""
    n = bars.groupBy("ticker").agg(F.count(F.lit(1)).cast("int").alias("n"))
    ok = n.where(F.col("n") >= train + test)
    starts = F.sequence(F.lit(0), F.col("n") - (train + test), F.lit(test))
    x = ok.select("ticker", F.posexplode(starts).alias("fold", "train_start"))
    x = x.withColumns({"train_end": F.col("train_start") + train, "test_start": F.col("train_start") + train, "test_end": F.col("train_start") + train + test})
    return x.where(F.col("test_end") - F.col("test_start") >= min_test)


def fold_results(done: DataFrame, train: int = 504, test: int = 126) -> DataFrame:
    """Win rate and profit factor of the entries inside each test window (folds follow from the bar index)."""
    x = done.where(F.col("i") >= train).withColumn("fold", F.floor((F.col("i") - train) / test).cast("int"))
    p = F.col("net_pnl_pct")
    return x.groupBy("ticker", "fold").agg(
        F.count(F.lit(1)).alias("n_trades"), F.round(F.count_if(p > 0) / F.count(F.lit(1)), 4).alias("win_rate"),
        F.coalesce(F.try_divide(F.sum(F.when(p > 0, p)), -F.sum(F.when(p < 0, p))), F.lit(0.0)).alias("profit_factor"),
        F.coalesce(F.try_divide(F.avg(p), F.stddev_pop(p)), F.lit(0.0)).alias("sharpe"),
    )


def stability(folds: DataFrame) -> DataFrame:
    wr = F.col("win_rate")
    x = folds.groupBy("ticker").agg(
        F.round(F.avg(wr), 4).alias("win_rate_mean"), F.round(F.stddev_pop(wr), 4).alias("win_rate_std"), F.min(wr).alias("win_rate_min"), F.round(F.avg("profit_factor"), 3).alias("pf_mean"), F.round(F.min("profit_factor"), 3).alias("pf_min"),
        F.count_if(wr > 0.5).alias("profitable_folds"), F.count(F.lit(1)).alias("total_folds"), F.sum("n_trades").alias("total_trades"),
    )
    return x.withColumn("consistency", F.round(F.col("profitable_folds") / F.col("total_folds"), 4))


def deployability(metrics: DataFrame) -> DataFrame:
    """Go/no-go: every criterion must hold.  Expects win_rate, profit_factor, max_drawdown_pct, consistency, n_trades."""
    checks = {
        "win_rate": F.col("win_rate") >= 0.52, "profit_factor": F.col("profit_factor") >= 1.4, "max_drawdown": F.abs("max_drawdown_pct") <= 0.22, "consistency": F.col("consistency") >= 0.60, "n_trades": F.col("n_trades") >= 30,
    }
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    return metrics.withColumns({"fail_reasons": failed}).withColumn("deployable", F.size("fail_reasons") == 0)


def scale_gate(metrics: DataFrame) -> DataFrame:
    ok = (F.col("win_rate") >= 0.52) & (F.col("profit_factor") >= 1.5) & (F.col("sharpe_ratio") >= 1.0) & (F.abs("max_drawdown_pct") <= 0.20) & (F.col("n_trades") >= 50)
    return metrics.withColumn("scale_up", ok)


def close_trade(df: DataFrame) -> DataFrame:
    """Net P&L after the round trip, R multiple and hours from a position and its exit."""
    sign = F.when(F.col("signal") == "LONG", 1.0).otherwise(-1.0)
    gross = sign * (F.col("exit_price") - F.col("entry_price"))
    return df.withColumns(
        {
            "net_amount": F.round(gross * F.col("shares") - F.col("entry_price") * F.col("shares") * TOTAL_COST, 4), "net_pct": F.round(gross / F.col("entry_price") - TOTAL_COST, 6),
            "r_multiple_now": F.round(F.try_divide(gross, F.abs(F.col("entry_price") - F.col("stop_price"))), 4), "held_hours": F.datediff("close_date", "opened_at") * 24.0,
        }
    )
