"""Trade-ledger analytics: P&L, curves, attribution, metrics, behaviour.

Ledger columns: see the adapter.  Amounts are summed as integers (``pnl_e4``: ten-thousandths), so
totals do not depend on the order of addition.  Every ordered pass over trades runs over daily
totals or inside bounded pieces; the trade table itself is never sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows as fw

def won() -> Column:
    return F.col("pnl_points") > 0


def lost() -> Column:
    return F.col("pnl_points") <= 0


def amount(c: Column) -> Column:
    return c / 10000


def core(extra: dict[str, Column] | None = None) -> list[Column]:
    """The aggregates every breakdown shares."""
    wins, pos, neg = F.count_if(won()), F.sum(F.when(F.col("pnl_e4") > 0, F.col("pnl_e4"))), F.sum(F.when(F.col("pnl_e4") < 0, -F.col("pnl_e4")))
    out = {
        "n_trades": F.count(F.lit(1)),
        "wins": wins,
        "win_rate": F.round(wins / F.count(F.lit(1)), 4),
        "profit_factor": F.round(F.coalesce(F.try_divide(F.coalesce(pos, F.lit(0)), neg), F.lit(0.0)), 4),
        "avg_win_pct": F.round(F.coalesce(F.try_divide(F.sum(F.when(won(), F.col("pnl_points"))), wins * 100), F.lit(0.0)), 6),
        "avg_loss_pct": F.round(F.coalesce(F.try_divide(F.sum(F.when(lost(), F.col("pnl_points"))), F.count_if(lost()) * 100), F.lit(0.0)), 6),
        "total_pnl": amount(F.sum("pnl_e4")),
    }
    return [c.alias(n) for n, c in (out | (extra or {})).items()]


def total_pnl(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("ticker").agg(amount(F.sum("pnl_e4")).alias("total_pnl"), F.count(F.lit(1)).alias("n_trades"))


def monthly_pnl(ledger: DataFrame, capital: float = 1e9) -> DataFrame:
    """Calendar-month P&L and its share of capital (negative = drawdown)."""
    x = ledger.groupBy(F.trunc("close_date", "month").alias("month")).agg(amount(F.sum("pnl_e4")).alias("pnl"), F.count(F.lit(1)).alias("n_trades"))
    return x.withColumn("drawdown_pct", F.round(F.col("pnl") / capital, 6))


def performance(ledger: DataFrame, as_of, days: int, by: list[str] | None = None) -> DataFrame:
    x = ledger.where((F.col("close_date") >= F.date_sub(as_of, days)) & (F.col("close_date") <= as_of))
    return (x.groupBy(*by) if by else x.groupBy()).agg(*core())


def newest(ledger: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The ``n`` newest trades per key, numbered from 1 = newest.

    A first rank inside (key, month) keeps at most ``n`` rows per month, so no key is ranked whole.
    """
    order = [F.desc("close_date"), F.desc("trade_no"), F.desc("signal_uuid")]
    x = ledger.withColumn("_m", F.trunc("close_date", "month"))
    x = x.withColumn("age", F.row_number().over(W.partitionBy(*by, "_m").orderBy(*order))).where(F.col("age") <= n)
    return x.withColumn("age", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("age") <= n).drop("_m")


def consecutive_losses(ledger: DataFrame, by: str = "ticker", look: int = 20) -> DataFrame:
    """Losses before the newest win among the newest ``look`` trades."""
    x = newest(ledger, look, [by])
    first_win = F.min(F.when(won(), F.col("age")))
    return x.groupBy(by).agg((F.coalesce(first_win, F.count(F.lit(1)) + 1) - 1).cast("int").alias("consecutive_losses"))


def rolling_win_rate(ledger: DataFrame, n: int = 10, by: str = "ticker") -> DataFrame:
    return newest(ledger, n, [by]).groupBy(by).agg(F.round(F.count_if(won()) / F.count(F.lit(1)), 4).alias("win_rate"))


def equity_curve(ledger: DataFrame, start: float = 100_000.0, by: str = "ticker") -> DataFrame:
    """End-of-day equity and drawdown per key: daily totals first, then one running sum over days."""
    return equity(ledger.groupBy(by, "close_date").agg(F.sum("pnl_e4").alias("_d")), start, by)


def equity(daily: DataFrame, start: float, by: str) -> DataFrame:
    """The same from daily totals ``_d``."""
    w = fw.running(W.partitionBy(by).orderBy("close_date"))
    x = daily.withColumn("equity", start + amount(F.sum("_d").over(w)))
    x = x.withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(start)))
    return x.withColumn("drawdown", F.round((F.col("equity") - F.col("peak")) / F.col("peak"), 6)).drop("_d")


DIMENSIONS = ("category", "regime_match", "entry_quality", "alignment", "regime", "ticker")


def attribution(ledger: DataFrame) -> DataFrame:
    """All six dimensions in one pass with grouping sets."""
    label = F.when(F.col("regime_match") == 1, "aligned").when(F.col("regime_match") == 0, "counter").otherwise("unknown")
    x = ledger.withColumn("regime_match", label)
    agg = x.groupingSets([[c] for c in DIMENSIONS], *DIMENSIONS).agg(
        *core({
            "expectancy_r": F.round(F.sum(F.col("pnl_points")) / F.count(F.lit(1)) / 2, 4),
            "avg_mfe": F.round(F.sum(F.round(F.col("mfe") * 100).cast("long")) / F.count(F.lit(1)) / 100, 6),
            "avg_mae": F.round(F.sum(F.round(F.col("mae") * 100).cast("long")) / F.count(F.lit(1)) / 100, 6),
        })
    )
    which = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in DIMENSIONS])
    return agg.select(which.alias("dimension"), F.coalesce(*DIMENSIONS).alias("value"), "n_trades", "win_rate", "profit_factor", "expectancy_r", "avg_mfe", "avg_mae")


# Confidence buckets.
BUCKETS = ((0.80, "0.80+"), (0.75, "0.75-0.80"), (0.70, "0.70-0.75"), (0.65, "0.65-0.70"), (0.60, "0.60-0.65"), (0.55, "0.55-0.60"))


def bucket(c: Column) -> Column:
    out = None
    for lo, name in BUCKETS:
        out = F.when(c >= lo, name) if out is None else out.when(c >= lo, name)
    return out.otherwise("<0.55")


def calibration(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(bucket(F.col("confidence")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(won()).alias("wins"), F.round(F.count_if(won()) / F.count(F.lit(1)), 4).alias("win_rate"),
        F.round(F.sum("pnl_points") / F.count(F.lit(1)) / 100, 6).alias("avg_pnl_pct"),
    )


def weekday(ledger: DataFrame) -> DataFrame:
    """Monday to Friday, zero where a day has no trades."""
    day = (F.dayofweek("close_date") + 5) % 7
    x = ledger.where(day < 5).groupBy(day.alias("dow")).agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(won()).alias("wins"), F.sum("pnl_e4").alias("_e4"))
    names = ledger.sparkSession.createDataFrame(list(enumerate(("Mon", "Tue", "Wed", "Thu", "Fri"))), "dow int, weekday string")
    return names.join(x, "dow", "left").select(
        "weekday", F.coalesce("n_trades", F.lit(0)).alias("n_trades"), F.round(F.coalesce(F.try_divide("wins", "n_trades"), F.lit(0.0)), 4).alias("win_rate"), F.coalesce(amount(F.col("_e4")), F.lit(0.0)).alias("pnl"),
    )


def sharpe_simple(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Mean over population deviation of trade percentages, annualised; needs three trades.

    Integer moments, so the variance is exact in any order.
    """
    n, s, ss = F.count(F.lit(1)), F.sum("pnl_points"), F.sum(F.col("pnl_points") * F.col("pnl_points"))
    sd = F.sqrt(ss / n - (s / n) * (s / n))
    return ledger.groupBy(*by).agg(F.when((n >= 3) & (sd > 0), F.round((s / n) / sd * F.sqrt(F.lit(252.0)), 4)).otherwise(0.0).alias("sharpe"))


def days(ledger: DataFrame, by: str) -> DataFrame:
    """Each (key, close date) in one pass: its total ``_d``, the longest win and loss run inside it, its first and last run.

    Trades meet their day only, so no key is ordered whole; what is put together in order is bounded by the calendar.
    """
    w = W.partitionBy(by, "close_date").orderBy("trade_no", "signal_uuid")
    x = ledger.select(by, "close_date", "trade_no", "signal_uuid", "pnl_e4", won().alias("_w"))
    x = x.withColumn("_new", F.when(F.col("_w") == F.lag("_w").over(w), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(fw.running(w)))
    x = x.groupBy(by, "close_date", "_run", "_w").agg(F.count(F.lit(1)).alias("_n"), F.sum("pnl_e4").alias("_d"))
    longest = lambda c: F.coalesce(F.max(F.when(c, F.col("_n"))), F.lit(0)).cast("long")
    edge = F.struct("_w", "_n")
    return x.groupBy(by, "close_date").agg(
        F.sum("_d").alias("_d"), F.max("_run").alias("_runs"), longest(F.col("_w")).alias("_mw"), longest(~F.col("_w")).alias("_ml"), F.min_by(edge, "_run").alias("_first"), F.max_by(edge, "_run").alias("_last"),
    )


def longest_runs(days: Column) -> Column:
    """(max_consec_wins, max_consec_losses) over an ordered array of days: a run may go on from day to day."""
    long = lambda n: F.lit(n).cast("long")

    def join(s: Column, d: Column) -> Column:
        n = F.when(d["_first"]["_w"] == s["w"], s["n"] + d["_first"]["_n"]).otherwise(d["_first"]["_n"])
        best = lambda old, own, c: F.greatest(old, own, F.when(c, n).otherwise(long(0)))
        return F.struct(
            d["_last"]["_w"].alias("w"), F.when(d["_runs"] == 1, n).otherwise(d["_last"]["_n"]).alias("n"),
            best(s["mw"], d["_mw"], d["_first"]["_w"]).alias("mw"), best(s["ml"], d["_ml"], ~d["_first"]["_w"]).alias("ml"),
        )

    none = F.struct(F.lit(None).cast("boolean").alias("w"), long(0).alias("n"), long(0).alias("mw"), long(0).alias("ml"))
    return F.aggregate(days, none, join, lambda s: F.struct(s["mw"].alias("max_consec_wins"), s["ml"].alias("max_consec_losses")))


def runs(ledger: DataFrame, by: str = "ticker") -> DataFrame:
    """Longest win and loss runs per key."""
    return days(ledger, by).groupBy(by).agg(longest_runs(in_order()).alias("_r")).select(by, "_r.*")


def in_order() -> Column:
    return F.sort_array(F.collect_list(F.struct("close_date", "_runs", "_mw", "_ml", "_first", "_last")))


def metrics(ledger: DataFrame, start: float = 1e9, risk_free: float = 0.065, by: str = "ticker") -> DataFrame:
    """Trade, equity and risk metrics per key; returns and drawdown on end-of-day equity."""
    trades = ledger.groupBy(by).agg(
        *core({
            "avg_trade_pct": F.round(F.sum("pnl_points") / F.count(F.lit(1)) / 100, 6),
            "long_trades": F.count_if(F.col("signal") == "LONG"), "short_trades": F.count_if(F.col("signal") == "SHORT"),
            "long_win_rate": F.round(F.coalesce(F.try_divide(F.count_if(won() & (F.col("signal") == "LONG")), F.count_if(F.col("signal") == "LONG")), F.lit(0.0)), 4),
            "short_win_rate": F.round(F.coalesce(F.try_divide(F.count_if(won() & (F.col("signal") == "SHORT")), F.count_if(F.col("signal") == "SHORT")), F.lit(0.0)), 4),
            "avg_hold_days": F.round(F.sum(F.datediff("close_date", "opened_at")) / F.count(F.lit(1)), 4),
            "median_hold_days": F.percentile(F.datediff("close_date", "opened_at"), F.lit(0.5)),
        })
    )
    curve = equity(days(ledger, by), start, by)
    prev = F.coalesce(F.lag("equity").over(W.partitionBy(by).orderBy("close_date")), F.lit(start))
    daily = curve.withColumn("_r", F.col("equity") / prev - 1)
    rf = (1 + risk_free) ** (1 / 252) - 1
    r = F.col("_r")
    neg = F.when(r < 0, r)
    risk = daily.groupBy(by).agg(
        F.min("drawdown").alias("max_drawdown_pct"), F.max_by("equity", "close_date").alias("ending_capital"),
        F.when((F.count(r) > 1) & (F.stddev_pop(r) > 0), (F.avg(r) - rf) / F.stddev_pop(r) * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe_ratio"),
        F.when(F.count(neg) > 1, F.try_divide(F.avg(r) * 252 - risk_free, F.stddev_pop(neg) * F.sqrt(F.lit(252.0)))).otherwise(0.0).alias("sortino_ratio"),
        longest_runs(in_order()).alias("_r"),
    ).select("*", "_r.*").drop("_r")
    x = trades.join(risk, by)
    total = (F.col("ending_capital") - start) / start
    wr = F.col("wins") / F.col("n_trades")
    x = x.withColumns({"total_return_pct": total, "calmar_ratio": F.when(F.col("max_drawdown_pct") < 0, total / F.abs("max_drawdown_pct")).otherwise(0.0), "expectancy_pct": wr * F.col("avg_win_pct") + (1 - wr) * F.col("avg_loss_pct")})
    return grade(x)


def grade(x: DataFrame) -> DataFrame:
    """Nine-point score to A–D, with the failed criteria."""
    wr, pf, sh, dd, n = F.col("win_rate"), F.col("profit_factor"), F.col("sharpe_ratio"), F.abs("max_drawdown_pct"), F.col("n_trades")
    two = lambda c, hi, lo: F.when(c >= hi, 2).when(c >= lo, 1).otherwise(0)
    score = two(wr, 0.58, 0.52) + two(pf, 2.0, 1.5) + two(sh, 1.5, 1.0) + F.when(dd <= 0.10, 2).when(dd <= 0.20, 1).otherwise(0) + F.when(n >= 100, 1).otherwise(0)
    issues = F.array_compact(F.array(
        F.when(wr < 0.52, "win_rate"), F.when(pf < 1.5, "profit_factor"), F.when(sh < 1.0, "sharpe"), F.when(dd > 0.20, "max_drawdown"), F.when(n < 50, "n_trades")
    ))
    x = x.withColumns({"grade_score": score, "issues": issues})
    g = F.when(F.col("grade_score") >= 8, "A").when(F.col("grade_score") >= 6, "B").when(F.col("grade_score") >= 4, "C").otherwise("D")
    return x.withColumn("grade", g).withColumn("is_deployable", F.col("grade").isin("A", "B"))


def milestones(curve: DataFrame, parts: int = 4) -> DataFrame:
    """Equity at the end of each of ``parts`` equal stretches of trading days."""
    x = curve.withColumn("part", F.ntile(parts).over(W.partitionBy("ticker").orderBy("close_date")))
    return x.groupBy("ticker", "part").agg(F.max("close_date").alias("close_date"), F.max_by("equity", "close_date").alias("equity"))


def monthly_distribution(ledger: DataFrame) -> DataFrame:
    m = monthly_pnl(ledger)
    return m.agg(
        F.count(F.lit(1)).alias("months"), F.count_if(F.col("pnl") > 0).alias("positive_months"), F.round(F.avg("pnl"), 2).alias("avg_month"), F.max("pnl").alias("best_month"), F.min("pnl").alias("worst_month"),
    )


# ---- behaviour ------------------------------------------------------------------------------


def hold_ratio() -> tuple[Column, Column, Column]:
    """Mean days held of winners and of losers, and how much longer the losers are."""
    days = F.datediff("close_date", "opened_at")
    mean = lambda c: F.try_divide(F.sum(F.when(c, days)), F.count_if(c))
    return mean(won()), mean(lost()), F.try_divide(mean(lost()), mean(won()))


def loss_aversion(ledger: DataFrame, by: list[str]) -> DataFrame:
    win, loss, ratio = hold_ratio()
    return ledger.groupBy(*by).agg(F.round(win, 4).alias("win_hold"), F.round(loss, 4).alias("loss_hold"), F.round(ratio, 4).alias("ratio"), F.coalesce(ratio > 1.5, F.lit(False)).cast("int").alias("detected"))


def low_share() -> Column:
    placed = F.col("signal") != "FLAT"
    return F.try_divide(F.count_if(placed & (F.col("confidence") < 0.55)), F.count_if(placed))


def overtrading(ledger: DataFrame, by: list[str]) -> DataFrame:
    return ledger.where(F.col("signal") != "FLAT").groupBy(*by).agg(F.round(low_share(), 4).alias("low_conf_share"), (low_share() > 0.15).cast("int").alias("detected"))


def revenge(ledger: DataFrame, by: str = "ticker") -> DataFrame:
    """Entries within a day after the previous close (by close order) that lost; detected from two on.

    The previous trade is found inside (key, day); only the first trade of a day looks at the last one of the day before, so no
    key is ordered whole.
    """
    w = W.partitionBy(by, "close_date").orderBy("trade_no", "signal_uuid")
    x = ledger.select(by, "opened_at", "close_date", "trade_no", "signal_uuid", "pnl_points")
    hit = lambda opened, closed, points: F.coalesce((points <= 0) & (F.datediff(opened, closed) >= 0) & (F.datediff(opened, closed) < 1), F.lit(False))
    x = x.withColumns({"_p": F.lag("pnl_points").over(w), "_i": F.row_number().over(w)})
    own = hit(F.col("opened_at"), F.col("close_date"), F.col("_p"))
    day = x.groupBy(by, "close_date").agg(F.count_if(own).alias("_n"), F.min_by("opened_at", "_i").alias("_opened"), F.max_by("pnl_points", "_i").alias("_points"))
    before = W.partitionBy(by).orderBy("close_date")
    day = day.withColumn("_first", hit(F.col("_opened"), F.lag("close_date").over(before), F.lag("_points").over(before)).cast("long"))
    n = F.sum(F.col("_n") + F.col("_first"))
    return day.groupBy(by).agg(n.alias("revenge_trades"), (n >= 2).cast("int").alias("detected"))


def target_share(target_points: int) -> Column:
    early = won() & (F.col("signal") == "LONG")
    cap = F.least(F.col("pnl_points") * 2, F.lit(3 * target_points))
    return F.try_divide(F.sum(F.when(early, cap)), F.count_if(early)) / (2 * target_points)


def early_exit(ledger: DataFrame, by: list[str], target_points: int = 5) -> DataFrame:
    """Mean share of the target distance that winning longs took, capped at 1.5; detected below .6."""
    mean = target_share(target_points)
    return ledger.where(won() & (F.col("signal") == "LONG")).groupBy(*by).agg(F.round(mean, 6).alias("achieved_ratio"), (mean < 0.6).cast("int").alias("detected"))


def size_spread() -> tuple[Column, Column]:
    v = F.col("value_cents").cast("double")
    cv = F.stddev_pop(v) / F.avg(v)
    return cv, (F.count(F.lit(1)) >= 5) & (cv > 0.5)


def sizing_cv(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Population deviation over mean of position value; detected above .5 with five trades."""
    cv, wide = size_spread()
    return ledger.groupBy(*by).agg(F.round(cv, 4).alias("sizing_cv"), wide.cast("int").alias("detected"))


def behaviour(ledger: DataFrame, by: str = "ticker", target_points: int = 5) -> DataFrame:
    """Five detectors per key, graded by how many fired; needs ten trades. Four share one pass over the trades."""
    parts = {"loss_aversion": hold_ratio()[2] > 1.5, "overtrading": low_share() > 0.15, "revenge_trading": None, "early_exit": target_share(target_points) < 0.6, "sizing": size_spread()[1]}
    x = ledger.groupBy(by).agg(F.count(F.lit(1)).alias("n_trades"), *[c.cast("int").alias(n) for n, c in parts.items() if c is not None])
    x = x.join(revenge(ledger, by).select(by, F.col("detected").alias("revenge_trading")), by, "left")
    flags = F.array_compact(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in parts]))
    x = x.withColumn("flags", flags)
    n = F.size("flags")
    g = F.when(F.col("n_trades") < 10, "INSUFFICIENT").when(n == 0, "A").when(n == 1, "B").when(n == 2, "C").otherwise("D")
    return x.withColumns({"n_flags": n, "behaviour_grade": g})


# ---- meta -----------------------------------------------------------------------------------


def meta_features(ledger: DataFrame, by: str = "ticker", last: int = 20) -> DataFrame:
    """Recent-form columns per key from its newest trades: accuracy, streaks, month's result, size."""
    x = newest(ledger, last, [by])
    latest = W.partitionBy(by).orderBy("age")
    x = x.withColumns({"_sig": F.first("signal").over(latest), "_month": F.first(F.trunc("close_date", "month")).over(latest)})
    n = F.count(F.lit(1))
    lead = lambda other: (F.coalesce(F.min(F.when(other, F.col("age"))), n + 1) - 1).cast("int")
    conf = F.round(F.col("confidence") * 100).cast("long")
    mean, sq = F.sum(conf) / n, F.sum(conf * conf) / n
    agg = x.groupBy(by).agg(
        F.round(F.count_if(won() & (F.col("age") <= 10)) / F.count_if(F.col("age") <= 10), 4).alias("rolling_accuracy_10"),
        F.round(mean / 100, 6).alias("avg_model_confidence"), F.round(F.sqrt(F.greatest(sq - mean * mean, F.lit(0.0))) / 100, 6).alias("conf_std"),
        lead(won()).alias("losing_streak"), lead(F.col("signal") != F.col("_sig")).alias("signal_streak"),
        F.round(F.least(F.greatest(F.sum(F.when(F.trunc("close_date", "month") == F.col("_month"), F.col("pnl_points")).otherwise(0)) / 10, F.lit(-1.0)), F.lit(1.0)), 4).alias("monthly_pnl_norm"),
    )
    acc, lose, month = F.col("rolling_accuracy_10"), F.col("losing_streak"), F.col("monthly_pnl_norm")
    health = acc * 0.4 + F.col("avg_model_confidence") * 0.3 + (1 - F.least(lose, F.lit(5)) / 5) * 0.3
    mult = (
        F.when(lose >= 3, 0.5).when(lose == 2, 0.75).otherwise(1.0) * F.when(acc < 0.40, 0.5).when(acc < 0.50, 0.75).otherwise(1.0)
        * F.when(month < -0.8, 0.0).when(month < -0.5, 0.5).otherwise(1.0)
    )
    return agg.withColumns(
        {
            "losing_streak_norm": F.round(F.least(lose, F.lit(5)) / 5, 4), "signal_streak_norm": F.round(F.least(F.col("signal_streak"), F.lit(5)) / 5, 4),
            "model_health_score": F.round(F.least(F.greatest(health * 2 - 1, F.lit(-1.0)), F.lit(1.0)), 6), "meta_size_mult": F.round(mult, 4),
        }
    )


#: Pieces that the trades of a day are dealt to; more make a day's floor higher and the first pass' groups more.
PIECES = 32


def day_floors(ledger: DataFrame, last: int = 10) -> DataFrame:
    """For each (ticker, close_date) its number of trades and ``_floor``: its newest ``last`` trades, and those from its last win on, are numbered that or higher.

    Trades are dealt to pieces by a hash of their number. The ``last``-th highest of the pieces' highest numbers is that of some trade
    with ``last`` - 1 others above it, so no trade below is wanted; a day with fewer pieces is wanted whole. ``_from`` and ``_to`` span the opening dates.
    """
    piece = F.pmod(F.hash("trade_no"), F.lit(PIECES)).alias("_piece")
    pieces = ledger.groupBy("ticker", "close_date", piece).agg(
        F.count(F.lit(1)).alias("_n"), F.max("trade_no").alias("_top"), F.max(F.when(won(), F.col("trade_no"))).alias("_win"), F.min("opened_at").alias("_from"), F.max("opened_at").alias("_to"),
    )
    tops = F.sort_array(F.collect_list("_top"), asc=False)
    days = pieces.groupBy("ticker", "close_date").agg(F.sum("_n").alias("_n"), tops.alias("_tops"), F.max("_win").alias("_win"), F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    enough = F.coalesce(F.get("_tops", F.lit(last - 1)), F.lit(-(1 << 62)))
    return days.select("ticker", "close_date", "_n", F.least(enough, "_win").alias("_floor"), "_from", "_to")


def day_state(ledger: DataFrame, last: int = 10, floors: DataFrame | None = None) -> DataFrame:
    """Recent form as of the end of each (ticker, close_date): accuracy and confidence of the newest ``last`` trades, losing streak.

    Each day is summarised on its own (count, trades after its last win, its newest ``last``); days are then put together
    in order, so what is ordered per name is bounded by the calendar. Of a day only the trades from its floor on are put in order;
    with ``floors`` (of all trades, see :func:`day_floors`) ``ledger`` may leave out those below.
    """
    floors = (day_floors(ledger, last) if floors is None else floors).select(F.col("ticker").alias("_ticker"), F.col("close_date").alias("_day"), "_n", "_floor")
    own = F.col("ticker").eqNullSafe(F.col("_ticker")) & F.col("close_date").eqNullSafe(F.col("_day")) & (F.col("trade_no") >= F.col("_floor"))
    newest = W.partitionBy("ticker", "close_date").orderBy(F.desc("trade_no"), F.desc("signal_uuid"))
    x = ledger.join(floors, own).withColumn("_r", F.row_number().over(newest))
    trade = F.struct((-F.col("_r")).alias("at"), won().cast("int").alias("win"), F.round(F.col("confidence") * 100).cast("long").alias("conf"))
    days = x.groupBy("ticker", "close_date").agg(
        F.first("_n").alias("_n"), F.min(F.when(won(), F.col("_r"))).alias("_win"), F.sort_array(F.collect_list(F.when(F.col("_r") <= last, trade))).alias("_own"),
    )
    w = W.partitionBy("ticker").orderBy("close_date")
    recent = F.slice(F.flatten(F.collect_list("_own").over(w.rowsBetween(1 - last, 0))), -last, last)
    recent = F.when(F.size(F.flatten(F.collect_list("_own").over(w.rowsBetween(1 - last, 0)))) > last, recent).otherwise(F.flatten(F.collect_list("_own").over(w.rowsBetween(1 - last, 0))))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    days = days.withColumns({"_recent": recent, "_cum": F.sum("_n").over(upto)})
    lost = F.col("_cum") - F.coalesce(F.last(F.when(F.col("_win").isNotNull(), F.col("_cum") - F.col("_win") + 1), ignorenulls=True).over(upto), F.lit(0))
    total = lambda f: F.aggregate("_recent", F.lit(0).cast("long"), lambda s, t: s + t[f])
    n = F.size("_recent")
    state = days.select("ticker", "close_date", F.round(total("win") / n, 4).alias("rolling_accuracy_10"), F.round(total("conf") / n / 100, 6).alias("avg_model_confidence"), lost.cast("int").alias("losing_streak"))
    low = F.least("losing_streak", F.lit(5)) / 5
    health = F.col("rolling_accuracy_10") * 0.4 + F.col("avg_model_confidence") * 0.3 + (1 - low) * 0.3
    return state.withColumns({"losing_streak_norm": F.round(low, 4), "model_health_score": F.round(F.least(F.greatest(health * 2 - 1, F.lit(-1.0)), F.lit(1.0)), 6)})
