"""Signal gates as column expressions, state rules in closed form, ranking and selection."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as fw
from ..functions.chains import path
from ..functions.scalars import ladder, lookup
from .joins import asof, asof_day
from .regime import BEAR, CHOPPY, HIGH_VOL

GATES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_gate(name: str, builder: Callable[[DataFrame], DataFrame]) -> None:
    """User gates: ``builder`` adds columns to a candidate frame."""
    GATES[name] = builder


# ---- gate 1: regime -------------------------------------------------------------------------


def gate1(df: DataFrame, direction: str | None = None) -> DataFrame:
    """Blocks choppy or very unstable regimes (and disallowed directions); shrinks size on flips and low stability."""
    s, flips = F.col("stability"), F.coalesce(F.col("regime_changes"), F.lit(0))
    wrong = F.lit(False)
    if direction:
        wrong = ((F.col(direction) == "LONG") & ~F.col("trade_long")) | ((F.col(direction) == "SHORT") & ~F.col("trade_short"))
    reason = F.when(F.col("regime") == CHOPPY, "choppy").when(wrong, "direction").when(s < 0.25, "unstable")
    mult = F.col("position_mult") * F.when(flips >= 2, 0.75).otherwise(1.0) * F.when(s < 0.40, 0.65).otherwise(1.0)
    df = df.withColumns({"g1_reason": reason, "g1_low_stability": (s < 0.40).cast("int")})
    ok = F.col("g1_reason").isNull()
    return df.withColumns({"g1_passed": ok, "g1_mult": F.when(ok, F.round(mult, 6)).otherwise(0.0)})


# ---- gate 2: eleven rules -------------------------------------------------------------------

HARD = ("earnings_risk", "anomaly_high", "vix_halt")


def gate2(df: DataFrame, min_passes: int = 8) -> DataFrame:
    """At least ``min_passes`` of 11 checks and none of the hard ones failed."""
    bear, hv = F.col("regime") == BEAR, F.col("regime") == HIGH_VOL
    z = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), F.lit(d))
    by_regime = lambda b, h, o: F.when(bear, b).when(hv, h).otherwise(o)
    macro, im, fx, nifty = z("macro_score"), z("intermarket_score"), z("usdinr_5d_pct"), z("nifty_5d_pct")
    fund = F.coalesce("fundamental_grade", F.lit("GOOD"))
    checks = {
        "has_trend": (z("adx") > 18) | (F.abs(z("ema_spread")) > 0.01),
        "volume_ok": z("volume_ratio", 1.0) >= 0.7,
        "market_ok": by_regime(nifty < 3.0, F.lit(True), nifty > -3.0),
        "earnings_risk": z("days_to_earnings", 99.0) > 3,
        "fundamentals_ok": F.when(bear, fund != "UNKNOWN").otherwise(~fund.isin("POOR", "UNKNOWN")),
        "anomaly_high": F.coalesce("severity", F.lit("LOW")) != "HIGH",
        "vix_halt": z("india_vix_level", 15.0) < 28,
        "macro_ok": by_regime(macro < 0.5, macro > -0.7, macro > -0.5),
        "intermarket_ok": by_regime(im < 0.5, im > -0.6, im > -0.4),
        "rupee_ok": by_regime(fx < 3.5, fx < 2.5, fx < 2.0),
        "not_rbi_day": z("days_to_rbi", 30.0) > 0,
    }
    df = df.withColumns({f"g2_{n}": c for n, c in checks.items()})
    n = sum((F.col(f"g2_{c}").cast("int") for c in checks), F.lit(0))
    failed = F.array_compact(F.array(*[F.when(~F.col(f"g2_{c}"), F.lit(c)) for c in checks]))
    hard = F.array_compact(F.array(*[F.when(~F.col(f"g2_{c}"), F.lit(c)) for c in HARD]))
    df = df.withColumns({"g2_n_passed": n, "g2_fail_reasons": failed, "g2_hard_failed": hard})
    return df.withColumns(
        {
            "g2_passed": (F.col("g2_n_passed") >= min_passes) & (F.size("g2_hard_failed") == 0),
            "fundamentals_stale": (fund == "DEFAULTED").cast("int"),
            "fundamentals_bear_confirm": (bear & (fund == "POOR")).cast("int"),
            "macro_bear_confirm": (bear & (macro < -0.5)).cast("int"),
            "intermarket_bear_confirm": (bear & (im < -0.4)).cast("int"),
            "rupee_bear_confirm": (bear & (fx >= 2.0)).cast("int"),
        }
    )


# ---- gate 3: universe rank ------------------------------------------------------------------

# Size by rank.
RANK_SIZE = {1: 1.00, 2: 0.85, 3: 0.70, 4: 0.55, 5: 0.40}


def gate3(bars: DataFrame, index: DataFrame, bear: bool = False) -> DataFrame:
    """Score every name per date, rank it, size by rank; far-off scores get size 0.

    Strength is measured against ``index`` (ts, close: one row a day of the bank index), whose 5-bar
    change as of the date counts 0 while it has none.  One shuffle by name for the windows, one by
    date for the ranks.
    """
    w = fw.series()
    delta = F.col("close") - F.lag("close").over(w)
    df = bars.withColumns({"_d": delta})
    df = df.withColumns({"_up": F.when(F.col("_d") > 0, F.col("_d")).when(F.col("_d").isNotNull(), 0.0), "_dn": F.when(F.col("_d") < 0, -F.col("_d")).when(F.col("_d").isNotNull(), 0.0)})
    gain, loss = fw.roll(F.avg, "_up", w, 14), fw.roll(F.avg, "_dn", w, 14)
    v20 = fw.roll(F.avg, "volume", w, 20)
    df = df.select(
        "ticker", "ts", (fw.pct_change("close", w, 5) * 100).alias("mom_5d"), (100 - 100 / (1 + gain / (loss + 1e-10))).alias("rsi"),
        (fw.roll(F.avg, "volume", w, 5) / (v20 + 1e-8)).alias("vol_trend"),
    ).where(F.col("vol_trend").isNotNull() & F.col("mom_5d").isNotNull() & F.col("rsi").isNotNull())
    day = fw.W.partitionBy("ts")
    change = index.select("ts", (fw.pct_change("close", fw.W.partitionBy(F.lit(0)).orderBy("ts"), 5) * 100).alias("_bn"))
    df = asof_day(df, change, ["_bn"], key=None).withColumn("rs_bn", F.col("mom_5d") - F.coalesce("_bn", F.lit(0.0))).drop("_bn")
    rsi = F.col("rsi")
    if bear:
        zone = F.when((rsi >= 65) | (rsi <= 35), 1.0).when((rsi >= 55) | (rsi <= 45), 0.5).otherwise(0.0)
    else:
        zone = F.when(rsi.between(40, 65), 1.0).when(rsi.between(35, 70), 0.5).otherwise(0.0)
    sign = -1.0 if bear else 1.0
    score = sign * F.col("mom_5d") * 0.40 + sign * F.col("rs_bn") * 0.30 + zone * 20 * 0.20 + (F.col("vol_trend") - 1) * 10 * 0.10
    df = df.withColumn("score", F.round(score, 6))
    df = df.withColumn("rank", F.row_number().over(day.orderBy(F.desc("score"), F.asc("ticker"))))
    size = F.when(F.col("score") < -5.0, 0.0).otherwise(lookup("rank", RANK_SIZE, 0.40))
    return df.withColumns({"g3_size_mult": size, "disqualified": F.col("score") < -5.0, "should_switch": F.col("rank") > 2})


# ---- gate 4: model votes --------------------------------------------------------------------

# Confidence boost and size per grade.
GRADE_BOOST = {"A+": 0.15, "A": 0.10, "B": 0.05, "B-": -0.05, "C": 0.00, "F": -0.20}
GRADE_SIZE = {"A+": 1.20, "A": 1.00, "B": 0.85, "B-": 0.75, "C": 0.70, "F": 0.50}
PLAIN_SIZE = {"A+": 1.20, "A": 1.00, "B": 0.85, "C": 0.70, "F": 0.00}


def raw_direction(long: str = "prob_long", flat: str = "prob_flat", short: str = "prob_short") -> Column:
    l, f, s = F.col(long), F.col(flat), F.col(short)
    return F.when((l > f) & (l >= s), "LONG").when((s > f) & (s > l), "SHORT").otherwise("FLAT")


def alignment(df: DataFrame, positional: str = "positional", swing: str = "swing", intraday: str = "intraday", regime_aware: bool = True, plain: bool = False) -> DataFrame:
    """Agreement grade of the three models; votes against the regime count as FLAT."""

    def vote(c: str) -> Column:
        v = F.col(c)
        if regime_aware:
            v = F.when((v == "LONG") & ~F.col("trade_long"), "FLAT").when((v == "SHORT") & ~F.col("trade_short"), "FLAT").otherwise(v)
        return v

    p, s, i = vote(positional), vote(swing), vote(intraday)
    longs = sum(((x == "LONG").cast("int") for x in (p, s, i)), F.lit(0))
    shorts = sum(((x == "SHORT").cast("int") for x in (p, s, i)), F.lit(0))
    df = df.withColumns({"_l": longs, "_s": shorts, "_ps": (p == s) & (p != "FLAT")})
    both = (F.col("_l") > 0) & (F.col("_s") > 0)
    conflict = F.when(both, "F") if plain else F.when(both & (F.greatest("_l", "_s") >= 2), "B-").when(both, "F")
    grade = conflict.when((F.col("_l") == 3) | (F.col("_s") == 3), "A+").when(F.col("_ps"), "A").when((F.col("_l") >= 2) | (F.col("_s") >= 2), "B").otherwise("C")
    df = df.withColumn("alignment", grade)
    return df.withColumns({"conf_boost": lookup("alignment", GRADE_BOOST), "g4_size_mult": lookup("alignment", PLAIN_SIZE if plain else GRADE_SIZE)}).drop("_l", "_s", "_ps")


def select_prediction(df: DataFrame, variants: tuple[str, ...] = ("prod", "full"), fallback: str = "technical", limit: float = 0.92) -> DataFrame:
    """First available variant; a collapsed one (any class probability >= ``limit``) gives way to the fallback."""
    chosen = F.coalesce(*[F.when(F.col(f"{v}.prob_long").isNotNull(), F.col(v)) for v in variants], F.col(fallback))
    df = df.withColumn("_c", chosen)
    collapsed = F.greatest(F.col("_c.prob_long"), F.col("_c.prob_flat"), F.col("_c.prob_short")) >= limit
    use = F.when(collapsed & F.col(f"{fallback}.prob_long").isNotNull(), F.col(fallback)).otherwise(F.col("_c"))
    df = df.withColumns({"used_fallback": collapsed.cast("int"), "_u": use})
    return df.withColumns({c: F.col(f"_u.{c}") for c in ("prob_long", "prob_flat", "prob_short")}).drop("_c", "_u")


# ---- gate 5: entry --------------------------------------------------------------------------

# Size per entry grade.
ENTRY_SIZE = {"A": 1.00, "B": 0.85, "C": 0.65, "D": 0.40}


def gate5(df: DataFrame, direction: str = "direction") -> DataFrame:
    d, rr = F.col(direction), F.col("reward_risk_sr")
    q = F.when(d == "SHORT", F.coalesce("entry_quality_short", "entry_quality")).otherwise(F.col("entry_quality"))
    near_s, near_r, brk = (F.col(c) == 1 for c in ("near_support", "near_resistance", "near_breakout"))
    mult = (
        lookup(q, ENTRY_SIZE, 0.5)
        * F.when((d == "LONG") & near_r & ~brk, 0.75).otherwise(1.0)
        * F.when((d == "LONG") & brk, 1.1).otherwise(1.0)
        * F.when((d == "SHORT") & near_s, 0.75).otherwise(1.0)
        * F.when((d == "SHORT") & brk, 0.80).otherwise(1.0)
        * F.when(rr < 2.0, 0.5).otherwise(1.0)
    )
    ok = rr >= 0.5
    return df.withColumns({"g5_quality": q, "g5_passed": ok, "g5_mult": F.when(ok, F.round(F.least(F.greatest(mult, F.lit(0.0)), F.lit(1.2)), 6)).otherwise(0.0)})


# ---- gate 6: confidence ---------------------------------------------------------------------

# Thresholds, premium, volatility boosts, allowed grades.
THRESHOLDS = {
    "swing": {"SMALL": 0.68, "GROWING": 0.60, "FULL": 0.60},
    "intraday": {"SMALL": 0.72, "GROWING": 0.68, "FULL": 0.65},
    "positional": {"SMALL": 0.65, "GROWING": 0.60, "FULL": 0.55},
}
EDGE_PREMIUM = {"swing": 0.03, "positional": 0.05, "intraday": 0.0}
VIX_BOOST = {"intraday": (0.03, 0.00), "swing": (0.10, 0.05), "positional": (0.15, 0.08)}
MIN_ALIGNMENT = {"SMALL": ("A+",), "GROWING": ("A+", "A"), "FULL": ("A+", "A", "B")}


def threshold() -> Column:
    out = None
    for cat, modes in THRESHOLDS.items():
        for mode, v in modes.items():
            hit = (F.col("category") == cat) & (F.col("capital_mode") == mode)
            out = F.when(hit, v) if out is None else out.when(hit, v)
    base = out.otherwise(0.60)
    base = F.least(base + lookup("category", EDGE_PREMIUM, 0.0), F.lit(0.95))
    vix = F.col("india_vix_level")
    high = lookup("category", {k: v[0] for k, v in VIX_BOOST.items()}, 0.10)
    mid = lookup("category", {k: v[1] for k, v in VIX_BOOST.items()}, 0.05)
    base = F.when(vix > 25, F.least(base + high, F.lit(0.90))).when(vix > 20, F.least(base + mid, F.lit(0.90))).otherwise(base)
    boost = F.coalesce(F.col("threshold_boost"), F.lit(0.0))
    return F.round(F.when(boost > 0, F.least(base + boost, F.lit(0.95))).otherwise(base), 6)


def gate6(df: DataFrame, check_alignment: bool = False) -> DataFrame:
    """Breaker, risk stop, optional alignment floor, then confidence against the threshold or a clean-geometry override."""
    conf = F.col("confidence")
    df = df.withColumn("g6_threshold", threshold())
    t = F.col("g6_threshold")
    rescue = (conf >= 0.50) & F.col("g5_quality").isin("A", "B") & (F.col("reward_risk_sr") >= 2.0) & (conf >= F.round(t - 0.10, 6)) & (conf < t)
    bad_grade = F.lit(False)
    if check_alignment:
        for mode, ok in MIN_ALIGNMENT.items():
            bad_grade = bad_grade | ((F.col("capital_mode") == mode) & ~F.col("alignment").isin(*ok))
    reason = (
        F.when(F.col("circuit_breaker_level").isin("PAUSE", "HALT"), "circuit_breaker")
        .when(~F.col("trading_allowed"), "risk_stop")
        .when(bad_grade, "alignment")
        .when((conf < t) & ~rescue, "confidence")
    )
    df = df.withColumns({"g6_reason": reason, "expectancy_pass": rescue.cast("int")})
    return df.withColumns({"g6_passed": F.col("g6_reason").isNull(), "expected_r": F.when(rescue, F.round(conf * F.col("reward_risk_sr") - (1 - conf), 6))})


# ---- timing, per-category flow --------------------------------------------------------------


def entry_timing(df: DataFrame, direction: str = "direction") -> DataFrame:
    """Defers entries against a sharp 30-minute move: more than max(.35 %, .4 ATR %)."""
    mom, d = F.coalesce(F.col("intraday_mom_30m"), F.lit(0.0)), F.col(direction)
    thr = F.greatest(F.lit(0.0035), 0.4 * F.greatest(F.coalesce(F.col("atr_pct"), F.lit(0.0)), F.lit(0.0)))
    bad = ((d == "LONG") & (mom <= -thr)) | ((d == "SHORT") & (mom >= thr))
    return df.withColumns({"adverse_threshold": thr, "entry_ok": ~bad})


# Timeframes per capital mode.
ALLOWED = {"SMALL": ("swing",), "GROWING": ("swing", "intraday"), "FULL": ("swing", "intraday", "positional")}


def category_signals(df: DataFrame) -> DataFrame:
    """Per (ticker, ts, category) candidate: hard blocks, stacked threshold boosts, gates 5 and 6, timing, size.

    Expects the regime rule columns, g1_mult, g1_low_stability, regime_changes, g3_size_mult,
    alignment with g4_size_mult, entry columns, risk columns and the candidate's direction and
    (boosted) confidence.
    """
    d, cat, regime = F.col("direction"), F.col("category"), F.col("regime")
    df = df.withColumn("regime_match_now", ((d == "LONG") & F.col("trade_long")) | ((d == "SHORT") & F.col("trade_short")))
    match = F.col("regime_match_now")
    cap = lambda c: F.least(c, F.lit(0.15))
    boost = F.lit(0.0)
    boost = cap(boost + F.when((cat == "positional") & (F.coalesce(F.col("fundamentals_stale"), F.lit(0)) == 1), 0.05).otherwise(0.0))
    boost = cap(boost + F.when(~match, F.when(cat == "intraday", 0.10).otherwise(0.07)).when(regime == HIGH_VOL, 0.05).otherwise(0.0))
    boost = cap(boost + F.when(F.col("g1_low_stability") == 1, 0.05).otherwise(0.0))
    boost = cap(boost + F.when(F.col("regime_changes") >= 2, 0.05).otherwise(0.0))
    df = df.withColumn("threshold_boost", F.round(boost, 6))
    df = entry_timing(gate6(gate5(df)))
    allowed = F.lit(False)
    for mode, cats in ALLOWED.items():
        allowed = allowed | ((F.col("capital_mode") == mode) & cat.isin(*cats))
    blocked = (
        F.when(~allowed, "mode")
        .when(d == "FLAT", "flat")
        .when((cat == "positional") & ~match, "positional_counter_regime")
        .when((cat == "positional") & (regime == HIGH_VOL), "positional_high_vol")
        .when(F.col("g5_passed") & ~match & (F.col("g5_quality") == "D"), "counter_regime_grade_d")
        .when(~F.col("g5_passed"), "gate5")
        .when(~F.col("g6_passed"), F.concat(F.lit("gate6_"), F.col("g6_reason")))
        .when(~F.col("entry_ok"), "timing")
    )
    size = F.col("g1_mult") * F.col("g3_size_mult") * F.col("g4_size_mult") * F.col("g5_mult") * F.col("final_size_mult") * F.when(match, 1.0).otherwise(0.5)
    df = df.withColumns({"block_reason": blocked, "size_mult": F.round(F.least(F.greatest(size, F.lit(0.0)), F.lit(1.5)), 6)})
    return df.withColumn("passed", F.col("block_reason").isNull())


def best_signal(df: DataFrame, keys: list[str]) -> DataFrame:
    """Highest confidence per key among passed candidates; name and category break ties."""
    cols = [c for c in ("ticker", "category", "direction", "confidence", "size_mult", "position_value") if c in df.columns and c not in keys]
    rank = F.struct((-F.col("confidence")).alias("c"), F.col("ticker").alias("t"), F.col("category").alias("k"))
    top = df.where(F.col("passed")).groupBy(*keys).agg(F.min_by(F.struct(*cols), rank).alias("z"))
    return top.select(*keys, *[F.col(f"z.{c}").alias(c) for c in cols])


# ---- state rules over cycles ----------------------------------------------------------------


def decisive(df: DataFrame, margin: float = 0.05) -> DataFrame:
    """Argmax direction and its dead-banded version."""
    df = df.withColumn("raw_dir", raw_direction())
    lead = F.when(F.col("raw_dir") == "LONG", F.col("prob_long")).otherwise(F.col("prob_short")) - F.col("prob_flat")
    return df.withColumn("decisive", F.when((F.col("raw_dir") != "FLAT") & (F.round(lead, 6) >= margin), F.col("raw_dir")).otherwise("FLAT"))


def stabilise(cycles: DataFrame, confirm: str = "confirm", key: str = "skey", order: tuple[str, ...] = ("ts", "event_id"), rows: int = 4096) -> DataFrame:
    """Committed direction per cycle (``confirm`` 1 to 3): needs that many equal decisive reads, drops to FLAT at once, reverses via FLAT.

    Closed form: with two or more confirmations the committed direction is the decisive one from
    the n-th equal read on; with one it alternates with FLAT along a run of direct reversals.
    Row-indexed blocks keep a hot key from landing in one task.
    """
    df = fw.index_rows(decisive(cycles), key, order, F.to_date("ts"))
    df = fw.blocked(df, "i", 2, rows)
    w = fw.W.partitionBy(key, "_blk").orderBy("i")
    l1, l2 = F.lag("decisive", 1).over(w), F.lag("decisive", 2).over(w)
    now = F.col("decisive")
    direct = (now != F.coalesce(l1, F.lit("FLAT"))) & (now != "FLAT") & (F.coalesce(l1, F.lit("FLAT")) != "FLAT")
    df = df.withColumns({"_two": now == l1, "_three": (now == l1) & (l1 == l2), "_direct": direct})
    df = fw.unblock(df)
    df = fw.prefix(df, key, {"_anchor": ("last", F.when(~F.col("_direct"), F.col("i")))})
    even = (F.col("i") - F.coalesce("_anchor", F.lit(-1))) % 2 == 0
    enough = F.when(F.col(confirm) >= 3, F.coalesce("_three", F.lit(False))).when(F.col(confirm) == 2, F.coalesce("_two", F.lit(False))).otherwise(even)
    df = df.withColumn("committed", F.when((now != "FLAT") & enough, now).otherwise("FLAT"))
    return df.withColumn("intervened", (F.col("committed") != F.col("raw_dir")).cast("int")).drop("_two", "_three", "_direct", "_anchor", "i")


def _segments(df: DataFrame, key: str, order: tuple[str, ...], reset: Callable, rows: int) -> DataFrame:
    """Adds ``i`` and ``_seg``: the index of the last row whose outcome does not depend on history."""
    df = fw.index_rows(df, key, order, F.to_date("ts"))
    df = fw.blocked(df, "i", 1, rows)
    w = fw.W.partitionBy(key, "_blk").orderBy("i")
    df = fw.unblock(df.withColumn("_reset", F.coalesce(reset(w), F.lit(True))))
    return fw.prefix(df, key, {"_seg": ("last", F.when(F.col("_reset"), F.col("i")))}).drop("_reset")


def _scan(df: DataFrame, key: str, out: str, step: Callable, fields: list[str]) -> DataFrame:
    """Ordered scan of (key, segment) pieces: one Arrow stream per task, state reset at each piece.

    ``step(state, i, *values) -> (flag, state)``.  Pieces are spread by hash, so a hot key's pieces
    run in many tasks, and a task keeps one state however many pieces it sees.
    """
    schema = df.withColumn(out, F.lit(1)).schema

    def run(batches):
        piece, state = None, None
        for pdf in batches:
            flags = []
            for k, s, i, *vals in zip(pdf[key], pdf["_seg"], pdf["i"], *[pdf[f] for f in fields]):
                if (k, s) != piece:
                    piece, state = (k, s), None
                hit, state = step(state, i, *vals)
                flags.append(int(hit))
            yield pdf.assign(**{out: pd.Series(flags, index=pdf.index, dtype="int32")})

    spread = df.repartition(key, "_seg").sortWithinPartitions(key, "_seg", "i")
    return spread.mapInPandas(run, schema).drop("_seg", "i")


def alert_dedup(df: DataFrame, key: str = "skey", direction: str = "committed", conf: str = "confidence", delta: float = 0.05, order: tuple[str, ...] = ("ts", "event_id"), rows: int = 4096) -> DataFrame:
    """``sent`` = 1 where the direction changed or confidence moved ``delta`` since the last sent row.

    A direction change is always sent, so history before it is irrelevant: series are cut there
    and only the pieces are scanned in order.  Going flat is sent once, never as a series' first row.
    """
    x = _segments(df, key, order, lambda w: F.col(direction) != F.lag(direction).over(w), rows)

    def step(last, i, d, c):
        if d == "FLAT":
            return last is None and i > 0, c
        hit = last is None or abs(last - c) >= delta - 1e-9
        return hit, c if hit else last

    return _scan(x, key, "sent", step, [direction, conf])


def cooldown(df: DataFrame, key: str = "skey", seconds: int = 1800, order: tuple[str, ...] = ("ts", "event_id"), rows: int = 4096) -> DataFrame:
    """``emitted`` = 1 at least ``seconds`` after the last emitted row.

    The row that follows an emitted one is the first one late enough, whatever came before: an as-of join finds it for every
    row, and the emitted rows are those on the path from a key's first row.
    """
    stamp = F.col("ts").cast("timestamp_ntz")
    x = fw.index_rows(df, key, order, F.to_date("ts"))
    at = x.groupBy(key, stamp.alias("_at")).agg(F.min("i").alias("nxt"))
    due = x.select(F.col(key).alias("_key"), "i", (stamp + F.make_dt_interval(secs=F.lit(seconds))).alias("_due"))
    nodes = asof(due.withColumnRenamed("_key", key), at, ["nxt"], key, "_due", "_at", "day", forward=True)
    on = path(nodes.select(F.col(key).alias("key"), "i", "nxt"), rows).select(F.col("key").alias(key), "i", F.lit(1).alias("emitted"))
    return x.join(on, [key, "i"], "left").withColumn("emitted", F.coalesce("emitted", F.lit(0))).select(*df.columns, "emitted")


def reversals(positions: DataFrame, models: DataFrame) -> DataFrame:
    """Open positions whose model now points the other way, or whose regime turned since entry."""
    x = positions.join(models, ["ticker", "category"])
    flip = ((F.col("signal") == "LONG") & (F.col("model_dir") == "SHORT")) | ((F.col("signal") == "SHORT") & (F.col("model_dir") == "LONG"))
    adverse = ((F.col("signal") == "LONG") & F.col("regime_now").contains("BEAR")) | ((F.col("signal") == "SHORT") & F.col("regime_now").contains("BULL"))
    turned = adverse & (F.coalesce("regime_match", F.lit(0)) == 1) & (F.col("regime") != F.col("regime_now"))
    return x.withColumn("alert", F.when(flip, "MODEL_REVERSAL").when(turned, "REGIME_CHANGE")).where(F.col("alert").isNotNull())


def funnel(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Where candidates die: counts per blocking reason."""
    return df.groupBy(*(by or []), F.coalesce("block_reason", F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def near_misses(df: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` confidence misses closest to their threshold, with the override's verdict."""
    gap = F.round(F.col("g6_threshold") - F.col("confidence"), 6)
    x = df.where(F.col("block_reason") == "gate6_confidence").withColumn("gap", gap)
    reach = (F.col("confidence") >= 0.5) & (F.col("reward_risk_sr") >= 2.0) & (F.col("gap") <= 0.10) & F.col("g5_quality").isin("A", "B")
    return x.withColumn("within_reach", reach.cast("int")).orderBy("gap", "ticker", "ts", "category").limit(n)
