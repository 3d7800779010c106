"""Gate, ranking and state-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..operators import anomaly as an
from ..operators import fundamentals as fd
from ..operators import gates as sg
from ..operators import joins as jn
from ..operators import macro as mc
from ..operators import regime as rg
from ..operators import technical as ta
from ..sources import adapters as src
from .macro import market
from .oracle import define, sql
from .regime import RULES_SQL
from .registry import register, wrap
from .technical import W, guarded

# ---- inputs ---------------------------------------------------------------------------------


def frame(spark, d):
    """Every bar with its technical, regime, anomaly, market, earnings and fundamental context."""
    t = ta.price_action(ta.volume(ta.trend(src.bars(spark, d))))
    r = rg.with_rules(rg.trend(rg.stability(rg.name(rg.classify(t)))))
    m = mc.name_frame(an.severity(an.rules(r)), market(spark, d))
    e = fd.days_to_earnings(m, fd.surprise(src.earnings(spark, d)))
    return jn.asof_day(e, fd.frame(src.fundamentals(spark, d)), ["fundamental_grade"], right_ts="fetched_at")


CATS = ("swing", "positional", "intraday")


def model_probs(df):
    """Three models' class probabilities from the bar's integers, with each one's direction."""
    c, v, h, l = (F.col(x).cast("long") for x in ("close", "volume", "high", "low"))
    for k, cat in enumerate(CATS):
        a, b, s = F.pmod(c * 7 + v * 3 + k * 13, F.lit(97)) + 1, F.pmod(h * 5 + v + k * 17, F.lit(31)) + 1, F.pmod(l * 11 + c + k * 19, F.lit(89)) + 1
        df = df.withColumns({f"{cat}_long": F.round(a / (a + b + s), 6), f"{cat}_flat": F.round(b / (a + b + s), 6), f"{cat}_short": F.round(s / (a + b + s), 6)})
        df = df.withColumn(cat, sg.raw_direction(f"{cat}_long", f"{cat}_flat", f"{cat}_short"))
    return df


def entry_context(df):
    """Entry, risk and mode columns from the bar's integers."""
    v, h, l = (F.col(x).cast("long") for x in ("volume", "high", "low"))
    grade = lambda x: F.element_at(F.array(*[F.lit(g) for g in "ABCD"]), (x % 4 + 1).cast("int"))
    return df.withColumns(
        {
            "entry_quality": grade(v), "entry_quality_short": grade(h), "near_support": (h % 3 == 0).cast("int"), "near_resistance": (l % 3 == 0).cast("int"),
            "near_breakout": (v % 7 == 0).cast("int"), "reward_risk_sr": F.lit(2.5), "circuit_breaker_level": F.when(v % 50 == 0, "PAUSE").otherwise("OK"), "trading_allowed": v % 29 != 0,
            "final_size_mult": F.lit(1.0), "capital_mode": F.element_at(F.array(*[F.lit(m) for m in ("SMALL", "GROWING", "FULL")]), (v % 3 + 1).cast("int")),
            "intraday_mom_30m": F.round(F.col("returns_1d") / 4, 6), "atr_pct": F.col("atr_14") / F.col("close"),
        }
    )


def candidates(spark, d):
    f = sg.gate2(sg.gate1(entry_context(frame(spark, d))))
    f = sg.alignment(model_probs(f))
    g3 = sg.gate3(src.bars(spark, d), src.bank_index(spark, d)).select("ticker", "ts", "g3_size_mult")
    f = f.join(g3, ["ticker", "ts"], "left").fillna(1.0, ["g3_size_mult"])
    conf = lambda c: F.round(clamp(F.greatest(f"{c}_long", f"{c}_flat", f"{c}_short") + F.col("conf_boost"), 0, 0.95), 6)
    one = lambda c: F.struct(F.lit(c).alias("category"), F.col(c).alias("direction"), conf(c).alias("confidence"))
    f = f.withColumn("_c", F.explode(F.array(*[one(c) for c in CATS])))
    return f.withColumns({"category": F.col("_c.category"), "direction": F.col("_c.direction"), "confidence": F.col("_c.confidence")}).drop("_c")


def signals(spark, d):
    return sg.category_signals(candidates(spark, d))


define(
    "gf",
    """SELECT r.ticker, r.ts, r.close, b.high, b.low, b.volume, r.regime, CAST(r.stability AS DOUBLE) AS stability, r.adx, r.ema_spread, q.trade_long, q.trade_short, q.position_mult, q.max_hold_days, t.changes, v.volume_ratio, p.returns_1d, tt.atr_14,
    m.nifty_5d_pct, m.india_vix_level, m.india_vix_1d_pct, m.macro_score, m.intermarket_score, m.usdinr_5d_pct, m.days_to_rbi, m.macro_event_mult, e.d AS days_to_earnings, a.sev, a.fl,
    CASE WHEN f.fundamental_score > 0.4 THEN 'EXCELLENT' WHEN f.fundamental_score > 0.1 THEN 'GOOD' WHEN f.fundamental_score > -0.1 THEN 'AVERAGE' WHEN f.fundamental_score > -0.4 THEN 'WEAK' WHEN f.fundamental_score IS NOT NULL THEN 'POOR' ELSE 'GOOD' END AS grade
  FROM regimes2 r JOIN """
    + RULES_SQL
    + """ USING (regime) JOIN bars b ON b.ticker = r.ticker AND b.ts = r.ts JOIN rtr1 t ON t.ticker = r.ticker AND t.ts = r.ts JOIN tech_volume v ON v.ticker = r.ticker AND v.ts = r.ts JOIN tech_price p ON p.ticker = r.ticker AND p.ts = r.ts
    JOIN tech_trend tt ON tt.ticker = r.ticker AND tt.ts = r.ts JOIN imk m ON m.ticker = r.ticker AND m.ts = r.ts JOIN er4 e ON e.ticker = r.ticker AND e.ts = r.ts JOIN an3 a ON a.ticker = r.ticker AND a.ts = r.ts
    ASOF LEFT JOIN fund3 f ON f.ticker = r.ticker AND r.ts >= f.fetched_at""",
    "regimes2", "bars", "rtr1", "tech_volume", "tech_price", "tech_trend", "imk", "er4", "an3", "fund3",
)
define(
    "g1",
    """SELECT *, CASE WHEN g1_reason IS NULL THEN round(position_mult * CASE WHEN changes >= 2 THEN 0.75 ELSE 1 END::DOUBLE * CASE WHEN stability < 0.4 THEN 0.65 ELSE 1 END::DOUBLE, 6) ELSE 0 END AS g1_mult FROM (
    SELECT *, CASE WHEN regime = 'CHOPPY_SIDEWAYS' THEN 'choppy' WHEN stability < 0.25 THEN 'unstable' END AS g1_reason FROM gf)""",
    "gf",
)
register(
    "gate1_regime",
    lambda spark, d: sg.gate1(rg.with_rules(rg.trend(rg.stability(rg.name(rg.classify(ta.price_action(ta.trend(src.bars(spark, d)))))))))
    .select("ticker", "ts", "regime", F.col("g1_passed"), "g1_reason", "g1_mult", "g1_low_stability"),
    sql("SELECT ticker, ts, regime, g1_reason IS NULL AS g1_passed, g1_reason, g1_mult, (stability < 0.4)::INT AS g1_low_stability FROM g1", "g1"),
)
_by = lambda b, h, o: f"CASE regime WHEN 'BEAR_TRENDING' THEN {b} WHEN 'HIGH_VOLATILITY' THEN {h} ELSE {o} END"
_G2 = {
    "has_trend": "coalesce(adx, 0) > 18 OR abs(coalesce(ema_spread, 0)) > 0.01",
    "volume_ok": "coalesce(volume_ratio, 1) >= 0.7",
    "market_ok": _by("coalesce(nifty_5d_pct, 0) < 3", "true", "coalesce(nifty_5d_pct, 0) > -3"),
    "earnings_risk": "days_to_earnings > 3",
    "fundamentals_ok": "CASE WHEN regime = 'BEAR_TRENDING' THEN grade <> 'UNKNOWN' ELSE grade NOT IN ('POOR', 'UNKNOWN') END",
    "anomaly_high": "sev <> 'HIGH'",
    "vix_halt": "coalesce(india_vix_level, 15) < 28",
    "macro_ok": _by("coalesce(macro_score, 0) < 0.5", "coalesce(macro_score, 0) > -0.7", "coalesce(macro_score, 0) > -0.5"),
    "intermarket_ok": _by("coalesce(intermarket_score, 0) < 0.5", "coalesce(intermarket_score, 0) > -0.6", "coalesce(intermarket_score, 0) > -0.4"),
    "rupee_ok": _by("coalesce(usdinr_5d_pct, 0) < 3.5", "coalesce(usdinr_5d_pct, 0) < 2.5", "coalesce(usdinr_5d_pct, 0) < 2"),
    "not_rbi_day": "coalesce(days_to_rbi, 30) > 0",
}
define("g2a", f"SELECT *, {', '.join(f'({e}) AS {n}' for n, e in _G2.items())} FROM g1", "g1")
define("g2", f"SELECT *, {' + '.join(f'{n}::INT' for n in _G2)} AS np, concat_ws(',', {', '.join(f'''CASE WHEN NOT {n} THEN '{n}' END''' for n in _G2)}) AS fails FROM g2a", "g2a")
register(
    "gate2_rules",
    lambda spark, d: sg.gate2(frame(spark, d)).select("ticker", "ts", *[f"g2_{n}" for n in _G2], F.col("g2_n_passed").alias("n_passed"), F.array_join("g2_fail_reasons", ",").alias("fail_reasons"), F.col("g2_passed").alias("passed")),
    sql(f"SELECT ticker, ts, {', '.join(f'{n} AS g2_{n}' for n in _G2)}, np AS n_passed, fails AS fail_reasons, np >= 8 AND earnings_risk AND anomaly_high AND vix_halt AS passed FROM g2", "g2"),
)
register(
    "gate2_confirms",
    lambda spark, d: sg.gate2(frame(spark, d)).select("ticker", "ts", "fundamentals_stale", "fundamentals_bear_confirm", "macro_bear_confirm", "intermarket_bear_confirm", "rupee_bear_confirm"),
    sql(
        """SELECT ticker, ts, (grade = 'DEFAULTED')::INT AS fundamentals_stale, (b AND grade = 'POOR')::INT AS fundamentals_bear_confirm, (b AND coalesce(macro_score, 0) < -0.5)::INT AS macro_bear_confirm,
    (b AND coalesce(intermarket_score, 0) < -0.4)::INT AS intermarket_bear_confirm, (b AND coalesce(usdinr_5d_pct, 0) >= 2)::INT AS rupee_bear_confirm FROM (SELECT *, regime = 'BEAR_TRENDING' AS b FROM gf)""",
        "gf",
    ),
)

define("bn5", "SELECT ts, (close / lag(close, 5) OVER (ORDER BY ts) - 1) * 100 AS bn FROM series WHERE name = 'banknifty'", "series")
define("g3a", f"SELECT *, close - lag(close) {W}) AS dl, (close / lag(close, 5) {W}) - 1) * 100 AS mom, {guarded('avg(volume)', 'volume', 5)} / ({guarded('avg(volume)', 'volume', 20)} + 1e-8) AS vt FROM bars", "bars")
define(
    "g3b",
    f"""SELECT g.*, coalesce(bn5.bn, 0) AS bn FROM (SELECT ticker, ts, mom, vt, 100 - 100 / (1 + {guarded('avg(greatest(dl, 0))', 'dl', 14)} / ({guarded('avg(greatest(-dl, 0))', 'dl', 14)} + 1e-10)) AS rsi FROM g3a) g ASOF LEFT JOIN bn5 ON g.ts >= bn5.ts WHERE vt IS NOT NULL AND mom IS NOT NULL AND rsi IS NOT NULL""",
    "g3a", "bn5",
)
for _bear in (False, True):
    _z = "CASE WHEN rsi >= 65 OR rsi <= 35 THEN 1 WHEN rsi >= 55 OR rsi <= 45 THEN 0.5 ELSE 0 END" if _bear else "CASE WHEN rsi BETWEEN 40 AND 65 THEN 1 WHEN rsi BETWEEN 35 AND 70 THEN 0.5 ELSE 0 END"
    _s = "-" if _bear else ""
    define(
        "g3bear" if _bear else "g3",
        f"""SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, ticker) AS rk FROM (SELECT *, round({_s}mom * 0.4 + {_s}(mom - bn) * 0.3 + {_z}::DOUBLE * 4 + (vt - 1), 6) AS score FROM g3b)""",
        "g3b",
    )
    register(
        "gate3_rank" + ("_bear" if _bear else ""),
        lambda spark, d, bear=_bear: sg.gate3(src.bars(spark, d), src.bank_index(spark, d), bear).select("ticker", "ts", "score", "rank", "g3_size_mult", "disqualified", "should_switch"),
        sql(
            f"""SELECT ticker, ts, score, CAST(rk AS INT) AS rank, CASE WHEN score < -5 THEN 0 ELSE [1.0, 0.85, 0.7, 0.55, 0.4][rk] END::DOUBLE AS g3_size_mult, score < -5 AS disqualified, rk > 2 AS should_switch FROM {"g3bear" if _bear else "g3"}""",
            "g3bear" if _bear else "g3",
        ),
    )
define("g3ca", f"SELECT *, close - lag(close) {W}) AS dl, (close / lag(close, 5) {W}) - 1) * 100 AS mom, {guarded('avg(volume)', 'volume', 5)} / ({guarded('avg(volume)', 'volume', 20)} + 1e-8) AS vt FROM clean", "clean")
define(
    "g3cb",
    f"""SELECT g.*, coalesce(bn5.bn, 0) AS bn FROM (SELECT ticker, ts, mom, vt, 100 - 100 / (1 + {guarded('avg(greatest(dl, 0))', 'dl', 14)} / ({guarded('avg(greatest(-dl, 0))', 'dl', 14)} + 1e-10)) AS rsi FROM g3ca) g ASOF LEFT JOIN bn5 ON g.ts >= bn5.ts WHERE vt IS NOT NULL AND mom IS NOT NULL AND rsi IS NOT NULL""",
    "g3ca", "bn5",
)
define(
    "g3c",
    """SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, ticker) AS rk FROM (SELECT *, round(mom * 0.4 + (mom - bn) * 0.3
    + CASE WHEN rsi BETWEEN 40 AND 65 THEN 1 WHEN rsi BETWEEN 35 AND 70 THEN 0.5 ELSE 0 END::DOUBLE * 4 + (vt - 1), 6) AS score FROM g3cb)""",
    "g3cb",
)
register(
    "universe_top1",
    lambda spark, d: sg.gate3(ta.clean_bars(src.bars(spark, d)), src.bank_index(spark, d)).where((F.col("rank") == 1) & ~F.col("disqualified")).select("ts", "ticker", "score", F.round("rsi", 4).alias("rsi")),
    sql(
        "SELECT ts, ticker, score, round(rsi, 4) AS rsi FROM g3c WHERE rk = 1 AND NOT score < -5",
        "g3c",
    ),
)

_M = [("swing", 0), ("positional", 1), ("intraday", 2)]
define(
    "mp0",
    "SELECT *, " + ", ".join(f"(CAST(close AS BIGINT) * 7 + CAST(volume AS BIGINT) * 3 + {k * 13}) % 97 + 1 AS {c}_a, (CAST(high AS BIGINT) * 5 + CAST(volume AS BIGINT) + {k * 17}) % 31 + 1 AS {c}_b, (CAST(low AS BIGINT) * 11 + CAST(close AS BIGINT) + {k * 19}) % 89 + 1 AS {c}_s" for c, k in _M) + " FROM g1",
    "g1",
)
define("mp1", "SELECT *, " + ", ".join(f"CASE WHEN {c}_a > {c}_b AND {c}_a >= {c}_s THEN 'LONG' WHEN {c}_s > {c}_b AND {c}_s > {c}_a THEN 'SHORT' ELSE 'FLAT' END AS d_{c}, round(greatest({c}_a, {c}_b, {c}_s) / ({c}_a + {c}_b + {c}_s), 6) AS {c}_p" for c, _ in _M) + " FROM mp0", "mp0")


def _votes(regime: bool) -> str:
    return ", ".join(f"CASE WHEN d_{c} = 'LONG' AND NOT trade_long THEN 'FLAT' WHEN d_{c} = 'SHORT' AND NOT trade_short THEN 'FLAT' ELSE d_{c} END AS v_{c}" if regime else f"d_{c} AS v_{c}" for c, _ in _M)


for _n, _reg, _plain in (("al", True, False), ("alp", False, True)):
    define(
        _n,
        f"""SELECT *, CASE WHEN ln > 0 AND sn > 0 {"" if _plain else "AND greatest(ln, sn) >= 2"} THEN '{'F' if _plain else 'B-'}' WHEN ln > 0 AND sn > 0 THEN 'F' WHEN ln = 3 OR sn = 3 THEN 'A+' WHEN v_positional = v_swing AND v_swing <> 'FLAT' THEN 'A' WHEN greatest(ln, sn) >= 2 THEN 'B' ELSE 'C' END AS alignment
    FROM (SELECT *, (v_swing = 'LONG')::INT + (v_positional = 'LONG')::INT + (v_intraday = 'LONG')::INT AS ln, (v_swing = 'SHORT')::INT + (v_positional = 'SHORT')::INT + (v_intraday = 'SHORT')::INT AS sn FROM (SELECT *, {_votes(_reg)} FROM mp1) v)""",
        "mp1",
    )
_BOOST = "CASE alignment WHEN 'A+' THEN 0.15 WHEN 'A' THEN 0.1 WHEN 'B' THEN 0.05 WHEN 'B-' THEN -0.05 WHEN 'C' THEN 0 ELSE -0.2 END::DOUBLE"
_ASIZE = "CASE alignment WHEN 'A+' THEN 1.2 WHEN 'A' THEN 1 WHEN 'B' THEN 0.85 WHEN 'B-' THEN 0.75 WHEN 'C' THEN 0.7 ELSE 0.5 END::DOUBLE"
register(
    "alignment_grade",
    lambda spark, d: sg.alignment(model_probs(rg.with_rules(rg.name(rg.classify(ta.price_action(ta.trend(src.bars(spark, d)))))))).select("ticker", "ts", "swing", "positional", "intraday", "alignment", "conf_boost", "g4_size_mult"),
    sql(f"SELECT ticker, ts, d_swing AS swing, d_positional AS \"positional\", d_intraday AS intraday, alignment, {_BOOST} AS conf_boost, {_ASIZE} AS g4_size_mult FROM al", "al"),
)
register(
    "alignment_plain",
    lambda spark, d: sg.alignment(model_probs(src.bars(spark, d)), regime_aware=False, plain=True).select("ticker", "ts", "alignment", "g4_size_mult"),
    sql("SELECT ticker, ts, alignment, CASE alignment WHEN 'A+' THEN 1.2 WHEN 'A' THEN 1 WHEN 'B' THEN 0.85 WHEN 'C' THEN 0.7 ELSE 0 END::DOUBLE AS g4_size_mult FROM alp", "alp"),
)


def variants(spark, d):
    """Production and fallback predictions per cycle; the production one is missing for every seventh event."""
    c = src.cycles(spark, d)
    probs = lambda a, b, s: F.struct(F.col(a).alias("prob_long"), F.col(b).alias("prob_flat"), F.col(s).alias("prob_short"))
    prod = F.when(F.col("event_id") % 7 != 0, probs("prob_long", "prob_flat", "prob_short"))
    full = F.when(F.col("event_id") % 2 == 0, probs("prob_flat", "prob_short", "prob_long"))
    return c.select("event_id", prod.alias("prod"), full.alias("full"), probs("prob_short", "prob_long", "prob_flat").alias("technical"))


register(
    "predict_select",
    lambda spark, d: sg.select_prediction(variants(spark, d)).select("event_id", "used_fallback", "prob_long", "prob_flat", "prob_short"),
    sql(
        """SELECT event_id, col::INT AS used_fallback, CASE WHEN col THEN s ELSE a END AS prob_long, CASE WHEN col THEN l ELSE b END AS prob_flat, CASE WHEN col THEN f ELSE c END AS prob_short FROM (
    SELECT *, greatest(a, b, c) >= 0.92 AS col FROM (SELECT event_id, prob_long AS l, prob_flat AS f, prob_short AS s, CASE WHEN event_id % 7 <> 0 THEN prob_long WHEN event_id % 2 = 0 THEN prob_flat ELSE prob_short END AS a,
      CASE WHEN event_id % 7 <> 0 THEN prob_flat WHEN event_id % 2 = 0 THEN prob_short ELSE prob_long END AS b, CASE WHEN event_id % 7 <> 0 THEN prob_short WHEN event_id % 2 = 0 THEN prob_long ELSE prob_flat END AS c FROM cycles))""",
        "cycles",
    ),
)

define(
    "cand",
    f"""SELECT a.ticker, a.ts, a.close, a.atr_14, a.regime, a.stability, a.changes, a.trade_long, a.trade_short, a.g1_mult, a.alignment, {_ASIZE} AS g4m, coalesce(g3m, 1.0) AS g3m, a.india_vix_level AS vix, a.macro_event_mult, x.category, x.direction,
    round(least(0.95, greatest(0, x.p + {_BOOST})), 6) AS confidence, ['A', 'B', 'C', 'D'][CAST(volume AS BIGINT) % 4 + 1] AS eq, ['A', 'B', 'C', 'D'][CAST(high AS BIGINT) % 4 + 1] AS eqs, CAST(high AS BIGINT) % 3 = 0 AS ns, CAST(low AS BIGINT) % 3 = 0 AS nr,
    CAST(volume AS BIGINT) % 7 = 0 AS brk, CAST(volume AS BIGINT) % 50 = 0 AS cb, CAST(volume AS BIGINT) % 29 <> 0 AS allowed, ['SMALL', 'GROWING', 'FULL'][CAST(volume AS BIGINT) % 3 + 1] AS mode, round(returns_1d / 4, 6) AS m30
  FROM al a LEFT JOIN (SELECT ticker, ts, CASE WHEN score < -5 THEN 0 ELSE [1.0, 0.85, 0.7, 0.55, 0.4][rk] END::DOUBLE AS g3m FROM g3) r ON r.ticker = a.ticker AND r.ts = a.ts,
    LATERAL (VALUES ('swing', d_swing, swing_p), ('positional', d_positional, positional_p), ('intraday', d_intraday, intraday_p)) x(category, direction, p)""",
    "al", "g3",
)
define(
    "cand1",
    """SELECT *, CASE WHEN direction = 'SHORT' THEN eqs ELSE eq END AS q, (direction = 'LONG' AND trade_long) OR (direction = 'SHORT' AND trade_short) AS mt,
    round(least(1.2, CASE CASE WHEN direction = 'SHORT' THEN eqs ELSE eq END WHEN 'A' THEN 1 WHEN 'B' THEN 0.85 WHEN 'C' THEN 0.65 ELSE 0.4 END::DOUBLE * CASE WHEN direction = 'LONG' AND nr AND NOT brk THEN 0.75 ELSE 1 END::DOUBLE
      * CASE WHEN direction = 'LONG' AND brk THEN 1.1 ELSE 1 END::DOUBLE * CASE WHEN direction = 'SHORT' AND ns THEN 0.75 ELSE 1 END::DOUBLE * CASE WHEN direction = 'SHORT' AND brk THEN 0.8 ELSE 1 END::DOUBLE), 6) AS g5m FROM cand""",
    "cand",
)
define(
    "cand2",
    """SELECT *, CASE category WHEN 'swing' THEN CASE mode WHEN 'SMALL' THEN 0.68 ELSE 0.60 END + 0.03 WHEN 'intraday' THEN CASE mode WHEN 'SMALL' THEN 0.72 WHEN 'GROWING' THEN 0.68 ELSE 0.65 END
      ELSE CASE mode WHEN 'SMALL' THEN 0.65 WHEN 'GROWING' THEN 0.60 ELSE 0.55 END + 0.05 END::DOUBLE AS t0,
    least(0.15, least(0.15, CASE WHEN NOT mt THEN CASE WHEN category = 'intraday' THEN 0.1 ELSE 0.07 END WHEN regime = 'HIGH_VOLATILITY' THEN 0.05 ELSE 0 END + CASE WHEN stability < 0.4 THEN 0.05 ELSE 0 END) + CASE WHEN changes >= 2 THEN 0.05 ELSE 0 END)::DOUBLE AS boost FROM cand1""",
    "cand1",
)
define(
    "cand3",
    """SELECT *, round(CASE WHEN boost > 0 THEN least(0.95, t1 + boost) ELSE t1 END, 6) AS thr FROM (SELECT *, CASE WHEN vix > 25 THEN least(0.9, t0 + CASE category WHEN 'intraday' THEN 0.03 WHEN 'swing' THEN 0.1 ELSE 0.15 END::DOUBLE)
    WHEN vix > 20 THEN least(0.9, t0 + CASE category WHEN 'intraday' THEN 0 WHEN 'swing' THEN 0.05 ELSE 0.08 END::DOUBLE) ELSE t0 END AS t1 FROM cand2)""",
    "cand2",
)
define(
    "cand4",
    """SELECT *, CASE WHEN cb THEN 'circuit_breaker' WHEN NOT allowed THEN 'risk_stop' WHEN confidence < thr AND NOT rescue THEN 'confidence' END AS g6r,
    NOT ((direction = 'LONG' AND m30 <= -greatest(0.0035, 0.4 * atr_14 / close)) OR (direction = 'SHORT' AND m30 >= greatest(0.0035, 0.4 * atr_14 / close))) AS ok FROM (
    SELECT *, confidence >= 0.5 AND q IN ('A', 'B') AND confidence >= round(thr - 0.1, 6) AND confidence < thr AS rescue FROM cand3)""",
    "cand3",
)
define(
    "cand5",
    """SELECT *, CASE WHEN NOT (category = 'swing' OR (mode <> 'SMALL' AND category = 'intraday') OR mode = 'FULL') THEN 'mode' WHEN direction = 'FLAT' THEN 'flat' WHEN category = 'positional' AND NOT mt THEN 'positional_counter_regime'
    WHEN category = 'positional' AND regime = 'HIGH_VOLATILITY' THEN 'positional_high_vol' WHEN NOT mt AND q = 'D' THEN 'counter_regime_grade_d' WHEN g6r IS NOT NULL THEN 'gate6_' || g6r WHEN NOT ok THEN 'timing' END AS block_reason,
    round(least(1.5, greatest(0, g1_mult * g3m * g4m * g5m * CASE WHEN mt THEN 1 ELSE 0.5 END::DOUBLE)), 6) AS size_mult FROM cand4""",
    "cand4",
)
register(
    "gate5_entry",
    lambda spark, d: sg.gate5(candidates(spark, d)).select("ticker", "ts", "category", "g5_quality", "g5_passed", "g5_mult"),
    sql("SELECT ticker, ts, category, q AS g5_quality, true AS g5_passed, g5m AS g5_mult FROM cand1", "cand1"),
)
register(
    "gate6_confidence",
    lambda spark, d: signals(spark, d).select("ticker", "ts", "category", "confidence", "g6_threshold", "g6_reason", "g6_passed", "expectancy_pass", "expected_r"),
    sql("SELECT ticker, ts, category, confidence, thr AS g6_threshold, g6r AS g6_reason, g6r IS NULL AS g6_passed, rescue::INT AS expectancy_pass, CASE WHEN rescue THEN round(confidence * 2.5 - (1 - confidence), 6) END AS expected_r FROM cand4", "cand4"),
)
register(
    "entry_timing",
    lambda spark, d: sg.entry_timing(entry_context(model_probs(ta.price_action(ta.trend(src.bars(spark, d))))), "swing").select("ticker", "ts", F.round("adverse_threshold", 6).alias("adverse_threshold"), "entry_ok"),
    sql("SELECT ticker, ts, round(greatest(0.0035, 0.4 * atr_14 / close), 6) AS adverse_threshold, ok AS entry_ok FROM cand4 WHERE category = 'swing'", "cand4"),
)
register(
    "category_signals",
    lambda spark, d: signals(spark, d).select("ticker", "ts", "category", "direction", "confidence", "block_reason", "passed", "size_mult"),
    sql("SELECT ticker, ts, category, direction, confidence, block_reason, block_reason IS NULL AS passed, size_mult FROM cand5", "cand5"),
)
register(
    "best_signal",
    lambda spark, d: sg.best_signal(signals(spark, d), ["ts"]).select("ts", "ticker", "category", "direction", "confidence"),
    sql("SELECT ts, ticker, category, direction, confidence FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY confidence DESC, ticker, category) AS k FROM cand5 WHERE block_reason IS NULL) WHERE k = 1", "cand5"),
)
register(
    "best_signal_per_name",
    lambda spark, d: sg.best_signal(signals(spark, d), ["ticker", "ts"]).select("ticker", "ts", "category", "direction", "confidence"),
    sql("SELECT ticker, ts, category, direction, confidence FROM (SELECT *, row_number() OVER (PARTITION BY ticker, ts ORDER BY confidence DESC, category) AS k FROM cand5 WHERE block_reason IS NULL) WHERE k = 1", "cand5"),
)
register(
    "funnel",
    lambda spark, d: sg.funnel(signals(spark, d), ["category"]),
    sql("SELECT category, coalesce(block_reason, 'passed') AS reason, count(*) AS n FROM cand5 GROUP BY 1, 2", "cand5"),
)
register(
    "near_misses",
    lambda spark, d: sg.near_misses(signals(spark, d)).select("ticker", "ts", "category", "gap", "within_reach"),
    sql("""SELECT ticker, ts, category, round(thr - confidence, 6) AS gap, (confidence >= 0.5 AND round(thr - confidence, 6) <= 0.1 AND q IN ('A', 'B'))::INT AS within_reach FROM cand5 WHERE block_reason = 'gate6_confidence'
  ORDER BY round(thr - confidence, 6), ticker, ts, category LIMIT 8""", "cand5"),
)

# ---- state rules ----------------------------------------------------------------------------


def keyed_cycles(spark, d):
    """Cycles keyed by user and event type; purchases and errors confirm in one read, the rest in two."""
    c = src.cycles(spark, d)
    return c.withColumns({"skey": F.concat_ws("/", "key", "category"), "confirm": F.when(F.col("category").isin("purchase", "error"), 1).otherwise(2)})


define(
    "st0",
    """SELECT *, row_number() OVER (PARTITION BY skey ORDER BY ts, event_id) AS n FROM (SELECT *, CASE WHEN raw_dir = 'LONG' AND round(prob_long - prob_flat, 6) >= 0.05 THEN 'LONG' WHEN raw_dir = 'SHORT' AND round(prob_short - prob_flat, 6) >= 0.05 THEN 'SHORT' ELSE 'FLAT' END AS dec FROM (
    SELECT *, concat_ws('/', key, category) AS skey, CASE WHEN category IN ('purchase', 'error') THEN 1 ELSE 2 END AS need,
      CASE WHEN prob_long > prob_flat AND prob_long >= prob_short THEN 'LONG' WHEN prob_short > prob_flat AND prob_short > prob_long THEN 'SHORT' ELSE 'FLAT' END AS raw_dir FROM cycles))""",
    "cycles",
)
define(
    "st_rec",
    """SELECT skey, n, event_id, raw_dir, dec, need, CASE WHEN dec <> 'FLAT' AND need = 1 THEN dec ELSE 'FLAT' END AS com, CASE WHEN dec <> 'FLAT' AND need > 1 THEN dec ELSE '' END AS pend, CASE WHEN dec <> 'FLAT' AND need > 1 THEN 1 ELSE 0 END AS cnt FROM st0 WHERE n = 1
  UNION ALL SELECT b.skey, b.n, b.event_id, b.raw_dir, b.dec, b.need,
    CASE WHEN b.dec = p.com THEN p.com WHEN b.dec = 'FLAT' THEN 'FLAT' WHEN p.com <> 'FLAT' THEN 'FLAT' WHEN CASE WHEN p.pend = b.dec THEN p.cnt + 1 ELSE 1 END >= b.need THEN b.dec ELSE 'FLAT' END,
    CASE WHEN b.dec = p.com OR b.dec = 'FLAT' THEN '' WHEN p.com <> 'FLAT' THEN b.dec WHEN CASE WHEN p.pend = b.dec THEN p.cnt + 1 ELSE 1 END >= b.need THEN '' ELSE b.dec END,
    CASE WHEN b.dec = p.com OR b.dec = 'FLAT' THEN 0 WHEN p.com <> 'FLAT' THEN 1 WHEN CASE WHEN p.pend = b.dec THEN p.cnt + 1 ELSE 1 END >= b.need THEN 0 ELSE CASE WHEN p.pend = b.dec THEN p.cnt + 1 ELSE 1 END END
  FROM st_rec p JOIN st0 b ON b.skey = p.skey AND b.n = p.n + 1""",
    "st0",
)
register(
    "stabilise",
    lambda spark, d: sg.stabilise(keyed_cycles(spark, d)).select("event_id", "raw_dir", "decisive", "committed", "intervened"),
    sql("SELECT event_id, raw_dir, dec AS decisive, com AS committed, (com <> raw_dir)::INT AS intervened FROM st_rec", "st_rec"),
)
define("sd0", "SELECT s.skey, s.n, s.event_id, dec, round(greatest(prob_long, prob_flat, prob_short), 6) AS conf FROM st0 s", "st0")
define(
    "sd_rec",
    """SELECT skey, n, event_id, dec, conf, (dec <> 'FLAT')::INT AS sent, CASE WHEN dec <> 'FLAT' THEN dec END AS ld, CASE WHEN dec <> 'FLAT' THEN conf END AS lc FROM sd0 WHERE n = 1
  UNION ALL SELECT b.skey, b.n, b.event_id, b.dec, b.conf, CASE WHEN b.dec = 'FLAT' THEN (p.ld IS NOT NULL)::INT WHEN p.ld = b.dec AND abs(p.lc - b.conf) < 0.05 - 1e-9 THEN 0 ELSE 1 END,
    CASE WHEN b.dec = 'FLAT' THEN NULL WHEN p.ld = b.dec AND abs(p.lc - b.conf) < 0.05 - 1e-9 THEN p.ld ELSE b.dec END, CASE WHEN b.dec = 'FLAT' THEN NULL WHEN p.ld = b.dec AND abs(p.lc - b.conf) < 0.05 - 1e-9 THEN p.lc ELSE b.conf END
  FROM sd_rec p JOIN sd0 b ON b.skey = p.skey AND b.n = p.n + 1""",
    "sd0",
)
register(
    "signal_changed",
    lambda spark, d: sg.alert_dedup(
        sg.decisive(keyed_cycles(spark, d)).select("skey", "ts", "event_id", "decisive", F.round(F.greatest("prob_long", "prob_flat", "prob_short"), 6).alias("confidence")), direction="decisive"
    ).select("event_id", "decisive", "sent"),
    sql("SELECT event_id, dec AS decisive, sent FROM sd_rec", "sd_rec"),
)
define("cd0", "SELECT user_id AS k, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
define(
    "cd_rec",
    """SELECT k, n, event_id, ts AS le, 1 AS emitted FROM cd0 WHERE n = 1 UNION ALL SELECT b.k, b.n, b.event_id, CASE WHEN b.ts - p.le >= INTERVAL 1800 SECONDS THEN b.ts ELSE p.le END, (b.ts - p.le >= INTERVAL 1800 SECONDS)::INT
  FROM cd_rec p JOIN cd0 b ON b.k = p.k AND b.n = p.n + 1""",
    "cd0",
)
register(
    "cooldown",
    lambda spark, d: sg.cooldown(src.table(spark, d, "events").select(F.col("user_id").alias("skey"), "ts", "event_id")).select("event_id", "emitted"),
    sql("SELECT event_id, emitted FROM cd_rec", "cd_rec"),
)
AS_OF = "1998-06-30"
define("openpos", f"SELECT *, value_cents / 100.0::DOUBLE AS value, round(value_cents * 0.0002::DOUBLE, 4) AS risk_amount FROM ledger WHERE opened_at <= DATE '{AS_OF}' AND close_date > DATE '{AS_OF}'", "ledger")


def open_positions(spark, d):
    """Ledger rows opened on or before the as-of date and closed after it."""
    day = F.lit(AS_OF).cast("date")
    x = src.ledger(spark, d).where((F.col("opened_at") <= day) & (F.col("close_date") > day))
    return x.withColumns({"value": F.col("value_cents") / 100, "risk_amount": F.round(F.col("value_cents") * 0.0002, 4)})


def model_now(spark, d):
    """Latest regime and model directions per (ticker, category) at the as-of date."""
    f = model_probs(rg.name(rg.classify(ta.price_action(ta.trend(src.bars(spark, d))))))
    last = ta.latest(f.where(F.col("ts") <= AS_OF).select("ticker", "ts", "regime", *CATS))
    x = last.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("model_dir")) for c in CATS])))
    return x.select("ticker", "_c.category", "_c.model_dir", F.col("regime").alias("regime_now"))


define("mnow", f"SELECT ticker, x.category, x.model_dir, regime AS regime_now FROM (SELECT * FROM mp1 WHERE ts <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1), LATERAL (VALUES ('swing', d_swing), ('positional', d_positional), ('intraday', d_intraday)) x(category, model_dir)", "mp1")
register(
    "reversals",
    lambda spark, d: sg.reversals(open_positions(spark, d), model_now(spark, d)).select("signal_uuid", "ticker", "category", "signal", "model_dir", "regime_now", "alert"),
    sql(
        """SELECT * FROM (SELECT signal_uuid, p.ticker, p.category, signal, model_dir, regime_now, CASE WHEN (signal = 'LONG' AND model_dir = 'SHORT') OR (signal = 'SHORT' AND model_dir = 'LONG') THEN 'MODEL_REVERSAL'
    WHEN ((signal = 'LONG' AND contains(regime_now, 'BEAR')) OR (signal = 'SHORT' AND contains(regime_now, 'BULL'))) AND coalesce(regime_match, 0) = 1 AND regime <> regime_now THEN 'REGIME_CHANGE' END AS alert
  FROM openpos p JOIN mnow m ON m.ticker = p.ticker AND m.category = p.category) WHERE alert IS NOT NULL""",
        "openpos", "mnow",
    ),
)

# Queries over the whole context of a bar: their small inputs are derived once.
wrap(src.once, "gate2_rules", "gate2_confirms", "gate5_entry", "gate6_confidence", "category_signals", "best_signal", "best_signal_per_name", "funnel", "near_misses")
