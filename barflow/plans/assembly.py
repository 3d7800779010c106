"""Feature-assembly queries: the full row of every bar, its quality, training sets and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import clip, finite_or
from ..operators import assembly as fa
from ..operators import calendar as ca
from ..operators import fundamentals as fd
from ..operators import ledger as lq
from ..operators import macro as mc
from ..operators import options as op
from ..operators import orderflow as of
from ..operators import patterns as pt
from ..operators import regime as rg
from ..operators import sentiment as tx
from ..operators import technical as ta
from ..operators.registries import REGISTRIES
from ..sources import adapters as src
from . import fundamentals, orderflow, patterns, regime  # noqa: F401 - their checks are parts of those here
from .flow import insider, rolled
from .fundamentals import ALT, CA, alt_frame, calendar_inputs, holidays
from .macro import MF, names
from .options import OPT_FEATURES, snap
from .oracle import define, sql
from .registry import check, register, wrap
from .technical import _clamped
from .text import SENTIMENT, effect_inputs

TECH = (
    "rsi_14", "stoch_rsi", "rsi_divergence", "macd_hist", "macd_hist_roc", "adx", "ema_spread", "ema_spread_roc", "supertrend", "support_dist", "resistance_dist", "bb_pct_b", "bb_squeeze", "atr_ratio",
    "hv_ratio", "range_pct_52w", "obv_roc", "mfi", "cmf", "volume_ratio", "close_pct_range", "returns_1d", "returns_3d", "returns_5d", "returns_20d", "gap_pct", "consec_days", "vwap_dist",
)
CHARTS = ("chart_golden_cross", "chart_death_cross", "chart_volume_breakout", "chart_bb_breakout", "chart_inside_bar")
REGIMES = ("regime_bull", "regime_bear", "regime_high_vol", "regime_choppy")
FLOWS = ("fii_5d_norm", "fii_signal", "fii_flow_surprise", "dii_3d_norm", "flow_confluence")
META = ("rolling_accuracy_10", "losing_streak_norm", "model_health_score", "avg_model_confidence")
#: Columns that a narrower source names with a mark of its own.
PLAIN = {"news_spike_f": "news_spike", "earnings_relevance_f": "earnings_relevance", "announcement_score_f": "announcement_score", "combined_score_f": "combined_score", "pre_earnings_drift_norm": "pre_earnings_drift"}


def plain(name: str) -> str:
    return PLAIN.get(name, name.removesuffix("_f"))


BAR = (*TECH, "price_above_vwap", *REGIMES, "regime_stability", "atr_percentile_252", "pattern_score", *CHARTS, "order_flow_score", "cum_delta_norm", "delta_divergence", "absorption_flag", "institutional_bias")
TEXTS = ("news_score_24h", "news_score_trend", "news_momentum", "news_momentum_3d", "news_spike_f", "earnings_relevance_f", "announcement_score_f", "combined_score_f", "social_contrarian_score")
#: The calendar's own reading of the expiry stays, that of the option snapshot gives way.
CALENDAR = tuple(c for c in ca.FEATURES if c != "max_pain_dist_norm")
OPTIONS = tuple(c for c in OPT_FEATURES if c != "expiry_proximity")
FUND = tuple(fd.FEATURES)
OWN = ("insider_score_f", "promoter_trend_score", "pledge_risk", "dii_accumulation")
EXACT = (*BAR, "banks_above_50dma_pct", *mc.FEATURES, "jpmorgan_norm", *TEXTS, "earnings_score", *CALENDAR)
SLOW = (*OPTIONS, *FLOWS, *OWN, *FUND, *ALT, *META)
NAMES = tuple(plain(c) for c in (*EXACT, *SLOW))


def bar_frame(spark, d):
    """What a bar and those before it say: every indicator over one partitioning by name."""
    x = rg.stability(rg.name(rg.classify(ta.atr_percentile(ta.technical_frame(src.bars(spark, d))))))
    x = of.order_flow(pt.breakouts(pt.crosses(pt.pattern_score(pt.candles(x)))))
    own = {c: finite_or(F.col(c).cast("double")) for c in TECH}
    out = ta.winsorise(x.withColumns(own)).withColumns({
        "price_above_vwap": (F.col("vwap_dist") > 0).cast("int"), "regime_stability": F.col("stability"), "pattern_score": clip(F.col("pattern_score") / 100), "order_flow_score": clip("order_flow_score"),
        "cum_delta_norm": clip("cum_delta_norm"), "delta_divergence": F.coalesce(F.col("delta_divergence_flag").cast("double"), F.lit(0.0)), "absorption_flag": F.col("absorption_detected"),
        "institutional_bias": F.when(F.col("inst_bias") == "INSTITUTIONAL_BUYING", 1.0).when(F.col("inst_bias") == "INSTITUTIONAL_SELLING", -1.0).otherwise(0.0),
    })
    return out.select("ticker", "ts", *BAR)


def market_flows(spark, d):
    x = rolled(spark, d)
    sides = F.when(F.col("flow_confluence") == "BOTH_BUYING", 1.0).when(F.col("flow_confluence") == "BOTH_SELLING", -1.0).otherwise(0.0)
    return x.select(
        "trade_date", clip(F.col("fii_net_5d_cr") / 5000, digits=10).alias("fii_5d_norm"), F.round("fii_signal", 10).alias("fii_signal"), clip(F.col("fii_flow_surprise") / 3.0, digits=10).alias("fii_flow_surprise"),
        clip(F.col("dii_net_3d_cr") / 2000, digits=10).alias("dii_3d_norm"), sides.alias("flow_confluence"),
    )


def macro_frame(spark, d):
    market = names(spark, d)
    return mc.features(market).join(market.select("ticker", "ts", clip(F.col("jpmorgan_5d_pct") / 5).alias("jpmorgan_norm")), ["ticker", "ts"])


def text_frame(spark, d):
    scored = tx.earnings_decay(effect_inputs(spark, d))
    return tx.features(scored).join(scored.select("ticker", "ts", F.col("earnings_effect").alias("earnings_score")), ["ticker", "ts"])


def form(spark, d):
    floors = src.kept(spark, d, ("day_floors",), lambda: lq.day_floors(src.ledger(spark, d)))
    return lq.day_state(src.ledger_since(spark, d, floors), floors=floors)


#: Every group of features, each from its own tables.
GROUPS = {
    "bar_features": bar_frame, "breadth": lambda spark, d: ta.breadth(src.bars(spark, d)).select("ts", F.col("breadth_50dma").alias("banks_above_50dma_pct")), "macro_row": macro_frame, "text_row": text_frame,
    "calendar_row": lambda spark, d: ca.features(calendar_inputs(spark, d), holidays(spark, d)), "options_row": lambda spark, d: op.features(snap(spark, d)), "market_flows": market_flows,
    "ownership_row": lambda spark, d: fd.ownership_features(insider(spark, d)), "fundamental_row": lambda spark, d: fd.features(fundamentals.fund(spark, d)), "alternative_row": alt_frame,
    "form": form,
}


def slow_tables(g):
    """Tables of rarer readings; a reading over a month or a quarter is known when that is over."""
    over = lambda c, months: F.add_months(c, months)
    same = lambda cols: {c: c for c in cols}
    return {
        "options": fa.Slow(g["options_row"], over("fetched_at", 1), same(OPTIONS)),
        "flows": fa.Slow(g["market_flows"], "trade_date", {**same(FLOWS), "flow_day": "trade_date"}, key=None),
        "ownership": fa.Slow(g["ownership_row"], over("quarter", 3), same(OWN)),
        "fundamentals": fa.Slow(g["fundamental_row"], over("fetched_at", 3), same(FUND)),
        "alternative": fa.Slow(g["alternative_row"], F.date_add(over("period", -12 * 26), 1), same(ALT), key=None),
        "form": fa.Slow(g["form"], "close_date", same(META)),
    }


def wide(spark, d):
    """Every group as of the bar: those of the same (name, day) joined on it, the slow ones from one point-in-time table."""
    keys = ["ticker", "ts"]
    g = src.together(spark, d, GROUPS)
    x = g["bar_features"].join(g["breadth"], "ts", "left")
    for part, cols in (("macro_row", (*mc.FEATURES, "jpmorgan_norm")), ("text_row", (*TEXTS, "earnings_score")), ("calendar_row", CALENDAR)):
        x = x.join(g[part].select(*keys, *cols), keys, "left")
    x = fa.point_in_time(x.select(*keys, *EXACT), slow_tables(g))
    value = lambda c: F.round(finite_or(F.col(c).cast("double")), 6)
    return x.select(*keys, *[value(c).alias(plain(c)) for c in (*EXACT, *SLOW)], F.coalesce((F.datediff("ts", "flow_day") > 1).cast("int"), F.lit(1)).alias("macro_stale"))


for _key in ("rsi_divergence", "sr_distance", "atr_percentile_252", "ema_cross", "volume_breakout", "bb_breakout", "inside_bar", "delta", "inst_bias", "macro_features", "calendar_features", "breadth_50dma", "ownership_features", "fundamental_features", "alt_features"):
    _check = check(_key)
    define(f"c_{_key}", _check.select, *_check.needs)
define(
    "fw_vwap",
    """SELECT ticker, ts, (close - v) / (v + 1e-10) AS vwap_dist FROM (SELECT *, sum((high + low + close) / 3 * volume) OVER s / (sum(volume) OVER s + 1e-10) AS v FROM bars
    WINDOW s AS (PARTITION BY ticker, date_trunc('month', ts) ORDER BY ts ROWS UNBOUNDED PRECEDING))""",
    "bars",
)
_WINSORISED = {c: _clamped(c).removesuffix(f" AS {c}") for c in TECH if c in ta.WINSOR_BOUNDS}
_T = {c: _WINSORISED.get(c, f"coalesce({c}, 0)") for c in TECH}
define(
    "fw_bar",
    f"""SELECT ticker, ts, {', '.join(f'{e} AS {c}' for c, e in _T.items())}, (coalesce(vwap_dist, 0) > 0)::INT AS price_above_vwap, bull AS regime_bull, bear AS regime_bear, hv AS regime_high_vol, chop AS regime_choppy, stability AS regime_stability, atr_percentile_252,
    greatest(-1, least(1, sc_pat / 100)) AS pattern_score, {', '.join(CHARTS)}, greatest(-1, least(1, o.sc)) AS order_flow_score, greatest(-1, least(1, coalesce(cum_delta_norm, 0))) AS cum_delta_norm,
    CASE WHEN o.dv LIKE '%DIVERGENCE' THEN 1 ELSE 0 END AS delta_divergence, o.absorbed::INT AS absorption_flag, CASE inst_bias WHEN 'INSTITUTIONAL_BUYING' THEN 1 WHEN 'INSTITUTIONAL_SELLING' THEN -1 ELSE 0 END AS institutional_bias
  FROM tech_all JOIN c_rsi_divergence USING (ticker, ts) JOIN c_sr_distance USING (ticker, ts) JOIN fw_vwap USING (ticker, ts) JOIN (SELECT ticker, ts, bull, bear, hv, chop, stability FROM regimes2) USING (ticker, ts) JOIN c_atr_percentile_252 USING (ticker, ts)
  JOIN (SELECT ticker, ts, sc AS sc_pat FROM pt3) USING (ticker, ts) JOIN c_ema_cross USING (ticker, ts) JOIN c_volume_breakout USING (ticker, ts) JOIN c_bb_breakout USING (ticker, ts) JOIN c_inside_bar USING (ticker, ts)
  JOIN (SELECT ticker, ts, sc, dv, absorbed FROM of5) o USING (ticker, ts) JOIN c_delta USING (ticker, ts) JOIN c_inst_bias USING (ticker, ts)""",
    "tech_all", "c_rsi_divergence", "c_sr_distance", "fw_vwap", "regimes2", "c_atr_percentile_252", "pt3", "c_ema_cross", "c_volume_breakout", "c_bb_breakout", "c_inside_bar", "of5", "c_delta", "c_inst_bias",
)
define(
    "fw_exact",
    f"""SELECT b.*, d.breadth_50dma AS banks_above_50dma_pct, {', '.join(f'm.{c}' for c in mc.FEATURES)}, greatest(-1, least(1, coalesce(j.jpmorgan_5d_pct, 0) / 5)) AS jpmorgan_norm, {', '.join(f'{SENTIMENT[c]} AS {c}' for c in TEXTS)},
    round(es * greatest(1 - dse / 90, 0), 6) AS earnings_score, {', '.join(f'k.{c}' for c in CALENDAR)}
  FROM fw_bar b LEFT JOIN c_breadth_50dma d USING (ts) LEFT JOIN c_macro_features m USING (ticker, ts) LEFT JOIN (SELECT ticker, ts, jpmorgan_5d_pct FROM imk) j USING (ticker, ts) LEFT JOIN eff USING (ticker, ts) LEFT JOIN c_calendar_features k USING (ticker, ts)""",
    "fw_bar", "c_breadth_50dma", "c_macro_features", "imk", "eff", "c_calendar_features",
)
_clip = lambda e: f"round(least(greatest(coalesce({e}, 0), -1), 1), 10)"
define("s_options", f"SELECT ticker, CAST(fetched_at + INTERVAL 1 MONTH AS DATE) AS at, {', '.join(f'{OPT_FEATURES[c]} AS {c}' for c in OPTIONS)} FROM opts", "opts")
define(
    "s_flows",
    f"""SELECT trade_date AS at, {_clip('fii_net_5d_cr / 5000')} AS fii_5d_norm, round(fii_signal, 10) AS fii_signal, {_clip('fii_flow_surprise / 3.0::DOUBLE')} AS fii_flow_surprise, {_clip('dii_net_3d_cr / 2000')} AS dii_3d_norm,
    CASE flow_confluence WHEN 'BOTH_BUYING' THEN 1 WHEN 'BOTH_SELLING' THEN -1 ELSE 0 END AS flow_confluence FROM fl2""",
    "fl2",
)
define("s_own", "SELECT *, CAST(quarter + INTERVAL 3 MONTH AS DATE) AS at FROM c_ownership_features", "c_ownership_features")
define("s_fund", "SELECT *, CAST(fetched_at + INTERVAL 3 MONTH AS DATE) AS at FROM c_fundamental_features", "c_fundamental_features")
define("s_alt", "SELECT *, CAST(period - INTERVAL 26 YEARS + INTERVAL 1 DAY AS DATE) AS at FROM c_alt_features", "c_alt_features")
define("fm0", "SELECT ticker, close_date, (pnl_points > 0)::INT AS win, confidence, row_number() OVER (PARTITION BY ticker ORDER BY close_date, trade_no, signal_uuid) AS n FROM ledger", "ledger")
define(
    "fm1",
    """SELECT *, round(avg(win) OVER r, 4) AS acc, round(avg(confidence) OVER r, 6) AS conf, n - coalesce(max(CASE WHEN win = 1 THEN n END) OVER (PARTITION BY ticker ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS lose,
    lead(close_date) OVER (PARTITION BY ticker ORDER BY n) AS nx FROM fm0 WINDOW r AS (PARTITION BY ticker ORDER BY n ROWS 9 PRECEDING)""",
    "fm0",
)
define(
    "s_form",
    """SELECT ticker, close_date AS at, acc AS rolling_accuracy_10, round(least(lose, 5) / 5, 4) AS losing_streak_norm, round(least(1, greatest(-1, (acc * 0.4 + conf * 0.3 + (1 - least(lose, 5) / 5) * 0.3) * 2 - 1)), 6) AS model_health_score, conf AS avg_model_confidence
  FROM fm1 WHERE nx IS DISTINCT FROM close_date""",
    "fm1",
)
_SQL = {"options": OPTIONS, "flows": FLOWS, "own": OWN, "fund": FUND, "alt": ALT, "form": META}
define(
    "fw",
    f"""SELECT x.ticker, x.ts, {', '.join(f'round(coalesce(CAST({a}.{c} AS DOUBLE), 0), 6) AS {plain(c)}' for a, cols in {'x': EXACT, **_SQL}.items() for c in cols)}, coalesce((x.ts - flows.at > 1)::INT, 1) AS macro_stale FROM fw_exact x """
    + " ".join(f"ASOF LEFT JOIN s_{t} {t} ON {'' if t in ('flows', 'alt') else f'{t}.ticker = x.ticker AND '}x.ts >= {t}.at" for t in _SQL),
    "fw_exact", *(f"s_{t}" for t in _SQL),
)
register("feature_wide", wide, sql("SELECT * FROM fw", "fw"))
_USED = [n for n in NAMES if not fa.is_flag(n)]
define("dq", f"SELECT ticker, ts, {' + '.join(f'({n} = 0)::INT' for n in _USED)} AS z, macro_stale FROM fw", "fw")
register(
    "data_quality",
    lambda spark, d: fa.data_quality(wide(spark, d), list(NAMES), "macro_stale").select("ticker", "ts", "zero_features", "missing_pct", "quality", "total_features"),
    sql(f"""SELECT ticker, ts, z AS zero_features, round(z / {len(_USED)}, 4) AS missing_pct, CASE WHEN z / {len(_USED)} >= 0.5 THEN 'POOR' WHEN z / {len(_USED)} >= 0.25 OR macro_stale = 1 THEN 'DEGRADED' WHEN z / {len(_USED)} >= 0.1 THEN 'GOOD' ELSE 'EXCELLENT' END AS quality,
    {len(_USED)} AS total_features FROM dq""", "dq"),
)
SINCE = "1996-01-01"
#: What the bars themselves give; the history-long variant reads nothing else.
TECHNICAL = {*(plain(c) for c in BAR), "banks_above_50dma_pct"}
SETS = {**{(m, v): r for (m, v), r in REGISTRIES.items()}, **{(m, "technical"): r.of(TECHNICAL) for (m, v), r in REGISTRIES.items() if v == "prod"}}


def technical(spark, d):
    g = src.together(spark, d, {n: GROUPS[n] for n in ("bar_features", "breadth")})
    return g["bar_features"].join(g["breadth"], "ts", "left").select("ticker", "ts", *[F.round(finite_or(F.col(c).cast("double")), 6).alias(c) for c in (*BAR, "banks_above_50dma_pct")])


for _m, (_h, _t) in fa.LABELS.items():
    define(f"lab_{_m}", f"SELECT ticker, ts, f, CASE WHEN f > {_t} THEN 2 WHEN f < -{_t} THEN 0 ELSE 1 END AS label FROM (SELECT ticker, ts, lead(close, {_h}) OVER w / close - 1 AS f, row_number() OVER w - 1 AS i FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)) WHERE i >= 60 AND f IS NOT NULL", "bars")
for (_m, _v), _r in SETS.items():
    _recent = _v != "technical"
    _missing = [n for n in _r.names if n not in NAMES]
    register(
        f"training_set_{_m}" + ("" if _v == "full" else f"_{_v}"),
        lambda spark, d, r=_r, recent=_recent: fa.training_set(wide(spark, d) if recent else technical(spark, d), src.bars(spark, d), r, SINCE if recent else None),
        sql(f"SELECT f.ticker, f.ts, label, {', '.join(f'0.0::DOUBLE AS {n}' if n in _missing else n for n in _r.names)} FROM fw f JOIN lab_{_m} l USING (ticker, ts)" + (f" WHERE f.ts >= DATE '{SINCE}'" if _recent else ""), "fw", f"lab_{_m}"),
    )
_place = lambda r: " + ".join(f"{i} * round({n} * 1000000)::BIGINT" for i, n in enumerate(r.names, 1) if n in NAMES)


def vectors(spark, d):
    """Each registry's vector of every bar, its values in order as whole millionths, with its length and the sum of place x value, which any other order or fill changes."""
    x = wide(spark, d)
    x = x.select("ticker", "ts", *[r.vector(x).alias(f"{m}_{v}") for (m, v), r in REGISTRIES.items()])
    whole = lambda y: F.round(y * 1000000).cast("long")
    weigh = lambda c: F.aggregate(F.transform(c, lambda y, i: (i + 1) * whole(y)), F.lit(0).cast("long"), lambda s, y: s + y)
    listed = lambda c: F.array_join(F.transform(c, lambda y: whole(y).cast("string")), " ")
    parts = {"n": F.size, "sum": weigh, "vector": listed}
    return x.select("ticker", "ts", *[f(f"{m}_{v}").alias(f"{part}_{m}_{v}") for part, f in parts.items() for m, v in REGISTRIES])


_listed = lambda r: "concat_ws(' ', " + ", ".join(f"round({n} * 1000000)::BIGINT" if n in NAMES else "'0'" for n in r.names) + ")"
register(
    "vectorise",
    vectors,
    sql(
        f"""SELECT ticker, ts, {', '.join(f'{len(r.names)} AS n_{m}_{v}' for (m, v), r in REGISTRIES.items())}, {', '.join(f'CAST({_place(r)} AS BIGINT) AS sum_{m}_{v}' for (m, v), r in REGISTRIES.items())},
    {', '.join(f'{_listed(r)} AS vector_{m}_{v}' for (m, v), r in REGISTRIES.items())} FROM fw""",
        "fw",
    ),
)
wrap(src.once, "feature_wide", "data_quality", "vectorise", *(f"training_set_{m}" + ("" if v == "full" else f"_{v}") for m, v in SETS))
