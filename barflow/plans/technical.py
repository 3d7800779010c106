"""Technical features: one key per feature over the daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import technical as ta
from ..sources import adapters as src
from .oracle import define, sql
from .registry import query, register

W = "OVER (PARTITION BY ticker ORDER BY ts"


def last_n(n: int) -> str:
    return f"{W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def guarded(agg: str, x: str, n: int, need: int | None = None) -> str:
    return f"CASE WHEN count({x}) {last_n(n)} >= {n if need is None else need} THEN {agg} {last_n(n)} END"


LAG = "lag({0}) OVER (PARTITION BY ticker ORDER BY ts)"

define(
    "ta1",
    f"""SELECT *, row_number() {W}) - 1 AS i, close - lag(close) {W}) AS delta,
    greatest(high - low, abs(high - lag(close) {W})), abs(low - lag(close) {W}))) AS true_range,
    greatest(coalesce(high - lag(high) {W}), 0), 0) AS up0, greatest(coalesce(lag(low) {W}) - low, 0), 0) AS dn0 FROM bars""",
    "bars",
)
define(
    "ta2",
    """SELECT *, CASE WHEN up0 > dn0 THEN up0 ELSE 0 END AS dmp, CASE WHEN dn0 > (CASE WHEN up0 > dn0 THEN up0 ELSE 0 END) THEN dn0 ELSE 0 END AS dmm FROM ta1""",
    "ta1",
)


def _ema(x: str, prev: str, span: int) -> str:
    return f"{2.0 / (span + 1)!r}::DOUBLE * {x} + {1 - 2.0 / (span + 1)!r}::DOUBLE * {prev}"


def _dx(atr: str, p: str, m: str) -> str:
    dip, dim = f"(100 * {p} / ({atr} + 1e-10))", f"(100 * {m} / ({atr} + 1e-10))"
    return f"(100 * abs({dip} - {dim}) / ({dip} + {dim} + 1e-10))"


_E = {"e12": ("close", 12), "e26": ("close", 26), "e20": ("close", 20), "e50": ("close", 50), "atr": ("true_range", 14), "atr10": ("true_range", 10), "sp": ("dmp", 14), "sm": ("dmm", 14)}
_step = {n: _ema(f"b.{x}", f"r.{n}", s) for n, (x, s) in _E.items()}
define(
    "ema_rec",
    f"""SELECT ticker, i, close AS e12, close AS e26, close AS e20, close AS e50, true_range AS atr, true_range AS atr10, CAST(dmp AS DOUBLE) AS sp, CAST(dmm AS DOUBLE) AS sm,
    0.0::DOUBLE AS sig, {_dx('true_range', 'dmp', 'dmm')} AS adx FROM ta2 WHERE i = 0
  UNION ALL SELECT b.ticker, b.i, {', '.join(_step.values())}, {_ema(f"(({_step['e12']}) - ({_step['e26']}))", 'r.sig', 9)},
    {_ema(_dx(f"({_step['atr']})", f"({_step['sp']})", f"({_step['sm']})"), 'r.adx', 14)}
  FROM ema_rec r JOIN ta2 b ON b.ticker = r.ticker AND b.i = r.i + 1""",
    "ta2",
)
define(
    "ta3",
    f"""SELECT b.*, e12 - e26 AS macd, e12 - e26 - sig AS macd_hist, e20 AS ema_20, e50 AS ema_50, (e20 - e50) / e50 AS ema_spread, adx, atr AS atr_14, atr / close AS atr_ratio,
    (high + low) / 2 + 3 * atr10 AS st_up, (high + low) / 2 - 3 * atr10 AS st_lo FROM ta2 b JOIN ema_rec USING (ticker, i)""",
    "ta2",
    "ema_rec",
)
define(
    "ta4",
    f"""SELECT *, coalesce(macd_hist / nullif(lag(macd_hist, 3) {W}), 0) - 1, 0) AS macd_hist_roc, coalesce(ema_spread / nullif(lag(ema_spread, 5) {W}), 0) - 1, 0) AS ema_spread_roc,
    CASE WHEN i = 0 THEN 1.0 WHEN close > lag(st_up) {W}) THEN 1.0 WHEN close < lag(st_lo) {W}) THEN -1.0 END AS st_event FROM ta3""",
    "ta3",
)
define("tech_trend", f"SELECT *, last_value(st_event IGNORE NULLS) {W}) AS supertrend FROM ta4", "ta4")
define(
    "mo1",
    f"""SELECT *, 100 - 100 / (1 + {guarded('avg(greatest(delta, 0))', 'delta', 14)} / ({guarded('avg(greatest(-delta, 0))', 'delta', 14)} + 1e-10)) AS rsi_14 FROM ta1""",
    "ta1",
)
define(
    "tech_momentum",
    f"""SELECT *, (rsi_14 - {guarded('min(rsi_14)', 'rsi_14', 14)}) / ({guarded('max(rsi_14)', 'rsi_14', 14)} - {guarded('min(rsi_14)', 'rsi_14', 14)} + 1e-10) AS stoch_rsi FROM mo1""",
    "mo1",
)
define(
    "vo1",
    f"""SELECT *, close / lag(close) {W}) - 1 AS ret, {guarded('avg(close)', 'close', 20)} AS bb_mid, {guarded('stddev_samp(close)', 'close', 20)} AS bb_sigma FROM bars""",
    "bars",
)
define(
    "vo2",
    f"""SELECT *, 4 * bb_sigma / (bb_mid + 1e-10) AS bb_width, (close - bb_mid + 2 * bb_sigma) / (4 * bb_sigma + 1e-10) AS bb_pct_b,
    coalesce({guarded('stddev_samp(ret)', 'ret', 10)} * sqrt(252) / ({guarded('stddev_samp(ret)', 'ret', 30)} * sqrt(252) + 1e-10), 1.0) AS hv_ratio FROM vo1""",
    "vo1",
)
define(
    "tech_volatility",
    f"""SELECT *, CASE WHEN bb_width < {guarded('quantile_cont(bb_width, 0.1)', 'bb_width', 126)} - 1e-12 THEN 1.0 ELSE 0.0 END AS bb_squeeze FROM vo2""",
    "vo2",
)
define(
    "vl1",
    f"""SELECT *, (high + low + close) / 3 AS tp, sign(coalesce(close - lag(close) {W}), 0)) * volume AS step, ((close - low) - (high - close)) / (high - low + 1e-10) * volume AS mfv,
    volume / {guarded('avg(volume)', 'volume', 10)} AS volume_ratio, coalesce(volume / lag(volume, 5) {W}) - 1, 0) AS vol_roc FROM bars""",
    "bars",
)
define(
    "vl2",
    f"""SELECT *, sum(step) {W} ROWS UNBOUNDED PRECEDING) AS obv, CASE WHEN tp > lag(tp) {W}) THEN tp * volume ELSE 0 END AS pmf, CASE WHEN tp < lag(tp) {W}) THEN tp * volume ELSE 0 END AS nmf,
    {guarded('sum(mfv)', 'mfv', 20)} / ({guarded('sum(volume)', 'volume', 20)} + 1e-10) AS cmf FROM vl1""",
    "vl1",
)
define(
    "tech_volume",
    f"""SELECT *, 100 - 100 / (1 + {guarded('sum(pmf)', 'pmf', 14)} / ({guarded('sum(nmf)', 'nmf', 14)} + 1e-10)) AS mfi,
    coalesce(obv / nullif(lag(obv, 5) {W}), 0) - 1, 0) AS obv_roc FROM vl2""",
    "vl2",
)
define(
    "pa1",
    f"""SELECT *, {', '.join(f'coalesce(close / lag(close, {k}) {W}) - 1, 0) AS returns_{k}d' for k in (1, 3, 5, 20))},
    (close - low) / (high - low + 1e-8) AS close_pct_range, (open - lag(close) {W})) / lag(close) {W}) AS gap_pct,
    (close - {guarded('min(close)', 'close', 252, 20)}) / ({guarded('max(close)', 'close', 252, 20)} - {guarded('min(close)', 'close', 252, 20)} + 1e-10) AS range_pct_52w,
    sign(coalesce(close - lag(close) {W}), 0)) AS dir, CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week, CAST(month(ts) AS DOUBLE) AS month,
    CAST(isodow(ts) = 1 AS INT)::DOUBLE AS is_monday, CAST(isodow(ts) = 5 AS INT)::DOUBLE AS is_friday, row_number() {W}) AS rn FROM bars""",
    "bars",
)
define(
    "tech_price",
    f"""SELECT *, dir * row_number() OVER (PARTITION BY ticker, dir, grp ORDER BY ts) AS consec_days FROM (SELECT *, rn - row_number() OVER (PARTITION BY ticker, dir ORDER BY ts) AS grp FROM pa1)""",
    "pa1",
)


def bars(spark, d):
    return src.bars(spark, d)


def feature_query(part, names):
    def run(spark, d):
        return part(bars(spark, d)).select("ticker", "ts", *[F.round(n, 6).alias(n) for n in names])

    return run


def feature_sql(cte, names):
    return sql(f"SELECT ticker, ts, {', '.join(f'round(CAST({n} AS DOUBLE), 6) AS {n}' for n in names)} FROM {cte}", cte)


GROUPS = {
    "rsi_14": (ta.momentum, "tech_momentum", ["rsi_14"]),
    "stoch_rsi": (ta.momentum, "tech_momentum", ["stoch_rsi"]),
    "true_range": (ta.true_range, "ta1", ["true_range"]),
    "ewm": (ta.trend, "tech_trend", ["ema_20", "ema_50"]),
    "macd": (ta.trend, "tech_trend", ["macd", "macd_hist"]),
    "macd_hist_roc": (ta.trend, "tech_trend", ["macd_hist", "macd_hist_roc"]),
    "ema_spread": (ta.trend, "tech_trend", ["ema_20", "ema_50", "ema_spread", "ema_spread_roc"]),
    "atr_14": (ta.trend, "tech_trend", ["true_range", "atr_14"]),
    "adx_14": (ta.trend, "tech_trend", ["adx"]),
    "supertrend": (ta.trend, "tech_trend", ["supertrend"]),
    "atr_ratio": (ta.trend, "tech_trend", ["atr_ratio"]),
    "bollinger": (ta.volatility, "tech_volatility", ["bb_mid", "bb_sigma", "bb_width", "bb_pct_b", "bb_squeeze"]),
    "hv_ratio": (ta.volatility, "tech_volatility", ["hv_ratio"]),
    "volume_ratio": (ta.volume, "tech_volume", ["volume_ratio", "vol_roc"]),
    "obv": (ta.volume, "tech_volume", ["obv", "obv_roc"]),
    "mfi_14": (ta.volume, "tech_volume", ["mfi"]),
    "cmf_20": (ta.volume, "tech_volume", ["cmf"]),
    "returns": (ta.price_action, "tech_price", ["returns_1d", "returns_3d", "returns_5d", "returns_20d"]),
    "close_pct_range": (ta.price_action, "tech_price", ["close_pct_range", "gap_pct"]),
    "range_pct_52w": (ta.price_action, "tech_price", ["range_pct_52w"]),
    "consec_days": (ta.price_action, "tech_price", ["consec_days"]),
    "calendar_flags": (ta.price_action, "tech_price", ["day_of_week", "month", "is_monday", "is_friday"]),
}
for _key, (_part, _cte, _names) in GROUPS.items():
    register(_key, feature_query(_part, _names), feature_sql(_cte, _names))


def pivot_sql(x: str, order: int, high: bool = True, confirmed: bool = True) -> str:
    """Value of the pivot that becomes known on this row (or sits on it when not confirmed)."""
    agg, op = ("max", ">") if high else ("min", "<")
    here = f"lag({x}, {order}) {W})" if confirmed else x
    lo, hi = ((f"{2 * order} PRECEDING AND {order + 1} PRECEDING", f"{order - 1} PRECEDING AND CURRENT ROW") if confirmed else (f"{order} PRECEDING AND 1 PRECEDING", f"1 FOLLOWING AND {order} FOLLOWING"))
    return f"CASE WHEN {here} {op} {agg}({x}) {W} ROWS BETWEEN {lo}) AND {here} {op} {agg}({x}) {W} ROWS BETWEEN {hi}) THEN {here} END"


for _mode in ("confirmed", "legacy"):
    _late = _mode == "confirmed"
    define(
        f"div_{_mode}",
        f"""SELECT *, {pivot_sql('close', 10, True, _late)} AS ph, {pivot_sql('close', 10, False, _late)} AS pl, {pivot_sql('r50', 10, True, _late)} AS rh, {pivot_sql('r50', 10, False, _late)} AS rl
    FROM (SELECT *, coalesce(rsi_14, 50) AS r50 FROM mo1)""",
        "mo1",
    )
    register(
        "rsi_divergence" + ("" if _late else "_legacy"),
        lambda spark, d, m=_mode: ta.rsi_divergence(ta.momentum(bars(spark, d)), mode=m).select("ticker", "ts", "rsi_divergence"),
        sql(
            f"""SELECT ticker, ts, CAST(CASE WHEN i - {10 if _late else 0} < 10 THEN 0 WHEN ph IS NOT NULL AND rh IS NULL THEN -1 WHEN pl IS NOT NULL AND rl IS NULL THEN 1 ELSE 0 END AS DOUBLE) AS rsi_divergence FROM div_{_mode}""",
            f"div_{_mode}",
        ),
    )


@query(
    "pivots",
    sql(
        f"""SELECT ticker, ts, {pivot_sql('high', 8)} AS pivot_high, {pivot_sql('low', 8, False)} AS pivot_low,
    {pivot_sql('high', 8, True, False)} AS pivot_high_at, {pivot_sql('low', 8, False, False)} AS pivot_low_at FROM bars""",
        "bars",
    ),
)
def pivots(spark, d):
    from ..functions import windows as fw

    w = fw.series()
    return bars(spark, d).select(
        "ticker", "ts", fw.pivot("high", w, 8).alias("pivot_high"), fw.pivot("low", w, 8, high=False).alias("pivot_low"),
        fw.pivot("high", w, 8, confirmed=False).alias("pivot_high_at"), fw.pivot("low", w, 8, high=False, confirmed=False).alias("pivot_low_at"),
    )


define("lv1", f"SELECT ticker, ts, close, row_number() {W}) AS i, {pivot_sql('low', 10, False)} AS pl, {pivot_sql('high', 10)} AS ph FROM bars", "bars")
register(
    "sr_distance",
    lambda spark, d: ta.level_distances(bars(spark, d)).select("ticker", "ts", F.round("support_dist", 6).alias("support_dist"), F.round("resistance_dist", 6).alias("resistance_dist")),
    sql(
        """SELECT a.ticker, a.ts, round((a.close - coalesce(max(b.pl) FILTER (b.pl < a.close), a.close * 0.95)) / a.close, 6) AS support_dist,
    round((coalesce(min(b.ph) FILTER (b.ph > a.close), a.close * 1.05) - a.close) / a.close, 6) AS resistance_dist
  FROM lv1 a LEFT JOIN lv1 b ON b.ticker = a.ticker AND b.i BETWEEN a.i - 251 AND a.i AND (b.pl IS NOT NULL OR b.ph IS NOT NULL) GROUP BY a.ticker, a.ts, a.close""",
        "lv1",
    ),
)
define(
    "poc1",
    f"SELECT ticker, ts, close, volume, row_number() {W}) AS i, min(low) {last_n(252)} AS lo, (max(high) {last_n(252)} - min(low) {last_n(252)}) / 20 AS size FROM bars",
    "bars",
)
define(
    "poc2",
    """SELECT a.ticker, a.ts, a.close, a.lo, a.size, CAST(floor((b.close - a.lo) / (a.size + 1e-10)) AS INT) AS bucket, sum(b.volume) AS vol
  FROM poc1 a JOIN poc1 b ON b.ticker = a.ticker AND b.i BETWEEN a.i - 251 AND a.i GROUP BY ALL""",
    "poc1",
)
register(
    "poc_distance",
    lambda spark, d: ta.poc_distance(bars(spark, d)).select("ticker", "ts", F.round("poc_distance", 6).alias("poc_distance")),
    sql(
        """SELECT ticker, ts, round((close - (lo + (bucket + 0.5) * size)) / (lo + (bucket + 0.5) * size + 1e-10), 6) AS poc_distance
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker, ts ORDER BY vol DESC, bucket) AS rk FROM poc2) WHERE rk = 1""",
        "poc2",
    ),
)
register(
    "vwap_dist",
    lambda spark, d: ta.vwap_distance(src.bars_intraday(spark, d)).select("ticker", "ts", F.round("vwap", 6).alias("vwap"), F.round("vwap_dist", 6).alias("vwap_dist")),
    sql(
        """SELECT ticker, ts, round(v, 6) AS vwap, round((close - v) / (v + 1e-10), 6) AS vwap_dist FROM (SELECT *,
    sum((high + low + close) / 3 * volume) OVER s / (sum(volume) OVER s + 1e-10) AS v FROM bars_intraday WINDOW s AS (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING))""",
        "bars_intraday",
    ),
)
register(
    "atr_percentile_252",
    lambda spark, d: ta.atr_percentile(ta.trend(bars(spark, d))).select("ticker", "ts", F.round("atr_percentile_252", 6).alias("atr_percentile_252")),
    sql(
        """SELECT a.ticker, a.ts, round(CASE WHEN count(*) >= 20 THEN count(*) FILTER (b.atr_14 <= a.atr_14) / count(*) ELSE 0.5 END, 6) AS atr_percentile_252
  FROM tech_trend a JOIN tech_trend b ON b.ticker = a.ticker AND b.i BETWEEN a.i - 251 AND a.i GROUP BY a.ticker, a.ts""",
        "tech_trend",
    ),
)
define("sma", f"SELECT ts, close, {guarded('avg(close)', 'close', 50)} AS s FROM bars", "bars")
register(
    "breadth_50dma",
    lambda spark, d: ta.breadth(bars(spark, d)).select("ts", F.round("breadth_50dma", 6).alias("breadth_50dma"), "n_names"),
    sql("SELECT ts, round(avg(CASE WHEN close > s THEN 1.0 ELSE 0.0 END), 6) AS breadth_50dma, count(*) AS n_names FROM sma WHERE s IS NOT NULL GROUP BY ts", "sma"),
)
register(
    "intraday_mom_30m",
    lambda spark, d: ta.price_action(src.bars_intraday(spark, d)).select("ticker", "ts", F.round("intraday_mom_30m", 6).alias("intraday_mom_30m")),
    sql(f"SELECT ticker, ts, round(coalesce(close / lag(close, 6) {W}) - 1, 0), 6) AS intraday_mom_30m FROM bars_intraday", "bars_intraday"),
)
define("fwd", f"SELECT ticker, ts, lead(close, 5) {W}) / close - 1 AS f, row_number() {W}) - 1 AS i FROM bars", "bars")
register(
    "forward_label",
    lambda spark, d: ta.forward_label(bars(spark, d), 5, 0.015).select("ticker", "ts", F.round("forward_return", 6).alias("forward_return"), "label"),
    sql("SELECT ticker, ts, round(f, 6) AS forward_return, CASE WHEN f > 0.015 THEN 2 WHEN f < -0.015 THEN 0 ELSE 1 END AS label FROM fwd WHERE i >= 60 AND f IS NOT NULL", "fwd"),
)


@query(
    "feature_sequence",
    sql(
        f"""SELECT ticker, ts, round(list_sum(list_transform(seq, lambda r: r[1])), 6) AS sum_5d, seq[1][2] AS first_ret, len(seq) AS n FROM (
    SELECT ticker, ts, list([round(returns_5d, 6), round(returns_1d, 6)]) {last_n(20)} AS seq FROM tech_price) WHERE len(seq) = 20""",
        "tech_price",
    ),
)
def feature_sequence(spark, d):
    df = ta.feature_sequence(ta.price_action(bars(spark, d)), ["returns_5d", "returns_1d"], 20)
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, r: acc + r[0])
    return df.select("ticker", "ts", F.round(total, 6).alias("sum_5d"), F.col("sequence")[0][1].alias("first_ret"), F.size("sequence").cast("long").alias("n"))


_LATEST = ["rsi_14", "stoch_rsi", "adx", "bb_pct_b", "atr_ratio", "hv_ratio", "volume_ratio", "obv_roc", "returns_1d", "returns_5d", "returns_20d", "gap_pct", "ema_spread", "ema_spread_roc", "macd_hist_roc"]


def _clamped(c: str) -> str:
    lo, hi = ta.WINSOR_BOUNDS[c]
    return f"round(least(greatest(coalesce({c}, 0), {lo}), {hi}), 6) AS {c}"


define(
    "tech_all",
    """SELECT t.*, m.rsi_14, m.stoch_rsi, v.bb_pct_b, v.bb_width, v.bb_squeeze, v.bb_mid, v.hv_ratio, o.volume_ratio, o.vol_roc, o.obv, o.obv_roc, o.mfi, o.cmf,
    p.returns_1d, p.returns_3d, p.returns_5d, p.returns_20d, p.close_pct_range, p.gap_pct, p.range_pct_52w, p.consec_days, p.day_of_week, p.month, p.is_monday, p.is_friday
  FROM tech_trend t JOIN tech_momentum m USING (ticker, ts) JOIN tech_volatility v USING (ticker, ts) JOIN tech_volume o USING (ticker, ts) JOIN tech_price p USING (ticker, ts)""",
    "tech_trend", "tech_momentum", "tech_volatility", "tech_volume", "tech_price",
)
register(
    "extract_latest",
    lambda spark, d: ta.latest(ta.winsorise(ta.technical_frame(bars(spark, d))).select("ticker", "ts", *[F.round(c, 6).alias(c) for c in _LATEST])),
    sql(f"SELECT ticker, ts, {', '.join(_clamped(c) for c in _LATEST)} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM tech_all) WHERE back = 1", "tech_all"),
)
register(
    "winsorise",
    lambda spark, d: ta.winsorise(ta.price_action(ta.volume(bars(spark, d)))).select("ticker", "ts", *[F.round(c, 6).alias(c) for c in ("obv_roc", "volume_ratio", "returns_1d", "returns_5d", "returns_20d", "gap_pct")]),
    sql(f"SELECT ticker, ts, {', '.join(_clamped(c) for c in ('obv_roc', 'volume_ratio', 'returns_1d', 'returns_5d', 'returns_20d', 'gap_pct'))} FROM tech_volume JOIN tech_price USING (ticker, ts)", "tech_volume", "tech_price"),
)
