"""Drift queries: 1995-1998 as training, later bars as live."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as dr
from ..sources import adapters as src
from .ml import X, labelled
from .oracle import define, sql
from .registry import register

CUT = "1999-01-01"


def split(spark, d):
    x = labelled(spark, d)
    return x.where(F.col("ts") < CUT), x.where(F.col("ts") >= CUT)


define("drm", f"SELECT x.feature, x.value, ts >= DATE '{CUT}' AS live, ticker, ts FROM mlx, LATERAL (VALUES " + ", ".join(f"('{c}', {c})" for c in X) + ") x(feature, value)", "mlx")
_Q = ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{int(q * 100)}" for q in dr.QUANTILES)
register(
    "training_distribution",
    lambda spark, d: (lambda t: t.select("feature", "n", *[F.round(c, 6).alias(c) for c in t.columns if c not in ("feature", "n")]))(dr.distribution(split(spark, d)[0], X)),
    sql(f"SELECT feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, {_Q} FROM drm WHERE NOT live GROUP BY 1", "drm"),
)
define("pse", "SELECT feature, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM drm WHERE NOT live GROUP BY 1", "drm")
define("psh", "SELECT m.feature, len(list_filter(e.e, lambda q: m.value > q)) AS bin, count(*) FILTER (NOT live) AS ex, count(*) FILTER (live) AS ac FROM drm m JOIN pse e USING (feature) GROUP BY ALL", "drm", "pse")
define("psp", "SELECT feature, (ex + 0.5) / (sum(ex) OVER w + 0.5 * count(*) OVER w) AS pe, (ac + 0.5) / (sum(ac) OVER w + 0.5 * count(*) OVER w) AS pa FROM psh WINDOW w AS (PARTITION BY feature)", "psh")
register(
    "psi",
    lambda spark, d: dr.psi(*split(spark, d), X),
    sql("SELECT feature, p AS psi, CASE WHEN p >= 0.25 THEN 'ALERT' WHEN p >= 0.1 THEN 'WARN' ELSE 'OK' END AS status FROM (SELECT feature, round(sum((pa - pe) * ln(pa / pe)), 6) AS p FROM psp GROUP BY 1)", "psp"),
)
register(
    "psi_proxy",
    lambda spark, d: (lambda s: dr.psi_proxy(s[1], dr.distribution(s[0], X), X, ["ticker", "ts"]))(split(spark, d)),
    sql("""SELECT ticker, ts, m.feature, CASE WHEN z < 1 THEN 0 WHEN z < 2 THEN 0.05 WHEN z < 3 THEN 0.15 ELSE 0.3 END::DOUBLE AS psi_proxy FROM (SELECT d.*, abs((value - mu) / greatest(sd, 0.001)) AS z FROM drm d JOIN (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM drm WHERE NOT live GROUP BY 1) t USING (feature) WHERE live) m""", "drm"),
)
define("brd", "SELECT category, close_date, sum((round(confidence * 100) - CASE WHEN pnl_points > 0 THEN 100 ELSE 0 END) ** 2) AS s, count(*) AS n FROM ledger GROUP BY 1, 2", "ledger")
define("brr", "SELECT category, close_date, CAST(sum(n) OVER w AS BIGINT) AS n, CASE WHEN sum(n) OVER w >= 10 THEN round(sum(s) OVER w / sum(n) OVER w / 10000, 6) END AS brier FROM brd WINDOW w AS (PARTITION BY category ORDER BY close_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)", "brd")
register("brier_rolling", lambda spark, d: dr.brier_rolling(src.ledger(spark, d)), sql("SELECT * FROM brr", "brr"))


def _drift(spark, d):
    r = dr.brier_rolling(src.ledger(spark, d))
    base = r.where(F.col("close_date") < "1996-01-01").groupBy("category").agg(F.round(F.avg("brier"), 4).alias("brier"))
    return dr.brier_drift(r, base).select("category", "close_date", "brier", "train_brier", "degraded")


register("brier_drift", _drift, sql("SELECT r.category, close_date, brier, b AS train_brier, coalesce(brier > b * 1.2, false)::INT AS degraded FROM brr r JOIN (SELECT category, round(avg(brier), 4) AS b FROM brr WHERE close_date < DATE '1996-01-01' GROUP BY 1) USING (category)", "brr"))
