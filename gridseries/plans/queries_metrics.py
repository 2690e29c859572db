"""Queries of error metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridseries.operators import metrics
from gridseries.sources import fixtures as fx


def long_forecasts(s, d):
    """Lag-1-day forecasts of two variables, as long rows with a tag."""
    parts = [fx.forecasts(s, d, c).withColumns({"var": F.lit(c), "tag": F.lit("lag1d"), "y_hat": F.col("base")}) for c in ("load", "rt")]
    return metrics.consolidate(parts)


FC2 = """p2 AS (SELECT hz.site AS site, hz.t_dec AS t_dec, hz.split AS split, CAST(hz.h AS INTEGER) AS h, hz.tgt_time AS tgt_time, d.rt AS y, p.rt AS base FROM hz LEFT JOIN dense d ON d.site = hz.site AND d.slot = hz.tgt_time LEFT JOIN dense p ON p.site = hz.site AND p.slot = hz.tgt_time - INTERVAL 1 DAY),
lf AS (SELECT 'load' AS var, * FROM fc UNION ALL SELECT 'rt' AS var, * FROM p2)"""
HM = f"""{FC2}, hm AS (SELECT 'lag1d' AS tag, split, var, h, count(base - y) AS n, avg(abs(base - y)) AS mae, sqrt(avg((base - y) * (base - y))) AS rmse FROM lf WHERE split IN ('val', 'test') GROUP BY ALL)"""


def compared(s, d):
    p = fx.price_pairs(s, d).withColumns({"split": F.when(F.year("ts") < 1996, "train").otherwise("test"), "naive": F.when(F.col("actual") > 20000, F.col("actual") * 0.9)})
    return metrics.compare_models(p, "actual", {"model": "forecast", "naive": "naive"})


QUERIES = {
    "me1_pair_report": (lambda s, d: metrics.pair_report(fx.price_pairs(s, d), ["grp"]), """SELECT grp, count(*) AS n, avg(abs(forecast - actual)) AS mae, sqrt(avg((forecast - actual) ** 2)) AS rmse, avg(forecast - actual) AS bias, corr(actual, forecast) AS corr, avg(abs(forecast - actual) / abs(actual)) * 100 AS mape FROM pp GROUP BY grp
 -- round: mae rmse bias corr mape"""),
    "me4_wide_pairs": (lambda s, d: metrics.pair_report(metrics.pairs_long(fx.wide15(s, d), ["site"], {"price": ("rt", "da"), "power": ("load", "pv")}), ["site", "variable"]), """SELECT site, variable, count(e) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, CASE WHEN count(e) >= 2 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS corr, avg(abs(e) / abs(a)) FILTER (abs(a) > 1e-9) * 100 AS mape
 FROM (SELECT site, variable, b - a AS e, CASE WHEN b IS NOT NULL THEN a END AS a, CASE WHEN a IS NOT NULL THEN b END AS b FROM (SELECT site, 'price' AS variable, rt AS a, da AS b FROM wide UNION ALL SELECT site, 'power', load, pv FROM wide)) GROUP BY ALL
 -- round: mae rmse bias corr mape"""),
    "me5_recent_overlap": (lambda s, d: metrics.recent_overlap(fx.wide15(s, d).select("site", "slot", F.col("rt").alias("actual"), F.col("da").alias("forecast")), ["site"], "slot", 7), """SELECT site, slot, actual, forecast FROM (SELECT site, slot, rt AS actual, da AS forecast FROM wide) JOIN (SELECT site AS s2, coalesce(max(slot) FILTER (rt IS NOT NULL AND da IS NOT NULL), CASE WHEN max(slot) FILTER (rt IS NOT NULL) IS NOT NULL AND max(slot) FILTER (da IS NOT NULL) IS NOT NULL THEN least(max(slot) FILTER (rt IS NOT NULL), max(slot) FILTER (da IS NOT NULL)) END, max(slot)) AS e FROM wide GROUP BY 1) ON site = s2 WHERE slot <= e AND slot >= e - INTERVAL 7 DAY
 -- round: actual forecast"""),
    "me6_split_scores": (lambda s, d: metrics.split_scores(fx.forecasts(s, d), ["site", "split"], p="base"), "SELECT site, split, count(base - y) AS n, avg(abs(base - y)) AS mae, sqrt(avg((base - y) ** 2)) AS rmse FROM fc GROUP BY ALL\n -- round: mae rmse"),
    "me7_compare_models": (compared, """SELECT model, split AS dataset, avg(abs(p - actual)) AS mae, sqrt(avg((p - actual) ** 2)) AS rmse, count(*) AS n FROM (SELECT 'naive' AS model, CASE WHEN year(ts) < 1996 THEN 'train' ELSE 'test' END AS split, actual, actual * 0.9 AS p FROM pp WHERE actual > 20000 UNION ALL SELECT 'model on naive', CASE WHEN year(ts) < 1996 THEN 'train' ELSE 'test' END, actual, forecast FROM pp WHERE actual > 20000) GROUP BY ALL
 -- round: mae rmse"""),
    "me8_horizon_metrics": (lambda s, d: metrics.horizon_metrics(long_forecasts(s, d), ["tag"]), f"WITH {HM} SELECT * FROM hm\n -- round: mae rmse"),
    "me9_horizon_summary": (lambda s, d: metrics.horizon_summary(metrics.horizon_metrics(long_forecasts(s, d), ["tag"]), ["tag"]), f"WITH {HM} SELECT tag, split, var, avg(mae) AS all_mae, avg(rmse) AS all_rmse, max(mae) FILTER (h = 24) AS last_mae, max(rmse) FILTER (h = 24) AS last_rmse, CAST(sum(n) AS BIGINT) AS valid_points_all, coalesce(max(n) FILTER (h = 24), 0) AS valid_points_last, sum(n) = 0 AS no_valid_points FROM hm GROUP BY ALL\n -- round: all_mae all_rmse last_mae last_rmse"),
    "me10_last_days": (lambda s, d: metrics.last_days(long_forecasts(s, d).where("split = 'test'"), ["site", "var"], "tgt_time", days=3).select("site", "var", "t_dec", "tgt_time", "y", "y_hat"), f"WITH {FC2} SELECT site, var, t_dec, tgt_time, y, base AS y_hat FROM (SELECT *, dense_rank() OVER (PARTITION BY site, var ORDER BY CAST(tgt_time AS DATE) DESC) AS k FROM lf WHERE split = 'test' AND h = 24 AND y IS NOT NULL AND base IS NOT NULL) WHERE k <= 3\n -- round: y y_hat"),
    "me11_masked_huber": (lambda s, d: metrics.masked_huber(fx.forecasts(s, d), ["site", "h"], "y", "base"), "SELECT site, h, coalesce(avg(CASE WHEN abs(base - y) <= 2 THEN 0.5 * (base - y) * (base - y) ELSE 2 * (abs(base - y) - 1) END), 0.0) AS huber FROM fc GROUP BY ALL\n -- round: huber"),
    "me12_consolidate": (lambda s, d: long_forecasts(s, d).groupBy("tag", "var", "split").agg(F.count("*").alias("n"), F.count("y").alias("n_y")), f"WITH {FC2} SELECT 'lag1d' AS tag, var, split, count(*) AS n, count(y) AS n_y FROM lf GROUP BY ALL"),
    "me13_overview": (lambda s, d: metrics.overview(fx.wide15(s, d).where("rt is not null"), ["site"], "slot", ["rt", "da"]), "SELECT site, slot, rt, da FROM wide WHERE rt IS NOT NULL"),
}
