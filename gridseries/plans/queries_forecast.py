"""Queries of forecasters, priors, shapes and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridseries.functions import schema
from gridseries.operators import dayahead, drivers, forecast, index, lookups, metrics, models, order, scale, windows
from gridseries.sources import fixtures as fx
from gridseries.sources.shared import checkpointed

K, T = fx.KEYS, "slot"

RES = "rs AS (SELECT site, h, CASE WHEN count(y - base) >= 200 THEN median(y - base) ELSE 0.0 END AS c FROM fc WHERE split = 'train' AND y - base IS NOT NULL GROUP BY ALL)"
CORR = f"{RES}, lr AS (SELECT fc.*, base + coalesce(c, 0.0) AS y_hat FROM fc LEFT JOIN rs USING (site, h))"


def corrected(s, d, c="load"):
    return forecast.lag_residual(fx.forecasts(s, d, c), ["site", "h"])


def prior(s, d, **options):
    rows = forecast.target_weights(fx.decisions(s, d), fx.dense15(s, d), K, T, "ru")
    return forecast.seasonal_prior(rows, K, T, "ru", **options)


TW = "tw AS (SELECT hz.site AS site, hz.tgt_time AS t, dense.ru AS v FROM hz JOIN dense ON dense.site = hz.site AND dense.slot = hz.tgt_time WHERE split = 'train')"
PRIOR = f"""{TW}, pr AS (SELECT site, CAST(month(t) AS INTEGER) AS month, CAST(CASE WHEN isodow(t) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend, CAST(hour(t) * 4 + minute(t) // 15 AS INTEGER) AS slot, median(v) AS prior FROM tw GROUP BY ALL),
pa AS (SELECT site, median(v) AS prior FROM tw GROUP BY site)"""


def with_prior(s, d):
    p, overall = prior(s, d)
    return lookups.prior_lookup(fx.forecasts(s, d, "ru"), p, overall, K)


PRIOR_ROWS = f"""{PRIOR}, rows AS (SELECT hz.*, y.ru AS y FROM hz LEFT JOIN dense y ON y.site = hz.site AND y.slot = hz.tgt_time), wp AS (SELECT rows.site AS site, t_dec, split, CAST(h AS INTEGER) AS h, tgt_time, rows.y AS y, coalesce(pr.prior, pa.prior) AS prior FROM rows LEFT JOIN pr ON pr.site = rows.site AND pr.month = month(tgt_time) AND pr.is_weekend = (CASE WHEN isodow(tgt_time) >= 6 THEN 1 ELSE 0 END) AND pr.slot = hour(tgt_time) * 4 + minute(tgt_time) // 15 LEFT JOIN pa ON pa.site = rows.site)"""


def gate(s, d):
    rows = fx.forecasts(s, d, "pv")
    return rows.select("site", "t_dec", "h", "tgt_time", "base", forecast.gated(F.col("tgt_time"), F.col("base"), F.col("h") * 0.5).alias("y_hat"))


PVF = "pf AS (SELECT hz.site AS site, hz.t_dec AS t_dec, hz.split AS split, CAST(hz.h AS INTEGER) AS h, hz.tgt_time AS tgt_time, p.pv AS base FROM hz LEFT JOIN dense p ON p.site = hz.site AND p.slot = hz.tgt_time - INTERVAL 1 DAY)"


def long_rows(s, d):
    return corrected(s, d).withColumn("var", F.lit("load"))


def wide(s, d):
    return forecast.to_wide(long_rows(s, d), K, ["load"])


def ridge_rows(s, d):
    """Residual training rows with features of the target time and of stage one."""
    stage = long_rows(s, d).select("site", "t_dec", "h", "var", "y_hat")
    rows = lookups.stage_one_features(fx.forecasts(s, d, "ru"), stage, K, ["load"])
    return rows.withColumns({"r": F.col("y") - F.col("base"), "hour": F.hour("tgt_time").cast("double")})


FEATURES = ["base", "hour", "pred_load"]


def ridge(s, d):
    rows = ridge_rows(s, d)
    model = models.fit_ridge(rows, ["h"], FEATURES, "r")
    out = models.predict_ridge(rows, model, ["h"], FEATURES)
    return metrics.split_scores(out.withColumn("y_hat", forecast.recompose(F.col("base"), F.col("r_hat"))), ["split", "h"])


def delta_ridge(s, d):
    """The residual scaled by its training moments, modelled, scaled back and put on the baseline."""
    rows = ridge_rows(s, d)
    scalers = scale.fit_delta_scaler(rows, K)
    rows = rows.join(scalers, K).withColumn("z", scale.scaled(F.col("r"), F.col("mu"), F.col("sd")))
    out = models.predict_ridge(rows, models.fit_ridge(rows, ["h"], FEATURES, "z"), ["h"], FEATURES, "z_hat")
    return metrics.split_scores(out.withColumn("y_hat", F.col("base") + scale.unscaled(F.col("z_hat"), F.col("mu"), F.col("sd"))), ["split"])


METHODS = {"load": "lag1d_residual", "pv": "pv_day_residual", "line": "direct", "da": "lag1d"}


def short_vectors(rows):
    """`rows` with three features, so that SQL can solve the normal equations too; the jobs take all of drivers.with_features."""
    return rows.withColumn("x", models.vector([F.col("base"), F.hour("tgt_time"), F.weekday("tgt_time")]))


def staged(s, d):
    """Stage one, each variable by its method."""
    return staged_of(fx.Stored(s, d))


def staged_of(f):
    rows = checkpointed(short_vectors(drivers.rows_of(f.index, f.dense, K, T, list(METHODS))))
    return drivers.driver_forecasts(rows, METHODS)


def reserves(s, d):
    """Both reserves, on their priors and stage one."""
    f = fx.Stored(s, d)
    rows = drivers.with_prior(drivers.rows_of(f.index, f.dense, K, T, ["ru", "rd"]), f.index, f.dense, K, T, ["ru", "rd"])
    return drivers.reserve_forecasts(checkpointed(rows.withColumn("x", F.array().cast("array<double>"))), checkpointed(staged_of(f)), K, ["load", "pv", "line"])


def ratios(s, d):
    """The three ratios of each decision, with the wide forecasts attached."""
    idx, rows = fx.decisions(s, d), fx.forecasts(s, d, "rt").withColumns({"var": F.lit("rtbase"), "y_hat": F.col("base")})
    base = forecast.to_wide(rows, K, ["rtbase"], keep=())
    return windows.sample_ratios(idx.select("site", "t_dec"), fx.wide15(s, d), K, T, fx.COLUMNS, wide(s, d), ["load"], base)


def method_rows(s, d):
    """Target rows by variable and method, of a parsed and checked map."""
    methods = schema.check_methods(schema.parse_methods("load=lag1d_residual, pv=pv_day_residual,line=direct,da=lag1d"), list(METHODS))
    name = F.create_map(*[F.lit(x) for kv in methods.items() for x in kv])[F.col("var")]
    rows = drivers.rows_of(fx.decisions(s, d), fx.dense15(s, d), K, T, list(methods))
    return rows.groupBy("var", name.alias("method"), "split").agg(F.count("*").alias("n"), F.count("y").alias("known"))


def solved(rows: str, by: str, ok: str, name: str) -> str:
    """SQL of ridge coefficients (c0 to c3) of `rows` (by, x1, x2, x3, r), penalty 0.001, by elimination of centred normal equations.

    Missing features count as 0, as in the library.
    """
    use = f"SELECT {by}, coalesce(x1, 0.0) AS x1, coalesce(x2, 0.0) AS x2, coalesce(x3, 0.0) AS x3, r FROM {rows} WHERE split = 'train' AND r IS NOT NULL AND ({ok})"
    pair = lambda i, j: f"sum((x{i} - m{i}) * (x{j} - m{j})){' + 0.001' if i == j else ''} AS a{i}{j}"
    sums = ", ".join([pair(1, 1), pair(1, 2), pair(1, 3), pair(2, 2), pair(2, 3), pair(3, 3), *[f"sum((x{i} - m{i}) * (r - mr)) AS b{i}" for i in (1, 2, 3)]])
    steps = [
        ("u", use),
        ("m", f"SELECT {by}, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(r) AS mr FROM {name}_u GROUP BY {by}"),
        ("s", f"SELECT {by}, any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3, any_value(mr) AS mr, {sums} FROM {name}_u JOIN {name}_m USING ({by}) GROUP BY {by}"),
        ("t", f"SELECT *, a22 - a12 * a12 / a11 AS t22, a23 - a12 * a13 / a11 AS t23, a33 - a13 * a13 / a11 AS t33, b2 - a12 * b1 / a11 AS u2, b3 - a13 * b1 / a11 AS u3 FROM {name}_s"),
        ("c", f"SELECT *, (u3 - t23 * u2 / t22) / (t33 - t23 * t23 / t22) AS c3 FROM {name}_t"),
        ("d", f"SELECT *, (u2 - t23 * c3) / t22 AS c2 FROM {name}_c"),
        ("e", f"SELECT *, (b1 - a12 * c2 - a13 * c3) / a11 AS c1 FROM {name}_d"),
    ]
    parts = [f"{name}_{step} AS ({text})" for step, text in steps]
    return ", ".join([*parts, f"{name} AS (SELECT {by}, c1, c2, c3, mr - c1 * m1 - c2 * m2 - c3 * m3 AS c0 FROM {name}_e)"])


DOT = "c0 + c1 * coalesce(x1, 0.0) + c2 * coalesce(x2, 0.0) + c3 * coalesce(x3, 0.0)"
SCORES = "count(y - y_hat) AS n, avg(abs(y - y_hat)) AS mae, sqrt(avg((y - y_hat) * (y - y_hat))) AS rmse"
RIDGE_ROWS = f"""{CORR}, rr AS (SELECT lr.site AS site, lr.t_dec AS t_dec, lr.split AS split, lr.h AS h, q.ru AS y, p.ru AS base, p.ru AS x1, CAST(hour(lr.tgt_time) AS DOUBLE) AS x2, lr.y_hat AS x3, q.ru - p.ru AS r
 FROM lr LEFT JOIN dense q ON q.site = lr.site AND q.slot = lr.tgt_time LEFT JOIN dense p ON p.site = lr.site AND p.slot = lr.tgt_time - INTERVAL 1 DAY)"""
RIDGE_SQL = f"WITH {RIDGE_ROWS}, {solved('rr', 'h', 'TRUE', 'm')}, o AS (SELECT *, base + {DOT} AS y_hat FROM rr LEFT JOIN m USING (h)) SELECT split, h, {SCORES} FROM o GROUP BY ALL\n -- round: mae rmse"
DELTA_SQL = f"""WITH {RIDGE_ROWS}, ds AS (SELECT site, coalesce(avg(r), 0.0) AS mu, CASE WHEN stddev_pop(r) > 1e-8 THEN stddev_pop(r) ELSE 1.0 END AS sd FROM rr WHERE split = 'train' GROUP BY site),
 rz AS (SELECT rr.* REPLACE ((r - mu) / sd AS r), mu, sd FROM rr JOIN ds USING (site)), {solved('rz', 'h', 'TRUE', 'm')}, o AS (SELECT *, base + ({DOT}) * sd + mu AS y_hat FROM rz LEFT JOIN m USING (h)) SELECT split, {SCORES} FROM o GROUP BY ALL
 -- round: mae rmse"""


def target_rows(v: str) -> str:
    return f"""SELECT hz.site AS site, hz.t_dec AS t_dec, hz.split AS split, '{v}' AS var, CAST(hz.h AS INTEGER) AS h, hz.tgt_time AS tgt_time, q.{v} AS y, p.{v} AS base
 FROM hz LEFT JOIN dense q ON q.site = hz.site AND q.slot = hz.tgt_time LEFT JOIN dense p ON p.site = hz.site AND p.slot = hz.tgt_time - INTERVAL 1 DAY"""


VARS = f"va AS ({' UNION ALL '.join(map(target_rows, METHODS))})"
NAMED = "CASE var WHEN 'load' THEN 'lag1d_residual' WHEN 'pv' THEN 'pv_day_residual' WHEN 'line' THEN 'direct' ELSE 'lag1d' END AS method"
OPEN = "(var <> 'pv' OR coalesce(hour(tgt_time) BETWEEN 6 AND 18 AND base > 1.0, FALSE))"
STAGED = f"""{VARS}, vr AS (SELECT *, base AS x1, CAST(hour(tgt_time) AS DOUBLE) AS x2, CAST(isodow(tgt_time) - 1 AS DOUBLE) AS x3, CASE WHEN var = 'line' THEN y ELSE y - base END AS r FROM va),
 {solved("vr", "var, h", f"var <> 'da' AND {OPEN}", "vm")}, st AS (SELECT vr.*, CASE WHEN var = 'line' THEN {DOT} WHEN var = 'da' THEN base WHEN {OPEN} THEN base + {DOT} ELSE base END AS y_hat FROM vr LEFT JOIN vm USING (var, h))"""


def priors_of(v: str) -> str:
    return f"""tw_{v} AS (SELECT hz.site AS site, hz.tgt_time AS t, dense.{v} AS v FROM hz JOIN dense ON dense.site = hz.site AND dense.slot = hz.tgt_time WHERE split = 'train'),
 pr_{v} AS (SELECT site, month(t) AS mo, isodow(t) >= 6 AS we, hour(t) * 4 + minute(t) // 15 AS sl, median(v) AS prior FROM tw_{v} GROUP BY ALL), pa_{v} AS (SELECT site, median(v) AS prior FROM tw_{v} GROUP BY site),
 wr_{v} AS (SELECT x.*, coalesce(pr_{v}.prior, pa_{v}.prior) AS prior FROM ({target_rows(v)}) x LEFT JOIN pr_{v} ON pr_{v}.site = x.site AND mo = month(tgt_time) AND we = (isodow(tgt_time) >= 6) AND sl = hour(tgt_time) * 4 + minute(tgt_time) // 15
  LEFT JOIN pa_{v} ON pa_{v}.site = x.site)"""


STAGES = ", ".join(f"max(y_hat) FILTER (var = '{v}') AS x{i}" for i, v in enumerate(("load", "pv", "line"), 1))
RESERVES = f"""{STAGED}, {priors_of("ru")}, {priors_of("rd")}, sw AS (SELECT site, t_dec, h, {STAGES} FROM st GROUP BY ALL),
 rv AS (SELECT w.*, x1, x2, x3, y - prior AS r FROM (SELECT * FROM wr_ru UNION ALL SELECT * FROM wr_rd) w JOIN sw USING (site, t_dec, h)), {solved("rv", "var, h", "TRUE", "rm")}, ro AS (SELECT rv.*, prior + {DOT} AS y_hat FROM rv LEFT JOIN rm USING (var, h))"""
PRESENT = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in fx.COLUMNS)
RATIOS = f"""{CORR}, hr AS (SELECT site, slot AS t_dec, sum(n) OVER (PARTITION BY site ORDER BY slot ROWS 191 PRECEDING) / (192.0 * {len(fx.COLUMNS)}) AS hist_ratio FROM (SELECT site, slot, {PRESENT} AS n FROM wide)),
 fr AS (SELECT site, t_dec, count(y_hat) / 24.0 AS future_ratio FROM lr GROUP BY ALL), br AS (SELECT hz.site AS site, t_dec, count(p.rt) / 24.0 AS base_ratio FROM hz LEFT JOIN dense p ON p.site = hz.site AND p.slot = tgt_time - INTERVAL 1 DAY GROUP BY ALL),
 ra AS (SELECT * FROM (SELECT site, t_dec FROM idx) LEFT JOIN hr USING (site, t_dec) LEFT JOIN fr USING (site, t_dec) LEFT JOIN br USING (site, t_dec))"""


def segments(s, d):
    """Boosted trees for each third of the day; few and shallow ones, as this is a check of the job."""
    t = dayahead.feature_table(fx.dense15(s, d), K, T, "da", "rt")
    t = checkpointed(index.high_price_weights(index.split_by_rows(t, K, T, 5, 6), K, "y", "segment"))  # three models read it
    names = dayahead.feature_names(t, K, T)
    fitted = models.fit_segments(t, names, maxIter=3, maxDepth=3)
    return metrics.split_scores(models.predict_segments(t, fitted, names), ["split", "segment"])


def user_rows(s, d):
    """Each user's rows with the step from the row before, whose last third of days is test, and three features."""
    rows = fx.by_user(s, d).withColumn("base", F.lag("value").over(Window.partitionBy("user_id").orderBy(T)))
    split = F.when(F.dayofmonth(T) <= 20, "train").otherwise("test")
    return rows.withColumns({"split": split, "r": F.col("value") - F.col("base"), "x": models.vector([F.col("base"), F.hour(T), F.weekday(T)])})


USER_ROWS = """ur AS (SELECT user_id, slot, value AS y, base, CASE WHEN day(slot) <= 20 THEN 'train' ELSE 'test' END AS split, coalesce(base, 0.0) AS x1, CAST(hour(slot) AS DOUBLE) AS x2, CAST(isodow(slot) - 1 AS DOUBLE) AS x3, value - base AS r
 FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY slot) AS base FROM us))"""


def ridge_by_user(s, d):
    """A ridge of each user: as many models as the table has users."""
    rows = user_rows(s, d)
    got = models.predict_vectors(rows, models.fit_vectors(rows, ["user_id"], F.col("r"), F.lit(True)), ["user_id"])
    return metrics.split_scores(got.withColumn("y_hat", forecast.recompose(F.col("base"), F.col("r_hat"))).withColumnRenamed("value", "y"), ["user_id", "split"])


def as_of(s, d):
    rows = long_rows(s, d)
    last = index.last_decision(fx.decisions(s, d), K)
    return forecast.as_of_output(last, rows.select("site", "t_dec", "h", "base"), rows.select("site", "t_dec", "h", (F.col("h") / 24).alias("r_hat")), K, 1.0, 2.0)


QUERIES = {
    "fc1_horizons": (lambda s, d: lookups.horizons(fx.decisions(s, d)).select("site", "t_dec", "h", "tgt_time"), "SELECT site, t_dec, CAST(h AS INTEGER) AS h, tgt_time FROM hz"),
    "fc2_lag_one_day": (lambda s, d: fx.forecasts(s, d, "rt").select("site", "t_dec", "h", F.col("base").alias("y_hat")), "SELECT hz.site AS site, t_dec, CAST(h AS INTEGER) AS h, p.rt AS y_hat FROM hz LEFT JOIN dense p ON p.site = hz.site AND p.slot = tgt_time - INTERVAL 1 DAY\n -- round: y_hat"),
    "fc3_median_residuals": (lambda s, d: forecast.median_residuals(fx.forecasts(s, d), ["site", "h"]), f"WITH {RES} SELECT site, h, c AS correction FROM rs\n -- round: correction"),
    "fc3_medians_refined": (lambda s, d: order.quantiles(fx.forecasts(s, d).where("split = 'train'"), ["site", "h"], F.col("y") - F.col("base"), 0.5, "median", few=20), "SELECT site, h, median(y - base) AS median, count(y - base) AS n FROM fc WHERE split = 'train' AND y - base IS NOT NULL GROUP BY ALL\n -- round: median"),
    "fc3_median_steps_by_user": (lambda s, d: forecast.median_residuals(user_rows(s, d).withColumnRenamed("value", "y"), ["user_id"], min_pairs=20), f"WITH {USER_ROWS} SELECT user_id, CASE WHEN count(r) >= 20 THEN median(r) ELSE 0.0 END AS correction FROM ur WHERE split = 'train' AND r IS NOT NULL GROUP BY user_id\n -- round: correction"),
    "md6_ridge_by_user": (ridge_by_user, f"WITH {USER_ROWS}, {solved('ur', 'user_id', 'TRUE', 'um')}, uo AS (SELECT ur.*, base + {DOT} AS y_hat FROM ur LEFT JOIN um USING (user_id)) SELECT user_id, split, {SCORES} FROM uo GROUP BY ALL\n -- round: mae rmse"),
    "fc3_lag_residual": (corrected, f"WITH {CORR} SELECT * FROM lr\n -- round: y base y_hat"),
    "fc4_fallback": (lambda s, d: forecast.require_forecasts(corrected(s, d), fallback=True).groupBy("site", "split").agg(F.count_if(F.col("y_hat").isNull()).alias("missing"), F.count("y_hat").alias("made")), f"WITH {CORR} SELECT site, split, count(*) FILTER (y_hat IS NULL) AS missing, count(y_hat) AS made FROM lr GROUP BY ALL"),
    "fc5_recompose": (lambda s, d: fx.forecasts(s, d).select("site", "t_dec", "h", (F.col("y") - F.col("base")).alias("r"), forecast.recompose(F.col("base"), F.col("y") - F.col("base")).alias("again")), "SELECT site, t_dec, h, y - base AS r, base + (y - base) AS again FROM fc\n -- round: r again"),
    "fc6_daylight_gate": (gate, f"WITH {PVF} SELECT site, t_dec, h, tgt_time, base, CASE WHEN hour(tgt_time) BETWEEN 6 AND 18 AND base > 1.0 THEN base + h * 0.5 ELSE base END AS y_hat FROM pf\n -- round: base y_hat"),
    "fc7_seasonal_prior": (lambda s, d: prior(s, d)[0], f"WITH {PRIOR} SELECT * FROM pr\n -- round: prior"),
    "fc7_prior_overall": (lambda s, d: prior(s, d)[1], f"WITH {PRIOR} SELECT * FROM pa\n -- round: prior"),
    "fc7_prior_mean_no_month": (lambda s, d: prior(s, d, by_month=False, statistic="mean")[0].where("month = 1").drop("month"), f"WITH {TW} SELECT site, CAST(CASE WHEN isodow(t) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend, CAST(hour(t) * 4 + minute(t) // 15 AS INTEGER) AS slot, avg(v) AS prior FROM tw GROUP BY ALL\n -- round: prior"),
    "jo8_prior_lookup": (lambda s, d: with_prior(s, d).select("site", "t_dec", "h", "y", "prior"), f"WITH {PRIOR_ROWS} SELECT site, t_dec, h, y, prior FROM wp\n -- round: y prior"),
    "fc8_prior_recompose": (lambda s, d: with_prior(s, d).select("site", "t_dec", "h", forecast.recompose(F.col("prior"), F.col("h") / 8).alias("y_hat")), f"WITH {PRIOR_ROWS} SELECT site, t_dec, h, prior + h / 8.0 AS y_hat FROM wp\n -- round: y_hat"),
    "fc9_source_forecast": (lambda s, d: forecast.use_source_forecast(lookups.horizons(fx.decisions(s, d)).select("site", "t_dec", "h", "tgt_time"), fx.dense15(s, d), K, T, {"rt": "da", "load": "load_fcst"}), "SELECT hz.site AS site, t_dec, CAST(h AS INTEGER) AS h, tgt_time, 'rt' AS var, da AS y_hat FROM hz JOIN dense d ON d.site = hz.site AND d.slot = tgt_time\n -- round: y_hat"),
    "fc10_to_wide": (lambda s, d: wide(s, d), "WITH " + CORR + " SELECT site, t_dec, split, " + ", ".join(f"max(y_hat) FILTER (h = {h}) AS load_h{h:02d}" for h in range(1, 25)) + " FROM lr GROUP BY ALL\n -- round: " + " ".join(f"load_h{h:02d}" for h in range(1, 25))),
    "fc11_to_long": (lambda s, d: forecast.to_long(wide(s, d), K, ["load"], {"load": "lag1d_residual"}, "v1"), f"WITH {CORR} SELECT site, t_dec, h, tgt_time, 'load' AS var, y_hat, split, 'lag1d_residual' AS method, 'v1' AS model_version, CAST(CASE WHEN y_hat IS NULL THEN 0 ELSE 1 END AS INTEGER) AS is_valid FROM lr\n -- round: y_hat"),
    "fc12_as_of_output": (as_of, "SELECT fc.site AS site, tgt_time AS t, base + h / 24.0 * 2.0 + 1.0 AS rt_pred FROM fc JOIN (SELECT site, max(t_dec) AS t_dec FROM idx GROUP BY site) USING (site, t_dec)\n -- round: rt_pred"),
    "jo11_stage_one_features": (lambda s, d: ridge_rows(s, d).select("site", "t_dec", "h", "y", "pred_load"), f"WITH {CORR} SELECT lr.site AS site, t_dec, h, ru AS y, y_hat AS pred_load FROM lr LEFT JOIN dense ON dense.site = lr.site AND dense.slot = lr.tgt_time\n -- round: y pred_load"),
    "jo12_attach_wide": (lambda s, d: lookups.attach_wide(fx.decisions(s, d), wide(s, d).select("site", "t_dec", "load_h01", "load_h24"), K).select("site", "t_dec", "load_h01", "load_h24"), f"WITH {CORR} SELECT site, t_dec, max(y_hat) FILTER (h = 1) AS load_h01, max(y_hat) FILTER (h = 24) AS load_h24 FROM lr GROUP BY ALL\n -- round: load_h01 load_h24"),
    "md5_segment_trees": (segments, ""),
    "md6_ridge_by_horizon": (ridge, RIDGE_SQL),
    "md6_driver_methods": (lambda s, d: metrics.split_scores(staged(s, d), ["var", "method", "split", "h"]), f"WITH {STAGED} SELECT var, {NAMED}, split, h, {SCORES} FROM st GROUP BY ALL\n -- round: mae rmse"),
    "md7_reserve_residuals": (lambda s, d: metrics.split_scores(reserves(s, d), ["var", "split", "h"]), f"WITH {RESERVES} SELECT var, split, h, {SCORES} FROM ro GROUP BY ALL\n -- round: mae rmse"),
    "md8_scaled_residual_ridge": (delta_ridge, DELTA_SQL),
    "sc7_method_map": (method_rows, f"WITH {VARS} SELECT var, {NAMED}, split, count(*) AS n, count(y) AS known FROM va GROUP BY ALL"),
    "wi7_sample_ratios": (ratios, f"WITH {RATIOS} SELECT site, t_dec, hist_ratio, future_ratio, base_ratio FROM ra\n -- round: hist_ratio future_ratio base_ratio"),
    "wi7_good_samples": (lambda s, d: windows.good_samples(ratios(s, d), 0.4, 0.98).select("site", "t_dec"), f"WITH {RATIOS} SELECT site, t_dec FROM ra WHERE hist_ratio >= 0.4 AND future_ratio >= 0.98 AND base_ratio >= 1"),
    "md9_usable_rows": (lambda s, d: models.usable_counts(ridge_rows(s, d), ["site", "h"], F.col("r").isNotNull()), "SELECT fc.site AS site, h, count(*) FILTER (d.ru IS NOT NULL AND p.ru IS NOT NULL) AS n FROM fc LEFT JOIN dense d ON d.site = fc.site AND d.slot = tgt_time LEFT JOIN dense p ON p.site = fc.site AND p.slot = tgt_time - INTERVAL 1 DAY WHERE split = 'train' GROUP BY ALL"),
}
