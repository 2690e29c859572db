"""Queries of calendar, index, window and lookup operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridseries.functions import calendar
from gridseries.operators import dayahead, index, lookups, scale, windows
from gridseries.sources import fixtures as fx

K, T = fx.KEYS, "slot"


def calendar_query(features, c="slot"):
    return lambda s, d: fx.wide15(s, d).select("site", "slot", *[v.alias(k) for k, v in features(F.col(c)).items()])


WAVE = lambda x, n: f"sin(2 * pi() * ({x})) AS {n}_sin, cos(2 * pi() * ({x})) AS {n}_cos"
PARTS = "CAST(hour(slot) AS INTEGER) AS hour, CAST(minute(slot) AS INTEGER) AS minute, CAST(isodow(slot) - 1 AS INTEGER) AS weekday, CAST(month(slot) AS INTEGER) AS month"
WEEKEND = "CAST(CASE WHEN isodow(slot) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend"
SLOT = "CAST(hour(slot) * 4 + minute(slot) // 15 AS INTEGER) AS slot_id"

TRAIL = """tr AS (SELECT site, slot, load AS last, avg(load) OVER d AS mean_96, stddev_pop(load) OVER d AS std_96, avg(load) OVER q AS mean_24, load - avg(load) OVER q AS trend FROM wide
 WINDOW d AS (PARTITION BY site ORDER BY slot ROWS BETWEEN 95 PRECEDING AND CURRENT ROW), q AS (PARTITION BY site ORDER BY slot ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


def rolling_sql(c, win):
    w = f"OVER (PARTITION BY site ORDER BY slot ROWS BETWEEN {win - 1} PRECEDING AND CURRENT ROW)"
    full = lambda f: f"CASE WHEN count({c}) {w} = {win} THEN {f}({c}) {w} END"
    return f"{full('avg')} AS {c}_{win}_mean, {full('stddev_pop')} AS {c}_{win}_std, {full('min')} AS {c}_{win}_min, {full('max')} AS {c}_{win}_max, CASE WHEN count({c}) {w} = {win} THEN {c} - lag({c}, {win - 1}) OVER (PARTITION BY site ORDER BY slot) END AS {c}_{win}_trend"


HISTORY = "SELECT site, slot, load, " + ", ".join(rolling_sql("load", w) for w in windows.WINDOWS) + ", lag(load, 96) OVER (PARTITION BY site ORDER BY slot) AS load_lag1d, lag(load, 192) OVER (PARTITION BY site ORDER BY slot) AS load_lag2d FROM dense"
HISTORY_DOUBLES = "load load_lag1d load_lag2d " + " ".join(f"load_{w}_{k}" for w in windows.WINDOWS for k in ("mean", "std", "min", "max", "trend"))


def rolling_by_user_sql(win):
    """As rolling_sql, of each user's rows."""
    return rolling_sql("value", win).replace("PARTITION BY site", "PARTITION BY user_id")


BY_USER_WINDOWS = (24, 8)
BY_USER = "SELECT user_id, slot, value, " + ", ".join(map(rolling_by_user_sql, BY_USER_WINDOWS)) + ", lag(value, 96) OVER (PARTITION BY user_id ORDER BY slot) AS value_lag1d, lag(value, 192) OVER (PARTITION BY user_id ORDER BY slot) AS value_lag2d FROM us"
BY_USER_DOUBLES = "value value_lag1d value_lag2d " + " ".join(f"value_{w}_{k}" for w in BY_USER_WINDOWS for k in ("mean", "std", "min", "max", "trend"))


def history(s, d):
    return windows.history_features(fx.dense15(s, d), K, T, ["load"])


def halo(s, d):
    return windows.with_halo(fx.dense15(s, d), K, T, 192, 15, lambda df, keys: windows.history_features(df.withColumn("_o", F.col("_own")), keys, T, ["load"]).withColumn("_own", F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(T)) / (7 * 86400))))


DAYS = """ds AS (SELECT site, CAST(slot AS DATE) AS date, avg(da) AS d_mean, max(da) AS d_max, min(da) AS d_min, stddev_pop(da) AS d_std, """ + ", ".join(f"avg(da) FILTER (hour(slot) // 6 = {b}) AS b{b}_mean, stddev_pop(da) FILTER (hour(slot) // 6 = {b}) AS b{b}_std" for b in range(4)) + " FROM dense GROUP BY ALL)"
DAY_DOUBLES = "d_mean d_max d_min d_std " + " ".join(f"b{b}_{k}" for b in range(4) for k in ("mean", "std"))
DAILY = """dm AS (SELECT site, CAST(slot AS DATE) AS date, avg(da) AS m FROM sparse GROUP BY ALL),
dr AS (SELECT *, avg(m) OVER (PARTITION BY site ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3, avg(m) OVER (PARTITION BY site ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m7 FROM dm)"""
PREV = f"""{DAILY}, pm AS (SELECT dr.site AS site, dr.date AS date, b.m AS prev_mean, b.m3 AS prev_mean_3d, b.m7 AS prev_mean_7d, coalesce(w.m, b.m7) AS d7_mean FROM dr LEFT JOIN dr b ON b.site = dr.site AND b.date + 1 = dr.date LEFT JOIN dr w ON w.site = dr.site AND w.date + 7 = dr.date)"""
ASOF = f"""{TRAIL}, ao AS (SELECT x.site AS site, CAST(x.day + INTERVAL 1 DAY AS DATE) AS date, max(tr.slot) AS as_of FROM (SELECT DISTINCT site, CAST(slot AS DATE) AS day FROM wide) x JOIN tr ON tr.site = x.site AND tr.slot <= x.day + INTERVAL 9 HOUR GROUP BY ALL),
aj AS (SELECT ao.site AS site, date, as_of, last, mean_96, std_96, mean_24, trend FROM ao JOIN tr ON tr.site = ao.site AND tr.slot = as_of)"""


def sparse(s, d):
    """The rows of the wide table that have a price: days and slots are absent."""
    return fx.wide15(s, d).where("da is not null")


SPARSE = "sparse AS (SELECT * FROM wide WHERE da IS NOT NULL)"


def scaled(s, d):
    train = scale.training_rows(fx.dense15(s, d), fx.decisions(s, d), K, T)
    return scale.fit_scalers(train, K, ["rt", "load"])


SCALERS = """sc AS (SELECT site, var, coalesce(avg(v), 0.0) AS mean, CASE WHEN stddev_pop(v) > 1e-8 THEN stddev_pop(v) ELSE 1.0 END AS std FROM (SELECT site, unnest(['rt','load']) AS var, unnest([rt, load]) AS v FROM dense JOIN (SELECT site AS s2, max(t_dec) AS l FROM idx WHERE split = 'train' GROUP BY 1) ON site = s2 AND slot <= l) GROUP BY ALL)"""


def weights(s, d):
    df = index.split_by_rows(sparse(s, d), K, T, 5, 6).withColumn("segment", calendar.segment(F.col(T)))
    return index.high_price_weights(df, K, "da", "segment").select("site", "slot", "split", "segment", "da", "weight")


SPLIT_ROWS = """sr AS (SELECT *, CASE WHEN k <= 576 THEN 'test' WHEN k <= 1056 THEN 'val' ELSE 'train' END AS split, CAST(hour(slot) // 8 AS INTEGER) AS segment FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY slot DESC) AS k FROM wide WHERE da IS NOT NULL))"""


def day_ahead(s, d):
    t = dayahead.feature_table(fx.dense15(s, d), K, T, "da", "rt", {"load": ("load_fcst", "load")})
    return t.select("site", "slot", "segment", "y", "same_slot_d1", "hour_sin", "x_load", "d_mean", "b2_std", "prev_mean_3d", "d7_mean", "rt_last", "rt_mean_96", "rt_trend")


QUERIES = {
    "sf1_calendar_day_ahead": (calendar_query(calendar.day_ahead_features), f"SELECT site, slot, {PARTS}, {WEEKEND}, {WAVE('hour(slot) / 24', 'hour')}, {WAVE('(isodow(slot) - 1) / 7', 'weekday')}, {WAVE('month(slot) / 12', 'month')} FROM wide\n -- round: hour_sin hour_cos weekday_sin weekday_cos month_sin month_cos"),
    "sf2_calendar_target_time": (lambda s, d: fx.wide15(s, d).select("site", F.col("slot").alias("t"), *[v.alias("slot_id" if k == "slot" else k) for k, v in calendar.target_time_features(F.col("slot")).items()]), f"SELECT site, slot AS t, {PARTS}, CAST(dayofyear(slot) AS INTEGER) AS dayofyear, {WEEKEND}, {SLOT}, {WAVE('(hour(slot) + minute(slot) / 60) / 24', 'hour')}, {WAVE('dayofyear(slot) / 365.25', 'doy')} FROM wide\n -- round: hour_sin hour_cos doy_sin doy_cos"),
    "sf3_calendar_decision_time": (calendar_query(calendar.decision_time_features), f"SELECT site, slot, {WAVE('(hour(slot) + minute(slot) / 60) / 24', 'hour')}, {WAVE('(isodow(slot) - 1) / 7', 'weekday')}, {WAVE('(month(slot) - 1) / 12', 'month')} FROM wide\n -- round: hour_sin hour_cos weekday_sin weekday_cos month_sin month_cos"),
    "sf4_slot_id": (lambda s, d: fx.wide15(s, d).groupBy("site", calendar.slot_id(F.col("slot")).alias("slot_id")).agg(F.count("*").alias("n")), f"SELECT site, {SLOT}, count(*) AS n FROM wide GROUP BY ALL"),
    "sf5_shifts": (lambda s, d: fx.wide15(s, d).select("site", "slot", calendar.shift(F.col("slot"), 24).alias("later"), calendar.shift_days(F.col("slot"), -1).alias("day_before")), "SELECT site, slot, slot + INTERVAL 6 HOUR AS later, slot - INTERVAL 1 DAY AS day_before FROM wide"),
    "sf7_horizon_names": (lambda s, d: lookups.horizons(fx.decisions(s, d)).select("site", "t_dec", calendar.horizon_name(F.lit("load"), F.col("h")).alias("name")), "SELECT site, t_dec, printf('load_h%02d', h) AS name FROM hz"),
    "wi1_history_features": (history, f"{HISTORY}\n -- round: {HISTORY_DOUBLES}"),
    "wi1_history_by_user": (lambda s, d: windows.history_features(fx.by_user(s, d), ["user_id"], T, ["value"], BY_USER_WINDOWS), f"{BY_USER}\n -- round: {BY_USER_DOUBLES}"),
    "wi1_history_with_halo": (halo, f"{HISTORY}\n -- round: {HISTORY_DOUBLES}"),
    "wi4_history_at_decisions": (lambda s, d: windows.at_decisions(history(s, d).select("site", "slot", "load", "load_192_mean", "load_lag2d"), fx.decisions(s, d), K, T), f"SELECT idx.site AS site, t_dec, tgt_max_time, date_tgt_max, split, load, load_192_mean, load_lag2d FROM idx JOIN ({HISTORY}) x ON x.site = idx.site AND slot = t_dec\n -- round: load load_192_mean load_lag2d"),
    "wi5_daily_means": (lambda s, d: windows.daily_means(sparse(s, d), K, T, "da"), f"WITH {SPARSE}, {DAILY} SELECT site, date, m AS mean, m3 AS mean_3d, m7 AS mean_7d FROM dr\n -- round: mean mean_3d mean_7d"),
    "wi5_daily_order_means": (lambda s, d: windows.daily_means(fx.daily_orders(s, d).withColumn("k", F.lit(1)), ["k"], "ts", "price").drop("k"), "SELECT date, m AS mean, avg(m) OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean_3d, avg(m) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS mean_7d FROM (SELECT CAST(ts AS DATE) AS date, avg(price) AS m FROM od GROUP BY 1)\n -- round: mean mean_3d mean_7d"),
    "wi6_trailing_stats": (lambda s, d: fx.wide15(s, d).select("site", "slot", *[v.alias(k) for k, v in windows.trailing_stats(K, T, "load").items()]), f"WITH {TRAIL} SELECT * FROM tr\n -- round: last mean_96 std_96 mean_24 trend"),
    "wi7_sample_quality": (lambda s, d: windows.sample_quality(fx.wide15(s, d), K, T, ["rt", "load", "ru"], ["load"]).select("site", "slot", "hist_ratio", "future_ratio"), "SELECT site, slot, sum((rt IS NOT NULL)::INT + (load IS NOT NULL)::INT + (ru IS NOT NULL)::INT) OVER (PARTITION BY site ORDER BY slot ROWS BETWEEN 191 PRECEDING AND CURRENT ROW) / 576.0 AS hist_ratio, coalesce(sum((load IS NOT NULL)::INT) OVER (PARTITION BY site ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING), 0) / 24.0 AS future_ratio FROM wide\n -- round: hist_ratio future_ratio"),
    "wi8_fill_windows": (lambda s, d: windows.future_arrays(fx.wide15(s, d), K, T, "load").select("site", "slot", windows.fill_window("future").alias("f")).select("site", "slot", F.round(F.col("f")[0], 4).alias("first"), F.round(F.col("f")[11], 4).alias("mid"), F.round(F.col("f")[23], 4).alias("last")), """SELECT site, slot, coalesce(l[1], list_filter(l, lambda x: x IS NOT NULL)[1]) AS first, coalesce(list_filter(l[1:12], lambda x: x IS NOT NULL)[-1], list_filter(l, lambda x: x IS NOT NULL)[1]) AS mid, list_filter(l, lambda x: x IS NOT NULL)[-1] AS last FROM (SELECT site, slot, list(load) OVER (PARTITION BY site ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS l FROM wide) WHERE len(l) = 24
 -- round: first mid last"""),
    "wi9_history_arrays": (lambda s, d: windows.history_arrays(fx.wide15(s, d), K, T, ["rt", "load"]).select("site", "slot", F.aggregate("history", F.lit(0.0), lambda a, r: a + F.coalesce(r[1], F.lit(0.0))).alias("total"), F.col("history")[0][0].alias("oldest")), "SELECT site, slot, total, oldest FROM (SELECT site, slot, coalesce(sum(load) OVER w, 0.0) AS total, first_value(rt) OVER w AS oldest, count(*) OVER w AS n FROM wide WINDOW w AS (PARTITION BY site ORDER BY slot ROWS BETWEEN 191 PRECEDING AND CURRENT ROW)) WHERE n = 192\n -- round: total oldest"),
    "wi10_normalised_path": (lambda s, d: windows.future_arrays(fx.dense15(s, d), K, T, "da").where(~F.exists("future", lambda x: x.isNull())).transform(windows.normalise_paths, "future").select("site", "slot", F.col("future")[0].alias("z1"), F.col("future")[23].alias("z24")), "SELECT site, slot, (a - m) / CASE WHEN s > 1e-6 THEN s ELSE 1.0 END AS z1, (z - m) / CASE WHEN s > 1e-6 THEN s ELSE 1.0 END AS z24 FROM (SELECT site, slot, avg(da) OVER w AS m, stddev_pop(da) OVER w AS s, first_value(da) OVER w AS a, last_value(da) OVER w AS z, count(da) OVER w AS n FROM dense WINDOW w AS (PARTITION BY site ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)) WHERE n = 24\n -- round: z1 z24"),
    "wi11_positions": (lambda s, d: windows.positions(fx.wide15(s, d), K, T).select("site", "slot", "position", "rows"), "SELECT site, slot, CAST(row_number() OVER (PARTITION BY site ORDER BY slot) - 1 AS INTEGER) AS position, count(*) OVER (PARTITION BY site) AS rows FROM wide"),
    "ix1_last_valid": (lambda s, d: index.last_valid_times(fx.wide15(s, d), K, T, ["rt", "da", "load"]), "SELECT site, max(slot) FILTER (rt IS NOT NULL) AS rt, max(slot) FILTER (da IS NOT NULL) AS da, max(slot) FILTER (load IS NOT NULL) AS load FROM wide GROUP BY site"),
    "ix2_cutoff": (lambda s, d: index.cutoff(fx.wide15(s, d), K, T, index.required_columns("rt_chain", ["wind"])).select("site", "cutoff", F.size("skipped").alias("n_skipped")), "SELECT site, least(max(slot) FILTER (rt IS NOT NULL), max(slot) FILTER (da IS NOT NULL), max(slot) FILTER (load IS NOT NULL), max(slot) FILTER (pv IS NOT NULL), max(slot) FILTER (line IS NOT NULL), max(slot)) AS cutoff, CAST(1 AS INTEGER) AS n_skipped FROM wide GROUP BY site"),
    "ix4_decision_index": (lambda s, d: index.decision_index(fx.wide15(s, d), K, T), "SELECT * FROM idx0"),
    "ix5_before_cutoff": (lambda s, d: index.before_cutoff(index.decision_index(fx.wide15(s, d), K, T), index.cutoff(fx.wide15(s, d), K, T, list(fx.TYPES.values())), K), "SELECT * FROM idx1"),
    "ix6_split_by_day": (fx.decisions, "SELECT * FROM idx"),
    "ix7_split_by_rows": (lambda s, d: index.split_by_rows(sparse(s, d), K, T, 5, 6).select("site", "slot", "split"), f"WITH {SPLIT_ROWS} SELECT site, slot, split FROM sr"),
    "ix8_split_ranges": (lambda s, d: index.split_ranges(fx.decisions(s, d), K, "t_dec"), "SELECT site, split, count(*) AS n, min(t_dec) AS first, max(t_dec) AS last FROM idx GROUP BY ALL"),
    "ix9_high_price_weights": (weights, f"WITH {SPLIT_ROWS} SELECT site, slot, split, segment, da, CASE WHEN segment = 2 AND da >= thr THEN 1.5 ELSE 1.0 END AS weight FROM sr LEFT JOIN (SELECT site AS s2, quantile_cont(da, 0.85) AS thr FROM sr WHERE split = 'train' AND segment = 2 GROUP BY 1) ON site = s2\n -- round: da weight"),
    "ix10_last_decision": (lambda s, d: index.last_decision(fx.decisions(s, d), K), "SELECT site, max(t_dec) AS t_dec FROM idx GROUP BY site"),
    "jo1_previous_day_stats": (lambda s, d: lookups.previous_day_stats(fx.dense15(s, d), K, T, "da").drop(*[c for c in fx.COLUMNS if c != "da"]), f"WITH {DAYS} SELECT dense.site AS site, CAST(slot AS DATE) AS date, slot, da, ds.* EXCLUDE (site, date) FROM dense JOIN ds ON ds.site = dense.site AND ds.date + 1 = CAST(slot AS DATE)\n -- round: da {DAY_DOUBLES}"),
    "jo2_same_slot_by_user": (lambda s, d: lookups.same_slot_before(fx.by_user(s, d), ["user_id"], T, "value"), "SELECT a.user_id AS user_id, a.slot AS slot, a.value AS value, b.value AS value_d1 FROM us a LEFT JOIN us b ON b.user_id = a.user_id AND b.slot = a.slot - INTERVAL 1 DAY\n -- round: value value_d1"),
    "jo3_as_of_daily_by_user": (lambda s, d: lookups.as_of_daily(fx.by_user(s, d), ["user_id"], T, "value").select("user_id", "date", "last"), """SELECT user_id, date, last FROM (SELECT w.user_id AS user_id, CAST(w.day + INTERVAL 1 DAY AS DATE) AS date, u.value AS last, row_number() OVER (PARTITION BY w.user_id, w.day ORDER BY u.slot DESC) AS k
 FROM (SELECT DISTINCT user_id, CAST(slot AS DATE) AS day FROM us) w JOIN us u ON u.user_id = w.user_id AND u.slot <= w.day + INTERVAL 9 HOUR) WHERE k = 1\n -- round: last"""),
    "jo2_same_slot_before": (lambda s, d: lookups.same_slot_before(sparse(s, d), K, T, "da").select("site", "slot", "da", "da_d1"), f"WITH {SPARSE} SELECT a.site AS site, a.slot AS slot, a.da AS da, b.da AS da_d1 FROM sparse a LEFT JOIN sparse b ON b.site = a.site AND b.slot = a.slot - INTERVAL 1 DAY\n -- round: da da_d1"),
    "jo3_as_of_daily": (lambda s, d: lookups.as_of_daily(fx.wide15(s, d), K, T, "load"), f"WITH {ASOF} SELECT * FROM aj\n -- round: last mean_96 std_96 mean_24 trend"),
    "jo4_previous_day_means": (lambda s, d: lookups.previous_day_means(sparse(s, d), K, T, "da"), f"WITH {SPARSE}, {PREV} SELECT * FROM pm\n -- round: prev_mean prev_mean_3d prev_mean_7d d7_mean"),
    "jo5_week_before": (lambda s, d: lookups.previous_day_means(sparse(s, d), K, T, "da").where("d7_mean is not null").select("site", "date", "d7_mean"), f"WITH {SPARSE}, {PREV} SELECT site, date, d7_mean FROM pm WHERE d7_mean IS NOT NULL\n -- round: d7_mean"),
    "jo6_future_values": (lambda s, d: lookups.future_values(fx.decisions(s, d).select("site", "t_dec"), fx.dense15(s, d), K, T, "load"), "SELECT site, t_dec, h, tgt_time, y FROM fc\n -- round: y"),
    "jo6_future_by_offsets": (lambda s, d: lookups.future_with_lag(fx.dense15(s, d), K, T, "load").where("y is not null").select("site", "t_dec", "h", "tgt_time", "y", "base"), "SELECT a.site AS site, a.slot AS t_dec, CAST(h AS INTEGER) AS h, b.slot AS tgt_time, b.load AS y, p.load AS base FROM dense a, range(1, 25) t(h) JOIN dense b ON b.site = a.site AND b.slot = a.slot + h * INTERVAL 15 MINUTE LEFT JOIN dense p ON p.site = a.site AND p.slot = b.slot - INTERVAL 1 DAY WHERE b.load IS NOT NULL\n -- round: y base"),
    "jo7_target_lag": (fx.forecasts, "SELECT * FROM fc\n -- round: y base"),
    "jo9_train_rows": (lambda s, d: lookups.train_rows(fx.forecasts(s, d).drop("split"), fx.decisions(s, d), K).groupBy("site", "h").agg(F.count("*").alias("n")), "SELECT site, h, count(*) AS n FROM fc WHERE split = 'train' GROUP BY ALL"),
    "jo10_keep_days": (lambda s, d: lookups.keep_days(index.decision_index(fx.wide15(s, d), K, T), fx.decisions(s, d).select("site", "date_tgt_max").distinct(), K, "date_tgt_max"), "SELECT idx0.* FROM idx0 SEMI JOIN dd ON dd.site = idx0.site AND dd.date_tgt_max = idx0.date_tgt_max"),
    "md1_scalers": (scaled, f"WITH {SCALERS} SELECT * FROM sc\n -- round: mean std"),
    "md2_delta_scaler": (lambda s, d: scale.fit_delta_scaler(fx.forecasts(s, d), K), "SELECT site, coalesce(avg(y - base), 0.0) AS mu, CASE WHEN stddev_pop(y - base) > 1e-8 THEN stddev_pop(y - base) ELSE 1.0 END AS sd FROM fc WHERE split = 'train' GROUP BY site\n -- round: mu sd"),
    "md3_apply_scalers": (lambda s, d: scale.apply_scalers(fx.dense15(s, d).select("site", "slot", "rt", "load").unpivot(["site", "slot"], ["rt", "load"], "var", "z"), scaled(s, d), K, "z"), f"WITH {SCALERS} SELECT site, slot, var, (v - mean) / std AS z FROM (SELECT site, slot, unnest(['rt','load']) AS var, unnest([rt, load]) AS v FROM dense) JOIN sc USING (site, var)\n -- round: z"),
    "md4_day_ahead_table": (day_ahead, f"""WITH {DAYS}, sparse AS (SELECT * FROM dense), {PREV}, {ASOF.replace('load', 'rt').replace('FROM wide', 'FROM dense')} SELECT d.site AS site, d.slot AS slot, CAST(hour(d.slot) // 8 AS INTEGER) AS segment, d.da AS y, s.da AS same_slot_d1, sin(2 * pi() * hour(d.slot) / 24) AS hour_sin, d.load AS x_load, d_mean, b2_std, prev_mean_3d, d7_mean, last AS rt_last, mean_96 AS rt_mean_96, trend AS rt_trend
 FROM dense d JOIN ds ON ds.site = d.site AND ds.date + 1 = CAST(d.slot AS DATE) LEFT JOIN pm ON pm.site = d.site AND pm.date = CAST(d.slot AS DATE) LEFT JOIN aj ON aj.site = d.site AND aj.date = CAST(d.slot AS DATE) LEFT JOIN dense s ON s.site = d.site AND s.slot = d.slot - INTERVAL 1 DAY WHERE d.da IS NOT NULL
 -- round: y same_slot_d1 hour_sin x_load d_mean b2_std prev_mean_3d d7_mean rt_last rt_mean_96 rt_trend"""),
}
