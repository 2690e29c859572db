"""Queries of reading, schema, cleaning and audit operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridseries.functions import calendar, schema
from gridseries.operators import audit, clean, index
from gridseries.sources import fixtures as fx
from gridseries.sources import tables

K, T, C = fx.KEYS, "slot", fx.COLUMNS


def flagship(s, d):
    """Floor, keep last, full grid, daily coverage of each event type and site."""
    slots = fx.slots(s, d)
    full = clean.on_grid(slots, ["site", "event_type"], T)
    return audit.daily_coverage(full, ["site", "event_type"], T, ["value"]).drop("col")


def dirty(s, d):
    """Text times and values made of event columns, some of them broken, by row number rules."""
    e = fx.table(s, d, "events")
    i = F.col("event_id")
    ts = F.when(i % 11 == 0, "junk").when(i % 13 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    v = F.when(i % 7 == 0, "abc").when(i % 17 == 0, "NaN").when(i % 19 == 0, "inf").when(i % 5 == 0, "").otherwise(F.concat(F.lit(" "), (i % 1000).cast("string"), F.lit(".5")))
    return e.select("event_id", (F.col("user_id") % 4).alias("site"), ts.alias("ts_text"), v.alias("v_text"))


DIRTY = """dirty AS (SELECT event_id, user_id % 4 AS site, CASE WHEN event_id % 11 = 0 THEN 'junk' WHEN event_id % 13 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_text,
 CASE WHEN event_id % 7 = 0 THEN 'abc' WHEN event_id % 17 = 0 THEN 'NaN' WHEN event_id % 19 = 0 THEN 'inf' WHEN event_id % 5 = 0 THEN '' ELSE ' ' || (event_id % 1000) || '.5' END AS v_text FROM events)"""
LONG = """long AS (SELECT site, slot, rn, n, unnest(['rt','da','load','pv','line','ru','rd']) AS col, unnest([rt,da,load,pv,line,ru,rd]) AS value
 FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY slot) AS rn, count(*) OVER (PARTITION BY site) AS n FROM wide))"""
BLOCKS = """blocks AS (SELECT site, col, min(slot) AS start_time, max(slot) AS end_time, count(*) AS length FROM
 (SELECT *, rn - row_number() OVER (PARTITION BY site, col ORDER BY slot) AS isl FROM long WHERE value IS NULL) GROUP BY site, col, isl HAVING count(*) >= 4)"""


def names(s, d):
    """Header-like names, an actual and a forecast for part brands, in four spellings; brands of type SMALL lack a forecast."""
    p = fx.table(s, d, "part")
    i = F.col("p_partkey")
    tail = F.when(i % 4 == 0, "实际值").when(i % 4 == 1, "预测值").when(i % 4 == 2, " 实际").otherwise("预测")
    return p.select(F.concat("p_brand", tail).alias("name"), i.alias("position"))


NAMES = """names AS (SELECT p_brand || CASE p_partkey % 4 WHEN 0 THEN '实际值' WHEN 1 THEN '预测值' WHEN 2 THEN ' 实际' ELSE '预测' END AS name, p_partkey AS position, p_partkey % 4 AS k, p_brand FROM part)"""


def time_axis(s, d):
    raw = clean.parse_time(dirty(s, d), "ts_text", drop=False)
    return audit.time_axis_report(raw, K, "ts").select("site", "n_rows", "n_parsed", "n_slots", "n_duplicates", "time_min", "time_max", "n_expected", "n_missing", "n_extra", "n_gaps", F.array_join("missing_head", ",").alias("head"), F.array_join("missing_tail", ",").alias("tail"))


def summary(s, d):
    return audit.column_summary(fx.wide15(s, d), K, T, C)


def long_rows(s, d):
    """The rows that are written one folder for each variable."""
    return audit.long_form(fx.wide15(s, d), K, T, C)


HEADERS = {"rt": "实时出清电价", "da": "日前出清电价", "load": "系统负荷实际值", "pv": "光伏实际值", "line": "联络线实际值", "ru": "上旋备用实际值", "rd": "下旋备用实际值"}


def with_headers(s, d, longer=""):
    """`wide15` under the headers that users' tables have."""
    w = fx.wide15(s, d)
    return w.select("site", F.col(T).alias("时间"), *[F.col(c).alias(h + longer) for c, h in HEADERS.items()])


def resolved_column(s, d):
    """Headers that hold a candidate as a part."""
    w = with_headers(s, d, " (MW)")
    return w.select("site", F.col("时间").alias("slot"), F.col(f"`{schema.resolve_column(w.columns, ['负荷', '系统负荷实际值'])}`").alias("load"))


def resolved_time(s, d):
    w = with_headers(s, d).withColumnRenamed("时间", "记录日期")
    return w.groupBy("site").agg(F.max(f"`{schema.resolve_time_column(w.columns)}`").alias("last"))


def resolved_fields(s, d):
    w = with_headers(s, d)
    found = schema.resolve_fields(w.columns, "real_time")
    return schema.select_fields(w, {"site": "site", **found}).withColumnRenamed("time", "slot")


def round_trip(write, read):
    """What is read back of what was written to a scratch folder."""

    def run(s, d):
        folder = fx.scratch(s)
        write(s, d, folder)
        return read(s, folder)

    return run


def overall(s, d):
    return audit.daily_overall(audit.daily_coverage(fx.wide15(s, d), K, T, C), K)


def modes(s, d):
    w = fx.wide15(s, d)
    parts = [index.cutoff(w, K, T, index.required_columns(m)).select("site", F.lit(m).alias("mode"), "cutoff", F.size("skipped").alias("skipped")) for m in ("rt_chain", "exog_only")]
    return parts[0].unionByName(parts[1])


def strict(s, d):
    report = audit.time_axis_report(fx.wide15(s, d).select("site", F.col(T).alias("ts")), K, "ts")
    audit.require_complete(report)
    return report.select("site", "n_rows", "n_missing", "n_gaps")


def by_user_axis(s, d):
    return audit.time_axis_report(fx.table(s, d, "events").select("user_id", "ts"), ["user_id"], "ts").select("user_id", "n_rows", "n_slots", "n_duplicates", "time_min", "time_max", "n_expected", "n_missing", "n_extra", "n_gaps", F.array_join("missing_head", ",").alias("head"), F.array_join("missing_tail", ",").alias("tail"))


def written_times(s, d):
    """Times of events as texts in many spellings, some of them no time."""
    e = fx.table(s, d, "events")
    shapes = ["yyyy/M/d H:mm", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd HH:mm", "yyyyMMddHHmmss", "yyyy'年'M'月'd'日' H:mm", "yyyy'年'M'月'd'日'H'时'm'分'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy.M.d HH:mm", "dd.MM.yyyy HH:mm"]
    text = F.lit("2024/13/45 99:99")
    for i, shape in enumerate(shapes):
        text = F.when(F.col("event_id") % 11 == i, F.date_format("ts", shape)).otherwise(text)
    return e.select("event_id", F.when(F.col("event_id") % 11 != 10, text).alias("text"))


TO_MINUTE = "date_trunc('minute', ts)"
GAPS = """lg AS (SELECT user_id, slot, lag(slot) OVER (PARTITION BY user_id ORDER BY slot) AS prev FROM (SELECT DISTINCT user_id, slot FROM us)),
 gp AS (SELECT user_id, prev + INTERVAL 15 MINUTE AS a, slot - INTERVAL 15 MINUTE AS b, row_number() OVER (PARTITION BY user_id ORDER BY slot) AS h, row_number() OVER (PARTITION BY user_id ORDER BY slot DESC) AS t FROM lg WHERE slot - prev > INTERVAL 15 MINUTE),
 hd AS (SELECT * FROM (SELECT user_id, slot, row_number() OVER (PARTITION BY user_id ORDER BY slot) AS k FROM (SELECT user_id, unnest(generate_series(a, least(b, a + INTERVAL 135 MINUTE), INTERVAL 15 MINUTE)) AS slot FROM gp WHERE h <= 10)) WHERE k <= 10),
 tl AS (SELECT * FROM (SELECT user_id, slot, row_number() OVER (PARTITION BY user_id ORDER BY slot DESC) AS k FROM (SELECT user_id, unnest(generate_series(greatest(a, b - INTERVAL 135 MINUTE), b, INTERVAL 15 MINUTE)) AS slot FROM gp WHERE t <= 10)) WHERE k <= 10)"""


QUERIES = {
    "flagship_daily_coverage": (flagship, f"""SELECT site, event_type, CAST(slot AS DATE) AS date, avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) AS ratio
 FROM (SELECT site, event_type, unnest(generate_series(a, b, INTERVAL '15 minutes')) AS slot FROM (SELECT site, event_type, min(slot) AS a, max(slot) AS b FROM sl GROUP BY 1, 2)) LEFT JOIN sl USING (site, event_type, slot) GROUP BY ALL
 -- round: ratio"""),
    "io1_read_wide_table": (fx.wide15, "SELECT * FROM wide"),
    "io3_long_rows": (long_rows, f"WITH {LONG} SELECT site, slot, col, value FROM long"),
    "io1_read_csv": (round_trip(lambda s, d, at: fx.wide15(s, d).write.option("header", True).csv(at), lambda s, at: tables.read_table(s, at, "csv", "site long, slot timestamp_ntz, rt double, da double, load double, pv double, line double, ru double, rd double")), "SELECT * FROM wide"),
    "io2_write_parquet": (round_trip(lambda s, d, at: tables.write_parquet(fx.wide15(s, d), at, ["site"]), lambda s, at: tables.read_table(s, at).withColumn("site", F.col("site").cast("long"))), "SELECT * FROM wide"),
    "io3_write_forecasts": (round_trip(lambda s, d, at: tables.write_forecasts(long_rows(s, d).withColumnRenamed("col", "var"), at), lambda s, at: tables.read_table(s, at)), f"WITH {LONG} SELECT site, slot, col AS var, value FROM long"),
    "io4_report_csv": (round_trip(lambda s, d, at: tables.write_report_csv(overall(s, d), at), lambda s, at: tables.read_table(s, at, "csv", "site long, date date, min_ratio double, mean_ratio double, cols_with_any_missing long, cols_all_missing long")), None),
    "io5_report_json": (round_trip(lambda s, d, at: tables.write_report_json(strict(s, d).select("site", F.struct(*tables.report(rows=F.col("n_rows"), gaps={"missing": F.col("n_missing"), "gaps": F.col("n_gaps")})).alias("r")), at), lambda s, at: tables.read_table(s, at, "json", "site long, r struct<rows:long,gaps:struct<missing:long,gaps:long>>").select("site", "r.rows", "r.gaps.missing", "r.gaps.gaps")), "SELECT site, count(*) AS rows, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS gaps FROM wide GROUP BY site"),
    "sc1_resolve_column": (resolved_column, "SELECT site, slot, load FROM wide"),
    "sc2_time_column": (resolved_time, "SELECT site, max(slot) AS last FROM wide GROUP BY site"),
    "sc3_resolve_fields": (resolved_fields, "SELECT site, slot, rt, da, load, pv, line, ru, rd FROM wide"),
    "ix3_required_modes": (modes, "WITH l AS (SELECT site, max(slot) FILTER (rt IS NOT NULL) AS rt, max(slot) FILTER (da IS NOT NULL) AS da, least(max(slot) FILTER (load IS NOT NULL), max(slot) FILTER (pv IS NOT NULL), max(slot) FILTER (line IS NOT NULL), max(slot)) AS x FROM wide GROUP BY site) SELECT site, 'rt_chain' AS mode, least(rt, da, x) AS cutoff, CAST(0 AS INTEGER) AS skipped FROM l UNION ALL SELECT site, 'exog_only', x, 0 FROM l"),
    "au6_strict_mode": (strict, "SELECT site, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_gaps FROM wide GROUP BY site"),
    "sc4_base_names": (lambda s, d: names(s, d).select("name", schema.base_name(F.col("name")).alias("base"), schema.name_kind(F.col("name")).alias("kind")).distinct(), f"WITH {NAMES} SELECT DISTINCT name, p_brand AS base, CASE WHEN k % 2 = 0 THEN 'actual' ELSE 'forecast' END AS kind FROM names"),
    "sc5_column_pairs": (lambda s, d: schema.column_pairs(names(s, d)), f"WITH {NAMES} SELECT p_brand AS base, arg_max(name, position) FILTER (k % 2 = 0) AS actual_col, arg_max(name, position) FILTER (k % 2 = 1) AS forecast_col FROM names GROUP BY p_brand HAVING count(*) FILTER (k % 2 = 0) > 0 AND count(*) FILTER (k % 2 = 1) > 0"),
    "sc6_exogenous_choice": (lambda s, d: fx.wide15(s, d).select("site", "slot", F.col(schema.choose_exogenous(C, "load_fcst", "load")).alias("x_load"), F.col(schema.choose_exogenous(C, "pv", "rd")).alias("x_pv")), "SELECT site, slot, load AS x_load, pv AS x_pv FROM wide"),
    "cl1_parse_time": (lambda s, d: clean.parse_time(dirty(s, d), "ts_text").select("event_id", "ts"), f"WITH {DIRTY} SELECT event_id, TRY_CAST(ts_text AS TIMESTAMP) AS ts FROM dirty WHERE TRY_CAST(ts_text AS TIMESTAMP) IS NOT NULL"),
    "cl1_time_formats": (lambda s, d: clean.parse_time(written_times(s, d), "text", drop=False).select("event_id", "text", "ts"), f"""SELECT event_id, CASE event_id % 11 WHEN 0 THEN strftime(ts, '%Y/%-m/%-d %-H:%M') WHEN 1 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y%m%d %H:%M') WHEN 3 THEN strftime(ts, '%Y%m%d%H%M%S')
 WHEN 4 THEN strftime(ts, '%Y年%-m月%-d日 %-H:%M') WHEN 5 THEN strftime(ts, '%Y年%-m月%-d日%-H时%-M分') WHEN 6 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 7 THEN strftime(ts, '%Y.%-m.%-d %H:%M') WHEN 8 THEN strftime(ts, '%d.%m.%Y %H:%M') WHEN 9 THEN '2024/13/45 99:99' END AS text,
 CASE WHEN event_id % 11 IN (1, 3, 6) THEN date_trunc('second', ts) WHEN event_id % 11 < 9 THEN {TO_MINUTE} END AS ts FROM events"""),
    "cl1_rejected_times": (lambda s, d: clean.rejected_times(clean.parse_time(written_times(s, d).withColumn("site", F.col("event_id") % 4), "text", drop=False), K, "text", "ts"), "SELECT event_id % 4 AS site, count(*) FILTER (event_id % 11 = 10) AS n_no_time, count(*) FILTER (event_id % 11 = 9) AS n_rejected, max(CASE WHEN event_id % 11 = 9 THEN '2024/13/45 99:99' END) AS rejected_first, max(CASE WHEN event_id % 11 = 9 THEN '2024/13/45 99:99' END) AS rejected_last FROM events GROUP BY 1"),
    "cl2_floor_time": (lambda s, d: fx.observations(s, d).select("event_id", "slot"), "SELECT event_id, slot FROM ev"),
    "cl3_keep_last": (fx.slots, "SELECT * FROM sl"),
    "cl3_keep_last_by_user": (fx.by_user, "SELECT * FROM us"),
    "cl6_irregular_steps_by_user": (lambda s, d: clean.irregular_steps(fx.by_user(s, d), ["user_id"], T), "SELECT user_id, count(*) FILTER (slot - prev <> INTERVAL '15 minutes') AS irregular FROM (SELECT *, lag(slot) OVER (PARTITION BY user_id ORDER BY slot) AS prev FROM us) GROUP BY user_id"),
    "au5_gap_counts_by_user": (lambda s, d: audit.gap_counts(fx.by_user(s, d), ["user_id"], T), "SELECT user_id, count(*) FILTER (slot - prev > INTERVAL '15 minutes') AS n_gaps FROM (SELECT *, lag(slot) OVER (PARTITION BY user_id ORDER BY slot) AS prev FROM us) GROUP BY user_id"),
    "cl4_to_number": (lambda s, d: dirty(s, d).select("event_id", clean.finite_or_null(clean.to_number(F.col("v_text"))).alias("v")), f"WITH {DIRTY} SELECT event_id, CASE WHEN isfinite(TRY_CAST(trim(v_text) AS DOUBLE)) THEN TRY_CAST(trim(v_text) AS DOUBLE) END AS v FROM dirty"),
    "cl5_value_classes": (lambda s, d: dirty(s, d).groupBy("site", clean.value_class(clean.to_number(F.col("v_text"))).alias("class")).agg(F.count("*").alias("n")), f"WITH {DIRTY} SELECT site, CASE WHEN v IS NULL OR isnan(v) THEN 'nan' WHEN isinf(v) THEN 'inf' ELSE 'finite' END AS class, count(*) AS n FROM (SELECT site, TRY_CAST(trim(v_text) AS DOUBLE) AS v FROM dirty) GROUP BY ALL"),
    "cl6_irregular_steps": (lambda s, d: clean.irregular_steps(fx.slots(s, d), ["site", "event_type"], T), "SELECT site, event_type, count(*) FILTER (slot - prev <> INTERVAL '15 minutes') AS irregular FROM (SELECT *, lag(slot) OVER (PARTITION BY site, event_type ORDER BY slot) AS prev FROM sl) GROUP BY ALL"),
    "cl7_on_grid": (lambda s, d: clean.on_grid(fx.slots(s, d).where("event_type = 'click'").drop("event_type"), K, T), "SELECT site, slot, value FROM (SELECT site, unnest(generate_series(a, b, INTERVAL '15 minutes')) AS slot FROM (SELECT site, min(slot) AS a, max(slot) AS b FROM sl WHERE event_type = 'click' GROUP BY site)) LEFT JOIN (SELECT site, slot, value FROM sl WHERE event_type = 'click') USING (site, slot)"),
    "cl7_filled_in_buckets": (lambda s, d: clean.fill_forward(fx.wide15(s, d), K, T, C, 7), "SELECT * FROM dense\n -- round: rt da load pv line"),
    "cl8_missing_counts": (lambda s, d: clean.missing_counts(fx.wide15(s, d), C), "SELECT col, count(*) FILTER (value IS NULL) AS missing FROM (SELECT unnest(['rt','da','load','pv','line','ru','rd']) AS col, unnest([rt,da,load,pv,line,ru,rd]) AS value FROM wide) GROUP BY col"),
    "cl9_finite_target": (lambda s, d: clean.finite_target(fx.wide15(s, d), "da").select("site", "slot", "da"), "SELECT site, slot, da FROM wide WHERE da IS NOT NULL"),
    "cl10_segments": (lambda s, d: fx.wide15(s, d).groupBy("site", calendar.segment(F.col("slot")).alias("segment")).agg(F.count("*").alias("n")), "SELECT site, CAST(hour(slot) // 8 AS INTEGER) AS segment, count(*) AS n FROM wide GROUP BY ALL"),
    "au1_time_axis_report": (time_axis, f"""WITH {DIRTY}, r AS (SELECT site, TRY_CAST(ts_text AS TIMESTAMP) AS ts, time_bucket(INTERVAL '15 minutes', TRY_CAST(ts_text AS TIMESTAMP)) AS slot FROM dirty),
 a AS (SELECT site, count(*) AS n_rows, count(ts) AS n_parsed, count(DISTINCT slot) AS n_slots, min(slot) AS time_min, max(slot) AS time_max FROM r GROUP BY site),
 p AS (SELECT DISTINCT site, slot FROM r WHERE slot IS NOT NULL), m AS (SELECT site, unnest(generate_series(time_min, time_max, INTERVAL '15 minutes')) AS slot FROM a),
 g AS (SELECT site, slot, row_number() OVER (PARTITION BY site ORDER BY slot) AS h, row_number() OVER (PARTITION BY site ORDER BY slot DESC) AS t FROM (SELECT * FROM m EXCEPT SELECT * FROM p)),
 s AS (SELECT site, string_agg(strftime(slot, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY slot) FILTER (h <= 10) AS head, string_agg(strftime(slot, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY slot) FILTER (t <= 10) AS tail FROM g GROUP BY site),
 q AS (SELECT site, count(*) FILTER (slot - prev > INTERVAL '15 minutes') AS n_gaps FROM (SELECT *, lag(slot) OVER (PARTITION BY site ORDER BY slot) AS prev FROM p) GROUP BY site)
 SELECT site, n_rows, n_parsed, n_slots, n_parsed - n_slots AS n_duplicates, time_min, time_max, CAST(date_diff('minute', time_min, time_max) // 15 + 1 AS BIGINT) AS n_expected, CAST(date_diff('minute', time_min, time_max) // 15 + 1 - n_slots AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_extra, n_gaps, coalesce(head, '') AS head, coalesce(tail, '') AS tail FROM a JOIN q USING (site) LEFT JOIN s USING (site)"""),
    "au2_missing_slots": (lambda s, d: audit.missing_slots(fx.slots(s, d), ["site", "event_type"], T), "SELECT site, event_type, unnest(generate_series(a, b, INTERVAL '15 minutes')) AS slot FROM (SELECT site, event_type, min(slot) AS a, max(slot) AS b FROM sl GROUP BY 1, 2) EXCEPT SELECT site, event_type, slot FROM sl"),
    "au3_extra_slots": (lambda s, d: audit.extra_slots(fx.observations(s, d).select("site", "ts").distinct(), K, "ts", 60).groupBy("site").agg(F.count("*").alias("n")), "SELECT site, count(*) AS n FROM (SELECT DISTINCT site, ts FROM ev) x JOIN (SELECT site AS s2, min(ts) AS a FROM ev GROUP BY 1) ON site = s2 WHERE epoch_us(ts) % 3600000000 <> epoch_us(a) % 3600000000 GROUP BY site"),
    "au4_missing_samples": (lambda s, d: audit.missing_samples(fx.slots(s, d).where("event_type = 'view'"), K, T), "SELECT * FROM (SELECT site, slot, CAST(row_number() OVER (PARTITION BY site ORDER BY slot) AS INTEGER) AS rank, 'head' AS \"end\" FROM (SELECT * FROM (SELECT site, unnest(generate_series(a, b, INTERVAL '15 minutes')) AS slot FROM (SELECT site, min(slot) AS a, max(slot) AS b FROM sl WHERE event_type = 'view' GROUP BY 1)) EXCEPT SELECT site, slot FROM sl WHERE event_type = 'view') UNION ALL SELECT site, slot, CAST(row_number() OVER (PARTITION BY site ORDER BY slot DESC) AS INTEGER) AS rank, 'tail' FROM (SELECT * FROM (SELECT site, unnest(generate_series(a, b, INTERVAL '15 minutes')) AS slot FROM (SELECT site, min(slot) AS a, max(slot) AS b FROM sl WHERE event_type = 'view' GROUP BY 1)) EXCEPT SELECT site, slot FROM sl WHERE event_type = 'view')) WHERE rank <= 10"),
    "au1_time_axis_by_user": (by_user_axis, f"""WITH {GAPS}, a AS (SELECT user_id, count(*) AS n_rows, count(DISTINCT slot) AS n_slots, min(slot) AS time_min, max(slot) AS time_max FROM ev GROUP BY user_id)
 SELECT user_id, n_rows, n_slots, n_rows - n_slots AS n_duplicates, time_min, time_max, CAST(date_diff('minute', time_min, time_max) // 15 + 1 AS BIGINT) AS n_expected, CAST(date_diff('minute', time_min, time_max) // 15 + 1 - n_slots AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_extra,
 coalesce(n, 0) AS n_gaps, coalesce(head, '') AS head, coalesce(tail, '') AS tail FROM a LEFT JOIN (SELECT user_id, count(*) AS n FROM gp GROUP BY user_id) USING (user_id)
 LEFT JOIN (SELECT user_id, string_agg(strftime(slot, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY slot) AS head FROM hd GROUP BY user_id) USING (user_id) LEFT JOIN (SELECT user_id, string_agg(strftime(slot, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY slot) AS tail FROM tl GROUP BY user_id) USING (user_id)"""),
    "au2_gaps_by_user": (lambda s, d: audit.gaps(fx.by_user(s, d), ["user_id"], T).withColumnsRenamed({"first": "gap_start", "last": "gap_end"}), f"WITH {GAPS} SELECT user_id, a AS gap_start, b AS gap_end, CAST(date_diff('minute', a, b) // 15 + 1 AS BIGINT) AS n FROM gp"),
    "au4_missing_samples_by_user": (lambda s, d: audit.missing_samples(fx.by_user(s, d), ["user_id"], T), f"WITH {GAPS} SELECT user_id, slot, CAST(k AS INTEGER) AS rank, 'head' AS \"end\" FROM hd UNION ALL SELECT user_id, slot, CAST(k AS INTEGER), 'tail' FROM tl"),
    "au4_missing_samples_by_type": (lambda s, d: audit.missing_samples(fx.slots(s, d), ["site", "event_type"], T), """WITH g AS (SELECT site, event_type, unnest(generate_series(a, b, INTERVAL '15 minutes')) AS slot FROM (SELECT site, event_type, min(slot) AS a, max(slot) AS b FROM sl GROUP BY ALL)), m AS (SELECT * FROM g EXCEPT SELECT site, event_type, slot FROM sl),
 r AS (SELECT *, row_number() OVER (PARTITION BY site, event_type ORDER BY slot) AS h, row_number() OVER (PARTITION BY site, event_type ORDER BY slot DESC) AS t FROM m) SELECT site, event_type, slot, CAST(h AS INTEGER) AS rank, 'head' AS "end" FROM r WHERE h <= 10 UNION ALL SELECT site, event_type, slot, CAST(t AS INTEGER), 'tail' FROM r WHERE t <= 10"""),
    "cl7_on_grid_by_type": (lambda s, d: clean.on_grid(fx.slots(s, d), ["site", "event_type"], T), "SELECT site, event_type, slot, value FROM (SELECT site, event_type, unnest(generate_series(a, b, INTERVAL '15 minutes')) AS slot FROM (SELECT site, event_type, min(slot) AS a, max(slot) AS b FROM sl GROUP BY ALL)) LEFT JOIN sl USING (site, event_type, slot)"),
    "au5_gap_counts": (lambda s, d: audit.gap_counts(fx.slots(s, d), ["site", "event_type"], T), "SELECT site, event_type, count(*) FILTER (slot - prev > INTERVAL '15 minutes') AS n_gaps FROM (SELECT *, lag(slot) OVER (PARTITION BY site, event_type ORDER BY slot) AS prev FROM sl) GROUP BY ALL"),
    "au7_column_summary": (summary, f"""WITH {LONG}, {BLOCKS} SELECT site, col, count(*) AS total, count(value) AS finite_cnt, count(*) - count(value) AS nan_cnt, count(*) - count(value) AS nonfinite_cnt, min(slot) FILTER (value IS NOT NULL) AS first_valid_time, max(slot) FILTER (value IS NOT NULL) AS last_valid_time,
 coalesce(min(rn) FILTER (value IS NOT NULL) - 1, max(n)) AS leading_missing, coalesce(max(n) - max(rn) FILTER (value IS NOT NULL), max(n)) AS trailing_missing, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std, count(value) / count(*) AS finite_ratio,
 coalesce(any_value(b.n_blocks), 0) AS n_blocks, coalesce(any_value(b.longest), 0) AS longest_block FROM long LEFT JOIN (SELECT site, col, count(*) AS n_blocks, max(length) AS longest FROM blocks GROUP BY ALL) b USING (site, col) GROUP BY site, col
 -- round: min max mean std finite_ratio"""),
    "au10_missing_blocks": (lambda s, d: audit.missing_blocks(fx.wide15(s, d), K, T, C), f"WITH {LONG}, {BLOCKS} SELECT * FROM blocks"),
    "au10_blocks_in_buckets": (lambda s, d: audit.missing_blocks(fx.wide15(s, d), K, T, C, days=7), f"WITH {LONG}, {BLOCKS} SELECT * FROM blocks"),
    "au13_worst_columns": (lambda s, d: audit.worst_columns(summary(s, d)).select("col", "finite_ratio"), f"WITH {LONG} SELECT col, count(value) / count(*) AS finite_ratio FROM long GROUP BY site, col ORDER BY finite_ratio, col LIMIT 15\n -- round: finite_ratio"),
    "au14_daily_coverage": (lambda s, d: audit.daily_coverage(fx.wide15(s, d), K, T, C), f"WITH {LONG} SELECT site, CAST(slot AS DATE) AS date, col, count(value) / count(*) AS ratio FROM long GROUP BY ALL\n -- round: ratio"),
    "au15_daily_coverage_wide": (lambda s, d: audit.daily_coverage_wide(audit.daily_coverage(fx.wide15(s, d), K, T, C), K, C), "SELECT site, CAST(slot AS DATE) AS date, count(rt) / count(*) AS rt, count(da) / count(*) AS da, count(load) / count(*) AS load, count(pv) / count(*) AS pv, count(line) / count(*) AS line, count(ru) / count(*) AS ru, count(rd) / count(*) AS rd FROM wide GROUP BY ALL\n -- round: rt da load pv line ru rd"),
    "au16_daily_overall": (lambda s, d: audit.daily_overall(audit.daily_coverage(fx.wide15(s, d), K, T, C), K), f"WITH {LONG} SELECT site, date, min(ratio) AS min_ratio, avg(ratio) AS mean_ratio, count(*) FILTER (ratio < 1) AS cols_with_any_missing, count(*) FILTER (ratio = 0) AS cols_all_missing FROM (SELECT site, CAST(slot AS DATE) AS date, col, count(value) / count(*) AS ratio FROM long GROUP BY ALL) GROUP BY ALL\n -- round: min_ratio mean_ratio"),
    "sf6_file_stems": (lambda s, d: names(s, d).select("position", calendar.file_stem(F.concat(F.lit(" a/b:"), "name", F.lit(" ?x_ "))).alias("stem")), f"WITH {NAMES} SELECT position, 'a_b_' || regexp_replace(name, ' +', '_', 'g') || '_x' AS stem FROM names"),
}
QUERIES["io4_report_csv"] = (QUERIES["io4_report_csv"][0], QUERIES["au16_daily_overall"][1])
