"""Cleaning and audit on hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridseries.functions import calendar, schema
from gridseries.operators import audit, clean

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def frame(spark, rows, schema_text):
    return spark.createDataFrame(rows, schema_text)


def series(spark, slots, values=None):
    values = values if values is not None else [1.0] * len(slots)
    return frame(spark, [("a", at(15 * s), v) for s, v in zip(slots, values)], "k string, slot timestamp_ntz, v double")


def test_keep_last_floors_before_it_chooses(spark):
    rows = [("a", at(16), 2, 5.0), ("a", at(29), 1, 7.0), ("a", at(29), 3, 8.0), ("a", at(31), 0, None), ("a", None, 9, 1.0)]
    df = frame(spark, rows, "k string, ts timestamp_ntz, seq int, v double")
    got = {r["slot"]: r["v"] for r in clean.regular_slots(df, ["k"], "ts", ["seq"]).collect()}
    assert got == {at(15): 8.0, at(30): None}


def test_keep_last_is_independent_of_partitions(spark):
    rows = [("a", at(i % 60), i, float(i)) for i in range(200)]
    df = frame(spark, rows, "k string, ts timestamp_ntz, seq int, v double")
    one = sorted(map(tuple, clean.regular_slots(df.coalesce(1), ["k"], "ts", ["seq"]).collect()))
    assert one == sorted(map(tuple, clean.regular_slots(df.repartition(7), ["k"], "ts", ["seq"]).collect()))


def test_numbers_and_classes(spark):
    df = frame(spark, [(x,) for x in ("1.5", " 2 ", "abc", "inf", "NaN", "1e3", "", None)], "t string")
    v = clean.to_number(F.col("t"))
    got = [(r[0], r[1]) for r in df.select(clean.finite_or_null(v), clean.value_class(v)).collect()]
    assert got == [(1.5, "finite"), (2.0, "finite"), (None, "nan"), (None, "inf"), (None, "nan"), (1000.0, "finite"), (None, "nan"), (None, "nan")]


def test_bad_times_go(spark):
    df = frame(spark, [("2024-01-01 00:07:30",), ("junk",), ("",), (None,)], "t string")
    assert [r["ts"] for r in clean.parse_time(df, "t").collect()] == [dt.datetime(2024, 1, 1, 0, 7, 30)]
    assert clean.parse_time(df, "t", drop=False).count() == 4


def test_continuity_gate(spark):
    clean.require_continuous(series(spark, range(5)), ["k"], "slot")
    with pytest.raises(ValueError, match="1 steps"):
        clean.require_continuous(series(spark, [0, 1, 3]), ["k"], "slot")


def test_grid_is_present_and_missing(spark):
    df = series(spark, [0, 1, 4, 6])
    missing = {r["slot"] for r in audit.missing_slots(df, ["k"], "slot").collect()}
    assert missing == {at(30), at(45), at(75)}
    assert clean.on_grid(df, ["k"], "slot").count() == 7
    assert audit.extra_slots(df, ["k"], "slot").count() == 0
    assert audit.gap_counts(df, ["k"], "slot").first()["n_gaps"] == 2


def test_blocks_run_over_rows_and_short_ones_do_not_count(spark):
    nan = float("nan")
    df = series(spark, [0, 1, 2, 9, 10, 11, 12, 13, 14], [None, nan, None, None, 1.0, None, None, None, 2.0])
    blocks = audit.missing_blocks(df, ["k"], "slot", ["v"]).collect()
    assert [(b["start_time"], b["end_time"], b["length"]) for b in blocks] == [(at(0), at(135), 4)]
    s = audit.column_summary(df, ["k"], "slot", ["v"]).first()
    assert (s["total"], s["finite_cnt"], s["nan_cnt"], s["leading_missing"], s["trailing_missing"], s["n_blocks"], s["longest_block"]) == (9, 2, 7, 4, 0, 1, 4)


def test_column_without_values(spark):
    s = audit.column_summary(series(spark, range(3), [None] * 3), ["k"], "slot", ["v"]).first()
    assert (s["leading_missing"], s["trailing_missing"], s["first_valid_time"], s["mean"], s["longest_block"]) == (3, 3, None, None, 0)


def test_time_axis_report_without_keys(spark):
    df = frame(spark, [(at(0),), (at(3),), (at(45),), (None,)], "ts timestamp_ntz")
    r = audit.time_axis_report(df, [], "ts").first()
    assert (r["n_rows"], r["n_parsed"], r["n_duplicates"], r["n_expected"], r["n_missing"], r["n_gaps"], r["n_extra"]) == (4, 3, 1, 4, 2, 1, 0)
    with pytest.raises(ValueError):
        audit.require_complete(audit.time_axis_report(df, [], "ts"))


def test_daily_ratio_is_over_present_rows(spark):
    df = series(spark, [0, 1, 2, 3], [1.0, None, 2.0, 3.0])
    cov = audit.daily_coverage(df, ["k"], "slot", ["v"])
    assert cov.first()["ratio"] == 0.75
    assert audit.daily_overall(cov, ["k"]).first()["cols_with_any_missing"] == 1


def test_column_resolution():
    assert schema.resolve_column(["x RT", "RT", 3], ["DA", "RT"]) == "RT"
    assert schema.resolve_column(["my DA price", "rt"], ["DA"]) == "my DA price"
    assert schema.resolve_column(["DA 1", "DA 2"], ["DA"]) is None
    assert schema.resolve_time_column(["v", "start time", "日期"]) == "start time"
    with pytest.raises(ValueError):
        schema.resolve_fields(["datetime"])


def test_pairs_of_headers():
    pairs = schema.pairs_of(["load实际值", "load预测值", "pv 实际", "pv预测", "lonely实际值"])
    assert pairs == {"load": ("load实际值", "load预测值"), "pv": ("pv 实际", "pv预测")}
    with pytest.raises(ValueError):
        schema.pairs_of(["a", "b"])


def test_methods():
    got = schema.check_methods(schema.parse_methods("load=direct, pv=pv_day_residual"), ["load", "pv"])
    assert got == {"load": "direct", "pv": "pv_day_residual"}
    for bad in ("load=pv_day_residual", "load=magic", ""):
        with pytest.raises(ValueError):
            schema.check_methods(schema.parse_methods(bad), ["load"])


def test_floor_keeps_type_and_null(spark):
    df = frame(spark, [(at(44) + dt.timedelta(seconds=59, microseconds=7),), (None,)], "ts timestamp_ntz")
    got = df.select(calendar.floor_time(F.col("ts")).alias("x"))
    assert got.schema["x"].dataType.simpleString() == "timestamp_ntz"
    assert [r["x"] for r in got.collect()] == [at(30), None]


def test_file_stem(spark):
    got = frame(spark, [(' a/b:c "d"? ',), ("x" * 200,)], "n string").select(calendar.file_stem(F.col("n"))).collect()
    assert got[0][0] == "a_b_c_d" and len(got[1][0]) == 120


@pytest.mark.parametrize("text, want", [("2024/1/1 0:15", at(15)), ("2024/01/01 00:15:00", at(15)), ("20240101 00:15", at(15)), ("202401010015", at(15)), ("20240101001500", at(15)), ("2024年1月1日 0:15", at(15)), ("2024年1月1日0时15分", at(15)), ("2024.1.1 0:15", at(15)), ("2024-01-01T00:15:00", at(15)), (" 2024-1-1 0:15 ", at(15)), ("2024/1/1", at(0)), ("20240101", at(0)), ("1.1.2024 0:15", at(15)), ("2024/13/1", None), ("2024/1/1 25:00", None), ("soon", None), ("", None), (None, None), ("2024/2/30", None)])
def test_times_in_many_spellings(spark, text, want):
    df = frame(spark, [(text,)], "t string")
    assert clean.parse_time(df, "t", drop=False).first()["ts"] == want


def test_a_sample_settles_what_is_day_and_month(spark):
    us, eu = frame(spark, [("1/2/2024",), ("12/31/2024",)], "t string"), frame(spark, [("1/2/2024",), ("31/12/2024",)], "t string")
    day = lambda df: clean.parse_time(df, "t", formats=clean.infer_formats(df, "t")).agg(F.min("ts")).first()[0]
    assert day(us) == dt.datetime(2024, 1, 2) and day(eu) == dt.datetime(2024, 2, 1)


def test_rejected_times_are_counted(spark):
    df = clean.parse_time(frame(spark, [("a", "2024/1/1"), ("a", "x"), ("a", "y"), ("a", None), ("a", " "), ("b", "2024-01-01")], "k string, t string"), "t", drop=False)
    got = {r["k"]: tuple(r)[1:] for r in clean.rejected_times(df, ["k"], "t", "ts").collect()}
    assert got == {"a": (2, 2, "x", "y"), "b": (0, 0, None, None)}


def test_numbers_of_other_languages_are_none(spark):
    texts = ["1d", "1.5f", "0x1p3", "1e3", " -2.5 ", ".5", "5.", "NaN", "-inf", "Infinity", "1,5", "", None, "+7"]
    got = [r[0] for r in frame(spark, [(t,) for t in texts], "t string").select(clean.to_number(F.col("t"))).collect()]
    assert got[:3] == [None] * 3 and got[3:7] == [1000.0, -2.5, 0.5, 5.0] and got[7] != got[7] and got[8:] == [float("-inf"), float("inf"), None, None, None, 7.0]


def test_gaps_are_rows_however_long(spark):
    df = series(spark, [0, 1, 4, 40_000])
    assert [(r["first"], r["last"], r["n"]) for r in audit.gaps(df, ["k"], "slot").orderBy("first").collect()] == [(at(30), at(45), 2), (at(75), at(15 * 39_999), 39_995)]
    plan = audit.time_axis_report(df.select("k", F.col("slot").alias("ts")), ["k"], "ts")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan
    samples = audit.missing_samples(df, ["k"], "slot", 3).orderBy("end", "rank").collect()
    assert [(r["slot"], r["rank"], r["end"]) for r in samples] == [(at(30), 1, "head"), (at(45), 2, "head"), (at(75), 3, "head"), (at(15 * 39_999), 1, "tail"), (at(15 * 39_998), 2, "tail"), (at(15 * 39_997), 3, "tail")]
