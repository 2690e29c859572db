"""Windows, joins, splits, forecasters and metrics on hand-made frames."""

import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridseries.operators import forecast, index, lookups, metrics, models, scale, windows

T0 = dt.datetime(2024, 1, 1)


def at(slot):
    return T0 + dt.timedelta(minutes=15 * slot)


def wave(spark, n, keys=("a",), gap=()):
    rows = [(k, at(i), 50 + 10 * math.sin(2 * math.pi * i / 96) + (i % 7) + j) for j, k in enumerate(keys) for i in range(n) if i not in gap]
    return spark.createDataFrame(rows, "k string, slot timestamp_ntz, v double")


def test_full_windows_only(spark):
    df = wave(spark, 30).withColumn("v", F.when(F.col("slot") == F.lit(at(10)), None).otherwise(F.col("v")))
    rows = windows.history_features(df, ["k"], "slot", ["v"], (8,)).orderBy("slot").collect()
    assert [r["v_8_mean"] is not None for r in rows] == [7 <= i < 10 or i >= 18 for i in range(30)]
    assert rows[20]["v_8_trend"] == pytest.approx(rows[20]["v"] - rows[13]["v"])


def test_halo_windows_equal_plain_ones(spark):
    df = wave(spark, 96 * 9, ("a", "b"))
    plain = sorted(map(tuple, windows.history_features(df, ["k"], "slot", ["v"], (24,)).collect()))

    def compute(spread, keys):
        return windows.history_features(spread.withColumn("o", F.col("_own")), keys, "slot", ["v", "o"], (24,)).withColumnRenamed("o", "_own")

    got = windows.with_halo(df, ["k"], "slot", 192, 15, compute, bucket_days=2)
    cols = [c for c in got.columns if not c.startswith("o_")]
    halo = sorted(map(tuple, got.select(*cols).collect()))
    assert len(halo) == len(plain)
    for x, y in zip(plain, halo):
        assert x[:2] == y[:2] and all(a == pytest.approx(b) for a, b in zip(x[2:], y[2:]))


def test_fill_window(spark):
    df = spark.createDataFrame([([None, 1.0, None, 2.0, None],), ([None, None],), (None,)], "a array<double>")
    got = [r[0] for r in df.select(windows.fill_window("a")).collect()]
    assert got[0] == [1.0, 1.0, 1.0, 2.0, 2.0] and got[2] is None and all(x is None or math.isnan(x) for x in got[1])


def test_previous_day_is_a_calendar_day(spark):
    df = wave(spark, 96 * 3, gap=range(96, 192))
    assert lookups.previous_day_stats(df, ["k"], "slot", "v").count() == 0
    assert lookups.same_slot_before(df, ["k"], "slot", "v").where("v_d1 is not null").count() == 0


@pytest.mark.parametrize("gap,expected", [((), 36), ((36,), 35), (range(30, 40), 29)])
def test_as_of_takes_the_last_row_up_to_nine(spark, gap, expected):
    got = {r["date"]: r["as_of"] for r in lookups.as_of_daily(wave(spark, 96, gap=gap), ["k"], "slot", "v").collect()}
    assert got == {dt.date(2024, 1, 2): at(expected)}


def test_as_of_does_not_see_later_rows(spark):
    df = wave(spark, 200)
    changed = df.withColumn("v", F.when(F.col("slot") > F.lit(at(36)), 999.0).otherwise(F.col("v")))
    day = dt.date(2024, 1, 2)
    a, b = (lookups.as_of_daily(x, ["k"], "slot", "v").where(F.col("date") == day).first() for x in (df, changed))
    assert a == b


def test_index_and_split(spark):
    df = wave(spark, 96 * 14)
    idx = index.decision_index(df, ["k"], "slot")
    assert idx.count() == 96 * 14 - 215
    got = index.split_by_day(idx, ["k"], 2, 3)
    days = {r["split"]: r["n"] for r in got.groupBy("split").agg(F.countDistinct("date_tgt_max").alias("n")).collect()}
    per_day = {r["n"] for r in got.groupBy("date_tgt_max").agg(F.count("*").alias("n")).collect()}
    assert days["test"] == 3 and days["val"] == 2 and per_day == {96}
    with pytest.raises(ValueError):
        index.require_days(idx, ["k"], 100)


def test_cutoff_skips_and_names(spark):
    df = wave(spark, 10).withColumns({"w": F.when(F.col("slot") < F.lit(at(4)), 1.0), "e": F.lit(None).cast("double")})
    r = index.cutoff(df, ["k"], "slot", ["v", "w", "e", "gone"]).first()
    assert r["cutoff"] == at(3) and [(x["col"], x["reason"]) for x in r["skipped"]] == [("gone", "absent"), ("e", "empty")]
    with pytest.raises(ValueError):
        index.cutoff(df, ["k"], "slot", ["gone"])


def test_row_split_may_cut_a_day(spark):
    got = index.split_by_rows(wave(spark, 96 * 4, gap=range(96 * 3, 96 * 3 + 50)), ["k"], "slot", 1, 1)
    n = {r["split"]: r["n"] for r in index.split_ranges(got, ["k"], "slot").collect()}
    assert n == {"test": 96, "val": 96, "train": 96 * 4 - 50 - 192}


def test_weights_at_the_threshold(spark):
    rows = [("train", 2, float(i)) for i in range(1, 102)] + [("test", 2, 86.0), ("test", 2, 85.9), ("test", 1, 500.0)]
    got = index.high_price_weights(spark.createDataFrame(rows, "split string, segment int, y double"), [], "y", "segment")
    assert [r["weight"] for r in got.where("split = 'test'").orderBy("y").collect()] == [1.0, 1.5, 1.0]


def long(spark, n, h=1, split="train", y=3.0, base=1.0):
    return spark.createDataFrame([("a", h, split, y, base)] * n, "k string, h int, split string, y double, base double")


@pytest.mark.parametrize("n,correction", [(199, 0.0), (200, 2.0)])
def test_median_residual_needs_pairs(spark, n, correction):
    assert forecast.median_residuals(long(spark, n), ["k", "h"]).first()["correction"] == correction


def test_gate_ends(spark):
    rows = [(dt.datetime(2024, 1, 1, 18, 45), 2.0), (dt.datetime(2024, 1, 1, 19, 0), 2.0), (dt.datetime(2024, 1, 1, 6, 0), 1.0), (dt.datetime(2024, 1, 1, 6, 0), None)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, b double")
    assert [r[0] for r in df.select(forecast.gated(F.col("t"), F.col("b"), F.lit(5.0))).collect()] == [7.0, 2.0, 1.0, None]


def test_prior_counts_targets_as_often_as_they_are_targets(spark):
    df = wave(spark, 96 * 12)
    idx = index.split_by_day(index.decision_index(df, ["k"], "slot"), ["k"], 2, 2)
    weighted = forecast.target_weights(idx, df, ["k"], "slot", "v")
    exploded = lookups.future_values(idx.where("split = 'train'").select("k", "t_dec"), df, ["k"], "slot", "v")
    assert weighted.agg(F.sum("times")).first()[0] == exploded.count()
    a = forecast.seasonal_prior(weighted, ["k"], "slot", "v")[1].first()["prior"]
    assert a == pytest.approx(exploded.agg(F.median("y")).first()[0])


def test_wide_and_long_are_inverse(spark):
    rows = [("a", at(0), "val", "load", h, float(h)) for h in range(1, 25)]
    df = spark.createDataFrame(rows, "k string, t_dec timestamp_ntz, split string, var string, h int, y_hat double")
    got = forecast.to_long(forecast.to_wide(df, ["k"], ["load"]), ["k"], ["load"], {"load": "direct"}, "v1")
    assert sorted((r["h"], r["y_hat"], r["is_valid"], r["method"]) for r in got.collect()) == [(h, float(h), 1, "direct") for h in range(1, 25)]


def test_offsets_equal_joins_on_a_grid(spark):
    df = wave(spark, 96 * 3)
    a = lookups.future_with_lag(df, ["k"], "slot", "v").where("y is not null").select("t_dec", "h", "y", "base")
    dec = df.select("k", F.col("slot").alias("t_dec"))
    b = lookups.target_lag(lookups.future_values(dec, df, ["k"], "slot", "v"), df, ["k"], "slot", "v").where("y is not null").select("t_dec", "h", "y", "base")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_constant_pairs_have_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1e-9, 1.0), ("b", None, 1.0), ("c", float("nan"), 1.0)], "g string, actual double, forecast double")
    got = {r["g"]: r for r in metrics.pair_report(df, ["g"]).collect()}
    assert got["a"]["corr"] is None and got["a"]["mape"] == pytest.approx(150) and got["b"]["mape"] is None and got["c"]["n"] == 0
    assert [r["g"] for r in metrics.pair_report(df, ["g"]).collect()][-1] == "c"


def test_summary_is_a_mean_over_horizons(spark):
    rows = [("val", "v", 1, 0.0, 1.0)] * 3 + [("val", "v", 24, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "split string, var string, h int, y double, y_hat double")
    r = metrics.horizon_summary(metrics.horizon_metrics(df, []), []).first()
    assert (r["all_mae"], r["last_mae"], r["valid_points_all"], r["no_valid_points"]) == (3.0, 5.0, 4, False)


def test_huber_without_pairs(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", 0.0, 3.0), ("b", 0.0, 1.0)], "g string, y double, p double")
    assert {r["g"]: r["huber"] for r in metrics.masked_huber(df, ["g"], "y", "p").collect()} == {"a": 0.0, "b": 2.25}


def test_scalers_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    got = {r["var"]: (r["mean"], r["std"]) for r in scale.fit_scalers(df, [], ["a", "b"]).collect()}
    assert got == {"a": (1.0, 1.0), "b": (0.0, 1.0)}


def test_ridge_beats_the_lag_on_a_sine(spark):
    df = wave(spark, 96 * 14)
    idx = index.split_by_day(index.decision_index(df, ["k"], "slot"), ["k"], 2, 3)
    rows = lookups.target_lag(lookups.future_values(idx.select("k", "t_dec", "split"), df, ["k"], "slot", "v", horizon=2), df, ["k"], "slot", "v")
    rows = rows.withColumns({"r": F.col("y") - F.col("base"), "s": F.sin(F.hour("tgt_time") * math.pi / 12), "c": F.cos(F.hour("tgt_time") * math.pi / 12)})
    model = models.fit_ridge(rows, ["h"], ["base", "s", "c"], "r")
    out = models.predict_ridge(rows, model, ["h"], ["base", "s", "c"]).withColumn("y_hat", F.col("base") + F.col("r_hat"))
    of = lambda p: metrics.split_scores(out.where("split = 'test'"), ["split"], p=p).first()["rmse"]
    assert of("y_hat") <= of("base")


def test_stream_slots(spark, tmp_path):
    from gridseries.streaming.slots import last_by_slot

    rows = [("a", at(0) + dt.timedelta(minutes=m), m, float(m)) for m in (1, 14, 16, 3)]
    spark.createDataFrame(rows, "k string, ts timestamp, seq int, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, seq int, v double").parquet(str(tmp_path / "in"))
    q = last_by_slot(stream, ["k"], "ts", "v", "seq").writeStream.outputMode("complete").format("memory").queryName("slots_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["v"], r["n"]) for r in spark.sql("select * from slots_out").collect()) == [(14.0, 3), (16.0, 1)]


def test_as_of_and_last_decision(spark):
    idx = index.decision_index(wave(spark, 240, ("a", "b")), ["k"], "slot")
    assert {r["t_dec"] for r in index.last_decision(idx, ["k"]).collect()} == {at(215)}
    assert index.as_of(idx, "2024-01-03 00:07:00").count() == 2
    with pytest.raises(ValueError):
        index.as_of(idx, "2030-01-01 00:00:00")


def test_required_columns():
    assert index.required_columns("exog_only", ["wind"]) == ["load", "pv", "line", "ru", "rd", "wind"]
    assert index.required_columns("rt_chain")[:2] == ["rt", "da"]
    with pytest.raises(ValueError):
        index.required_columns("all")


def test_missing_forecasts_and_training_rows_raise(spark):
    rows = long(spark, 2, base=None).withColumn("y_hat", F.lit(None).cast("double"))
    assert forecast.require_forecasts(rows, fallback=True).count() == 2
    with pytest.raises(ValueError, match="2 forecasts"):
        forecast.require_forecasts(rows)
    with pytest.raises(ValueError):
        models.require_usable(models.usable_counts(rows, ["k", "h"], F.col("y_hat").isNotNull()))


def test_compared_on_the_same_points(spark):
    df = spark.createDataFrame([("val", 1.0, 2.0, 1.0), ("val", 1.0, 5.0, None), ("val", 1.0, None, 9.0)], "split string, y double, a double, b double")
    got = {r["model"]: (r["mae"], r["n"]) for r in metrics.compare_models(df, "y", {"a": "a", "b": "b"}).collect()}
    assert got == {"b": (0.0, 1), "a on b": (1.0, 1)}


def test_actual_columns_as_features_warn(spark):
    from gridseries.operators import dayahead

    df = wave(spark, 96 * 3).withColumns({"da": F.col("v"), "rt": F.col("v"), "load": F.col("v")})
    with pytest.warns(UserWarning, match="leaks"):
        table = dayahead.feature_table(df, ["k"], "slot", exogenous={"load": ("load_fcst", "load"), "none": (None, "gone")})
    assert "x_load" in table.columns and "x_none" not in table.columns and table.count() == 96 * 2


def test_day_ahead_features_do_not_see_the_day(spark):
    from gridseries.operators import dayahead

    df = wave(spark, 96 * 3).withColumns({"da": F.col("v"), "rt": F.col("v")})
    late = F.col("slot") > F.lit(at(96 + 36))  # after 9 o'clock of the day before the last one
    changed = df.withColumn("rt", F.when(late, 0.0).otherwise(F.col("rt"))).withColumn("da", F.when(F.col("slot") >= F.lit(at(192)), -F.col("da")).otherwise(F.col("da")))
    pick = lambda x: [tuple(r) for r in dayahead.feature_table(x, ["k"], "slot").where(F.col("slot") >= F.lit(at(192))).drop("y").orderBy("slot").collect()]
    assert pick(df) == pick(changed)


def gram_rows(spark, n, k, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) * np.logspace(-3, 3, k) + 5
    y = x @ (rng.normal(size=k) / np.logspace(-3, 3, k)) + rng.normal(size=n)
    split = np.where(np.arange(n) % 5 == 0, "test", "train")
    group = np.arange(n) % 3
    rows = [(int(g), s, a.tolist(), float(b)) for g, s, a, b in zip(group, split, x, y)]
    return spark.createDataFrame(rows, "g int, split string, x array<double>, y double"), (group, split == "train", x, y)


def test_relative_ridge_of_many_features_against_numpy(spark):
    k = 120
    frame, (group, train, x, y) = gram_rows(spark, 1500, k)
    got = {r["g"]: r for r in models.fit_vectors(frame.repartition(5), ["g"], F.col("y"), F.lit(True), penalty=0.05, relative=True).collect()}
    for g in range(3):
        use = train & (group == g)
        a = np.hstack([np.ones((use.sum(), 1)), x[use]])
        reg = 0.05 * np.diag([0, *(use.sum() * x[use].var(axis=0))])
        want = np.linalg.solve(a.T @ a + reg, a.T @ y[use])
        assert got[g]["n_train"] == use.sum()
        np.testing.assert_allclose(a @ got[g]["coefficients"], a @ want, rtol=1e-6)


def test_many_batches_and_spills_give_the_sums_of_one(spark):
    frame, _ = gram_rows(spark, 900, 7)
    fit = lambda df, **o: {r["g"]: (r["n_train"], r["coefficients"]) for r in models.fit_vectors(df, ["g"], F.col("y"), F.col("y") > -1e9, **o).collect()}
    want = fit(frame.coalesce(1))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        many = fit(frame.repartition(6), branches=2)
        spilled = fit(frame.repartition(6), limit=1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for got in (many, spilled):
        assert got.keys() == want.keys()
        for g in want:
            assert got[g][0] == want[g][0]
            np.testing.assert_allclose(got[g][1], want[g][1], rtol=1e-6)


def test_a_task_sends_one_row_a_group():
    rng = np.random.default_rng(2)
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([1, 2, None, 1]), pa.array([[1.0, 2.0], None, [0.5, 1.0], rng.normal(size=2).tolist()]), pa.array([1.0, None, 2.0, 3.0])], names=["g", "x", "y"])
    out = list(models._gram(["g"], 1 << 20)(batch() for _ in range(50)))
    assert len(out) == 1 and sorted(map(str, out[0].column("g").to_pylist())) == ["1", "2", "None"]
    sums = dict(zip(out[0].column("g").to_pylist(), out[0].column("sums").to_pylist()))
    assert sums[1][0] == 100 and sums[None][0] == 50 and sums[2] == []


def test_a_group_without_training_rows_is_an_error(spark):
    rows = spark.createDataFrame([("a", "train", [1.0], 1.0), ("a", "train", [2.0], 3.0), ("b", "test", [1.0], 1.0)], "k string, split string, x array<double>, y double")
    model = models.fit_vectors(rows, ["k"], F.col("y"), F.lit(True))
    assert {r["k"]: (r["n_train"], r["coefficients"] is None) for r in model.collect()} == {"a": (2, False), "b": (0, True)}
    with pytest.raises(ValueError, match="1 groups"):
        models.require_fitted(model)
    with pytest.raises(ValueError, match="1 groups"):
        models.require_usable(models.usable_counts(rows, ["k"], F.lit(True)))


def test_only_full_days_are_eligible(spark):
    rows = [("a", at(i)) for i in range(96 * 3)] + [("b", at(i)) for i in range(96 * 5) if i % 96 > 3]
    df = spark.createDataFrame(rows, "k string, t_dec timestamp_ntz").withColumn("date_tgt_max", F.to_date("t_dec"))
    index.require_days(df.where("k = 'a'"), ["k"], 3)
    with pytest.raises(ValueError, match="1 series have fewer than 3"):
        index.require_days(df, ["k"], 3)  # b has five days, none of them full
    index.require_days(df, ["k"], 3, full_days=False)


def test_row_split_needs_rows_to_train_on(spark):
    df = wave(spark, 96 * 2 + 1)
    index.require_rows(df, ["k"], 1, 1)
    with pytest.raises(ValueError, match="none is left"):
        index.require_rows(df.limit(96 * 2), ["k"], 1, 1)


def test_weights_without_keys_or_training_rows(spark):
    rows = spark.createDataFrame([("train", 2, float(i)) for i in range(10)] + [("test", 2, 9.0)], "split string, segment int, y double")
    got = index.high_price_weights(rows, [], "y", "segment").collect()
    assert sum(r["weight"] == 1.5 for r in got) == 3
    assert {r["weight"] for r in index.high_price_weights(rows.where("split = 'test'"), [], "y", "segment").collect()} == {1.0}


def test_segment_trees_beat_the_lag_and_see_no_target(spark):
    """Boosted trees on a lag and the hour beat the lag alone; shuffled targets teach them nothing that the mean doesn't know."""
    n = 96 * 12
    base = F.col("i") % 96
    rows = spark.range(n).withColumnRenamed("id", "i").select("i", F.floor(base / 32).cast("int").alias("segment"), (F.floor(base / 4)).cast("double").alias("hour"), (10 * F.sin(base / 96 * 6.2832) + F.pmod(F.xxhash64("i"), F.lit(100)) / 12).alias("y"), F.lit(1.0).alias("weight"), F.when(F.col("i") < 96 * 9, "train").otherwise("test").alias("split"))
    rows = rows.join(rows.select((F.col("i") + 96).alias("i"), F.col("y").alias("lag")), "i").persist()
    mae = lambda df, c: df.where("split = 'test'").agg(F.avg(F.abs(F.col("y") - F.col(c)))).first()[0]
    fit = lambda df: models.predict_segments(df, models.fit_segments(df, ["hour", "lag"], maxIter=8, stepSize=0.3, maxDepth=4), ["hour", "lag"])
    got = fit(rows)
    assert got.count() == rows.count() and mae(got, "y_hat") < 0.85 * mae(rows, "lag")
    noise = rows.withColumn("y", F.pmod(F.xxhash64("i", F.lit(5)), F.lit(1000)) / 1000)
    assert mae(fit(noise), "y_hat") > 0.9 * 0.25
