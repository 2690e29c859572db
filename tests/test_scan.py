"""Buckets of time give what plain windows give, and more than one task for one series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridseries.operators import audit, clean, forecast, index, scan, windows

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def gaps(spark):
    """Series with gaps of minutes to months, runs of nulls, one of a single row and one under a null key."""
    rng, rows = random.Random(4), []
    for key, n in (("a", 900), ("b", 300), (None, 200), ("c", 1)):
        at, value = 0, 1.0
        for _ in range(n):
            at += rng.choice([1, 1, 1, 1, 2, 40, 700])
            value = None if rng.random() < (0.9 if value is None else 0.15) else rng.choice([1.0, float("nan"), float("inf"), 2.5, 7.0])
            rows.append((key, T0 + dt.timedelta(minutes=15 * at), value, rng.choice(["x", None, None])))
    return spark.createDataFrame(rows, "k string, slot timestamp_ntz, v double, s string").repartition(3).persist()


def same(a, b):
    show = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert show(a) == show(b)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("days", [1, 7, 400])
def test_buckets_equal_plain_windows(gaps, keys, days):
    df = gaps if keys else gaps.where("k = 'a'").drop("k")
    both = lambda f: same(f(None), f(days))
    both(lambda d: scan.row_numbers(df, keys, "slot", d))
    both(lambda d: scan.previous(df, keys, "slot", "before", d))
    both(lambda d: clean.fill_forward(df, keys, "slot", ["v", "s"], d))
    both(lambda d: clean.irregular_steps(df, keys, "slot", days=d))
    both(lambda d: audit.gap_counts(df, keys, "slot", days=d))
    both(lambda d: audit.missing_blocks(df, keys, "slot", ["v"], 2, d))
    both(lambda d: audit.column_summary(df, keys, "slot", ["v"], 2, d))
    both(lambda d: windows.positions(df, keys, "slot", d))
    both(lambda d: index.decision_index(df, keys, "slot", 20, 5, days=d))


def test_blocks_against_a_loop(gaps):
    want, run = [], []
    rows = sorted((r["slot"], r["v"]) for r in gaps.where("k = 'a'").collect())
    for slot, v in [*rows, (None, 0.0)]:
        if v is None or v != v or v == float("inf"):
            run.append(slot)
        else:
            want += [(run[0], run[-1], len(run))] if len(run) >= 3 else []
            run = []
    got = audit.missing_blocks(gaps.where("k = 'a'"), ["k"], "slot", ["v"], 3, 7).collect()
    assert sorted((r["start_time"], r["end_time"], r["length"]) for r in got) == want


def test_one_series_is_several_tasks(spark):
    n = 96 * 60
    df = spark.range(n).select(F.timestamp_add("MINUTE", (15 * F.col("id")).cast("int"), F.lit(T0).cast("timestamp_ntz")).alias("slot"), F.rand(1).alias("v"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = lambda d: sum(1 for n in d.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n)
        assert tasks(clean.fill_forward(df, [], "slot", ["v"])) == 1
        assert tasks(clean.fill_forward(df, [], "slot", ["v"], 7)) > 1
        assert tasks(scan.row_numbers(df, [], "slot", 7)) > 1
        halo = windows.with_halo(df, [], "slot", 192, 15, lambda d, k: windows.history_features(d, k, "slot", ["v"]), 7)
        assert tasks(halo) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_halo_on_both_sides(spark):
    n = 96 * 20
    df = spark.range(2 * n).select((F.col("id") % 2).alias("k"), F.timestamp_add("MINUTE", (15 * F.floor(F.col("id") / 2)).cast("int"), F.lit(T0).cast("timestamp_ntz")).alias("slot"), F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("v"))
    both = lambda f, back, ahead: same(f(df, ["k"]), windows.with_halo(df, ["k"], "slot", back, 15, f, 3, ahead))
    both(lambda d, k: windows.future_arrays(d, k, "slot", "v"), 0, 24)
    both(lambda d, k: windows.history_arrays(d, k, "slot", ["v"]), 192, 0)
    both(lambda d, k: windows.sample_quality(d, k, "slot", ["v"], ["v"]), 192, 24)
    idx = df.where("v > 50").select("k", F.col("slot").alias("t_dec"), F.lit("train").alias("split"))
    same(forecast.target_weights(idx, df, ["k"], "slot", "v"), forecast.target_weights(idx, df, ["k"], "slot", "v", days=3))
