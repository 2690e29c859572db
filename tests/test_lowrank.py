"""The projection of whole windows against numpy's decomposition of all of them at once."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseries.operators import lowrank, windows

T0 = dt.datetime(2024, 1, 1)
L, N = 30, 400


def reference(x, look_back):
    out = np.zeros((len(x) - look_back + 1, look_back, x.shape[1]))
    for t in range(len(out)):
        for c in range(x.shape[1]):
            w = x[t : t + look_back, c].copy()
            known = np.flatnonzero(np.isfinite(w))
            if len(known):
                at = np.maximum.accumulate(np.where(np.isfinite(w), np.arange(look_back), -1))
                out[t, :, c] = w[np.where(at < 0, known[0], at)]
    return out


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(size=(2, N, 3)), axis=1) * [1, 0.3, 2]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[0, 100:170, 1] = np.nan
    return x


def test_windows_are_filled_within_themselves(series):
    np.testing.assert_array_equal(lowrank.filled_windows(series[0], L), reference(series[0], L))


@pytest.mark.parametrize("keys", [["k"], []])
def test_projection_against_numpy(spark, series, keys):
    use = range(2) if keys else range(1)
    rows = [(*([k] if keys else []), T0 + dt.timedelta(minutes=15 * t), *[None if np.isnan(v) else float(v) for v in series[k][t]]) for k in use for t in range(N)]
    df = spark.createDataFrame(rows, ("k int, " if keys else "") + "slot timestamp_ntz, a double, b double, c double").repartition(3)
    train = df.where(F.col("slot") < F.lit(T0 + dt.timedelta(minutes=15 * 250)).cast("timestamp_ntz")).select(*keys, F.col("slot").alias("t_dec"))
    got = lowrank.fit(df, train, keys, "slot", ["a", "b", "c"], 4, L, days=1)
    w = np.concatenate([reference(series[k], L)[: 250 - L + 1].reshape(-1, L * 3) for k in use])
    np.testing.assert_allclose(got.mean, w.mean(axis=0), atol=1e-9)
    _, s, v = np.linalg.svd(w - w.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(np.abs(np.sum(got.components * v[:4], axis=1)), 1, atol=1e-7)
    assert got.explained == pytest.approx((s[:4] ** 2).sum() / (s**2).sum())
    z = {(r["k"] if keys else 0, r["t_dec"]): r["look_back"] for r in lowrank.project(df, got, keys, "slot", ["a", "b", "c"], L, days=1).collect()}
    assert len(z) == len(use) * (N - L + 1)
    for k in use:
        every = (reference(series[k], L).reshape(-1, L * 3) - got.mean) @ got.components.T
        np.testing.assert_allclose([z[k, T0 + dt.timedelta(minutes=15 * (t + L - 1))] for t in range(len(every))], every, atol=1e-8)


def test_width_is_bounded_and_training_times_needed(spark):
    df = spark.createDataFrame([(T0, 1.0)], "slot timestamp_ntz, v double")
    with pytest.raises(ValueError, match="more than"):
        lowrank.fit(df, df.select(F.col("slot").alias("t_dec")), [], "slot", ["v"] * 40, 2)
    with pytest.raises(ValueError, match="whole look-back"):
        lowrank.fit(df, df.select(F.col("slot").alias("t_dec")), [], "slot", ["v"], 2)
