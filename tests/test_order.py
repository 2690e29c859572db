"""Exact quantiles against numpy and Spark's own, whatever the sizes of groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseries.operators import order


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    groups = {"even": rng.normal(size=4000), "odd": rng.lognormal(0, 8, 4001), "ties": rng.integers(0, 5, 3000).astype(float), "steps": np.repeat(rng.normal(size=900), rng.integers(1, 9, 900)), "small": rng.normal(size=7), "one": np.array([4.0]), "wide": np.concatenate([-(10.0 ** rng.uniform(-300, 300, 1500)), 10.0 ** rng.uniform(-300, 300, 1500)])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(None, 1.5), (None, 2.5), ("small", None)]
    return spark.createDataFrame(rows, "k string, v double").repartition(5).persist(), groups | {None: np.array([1.5, 2.5])}


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.85, 1.0])
@pytest.mark.parametrize("few", [3, 100])
def test_quantiles_against_numpy(values, q, few):
    df, groups = values
    got = {r["k"]: (r["m"], r["n"]) for r in order.quantiles(df, ["k"], F.col("v"), q, "m", few=few).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k][1] == len(vs)
        np.testing.assert_allclose(got[k][0], np.quantile(vs, q), rtol=1e-12)


@pytest.mark.parametrize("few", [3, 10_000])
def test_weights_count_values_several_times(values, few):
    df, groups = values
    weight = (F.pmod(F.xxhash64("v"), F.lit(4)) + 1).cast("long")
    got = {r["k"]: (r["m"], r["n"]) for r in order.quantiles(df, ["k"], F.col("v"), 0.5, "m", weight=weight, few=few).collect()}
    each = df.where("v is not null").select("k", "v", F.explode(F.sequence(F.lit(1), weight)))
    want = {r["k"]: (r["m"], r["n"]) for r in each.groupBy("k").agg(F.percentile("v", 0.5).alias("m"), F.count("*").alias("n")).collect()}
    assert got == want


def test_one_group_without_keys_and_empty_tables(values):
    df, groups = values
    every = np.concatenate(list(groups.values()))
    for few in (5, 100_000):
        r = order.quantiles(df, [], F.col("v"), 0.5, "m", few=few).collect()
        assert len(r) == 1 and r[0]["n"] == len(every)
        np.testing.assert_allclose(r[0]["m"], np.median(every), rtol=1e-12)
    assert order.quantiles(df.limit(0), [], F.col("v"), 0.5, "m").count() == 0
    assert order.quantiles(df.limit(0), ["k"], F.col("v"), 0.5, "m").count() == 0


def test_millions_of_distinct_values_in_few_rounds(spark, monkeypatch):
    rounds = []
    stored = order.checkpointed
    monkeypatch.setattr(order, "checkpointed", lambda df: (rounds.append(df.columns), stored(df))[1])
    n = 2_000_001
    df = spark.range(n).select(F.exp(F.pmod(F.col("id") * 1_000_003, F.lit(n)) / n * 40).alias("v"))
    got = order.quantiles(df, [], F.col("v"), 0.5, "m", few=2000).first()
    assert got["n"] == n and got["m"] == pytest.approx(np.exp((n // 2) / n * 40), rel=1e-12)
    assert sum("_settled" in c for c in rounds) <= 3


def test_approximate_is_asked_for(values):
    df, groups = values
    got = order.quantiles(df.where("k = 'even'"), ["k"], F.col("v"), 0.5, "m", accuracy=1000).first()
    at = np.searchsorted(np.sort(groups["even"]), got["m"]) / 4000
    assert abs(at - 0.5) <= 0.002 and got["n"] == 4000
    with pytest.raises(ValueError):
        order.quantiles(df, ["k"], F.col("v"), 0.5, "m", weight=F.lit(1), accuracy=10)
