"""Forecasts of a stream with late rows, restarts and a repeated batch equal those of the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridseries.operators import clean, lookups
from gridseries.sources.shared import shared_folder
from gridseries.streaming import forecasts

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, seq long, v double"


def observations():
    """Two series of three days with gaps, slots of several rows, and rows up to 40 minutes late; (arrival, row)."""
    rng, rows = random.Random(6), []
    for k in ("a", "b"):
        for slot in range(96 * 3):
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = T0 + dt.timedelta(minutes=15 * slot, seconds=rng.randrange(900))
                rows.append((at + dt.timedelta(minutes=rng.choice([0, 0, 0, 20, 40])), (k, at, len(rows), float(rng.randrange(100)))))
    return [r for _, r in sorted(rows, key=lambda x: x[0])]


@pytest.fixture()
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, forecasts.ROCKSDB)
    yield
    spark.conf.set(key, old)


def test_stream_equals_batch(spark, tmp_path, rocksdb):
    shared_folder(spark)
    rows = observations()
    fix = spark.createDataFrame([(k, h, h / 10) for k in ("a",) for h in range(1, 25)], "k string, h int, correction double")
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        got = forecasts.corrected(forecasts.lag_targets(stream, ["k"], "ts", "v", "seq"), fix, ["k", "h"])
        query = got.writeStream.foreachBatch(forecasts.write_once(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()

    put = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    cut = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]
    for a, b in zip(cut, cut[1:]):  # each run is a restart
        put(rows[a:b])
        run()
    end = T0 + dt.timedelta(days=9)
    put([("z", end, 0, 0.0), ("a", T0, 10**6, -5.0)])  # pushes the watermark; the other one is far too late
    run()
    put([("a", T0 + dt.timedelta(minutes=5), 10**6, -7.0), ("z", end, 1, 0.0)])  # behind the watermark: dropped
    run()

    batch = spark.createDataFrame([r for r in rows], SCHEMA).withColumn("slot", F.window("ts", "15 minutes")["start"])
    slots = clean.keep_last(batch, ["k"], "slot", ["ts", "seq"])
    targets = lookups.target_lag(lookups.horizons(slots.select("k", F.col("slot").alias("t_dec"))), slots, ["k"], "slot", "v")
    want = forecasts.corrected(targets, fix, ["k", "h"])
    columns = ["k", "t_dec", "h", "tgt_time", "base", "y_hat"]
    show = lambda df: sorted(map(repr, df.where("k <> 'z'").select(*columns).collect()))
    got = spark.read.parquet(out)
    assert show(got) == show(want)

    # A batch that is run again replaces itself.
    last = got.where("k <> 'z'").agg(F.max("batch")).first()[0]
    forecasts.write_once(out)(got.where(F.col("batch") == last).drop("batch").checkpoint(), last)
    assert show(spark.read.parquet(out)) == show(want)


def test_ring_keeps_the_last_slots():
    ring = forecasts.Ring([], [], [], [], 3)
    for slot, time, order, value in ((0, 1, 1, 1.0), (10, 11, 1, 2.0), (10, 11, 0, 3.0), (20, 21, 0, 4.0), (30, 31, 0, 5.0), (20, 25, 0, 6.0)):
        ring.put(slot, time, order, value)
    assert ring.state(10) == ([10, 20, 30], [11, 25, 31], [1, 0, 0], [2.0, 6.0, 5.0])
    assert ring.value(40) is None
