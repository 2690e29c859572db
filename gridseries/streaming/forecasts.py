"""Forecasts of a stream of observations, each made once when its slot is final.

The state of a series is a ring of its last slots' values.  A slot is final when the watermark has passed its
end: a timer then gives the targets of that decision time with their values a day before, from the ring.  A
stored model's corrections are joined to that, and the sink writes each micro-batch as a partition of its own.

Needs a state store with timers: set spark.sql.streaming.stateStore.providerClass to RocksDBStateStoreProvider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridseries.functions.calendar import STEP_MINUTES
from gridseries.operators.index import HORIZON, LOOK_BACK

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS = 86_400_000


class Ring:
    """The slots of a series that have an observation, back to `size` slots before the first that isn't final: of each the value of its last one."""

    def __init__(self, slots, times, orders, values, size: int):
        self.size, self.held = size, {s: (t, o, v) for s, t, o, v in zip(slots, times, orders, values)}

    def put(self, slot: int, time: int, order: int, value: float) -> None:
        old = self.held.get(slot)
        if old is None or (time, order) >= old[:2]:
            self.held[slot] = (time, order, value)

    def value(self, slot: int) -> float | None:
        return self.held[slot][2] if slot in self.held else None

    def state(self, step: int, oldest: int | None = None) -> tuple[list, list, list, list]:
        """What is within `size` slots of the newest one, or before the `oldest` slot that isn't final yet."""
        newest = max(self.held, default=0) if oldest is None else oldest
        kept = sorted(s for s in self.held if s > newest - self.size * step)
        return kept, *([self.held[s][i] for s in kept] for i in range(3))


class LagTargets(StatefulProcessor):
    """(keys, t_dec, h, tgt_time, base) of each slot once it is final, base being the value a day before the target.

    A slot without an observation is no decision time; a target whose day before has none has a null base.
    """

    STATE = T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in (("slots", T.LongType()), ("times", T.LongType()), ("orders", T.LongType()), ("values", T.DoubleType()))])

    def __init__(self, keys: list[str], ts: str, value: str, order: str, minutes: int, horizon: int, size: int):
        self.keys, self.ts, self.value, self.order = keys, ts, value, order
        self.step, self.horizon, self.size = minutes * 60_000, horizon, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", self.STATE)

    def _load(self) -> Ring:
        return Ring(*(self.ring.get() if self.ring.exists() else ([], [], [], [])), self.size)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ring, waiting = self._load(), {t for t in self.handle.listTimers()}
        for frame in rows:
            frame = frame.dropna(subset=[self.ts])
            times = frame[self.ts].astype("datetime64[us]").astype("int64").to_numpy()
            for time, order, value in zip(times.tolist(), frame[self.order].tolist(), frame[self.value].astype(float).tolist()):
                slot = time // 1000 // self.step * self.step
                ring.put(slot, time, int(order), value)
                if slot + self.step not in waiting:
                    waiting.add(slot + self.step)
                    self.handle.registerTimer(slot + self.step)
        self.ring.update(ring.state(self.step, min(waiting) - self.step if waiting else None))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slot, ring = expiredTimerInfo.getExpiryTimeInMs() - self.step, self._load()
        if ring.value(slot) is None:
            return
        h = np.arange(1, self.horizon + 1)
        target = slot + h * self.step
        out = pd.DataFrame({k: [v] * len(h) for k, v in zip(self.keys, key)})
        out["t_dec"], out["h"], out["tgt_time"] = pd.to_datetime(np.full(len(h), slot), unit="ms"), h.astype("int32"), pd.to_datetime(target, unit="ms")
        out["base"] = pd.Series([ring.value(t - _DAY_MS) for t in target.tolist()], dtype=object)
        yield out

    def close(self) -> None:
        pass


def lag_targets(stream: DataFrame, keys: list[str], ts: str, value: str, order: str, late: str = "1 hour", minutes: int = STEP_MINUTES, horizon: int = HORIZON, size: int = LOOK_BACK) -> DataFrame:
    """(keys, t_dec, h, tgt_time, base) of a stream; `ts` is a TIMESTAMP in a session of UTC, `order` a long that breaks ties.

    Observations up to `late` behind the newest one count; later ones are dropped.  A ring of `size` slots a series has to
    reach a day and `late` back.
    """
    kinds = dict(stream.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "t_dec timestamp, h int, tgt_time timestamp, base double"])
    rows = stream.select(*keys, ts, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value)).withWatermark(ts, late)
    return rows.groupBy(*keys).transformWithStateInPandas(LagTargets(keys, ts, value, order, minutes, horizon, size), schema, "Append", "EventTime")


def corrected(targets: DataFrame, fix: DataFrame, by: list[str]) -> DataFrame:
    """`targets` with y_hat = base + the correction of its (by), from the stored model `fix`; without one the base."""
    joined = targets.join(fix.select(*by, "correction"), by, "left")
    return joined.withColumn("y_hat", F.col("base") + F.coalesce("correction", F.lit(0.0))).drop("correction")


def write_once(path: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: a batch is a partition of its own, so one that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write
