"""Slots of a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_by_slot(stream: DataFrame, keys: list[str], ts: str, value: str, order: str, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """(keys, slot, value, n): the last value of each slot.  State goes once the watermark has passed a slot.

    `ts` is a TIMESTAMP, as watermarks need one.  Works on batch frames too.
    """
    got = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, f"{minutes} minutes").alias("_w"))
    got = got.agg(F.max_by(value, F.struct(ts, order)).alias(value), F.count("*").alias("n"))
    return got.select(*keys, F.col("_w.start").alias("slot"), value, "n")
