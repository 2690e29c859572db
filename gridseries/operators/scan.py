"""Running values of very long series, in parallel buckets of time.

A plain window over a series is one task, however long the series is.  Here a series is cut into buckets
of `days`: an aggregation sums each bucket up in one row (its rows, its last time, its last values), a window
over those rows says what came before each bucket, and inside the bucket a plain window goes on from
there.  With `days` None everything is one plain window, which is cheaper for many short series.

The rows are read twice, for the sums and for the windows: store what is costly to make.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridseries.operators import keyed

BUCKET = "_bucket"


def bucket(ts: Column, days: int) -> Column:
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return F.floor(seconds / (days * 86400))


def _carried(df: DataFrame, keys: list[str], ts: str, days: int, sums: dict[str, Column], scans: dict[str, Callable[[WindowSpec, WindowSpec], Column]]) -> DataFrame:
    """`df` with its bucket and, of each scan, a column of what came before that bucket (or of all buckets)."""
    rows = df.withColumn(BUCKET, bucket(F.col(ts), days))
    of_bucket = rows.groupBy(*keys, BUCKET).agg(*[c.alias(k) for k, c in sums.items()])
    every = Window.partitionBy(*keys)
    before = every.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carries = of_bucket.select(*keys, BUCKET, *[f(before, every).alias(k) for k, f in scans.items()])
    return keyed.join(rows, carries, [*keys, BUCKET])


def _inside(keys: list[str], ts: str):
    return Window.partitionBy(*keys, BUCKET).orderBy(ts)


def row_numbers(df: DataFrame, keys: list[str], ts: str, days: int | None = None, number: str = "_rn", rows: str = "_n") -> DataFrame:
    """`df` with the number of each row in its series, from 1, and the rows of the series."""
    if days is None:
        w = Window.partitionBy(*keys)
        return df.withColumns({number: F.row_number().over(w.orderBy(ts)), rows: F.count("*").over(w)})
    scans = {"_c": lambda before, _: F.coalesce(F.sum("_s").over(before), F.lit(0)), rows: lambda _, every: F.sum("_s").over(every)}
    got = _carried(df, keys, ts, days, {"_s": F.count("*")}, scans)
    return got.withColumn(number, F.col("_c") + F.row_number().over(_inside(keys, ts))).drop(BUCKET, "_c")


def previous(df: DataFrame, keys: list[str], ts: str, name: str, days: int | None = None) -> DataFrame:
    """`df` with the time of the row before in its series, null at its first."""
    if days is None:
        return df.withColumn(name, F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts)))
    got = _carried(df, keys, ts, days, {"_s": F.max(ts)}, {"_c": lambda before, _: F.last("_s").over(before)})
    return got.withColumn(name, F.coalesce(F.lag(ts).over(_inside(keys, ts)), F.col("_c"))).drop(BUCKET, "_c")


def fill_forward(df: DataFrame, keys: list[str], ts: str, columns: list[str], days: int | None = None) -> DataFrame:
    """`df` with each null of `columns` replaced by the last value before it, if there is one."""
    upto = Window.unboundedPreceding, 0
    if days is None:
        w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(*upto)
        return df.select(*[F.last(f"`{c}`", ignorenulls=True).over(w).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])
    sums = {f"_s{i}": F.max_by(f"`{c}`", F.when(F.col(f"`{c}`").isNotNull(), F.col(ts))) for i, c in enumerate(columns)}
    scans = {f"_c{i}": (lambda before, _, i=i: F.last(f"_s{i}", ignorenulls=True).over(before)) for i in range(len(columns))}
    got, w = _carried(df, keys, ts, days, sums, scans), _inside(keys, ts).rowsBetween(*upto)
    place = {c: i for i, c in enumerate(columns)}
    return got.select(*[F.coalesce(F.last(f"`{c}`", ignorenulls=True).over(w), F.col(f"_c{place[c]}")).alias(c) if c in place else F.col(f"`{c}`") for c in df.columns])


def running_counts(df: DataFrame, keys: list[str], ts: str, conditions: dict[str, Column], days: int | None = None) -> DataFrame:
    """`df` with, of each condition, in how many rows of the series up to and with this one it holds; one sort serves all."""
    marked = df.withColumns({k: c.cast("int") for k, c in conditions.items()})
    total = lambda k, w: F.coalesce(F.sum(k).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    if days is None:
        return marked.withColumns({k: total(k, Window.partitionBy(*keys).orderBy(ts)) for k in conditions})
    sums = {f"_s{k}": F.sum(k) for k in conditions}
    scans = {f"_c{k}": (lambda before, _, k=k: F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0))) for k in conditions}
    got = _carried(marked, keys, ts, days, sums, scans)
    return got.withColumns({k: F.col(f"_c{k}") + total(k, _inside(keys, ts)) for k in conditions}).drop(BUCKET, *scans)
