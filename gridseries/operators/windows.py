"""Rolling features over the rows of a series, and sample windows as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries.operators import scan
from gridseries.operators.clean import is_finite

WINDOWS = (192, 96, 24, 8)
DAY = 96


def _rows(keys: list[str], ts: str, first: int, last: int):
    return Window.partitionBy(*keys).orderBy(ts).rowsBetween(first, last)


def rolling(keys: list[str], ts: str, c: str, win: int) -> dict[str, Column]:
    """mean, std (population), min, max and trend over `win` rows; null unless all are there."""
    w = _rows(keys, ts, 1 - win, 0)
    full = F.count(c).over(w) == win
    out = {k: F.when(full, f(c).over(w)) for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))}
    out["trend"] = F.when(full, F.col(c) - F.lag(c, win - 1).over(Window.partitionBy(*keys).orderBy(ts)))
    return {f"{c}_{win}_{k}": v for k, v in out.items()}


def same_slot_lags(keys: list[str], ts: str, c: str, days: tuple[int, ...] = (1, 2)) -> dict[str, Column]:
    w = Window.partitionBy(*keys).orderBy(ts)
    return {f"{c}_lag{d}d": F.lag(c, d * DAY).over(w) for d in days}


def history_features(df: DataFrame, keys: list[str], ts: str, variables: list[str], windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(keys, ts, 23 features for each variable): value, rolling statistics and lags; one sort serves all."""
    features: dict[str, Column] = {}
    for v in variables:
        features |= {v: F.col(v)}
        for win in windows:
            features |= rolling(keys, ts, v, win)
        features |= same_slot_lags(keys, ts, v)
    return df.select(*keys, ts, *[c.alias(k) for k, c in features.items()])


def at_decisions(features: DataFrame, index: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return index.join(features.withColumnRenamed(ts, "t_dec"), [*keys, "t_dec"])


def with_copies(df: DataFrame, ts: str, rows_back: int, minutes: int, bucket_days: int, rows_ahead: int = 0) -> DataFrame:
    """`df` with each row in its bucket of time (`_own`) and in each other one (`_bucket`) whose halo reaches it."""
    moved = lambda rows: scan.bucket(F.timestamp_add("MINUTE", F.lit(rows * minutes), F.col(ts)), bucket_days)
    return df.withColumn("_own", moved(0)).withColumn(scan.BUCKET, F.explode(F.sequence(moved(-rows_ahead), moved(rows_back))))


def with_halo(df: DataFrame, keys: list[str], ts: str, rows_back: int, minutes: int, compute, bucket_days: int | None = 7, rows_ahead: int = 0, out_ts: str | None = None) -> DataFrame:
    """`compute(df, keys + bucket)` for very long series on a continuous grid, in parallel buckets of time.

    Each bucket also gets the last `rows_back` rows before it and the first `rows_ahead` after it, as copies that go
    again afterwards, so windows of that length see what they would see unbucketed.  `compute` keeps its keys and
    the time, as `out_ts` if not as `ts`.  With bucket_days None it is `compute(df, keys)`.
    """
    if bucket_days is None:
        return compute(df, keys)
    spread = with_copies(df, ts, rows_back, minutes, bucket_days, rows_ahead)
    own = scan.bucket(F.col(out_ts or ts), bucket_days) == F.col(scan.BUCKET)
    return compute(spread, [*keys, scan.BUCKET]).where(own).drop("_own", scan.BUCKET)


def daily_means(df: DataFrame, keys: list[str], ts: str, c: str, days: tuple[int, ...] = (3, 7)) -> DataFrame:
    """(keys, date, mean, mean_3d, mean_7d): daily means, and their means over the last present days."""
    daily = df.groupBy(*keys, F.to_date(ts).alias("date")).agg(F.avg(c).alias("mean"))
    return daily.select("*", *[F.avg("mean").over(_rows(keys, "date", 1 - d, 0)).alias(f"mean_{d}d") for d in days])


def trailing_stats(keys: list[str], ts: str, c: str) -> dict[str, Column]:
    """At each row: last value, mean and std of up to 96 rows, mean of up to 24, trend against the latter."""
    day, six = _rows(keys, ts, 1 - DAY, 0), _rows(keys, ts, -23, 0)
    mean24 = F.avg(c).over(six)
    return {"last": F.col(c), "mean_96": F.avg(c).over(day), "std_96": F.stddev_pop(c).over(day), "mean_24": mean24, "trend": F.col(c) - mean24}


def sample_quality(df: DataFrame, keys: list[str], ts: str, columns: list[str], future: list[str], look_back: int = 192, horizon: int = 24) -> DataFrame:
    """`df` with hist_ratio and future_ratio: shares of finite values in the look-back and in the horizon.

    Values are finite or null.  Windows that the series cuts off count as missing.
    """
    n = lambda cs: sum((F.col(c).isNotNull().cast("int") for c in cs), F.lit(0))
    hist = F.sum(n(columns)).over(_rows(keys, ts, 1 - look_back, 0)) / (look_back * len(columns))
    ahead = F.coalesce(F.sum(n(future)).over(_rows(keys, ts, 1, horizon)), F.lit(0)) / (horizon * len(future))
    return df.withColumns({"hist_ratio": hist, "future_ratio": ahead})


def wide_ratio(columns: list[str]) -> Column:
    """The share of finite values among `columns` of a row, as of attached wide forecasts."""
    return sum((F.coalesce(is_finite(F.col(c)), F.lit(False)).cast("int") for c in columns), F.lit(0)) / len(columns)


def sample_ratios(index: DataFrame, history: DataFrame, keys: list[str], ts: str, columns: list[str], wide: DataFrame, variables: list[str], baseline: DataFrame, base_name: str = "rtbase", look_back: int = 192, horizon: int = 24, days: int | None = None) -> DataFrame:
    """`index` with hist_ratio, future_ratio and base_ratio of each decision time.

    The history is that of `columns` over the look-back; the future is the wide forecasts of `variables`, the
    baseline those of `base_name` (<name>_h01 ...); a decision time that has none of them has ratio 0.
    """
    quality = lambda d, k: sample_quality(d, k, ts, columns, columns[:1], look_back, horizon)
    hist = with_halo(history, keys, ts, look_back, 15, quality, days, horizon).select(*keys, F.col(ts).alias("t_dec"), "hist_ratio")
    cells = lambda names: [f"{v}_h{h:02d}" for v in names for h in range(1, horizon + 1)]
    ahead = wide.select(*keys, "t_dec", wide_ratio(cells(variables)).alias("future_ratio"))
    base = baseline.select(*keys, "t_dec", wide_ratio(cells([base_name])).alias("base_ratio"))
    out = index.join(hist, [*keys, "t_dec"], "left").join(ahead, [*keys, "t_dec"], "left").join(base, [*keys, "t_dec"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("hist_ratio", "future_ratio", "base_ratio")})


def good_samples(df: DataFrame, hist: float = 0.98, future: float = 0.98, baseline: float = 1.0) -> DataFrame:
    """The rows whose ratios reach their thresholds; where there is a base_ratio, that one too."""
    good = (F.col("hist_ratio") >= hist) & (F.col("future_ratio") >= future)
    return df.where(good & (F.col("base_ratio") >= baseline) if "base_ratio" in df.columns else good)


def history_arrays(df: DataFrame, keys: list[str], ts: str, columns: list[str], look_back: int = 192) -> DataFrame:
    """(keys, ts, history): for rows with a full look-back, its rows as arrays, oldest first, nulls kept."""
    w = _rows(keys, ts, 1 - look_back, 0)
    rows = F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w)
    return df.select(*keys, ts, rows.alias("history")).where(F.size("history") == look_back)


def future_arrays(df: DataFrame, keys: list[str], ts: str, c: str, horizon: int = 24) -> DataFrame:
    """(keys, ts, future): the next `horizon` values of `c`, nulls kept, where there are as many rows."""
    rows = F.collect_list(F.struct(F.col(c).cast("double").alias("v"))).over(_rows(keys, ts, 1, horizon))
    return df.select(*keys, ts, F.transform(rows, lambda x: x["v"]).alias("future")).where(F.size("future") == horizon)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fill_window(windows: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Each array filled forward, then backward; one without any value stays as it is."""

    def fill(a):
        if a is None:
            return None
        x = np.array(a, float)
        at = np.where(np.isnan(x), -1, np.arange(len(x)))
        at = np.maximum.accumulate(at)
        known = np.flatnonzero(at >= 0)
        return x[np.where(at < 0, at[known[0]], at)] if len(known) else a

    for s in windows:
        yield s.map(fill, na_action=None)


def normalise_paths(df: DataFrame, c: str) -> DataFrame:
    """`df` with the array `c` less its mean, over its population deviation (1 if that is at most 1e-6); no nulls in it."""
    n = F.size(c)
    total = F.aggregate(c, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
    out = df.withColumn("_t", total).withColumn("_mean", F.col("_t.s") / n)
    out = out.withColumn("_std", F.sqrt(F.greatest(F.col("_t.q") / n - F.col("_mean") * F.col("_mean"), F.lit(0.0))))
    out = out.withColumn("_std", F.when(F.col("_std") > 1e-6, F.col("_std")).otherwise(1.0))
    return out.withColumn(c, F.transform(c, lambda x: (x - F.col("_mean")) / F.col("_std"))).drop("_t", "_mean", "_std")


def positions(df: DataFrame, keys: list[str], ts: str, days: int | None = None) -> DataFrame:
    """`df` with `position` (from 0) and `rows` of its series; `days` as in `scan`."""
    return scan.row_numbers(df, keys, ts, days, "position", "rows").withColumn("position", F.col("position") - 1)
