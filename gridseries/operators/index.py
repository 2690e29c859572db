"""Decision times, cut-offs, splits and sample weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions.calendar import STEP_MINUTES, floor_time, shift
from gridseries.operators import scan
from gridseries.operators.clean import is_finite
from gridseries.operators.order import quantiles

HORIZON, LOOK_BACK, SLOTS_A_DAY = 24, 192, 96
EXOGENOUS = ["load", "pv", "line", "ru", "rd"]


def last_valid_times(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """(keys, one column each): the last time of a finite value."""
    return df.groupBy(*keys).agg(*[F.max(F.when(is_finite(F.col(c)), F.col(ts))).alias(c) for c in columns])


def required_columns(mode: str, optional: list[str] | None = None) -> list[str]:
    """rt_chain: both prices and the exogenous variables; exog_only: those alone."""
    if mode not in ("rt_chain", "exog_only"):
        raise ValueError(f"mode is rt_chain or exog_only, not {mode!r}")
    return [*(["rt", "da"] if mode == "rt_chain" else []), *EXOGENOUS, *(optional or [])]


def cutoff(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """(keys, cutoff, skipped): the earliest last valid time; columns that are absent or empty are skipped and named."""
    there = [c for c in columns if c in df.columns]
    if not there:
        raise ValueError(f"none of {columns} is a column")
    last = last_valid_times(df, keys, ts, there)
    absent = [F.struct(F.lit(c).alias("col"), F.lit("absent").alias("reason")) for c in columns if c not in there]
    empty = F.filter(F.array(*[F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("col"), F.lit("empty").alias("reason"))) for c in there]), lambda x: x.isNotNull())
    least = F.least(*[F.col(c) for c in there]) if len(there) > 1 else F.col(there[0])
    return last.select(*keys, least.alias("cutoff"), (F.concat(F.array(*absent), empty) if absent else empty).alias("skipped"))


def require_cutoffs(cutoffs: DataFrame) -> DataFrame:
    """`cutoffs`, if each series has one; an error if all required columns of a series are empty."""
    if none := cutoffs.where("cutoff is null").count():
        raise ValueError(f"{none} series have no finite value in any required column")
    return cutoffs


def decision_index(df: DataFrame, keys: list[str], ts: str, look_back: int = LOOK_BACK, horizon: int = HORIZON, minutes: int = STEP_MINUTES, days: int | None = None) -> DataFrame:
    """(keys, t_dec, tgt_max_time, date_tgt_max): the rows with a full look-back and a full horizon of rows; `days` as in `scan`."""
    placed = scan.row_numbers(df.select(*keys, ts), keys, ts, days)
    got = placed.where((F.col("_rn") >= look_back) & (F.col("_rn") <= F.col("_n") - horizon))
    end = shift(F.col(ts), horizon, minutes)
    return got.select(*keys, F.col(ts).alias("t_dec"), end.alias("tgt_max_time"), F.to_date(end).alias("date_tgt_max"))


def before_cutoff(index: DataFrame, cutoffs: DataFrame, keys: list[str]) -> DataFrame:
    """The decision times whose whole horizon is known."""
    joined = index.join(cutoffs.select(*keys, "cutoff"), keys) if keys else index.crossJoin(cutoffs.select("cutoff"))
    return joined.where("tgt_max_time <= cutoff").drop("cutoff")


def split_by_day(index: DataFrame, keys: list[str], val_days: int, test_days: int, full_days: bool = True) -> DataFrame:
    """`index` with `split`: the last eligible target days are test, those before them val, the rest train.

    With full_days a day is eligible if it has exactly 96 decision times; others go altogether.  The
    days are a small frame that is joined back on (keys, day).
    """
    days = index.groupBy(*keys, "date_tgt_max").agg(F.count("*").alias("_n"))
    if full_days:
        days = days.where(F.col("_n") == SLOTS_A_DAY)
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date_tgt_max")))
    days = days.withColumn("split", F.when(back <= test_days, "test").when(back <= test_days + val_days, "val").otherwise("train")).drop("_n")
    return index.join(days, [*keys, "date_tgt_max"])


def require_days(index: DataFrame, keys: list[str], days: int, full_days: bool = True) -> None:
    """An error if a series has fewer than `days` eligible days, which have exactly 96 decision times unless full_days is off."""
    by_day = index.groupBy(*keys, "date_tgt_max").agg(F.count("*").alias("_n"))
    eligible = F.count_if(F.col("_n") == SLOTS_A_DAY) if full_days else F.count("*")
    few = by_day.groupBy(*keys).agg(eligible.alias("n")).where(F.col("n") < days).count()
    if few:
        raise ValueError(f"{few} series have fewer than {days} eligible days")


def require_rows(df: DataFrame, keys: list[str], val_days: int, test_days: int) -> None:
    """An error if a series has no row left to train on when the last val_days and test_days are cut off by rows."""
    least = (val_days + test_days) * SLOTS_A_DAY
    few = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") <= least).count()
    if few:
        raise ValueError(f"{few} series have {least} rows or fewer: none is left to train on")


def split_by_rows(df: DataFrame, keys: list[str], ts: str, val_days: int, test_days: int) -> DataFrame:
    """`df` with `split` by row counts: the last test_days * 96 rows are test, the val_days * 96 before them val.

    Counts of days and their running sums place a day; only rows within a day are ordered.
    """
    day = F.to_date(ts)
    days = df.groupBy(*keys, day.alias("_day")).agg(F.count("*").alias("_n"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "_day", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_after"))
    placed = df.withColumn("_day", day).join(days, [*keys, "_day"])
    back = F.col("_after") + F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(F.desc(ts)))
    test, val = test_days * SLOTS_A_DAY, (test_days + val_days) * SLOTS_A_DAY
    return placed.withColumn("split", F.when(back <= test, "test").when(back <= val, "val").otherwise("train")).drop("_day", "_after")


def split_ranges(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return df.groupBy(*keys, "split").agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def high_price_weights(df: DataFrame, keys: list[str], target: str, segment: str, in_segment: int = 2, quantile: float = 0.85, weight: float = 1.5) -> DataFrame:
    """`df` with `weight`: more for targets at or above the exact quantile of the training rows of one segment."""
    train = df.where((F.col("split") == "train") & (F.col(segment) == in_segment))
    threshold = quantiles(train, keys, F.col(target), quantile, "_thr").drop("n")
    joined = df.join(threshold, keys, "left") if keys else df.join(threshold, F.lit(True), "left")  # without keys one row at most
    high = (F.col(segment) == in_segment) & (F.col(target) >= F.col("_thr"))
    return joined.withColumn("weight", F.when(high, weight).otherwise(1.0)).drop("_thr")


def last_decision(index: DataFrame, keys: list[str]) -> DataFrame:
    return index.groupBy(*keys).agg(F.max("t_dec").alias("t_dec"))


def as_of(index: DataFrame, time: str, minutes: int = STEP_MINUTES) -> DataFrame:
    """The decision times at `time`, floored to the grid; an error if there is none."""
    got = index.where(F.col("t_dec") == floor_time(F.lit(time).cast("timestamp_ntz"), minutes))
    if not got.limit(1).count():
        raise ValueError(f"{time} is no decision time")
    return got
