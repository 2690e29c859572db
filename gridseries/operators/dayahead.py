"""The day-ahead feature table: what is known at 9 o'clock of the day before."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.functions.calendar import day_ahead_features, segment
from gridseries.functions.schema import choose_exogenous
from gridseries.operators.clean import is_finite
from gridseries.operators.lookups import as_of_daily, day_stats, previous_day_means, same_slot_before


def feature_table(df: DataFrame, keys: list[str], ts: str, target: str = "da", rt: str = "rt", exogenous: dict[str, tuple[str | None, str | None]] | None = None) -> DataFrame:
    """(keys, ts, date, segment, features, target) of all slots whose day before exists and whose target is finite.

    `exogenous` maps a feature to its (forecast, actual) columns; the forecast is taken if the table
    has it, else the actual one, with a warning, as that one knows the future.
    """
    extra = {}
    for name, (forecast, actual) in (exogenous or {}).items():
        c = choose_exogenous(df.columns, forecast, actual)
        if c is not None:
            if c != forecast:
                warnings.warn(f"{name}: the actual column {c} stands in for a forecast and leaks the future", stacklevel=2)
            extra[name] = F.col(c).cast("double")
    days = day_stats(df, keys, ts, target).withColumn("date", F.date_add("date", 1))
    days = days.join(previous_day_means(df, keys, ts, target), [*keys, "date"], "left")
    rt_days = as_of_daily(df, keys, ts, rt).select(*keys, "date", *[F.col(c).alias(f"rt_{c}") for c in ("last", "mean_96", "std_96", "mean_24", "trend")])
    days = days.join(rt_days, [*keys, "date"], "left")
    calendar = day_ahead_features(F.col(ts))
    slots = same_slot_before(df, keys, ts, target, 1, "same_slot_d1")
    slots = slots.select(*keys, ts, F.to_date(ts).alias("date"), segment(F.col(ts)).alias("segment"), F.col(target).alias("y"), "same_slot_d1", *[c.alias(k) for k, c in calendar.items()], *[c.alias(f"x_{k}") for k, c in extra.items()])
    return slots.join(days, [*keys, "date"]).where(is_finite(F.col("y")))


def feature_names(table: DataFrame, keys: list[str], ts: str) -> list[str]:
    return [c for c in table.columns if c not in {*keys, ts, "date", "segment", "y", "split", "weight"}]
