"""Joins of a series with its own past and future.

Day frames have one row for each (keys, date), 96 times fewer than slots; Spark broadcasts them where
they are small and otherwise joins on (keys, date).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions.calendar import shift, shift_days, slot_id, weekend
from gridseries.operators.windows import daily_means, trailing_stats


def day_stats(df: DataFrame, keys: list[str], ts: str, c: str) -> DataFrame:
    """(keys, date, mean, max, min, std and four 6-hour blocks' mean and std) of each day."""
    block = F.floor(F.hour(ts) / 6)
    v = F.col(c)
    stats = [F.avg(v).alias("d_mean"), F.max(v).alias("d_max"), F.min(v).alias("d_min"), F.stddev_pop(v).alias("d_std")]
    for b in range(4):
        x = F.when(block == b, v)
        stats += [F.avg(x).alias(f"b{b}_mean"), F.stddev_pop(x).alias(f"b{b}_std")]
    return df.groupBy(*keys, F.to_date(ts).alias("date")).agg(*stats)


def previous_day_stats(df: DataFrame, keys: list[str], ts: str, c: str) -> DataFrame:
    """`df` with the statistics of the calendar day before; rows whose day before is absent go."""
    before = day_stats(df, keys, ts, c).withColumn("date", F.date_add("date", 1))
    return df.withColumn("date", F.to_date(ts)).join(before, [*keys, "date"])


def same_slot_before(df: DataFrame, keys: list[str], ts: str, c: str, days: int = 1, name: str | None = None) -> DataFrame:
    """`df` with the value exactly `days` calendar days earlier, null if that slot is absent."""
    past = df.select(*keys, shift_days(F.col(ts), days).alias(ts), F.col(c).alias(name or f"{c}_d{days}"))
    return df.join(past, [*keys, ts], "left")


def as_of_daily(df: DataFrame, keys: list[str], ts: str, c: str, hour: int = 9) -> DataFrame:
    """(keys, date, last, mean_96, std_96, mean_24, trend) for the day after each day of `df`: the
    trailing statistics of the last row at or before `hour` o'clock, taken from any earlier day.

    The last row of each day up to the hour is found by aggregation and carried forward over days, so
    nothing is compared with all of history.
    """
    cut = F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour))
    # A row after the hour serves the next day's cut-off.
    day = F.when(F.col(ts) <= cut, F.to_date(ts)).otherwise(F.date_add(F.to_date(ts), 1))
    stats = trailing_stats(keys, ts, c)
    rows = df.select(*keys, day.alias("cut_day"), F.col(ts).alias("_ts"), *[v.alias(k) for k, v in stats.items()])
    by_day = rows.groupBy(*keys, "cut_day").agg(F.max_by(F.struct(F.col("_ts").alias("as_of"), *stats), "_ts").alias("s"))
    wanted = df.select(*keys, F.to_date(ts).alias("cut_day")).distinct()
    # as_of is never null, so the last non-null struct is the latest row, even if its value is null.
    filled = wanted.join(by_day, [*keys, "cut_day"], "full").withColumn("s", F.last("s", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("cut_day")))
    return filled.join(wanted, [*keys, "cut_day"], "left_semi").where("s is not null").select(*keys, F.date_add("cut_day", 1).alias("date"), "s.*")


def previous_day_means(df: DataFrame, keys: list[str], ts: str, c: str) -> DataFrame:
    """(keys, date, prev_mean, prev_mean_3d, prev_mean_7d, d7_mean): of the day before, and of the day a
    week before or else the day before's 7-day mean; for the days of `df`."""
    m = daily_means(df, keys, ts, c)
    before = m.select(*keys, F.date_add("date", 1).alias("date"), F.col("mean").alias("prev_mean"), F.col("mean_3d").alias("prev_mean_3d"), F.col("mean_7d").alias("prev_mean_7d"))
    week = m.select(*keys, F.date_add("date", 7).alias("date"), F.col("mean").alias("_week"))
    out = m.select(*keys, "date").join(before, [*keys, "date"], "left").join(week, [*keys, "date"], "left")
    return out.withColumn("d7_mean", F.coalesce("_week", "prev_mean_7d")).drop("_week")


def horizons(index: DataFrame, horizon: int = 24, minutes: int = 15) -> DataFrame:
    """`index` with h = 1..horizon and tgt_time; explode before anything wide is joined."""
    return index.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("tgt_time", shift(F.col("t_dec"), F.col("h"), minutes))


def future_values(index: DataFrame, df: DataFrame, keys: list[str], ts: str, c: str, name: str = "y", horizon: int = 24) -> DataFrame:
    """(index, h, tgt_time, name): the value at each target time."""
    values = df.select(*keys, F.col(ts).alias("tgt_time"), F.col(c).alias(name))
    return horizons(index, horizon).join(values, [*keys, "tgt_time"], "left")


def target_lag(rows: DataFrame, df: DataFrame, keys: list[str], ts: str, c: str, days: int = 1, name: str = "base") -> DataFrame:
    """`rows` (with tgt_time) and the value `days` days before the target time."""
    values = df.select(*keys, shift_days(F.col(ts), days).alias("tgt_time"), F.col(c).alias(name))
    return rows.join(values, [*keys, "tgt_time"], "left")


def future_with_lag(df: DataFrame, keys: list[str], ts: str, c: str, horizon: int = 24, day: int = 96) -> DataFrame:
    """(keys, t_dec, h, tgt_time, y, base) on a continuous grid, by window offsets instead of joins: one sort."""
    w = Window.partitionBy(*keys).orderBy(ts)
    pairs = F.array(*[F.struct(F.lit(h).alias("h"), F.lead(c, h).over(w).alias("y"), (F.lag(c, day - h).over(w) if h < day else F.col(c)).alias("base")) for h in range(1, horizon + 1)])
    return df.select(*keys, F.col(ts).alias("t_dec"), pairs.alias("_a")).select(*keys, "t_dec", F.explode("_a").alias("_p")).select(*keys, "t_dec", "_p.h", shift(F.col("t_dec"), F.col("_p.h")).alias("tgt_time"), "_p.y", "_p.base")


def prior_lookup(rows: DataFrame, prior: DataFrame, overall: DataFrame, keys: list[str], tgt_time: str = "tgt_time") -> DataFrame:
    """`rows` with `prior`: by (keys, month, weekend, slot) of the target time, else the overall one."""
    t = F.col(tgt_time)
    marked = rows.withColumns({"month": F.month(t), "is_weekend": weekend(t), "slot": slot_id(t)})
    joined = marked.join(prior, [*keys, "month", "is_weekend", "slot"], "left")
    joined = joined.join(overall.withColumnRenamed("prior", "_all"), keys, "left") if keys else joined.crossJoin(overall.withColumnRenamed("prior", "_all"))
    return joined.withColumn("prior", F.coalesce("prior", "_all")).drop("_all", "month", "is_weekend", "slot")


def train_rows(rows: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """The rows at training decision times."""
    return rows.join(index.where("split = 'train'").select(*keys, "t_dec"), [*keys, "t_dec"], "left_semi")


def keep_days(rows: DataFrame, days: DataFrame, keys: list[str], day: str) -> DataFrame:
    return rows.join(days.select(*keys, day), [*keys, day], "left_semi")


def stage_one_features(rows: DataFrame, predictions: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """`rows` with the predictions of `variables` for the same (t_dec, h) as columns pred_<var>."""
    wide = predictions.groupBy(*keys, "t_dec", "h").pivot("var", variables).agg(F.first("y_hat"))
    wide = wide.select(*keys, "t_dec", "h", *[F.col(v).alias(f"pred_{v}") for v in variables])
    return rows.join(wide, [*keys, "t_dec", "h"])


def attach_wide(rows: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with wide forecasts of their decision time, null where there are none."""
    return rows.join(wide, [*keys, "t_dec"], "left")
