"""Cleaning: times, duplicates, numbers, the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.functions.calendar import STEP_MINUTES, floor_time
from gridseries.operators import scan


_CLOCK = r"(?:[ T]*(\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,6})?)?))?"
#: Ways to write a time beside ISO's: a pattern, and the same time as ISO has it.  Earlier ones win where several fit.
TIME_FORMATS = {
    "year/month/day": (rf"^\s*(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}}){_CLOCK}\s*$", "$1-$2-$3 $4"),
    "yearmonthday clock": (rf"^\s*(\d{{4}})(\d{{2}})(\d{{2}}){_CLOCK}\s*$", "$1-$2-$3 $4"),
    "14 digits": (r"^\s*(\d{4})(\d{2})(\d{2})[ T]?(\d{2})(\d{2})(\d{2})\s*$", "$1-$2-$3 $4:$5:$6"),
    "12 digits": (r"^\s*(\d{4})(\d{2})(\d{2})[ T]?(\d{2})(\d{2})\s*$", "$1-$2-$3 $4:$5"),
    "年月日 clock": (rf"^\s*(\d{{4}})\s*年\s*(\d{{1,2}})\s*月\s*(\d{{1,2}})\s*日?{_CLOCK}\s*$", "$1-$2-$3 $4"),
    "年月日时分": (r"^\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日\s*(\d{1,2})\s*[时点]\s*(\d{1,2})\s*分?\s*$", "$1-$2-$3 $4:$5"),
    "month/day/year": (rf"^\s*(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}}){_CLOCK}\s*$", "$3-$1-$2 $4"),
    "day/month/year": (rf"^\s*(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}}){_CLOCK}\s*$", "$3-$2-$1 $4"),
    "day.month.year": (rf"^\s*(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){_CLOCK}\s*$", "$3-$2-$1 $4"),
}
#: Rows that the order of formats is inferred from.
SAMPLE_ROWS = 10_000
_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"


def time_in(text: Column, name: str) -> Column:
    """The time without zone that `text` is in one of TIME_FORMATS, or null."""
    pattern, iso = TIME_FORMATS[name]
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, iso)).try_cast("timestamp_ntz")


def time_of(text: Column, formats: list[str] | None = None) -> Column:
    """The time without zone that `text` is: ISO's way, else the first of `formats` that gives one, or null."""
    return F.coalesce(text.try_cast("timestamp_ntz"), *[time_in(text, f) for f in formats or TIME_FORMATS])


def _is_text(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.simpleString() == "string"


def infer_formats(df: DataFrame, c: str, rows: int = SAMPLE_ROWS) -> list[str]:
    """TIME_FORMATS in the order of how many of the first `rows` texts they fit, so that 31/12/2024 settles what 1/2/2024 is."""
    if not _is_text(df, c):
        return list(TIME_FORMATS)
    text = F.col(f"`{c}`")
    one = df.select(text.alias("_t")).where("_t is not null").limit(rows)
    counts = one.agg(*[F.count(time_in(F.col("_t"), f)).alias(f"_{i}") for i, f in enumerate(TIME_FORMATS)]).first()
    return sorted(TIME_FORMATS, key=lambda f: -counts[list(TIME_FORMATS).index(f)])


def time_column(df: DataFrame, c: str, formats: list[str] | None = None) -> Column:
    """The column `c` as a time without zone: texts by `time_of`, other types by a cast."""
    return time_of(F.col(f"`{c}`"), formats) if _is_text(df, c) else F.col(f"`{c}`").try_cast("timestamp_ntz")


def parse_time(df: DataFrame, text: str, ts: str = "ts", drop: bool = True, formats: list[str] | None = None) -> DataFrame:
    """`ts` from text as a time without zone; rows whose text is no time go, unless drop is off."""
    out = df.withColumn(ts, time_column(df, text, formats))
    return out.where(F.col(ts).isNotNull()) if drop else out


def rejected_times(df: DataFrame, keys: list[str], text: str, ts: str) -> DataFrame:
    """(keys, n_no_time, n_rejected, rejected_first, rejected_last): rows without a text, with a text that is no time, and two of those."""
    t = F.trim(F.col(f"`{text}`").cast("string"))
    blank = t.isNull() | (t == "")
    bad = F.when(~blank & F.col(ts).isNull(), t)
    return df.groupBy(*keys).agg(F.count_if(blank).alias("n_no_time"), F.count(bad).alias("n_rejected"), F.min(bad).alias("rejected_first"), F.max(bad).alias("rejected_last"))


def to_number(c: Column) -> Column:
    """Double, or null for what is no number; neither hexadecimal digits nor a type's letter at the end make one."""
    return F.when(c.cast("string").rlike(_NUMBER), c.try_cast("double"))


def number_column(df: DataFrame, c: str) -> Column:
    """The column `c` as doubles: texts by `to_number`, other types by a cast."""
    return to_number(F.col(f"`{c}`")) if _is_text(df, c) else F.col(f"`{c}`").try_cast("double")


def is_finite(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c.cast("double"))


def value_class(c: Column) -> Column:
    """finite, nan (null too) or inf."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c), "nan").when(F.abs(c) == float("inf"), "inf").otherwise("finite")


def finite_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities become null, once; all later operators skip nulls."""
    return df.withColumns({c: finite_or_null(F.col(c)) for c in columns})


def keep_last(df: DataFrame, keys: list[str], slot: str, order: list[str]) -> DataFrame:
    """One row for each (keys, slot): the last by `order`.  Map tasks keep one row for each slot before the shuffle."""
    rest = [c for c in df.columns if c not in {*keys, slot}]
    last = df.groupBy(*keys, slot).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*keys, slot, *[F.col(f"_last.`{c}`").alias(c) for c in rest])


def steps(df: DataFrame, keys: list[str], ts: str, days: int | None = None) -> DataFrame:
    """`df` with `step_minutes` since the row before in its series; `days` as in `scan`."""
    placed = scan.previous(df, keys, ts, "_before", days)
    return placed.withColumn("step_minutes", F.timestamp_diff("SECOND", F.col("_before"), F.col(ts)) / 60).drop("_before")


def irregular_steps(df: DataFrame, keys: list[str], ts: str, minutes: int = STEP_MINUTES, days: int | None = None) -> DataFrame:
    """(keys, irregular): how many steps are not `minutes`."""
    return steps(df, keys, ts, days).groupBy(*keys).agg(F.count_if(F.col("step_minutes") != minutes).alias("irregular"))


def require_continuous(df: DataFrame, keys: list[str], ts: str, minutes: int = STEP_MINUTES, days: int | None = None) -> DataFrame:
    """`df`, if every step of every series is `minutes`; else an error."""
    bad = irregular_steps(df, keys, ts, minutes, days).where("irregular > 0").agg(F.count("*"), F.sum("irregular")).first()
    if bad[0]:
        raise ValueError(f"{bad[1]} steps of {bad[0]} series are not {minutes} minutes; put them on the grid first")
    return df


def grid(df: DataFrame, keys: list[str], ts: str, minutes: int = STEP_MINUTES) -> DataFrame:
    """(keys, ts): every slot from the first to the last of each series, made on the executors."""
    span = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    return span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"interval {minutes} minutes"))).alias(ts))


def on_grid(df: DataFrame, keys: list[str], ts: str, minutes: int = STEP_MINUTES) -> DataFrame:
    return grid(df, keys, ts, minutes).join(df, [*keys, ts], "left")


def fill_forward(df: DataFrame, keys: list[str], ts: str, columns: list[str], days: int | None = None) -> DataFrame:
    return scan.fill_forward(df, keys, ts, columns, days)


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, missing), most first: one pass over all columns."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], columns, "col", "missing").orderBy(F.desc("missing"), "col")


def finite_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(is_finite(F.col(target)))


def regular_slots(df: DataFrame, keys: list[str], ts: str, order: list[str], slot: str = "slot", minutes: int = STEP_MINUTES) -> DataFrame:
    """Floors times to the grid and keeps the last row of each slot."""
    floored = df.where(F.col(ts).isNotNull()).withColumn(slot, floor_time(F.col(ts), minutes))
    return keep_last(floored, keys, slot, [ts, *order])
