"""Audit of time axes and coverage.

`keys` are the series keys; an empty list is one series.  Slots are on the grid (floored, deduplicated).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions.calendar import STEP_MINUTES, floor_time
from gridseries.operators import keyed, scan
from gridseries.operators.clean import is_finite, steps, value_class


def gaps(present: DataFrame, keys: list[str], ts: str, minutes: int = STEP_MINUTES, days: int | None = None) -> DataFrame:
    """(keys, first, last, n): the runs of slots between its first and last that a series lacks, from the steps between its rows.

    A gap is one row, however long; `days` as in `scan`.
    """
    placed = scan.previous(present.select(*keys, ts), keys, ts, "_before", days)
    n = F.floor((F.timestamp_diff("SECOND", F.col("_before"), F.col(ts)) - 1) / (minutes * 60))
    moved = lambda c, k: F.timestamp_add("MINUTE", F.lit(k), F.col(c))
    return placed.withColumn("n", n).where("n > 0").select(*keys, moved("_before", minutes).alias("first"), moved(ts, -minutes).alias("last"), "n")


def missing_slots(present: DataFrame, keys: list[str], ts: str, minutes: int = STEP_MINUTES, days: int | None = None) -> DataFrame:
    """Slots of the full grid that a series lacks."""
    each = F.sequence("first", "last", F.expr(f"interval {minutes} minutes"))
    return gaps(present, keys, ts, minutes, days).select(*keys, F.explode(each).alias(ts))


def extra_slots(present: DataFrame, keys: list[str], ts: str, minutes: int = STEP_MINUTES) -> DataFrame:
    """Slots of a series that are not a number of steps after its first; none if it was floored."""
    first = present.groupBy(*keys).agg(F.min(ts).alias("_first"))
    off = F.pmod(F.timestamp_diff("MICROSECOND", F.col("_first"), F.col(ts)), F.lit(minutes * 60_000_000)) != 0
    return keyed.join(present.select(*keys, ts), first, keys).where(off).drop("_first")


def missing_samples(present: DataFrame, keys: list[str], ts: str, n: int = 10, minutes: int = STEP_MINUTES, days: int | None = None) -> DataFrame:
    """(keys, ts, rank, end): the first and last n missing slots of each series, from its first and last n gaps."""
    found, parts = gaps(present, keys, ts, minutes, days), []
    for end, edge, back in (("head", "first", 1), ("tail", "last", -1)):
        order = F.col(edge) if back > 0 else F.desc(edge)
        w = Window.partitionBy(*keys).orderBy(order)
        few = found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)  # tasks keep n of a series before they meet
        before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        each = few.withColumn("_taken", before).withColumn("_o", F.explode(F.array(*[F.lit(i) for i in range(n)]))).where((F.col("_o") < F.col("n")) & (F.col("_taken") + F.col("_o") < n))
        slot = F.timestamp_add("MINUTE", (F.col("_o") * (back * minutes)).cast("int"), F.col(edge))
        parts.append(each.select(*keys, slot.alias(ts), (F.col("_taken") + F.col("_o") + 1).cast("int").alias("rank"), F.lit(end).alias("end")))
    return parts[0].unionByName(parts[1])


def gap_counts(present: DataFrame, keys: list[str], ts: str, minutes: int = STEP_MINUTES, days: int | None = None) -> DataFrame:
    """(keys, n_gaps): how many steps are longer than `minutes`; `days` as in `scan`."""
    return steps(present, keys, ts, days).groupBy(*keys).agg(F.count_if(F.col("step_minutes") > minutes).alias("n_gaps"))


def time_axis_report(raw: DataFrame, keys: list[str], ts: str, minutes: int = STEP_MINUTES, days: int | None = None) -> DataFrame:
    """One row for each series: rows, parsed times, duplicates, span, grid size, missing and extra slots, gaps, samples.

    `raw` has times as parsed, null where that failed.  Rows are counted before null times go.  Missing
    slots are the grid's size less the slots present, as floored slots are all on the grid.
    """
    floored = raw.withColumn("_slot", floor_time(F.col(ts), minutes))
    rows = floored.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count(ts).alias("n_parsed"),
        F.countDistinct("_slot").alias("n_slots"),
        F.min("_slot").alias("time_min"),
        F.max("_slot").alias("time_max"),
    )
    rows = rows.withColumn("n_duplicates", F.col("n_parsed") - F.col("n_slots"))
    rows = rows.withColumn("n_expected", F.when(F.col("n_slots") > 0, F.floor(F.timestamp_diff("MINUTE", F.col("time_min"), F.col("time_max")) / minutes) + 1).otherwise(0))
    rows = rows.withColumn("n_missing", F.col("n_expected") - F.col("n_slots"))
    slots = floored.where("_slot is not null").select(*keys, F.col("_slot").alias("slot")).distinct()
    n_gaps = gaps(slots, keys, "slot", minutes, days).groupBy(*keys).agg(F.count("*").alias("n_gaps"))
    extra = extra_slots(slots, keys, "slot", minutes).groupBy(*keys).agg(F.count("*").alias("n_extra"))
    sample = missing_samples(slots, keys, "slot", 10, minutes, days).groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col("end") == e, F.col("slot").cast("string")))).alias(f"missing_{e}") for e in ("head", "tail")])
    out = _join(_join(_join(rows, n_gaps, keys), extra, keys), sample, keys)
    none = F.array().cast("array<string>")
    return out.withColumns({"n_gaps": F.coalesce("n_gaps", F.lit(0)), "n_extra": F.coalesce("n_extra", F.lit(0)), "missing_head": F.coalesce("missing_head", none), "missing_tail": F.coalesce("missing_tail", none)})


def _join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return keyed.join(a, b, keys, how="left")  # without keys both are one row


def require_complete(report: DataFrame) -> None:
    """Strict mode: an error if any series lacks a slot or has a gap."""
    bad = report.where("n_missing > 0 or n_gaps > 0").count()
    if bad:
        raise ValueError(f"{bad} series lack slots")


def long_form(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """(keys, ts, col, value)."""
    typed = df.select(*keys, ts, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot([*keys, ts], columns, "col", "value")


def _missing(value: Column) -> Column:
    return ~is_finite(value)


def missing_blocks(df: DataFrame, keys: list[str], ts: str, columns: list[str], min_len: int = 4, days: int | None = None) -> DataFrame:
    """(keys, col, start_time, end_time, length): runs of at least `min_len` rows without a finite value.

    Blocks run over rows that exist; slots that are absent do not lengthen them.  The rows of a block have the
    same number of finite values before them, which is counted for all columns in one sort; `days` as in `scan`.
    """
    finite = {f"_g{i}": is_finite(F.col(f"`{c}`")) for i, c in enumerate(columns)}
    counted = scan.running_counts(df.select(*keys, ts, *[f"`{c}`" for c in columns]), keys, ts, finite, days)
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.when(_missing(F.col(f"`{c}`")), F.col(f"_g{i}")).alias("_island")) for i, c in enumerate(columns)])
    bad = counted.select(*keys, ts, F.explode(F.filter(cells, lambda x: x["_island"].isNotNull())).alias("_cell")).select(*keys, ts, "_cell.*")
    blocks = bad.groupBy(*keys, "col", "_island").agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.count("*").alias("length"))
    return blocks.where(F.col("length") >= min_len).drop("_island")


def column_summary(df: DataFrame, keys: list[str], ts: str, columns: list[str], min_len: int = 4, days: int | None = None) -> DataFrame:
    """Coverage, span, leading and trailing gaps, blocks and finite-only moments of each column; `days` as in `scan`."""
    numbered = scan.row_numbers(df, keys, ts, days)
    long = long_form(numbered, [*keys, "_rn", "_n"], ts, columns)
    v = F.when(is_finite(F.col("value")), F.col("value"))
    kind = value_class(F.col("value"))
    stats = long.groupBy(*keys, "col").agg(
        F.count("*").alias("total"),
        F.count(v).alias("finite_cnt"),
        F.count_if(kind == "nan").alias("nan_cnt"),
        F.count_if(kind != "finite").alias("nonfinite_cnt"),
        F.min(F.when(v.isNotNull(), F.col(ts))).alias("first_valid_time"),
        F.max(F.when(v.isNotNull(), F.col(ts))).alias("last_valid_time"),
        F.coalesce(F.min(F.when(v.isNotNull(), F.col("_rn"))) - 1, F.max("_n")).alias("leading_missing"),
        F.coalesce(F.max("_n") - F.max(F.when(v.isNotNull(), F.col("_rn"))), F.max("_n")).alias("trailing_missing"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
    )
    blocks = missing_blocks(df, keys, ts, columns, min_len, days).groupBy(*keys, "col").agg(F.count("*").alias("n_blocks"), F.max("length").alias("longest_block"))
    out = stats.join(blocks, [*keys, "col"], "left").withColumns({"finite_ratio": F.col("finite_cnt") / F.col("total"), "n_blocks": F.coalesce("n_blocks", F.lit(0)), "longest_block": F.coalesce("longest_block", F.lit(0))})
    return out.orderBy("finite_ratio", "col", *keys)


def worst_columns(summary: DataFrame, n: int = 15) -> DataFrame:
    return summary.orderBy("finite_ratio", "col").limit(n)


def daily_coverage(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """(keys, date, col, ratio): the share of finite values among the rows of a day."""
    long = long_form(df, keys, ts, columns)
    return long.groupBy(*keys, F.to_date(ts).alias("date"), "col").agg(F.avg(is_finite(F.col("value")).cast("int")).alias("ratio"))


def daily_coverage_wide(coverage: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return coverage.groupBy(*keys, "date").pivot("col", columns).agg(F.first("ratio")).orderBy(*keys, "date")


def daily_overall(coverage: DataFrame, keys: list[str]) -> DataFrame:
    return coverage.groupBy(*keys, "date").agg(
        F.min("ratio").alias("min_ratio"),
        F.avg("ratio").alias("mean_ratio"),
        F.count_if(F.col("ratio") < 1).alias("cols_with_any_missing"),
        F.count_if(F.col("ratio") == 0).alias("cols_all_missing"),
    )
