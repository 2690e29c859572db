"""Joins on series keys, where null is a key like any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join(rows: DataFrame, other: DataFrame, by: list[str], where: Column | None = None, how: str = "inner") -> DataFrame:
    """`rows` joined with `other` on `by`, nulls being equal; without `by` every row of `other` is met, so it should be one row."""
    other = other.withColumnsRenamed({k: f"_r_{k}" for k in by})
    on = where if where is not None else F.lit(True)
    for k in by:
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`"))
    return rows.join(other, on, how).drop(*[f"_r_{k}" for k in by])
