"""Scalers fitted on training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.operators import keyed


def _safe(mean: Column, std: Column, least: float = 1e-8) -> tuple[Column, Column]:
    """A missing mean is 0, a missing or tiny deviation 1."""
    return F.coalesce(mean, F.lit(0.0)), F.when(std > least, std).otherwise(1.0)


def fit_scalers(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, var, mean, std) of each column, population deviation, in one pass over all columns."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(by, columns, "var", "_v")
    mean, std = _safe(F.avg("_v"), F.stddev_pop("_v"))
    return long.groupBy(*by, "var").agg(mean.alias("mean"), std.alias("std"))


def training_rows(df: DataFrame, index: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The rows up to the last training decision time of their series."""
    last = index.where("split = 'train'").groupBy(*keys).agg(F.max("t_dec").alias("_last"))
    joined = df.join(last, keys) if keys else df.crossJoin(last)
    return joined.where(F.col(ts) <= F.col("_last")).drop("_last")


def scaled_columns(df: DataFrame, scalers: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """`df` with each of `columns` scaled by the moments of its `by`; a row without scalers goes."""
    wide = scalers.groupBy(*by).pivot("var", columns).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    joined = keyed.join(df, wide, by)
    return joined.select(*[scaled(F.col(f"`{c}`"), F.col(f"`{c}_mean`"), F.col(f"`{c}_std`")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def fit_delta_scaler(rows: DataFrame, by: list[str], y: str = "y", base: str = "base") -> DataFrame:
    """(by, mu, sd) of y - base, pooled over all training (t_dec, h)."""
    d = F.col(y) - F.col(base)
    mu, sd = _safe(F.avg(d), F.stddev_pop(d))
    return rows.where("split = 'train'").groupBy(*by).agg(mu.alias("mu"), sd.alias("sd"))


def scaled(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / std


def unscaled(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean


def apply_scalers(long: DataFrame, scalers: DataFrame, by: list[str], value: str, inverse: bool = False) -> DataFrame:
    """`long` (by, var, value) with its values scaled, or scaled back."""
    joined = long.join(scalers, [*by, "var"])
    f = unscaled if inverse else scaled
    return joined.withColumn(value, f(F.col(value), F.col("mean"), F.col("std"))).drop("mean", "std")
