"""Forecasts in closed form, and their long and wide shapes.

Long rows are (keys, t_dec, h, tgt_time, split, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions.calendar import STEP_MINUTES, shift, slot_id, weekend
from gridseries.operators.clean import finite_or_null, is_finite
from gridseries.operators.lookups import horizons
from gridseries.operators.order import quantiles
from gridseries.operators.windows import with_halo

MIN_PAIRS = 200


def median_residuals(rows: DataFrame, by: list[str], y: str = "y", base: str = "base", min_pairs: int = MIN_PAIRS, accuracy: int | None = None) -> DataFrame:
    """(by, correction): the median of y - base over training rows, 0 for fewer than `min_pairs` pairs.

    The median is exact, or with `accuracy` that of a sketch, see `order.quantiles`.
    """
    got = quantiles(rows.where("split = 'train'"), by, F.col(y) - F.col(base), 0.5, "_m", accuracy=accuracy)
    return got.select(*by, F.when(F.col("n") >= min_pairs, F.col("_m")).otherwise(0.0).alias("correction"))


def lag_residual(rows: DataFrame, by: list[str], base: str = "base", **options) -> DataFrame:
    """`rows` with y_hat = base + the correction of its group; a group that never was trained gets 0."""
    fix = median_residuals(rows, by, base=base, **options)
    joined = rows.join(fix, by, "left")
    return joined.withColumn("y_hat", F.coalesce(F.col(base) + F.coalesce("correction", F.lit(0.0)), F.col(base))).drop("correction")


def require_forecasts(rows: DataFrame, c: str = "y_hat", fallback: bool = False) -> DataFrame:
    """`rows`, if no forecast is missing or a fallback is allowed; else an error."""
    if not fallback and (gone := rows.where(F.col(c).isNull()).count()):
        raise ValueError(f"{gone} forecasts are missing")
    return rows


def recompose(base: Column, residual: Column) -> Column:
    """base + residual; null if either is."""
    return base + residual


def daylight_gate(tgt_time: Column, base: Column, first_hour: int = 6, last_hour: int = 18, eps: float = 1.0) -> Column:
    """Whether the hour is within both ends and the base is finite and above eps."""
    return F.coalesce(F.hour(tgt_time).between(first_hour, last_hour) & is_finite(base) & (base > eps), F.lit(False))


def gated(tgt_time: Column, base: Column, residual: Column, **gate) -> Column:
    return F.when(daylight_gate(tgt_time, base, **gate), base + residual).otherwise(base)


def target_weights(index: DataFrame, df: DataFrame, keys: list[str], ts: str, c: str, horizon: int = 24, days: int | None = None) -> DataFrame:
    """(keys, ts, c, times): how many (t_dec, h) of training decisions have each slot as their target.

    Counting decisions in the horizon before a slot replaces exploding each decision 24 times.  With `days`, which
    needs a continuous grid, long series go in parallel buckets of time.
    """
    train = index.where("split = 'train'").select(*keys, F.col("t_dec").alias(ts), F.lit(1).alias("_d"))
    rows = df.join(train, [*keys, ts], "left")

    def counted(d: DataFrame, k: list[str]) -> DataFrame:
        w = Window.partitionBy(*k).orderBy(ts).rowsBetween(-horizon, -1)
        return d.select(*k, ts, c, F.coalesce(F.count("_d").over(w), F.lit(0)).alias("times"))

    return with_halo(rows, keys, ts, horizon, STEP_MINUTES, counted, days).where("times > 0")


def seasonal_prior(weighted: DataFrame, keys: list[str], ts: str, c: str, by_month: bool = True, statistic: str = "median") -> tuple[DataFrame, DataFrame]:
    """(prior by (keys, month, is_weekend, slot), overall median by keys) of `target_weights` rows.

    An observation counts as often as it is a target.  Without by_month the prior is the same for all
    months; statistic may be mean; the overall one stays a median.
    """
    t = F.col(ts)
    rows = weighted.where(F.col(c).isNotNull()).withColumns({"month": F.month(t), "is_weekend": weekend(t), "slot": slot_id(t)})
    by = [*keys, *(["month"] if by_month else []), "is_weekend", "slot"]
    if statistic == "median":
        prior = quantiles(rows, by, F.col(c), 0.5, "prior", F.col("times")).drop("n")
    else:
        prior = rows.groupBy(*by).agg((F.sum(F.col(c) * F.col("times")) / F.sum("times")).alias("prior"))
    if not by_month:
        prior = prior.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return prior, quantiles(rows, keys, F.col(c), 0.5, "prior", F.col("times")).drop("n")


def use_source_forecast(rows: DataFrame, df: DataFrame, keys: list[str], ts: str, columns: dict[str, str]) -> DataFrame:
    """(rows, var, y_hat): source forecast columns at the target time; absent columns are skipped."""
    there = {v: c for v, c in columns.items() if c in df.columns}
    if not there:
        raise ValueError("no source forecast column")
    values = df.select(*keys, F.col(ts).alias("tgt_time"), F.explode(F.array(*[F.struct(F.lit(v).alias("var"), F.col(c).cast("double").alias("y_hat")) for v, c in there.items()])).alias("_p")).select(*keys, "tgt_time", "_p.*")
    return rows.join(values, [*keys, "tgt_time"])


def to_wide(long: DataFrame, keys: list[str], variables: list[str], horizon: int = 24, value: str = "y_hat", keep: tuple[str, ...] = ("split",)) -> DataFrame:
    """(keys, t_dec, keep, <var>_h01 ...): the pivot has all its columns given, so nothing is scanned for them."""
    names = [f"{v}_h{h:02d}" for v in variables for h in range(1, horizon + 1)]
    return long.withColumn("_n", F.format_string("%s_h%02d", "var", "h")).groupBy(*keys, "t_dec", *keep).pivot("_n", names).agg(F.first(value))


def to_long(wide: DataFrame, keys: list[str], variables: list[str], methods: dict[str, str], model_version: str, horizon: int = 24) -> DataFrame:
    """(keys, t_dec, h, tgt_time, var, y_hat, split, method, model_version, is_valid); what is not finite is null."""
    cell = lambda v, h: F.struct(F.lit(v).alias("var"), F.lit(h).alias("h"), F.col(f"{v}_h{h:02d}").cast("double").alias("y"))
    cells = F.array(*[cell(v, h) for v in variables for h in range(1, horizon + 1)])
    method = F.create_map(*[F.lit(x) for v in variables for x in (v, methods.get(v, ""))])
    long = wide.select(*keys, "t_dec", "split", F.explode(cells).alias("_c")).select(*keys, "t_dec", "split", "_c.var", "_c.h", finite_or_null(F.col("_c.y")).alias("y_hat"))
    return long.select(*keys, "t_dec", "h", shift(F.col("t_dec"), F.col("h")).alias("tgt_time"), "var", "y_hat", "split", method[F.col("var")].alias("method"), F.lit(model_version).alias("model_version"), F.col("y_hat").isNotNull().cast("int").alias("is_valid"))


def as_of_output(index: DataFrame, baseline: DataFrame, residual: DataFrame, keys: list[str], mu: float, sd: float, horizon: int = 24) -> DataFrame:
    """(keys, t, rt_pred) of one decision time: baseline + residual * sd + mu."""
    rows = horizons(index, horizon).join(baseline, [*keys, "t_dec", "h"]).join(residual, [*keys, "t_dec", "h"])
    return rows.select(*keys, F.col("tgt_time").alias("t"), (F.col("base") + F.col("r_hat") * sd + mu).alias("rt_pred")).orderBy(*keys, "t")
