"""Forecasts of several variables over all horizons, each by its own method, and of reserves on top of them.

Rows are (keys, t_dec, split, var, h, tgt_time, y, base, x); one ridge model is fitted for each (var, h), over
all series or, with `by`, for each series too.  `x` has features of the decision's past and of the target time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.functions.calendar import STEP_MINUTES, target_time_features
from gridseries.functions.schema import check_methods
from gridseries.operators import forecast, lookups, metrics, models, windows
TRAINED = ("direct", "lag1d_residual", "pv_day_residual")
#: The daylight gate of pv_day_residual, unless given.
GATE = {"first_hour": 6, "last_hour": 18, "eps": 1.0}


def history_vectors(df: DataFrame, keys: list[str], ts: str, variables: list[str], days: int | None = None) -> DataFrame:
    """(keys, t_dec, past): the history features of `variables` as one array for each decision time.

    With `days`, which needs a continuous grid, long series go in parallel buckets of time.
    """
    back = max(*windows.WINDOWS, 2 * windows.DAY)
    features = windows.with_halo(df.select(*keys, ts, *dict.fromkeys(variables)), keys, ts, back, STEP_MINUTES, lambda d, k: windows.history_features(d, k, ts, variables), days)
    names = [c for c in features.columns if c not in {*keys, ts}]
    return features.select(*keys, F.col(ts).alias("t_dec"), models.vector([F.col(f"`{c}`") for c in names]).alias("past"))


def time_vector(tgt_time: Column) -> Column:
    return models.vector(list(target_time_features(tgt_time).values()))


def rows_of(index: DataFrame, df: DataFrame, keys: list[str], ts: str, variables: list[str]) -> DataFrame:
    """(keys, t_dec, split, var, h, tgt_time, y, base) of each variable: the value at the target time and a day before it.

    All variables are unpivoted first, so the future and the day before are joined once, not once for each.
    """
    values = df.select(*keys, ts, *[F.col(v).cast("double").alias(v) for v in variables]).unpivot([*keys, ts], variables, "var", "_v")
    names = F.explode(F.array(*map(F.lit, variables))).alias("var")
    rows = lookups.horizons(index.select(*keys, "t_dec", "split")).select("*", names)
    at = lambda shifted, name: values.select(*keys, "var", shifted.alias("tgt_time"), F.col("_v").alias(name))
    by = [*keys, "var", "tgt_time"]
    return rows.join(at(F.col(ts), "y"), by, "left").join(at(lookups.shift_days(F.col(ts), 1), "base"), by, "left")


def driver_forecasts(rows: DataFrame, methods: dict[str, str], by: list[str] | None = None, gate: dict | None = None, **ridge) -> DataFrame:
    """`rows` (with `x`) with y_hat and method, each variable by its method:

    direct: the model; lag1d: the base; lag1d_residual: base and model of y - base; pv_day_residual: that only
    where the daylight gate is open, else the base.  A (var, h) that has a model to fit and no usable row
    is an error.
    """
    check_methods(methods, sorted(methods))
    by, gate = [*(by or []), "var", "h"], GATE | (gate or {})
    method = F.create_map(*[F.lit(x) for kv in methods.items() for x in kv])[F.col("var")]
    rows = rows.withColumn("method", method)
    trained = rows.where(F.col("method").isin(*TRAINED))
    target = F.when(F.col("method") == "direct", F.col("y")).otherwise(F.col("y") - F.col("base"))
    is_open = (F.col("method") != "pv_day_residual") | forecast.daylight_gate(F.col("tgt_time"), F.col("base"), **gate)
    out = models.predict_vectors(rows, models.require_fitted(models.fit_vectors(trained, by, target, is_open, **ridge)), by)
    corrected = forecast.recompose(F.col("base"), F.col("r_hat"))
    y_hat = F.when(F.col("method") == "direct", F.col("r_hat")).when(F.col("method") == "lag1d", F.col("base")).when(is_open, corrected).otherwise(F.col("base"))
    return out.withColumn("y_hat", y_hat).drop("r_hat")


def with_prior(rows: DataFrame, index: DataFrame, df: DataFrame, keys: list[str], ts: str, variables: list[str], days: int | None = None) -> DataFrame:
    """`rows` with `prior`: the seasonal prior of their variable at the target time."""
    parts = []
    for v in variables:
        prior, overall = forecast.seasonal_prior(forecast.target_weights(index, df, keys, ts, v, days=days), keys, ts, v)
        parts.append(lookups.prior_lookup(rows.where(F.col("var") == v), prior, overall, keys))
    return reduce(DataFrame.unionByName, parts)


def reserve_forecasts(rows: DataFrame, drivers: DataFrame, keys: list[str], variables: list[str], by: list[str] | None = None, **ridge) -> DataFrame:
    """`rows` (with `x` and `prior`) with y_hat: the prior and a model of y - prior, which also sees the forecasts of `variables` in `drivers`."""
    by = [*(by or []), "var", "h"]
    staged = lookups.stage_one_features(rows, drivers, keys, variables)
    seen = staged.withColumn("x", F.concat("x", models.vector([F.col(f"pred_{v}") for v in variables])))
    residual = F.col("y") - F.col("prior")
    out = models.predict_vectors(seen, models.require_fitted(models.fit_vectors(seen, by, residual, F.lit(True), **ridge)), by)
    return out.withColumn("y_hat", forecast.recompose(F.col("prior"), F.col("r_hat"))).drop("r_hat", *[f"pred_{v}" for v in variables])


def with_features(rows: DataFrame, past: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with `x`: the features of their decision's past and of their target time."""
    return rows.join(past, [*keys, "t_dec"]).withColumn("x", F.concat("past", time_vector(F.col("tgt_time")))).drop("past")


def summary(long: DataFrame, tag: str) -> DataFrame:
    """The errors by split and variable of one set of forecasts."""
    return metrics.horizon_summary(metrics.horizon_metrics(long.withColumn("tag", F.lit(tag)), ["tag"]), ["tag"])
