"""Errors of forecasts against actuals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.operators.clean import is_finite


def both_finite(y: Column, p: Column) -> Column:
    return is_finite(y) & is_finite(p)


def error_columns(y: Column, p: Column) -> dict[str, Column]:
    """n, mae, rmse, bias, corr and mape of the rows where both are finite.

    corr is null unless there are two rows and neither side is constant; mape leaves out actuals
    within 1e-9 of zero.
    """
    ok = both_finite(y, p)
    a, b = F.when(ok, y.cast("double")), F.when(ok, p.cast("double"))
    e = b - a
    varies = (F.count(e) >= 2) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return {
        "n": F.count(e),
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "bias": F.avg(e),
        "corr": F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))),
        "mape": F.avg(F.when(F.abs(a) > 1e-9, F.abs(e) / F.abs(a))) * 100,
    }


def pair_report(df: DataFrame, by: list[str], actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """`error_columns` for each group, best first; groups without a pair come last."""
    got = df.groupBy(*by).agg(*[c.alias(k) for k, c in error_columns(F.col(actual), F.col(forecast)).items()])
    return got.orderBy(F.asc_nulls_last("rmse"), F.asc_nulls_last("mae"), *by)


def pairs_long(df: DataFrame, keep: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(keep, variable, actual, forecast) from wide columns, one row for each pair."""
    each = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"`{a}`").cast("double").alias("actual"), F.col(f"`{f}`").cast("double").alias("forecast")) for v, (a, f) in pairs.items()])
    return df.select(*keep, F.explode(each).alias("_p")).select(*keep, "_p.*")


def recent_overlap(df: DataFrame, by: list[str], ts: str, days: int, actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """The rows of the last `days` days up to the end of each pair.

    The end is the last time both are valid; else the earlier of their own last times; else the last
    time.  Rows without a time go; both ends count.
    """
    rows = df.where(F.col(ts).isNotNull())
    a, f = is_finite(F.col(actual)), is_finite(F.col(forecast))
    last = lambda ok: F.max(F.when(ok, F.col(ts)))
    ends = rows.groupBy(*by).agg(last(a & f).alias("_both"), last(a).alias("_a"), last(f).alias("_f"), F.max(ts).alias("_any"))
    ends = ends.select(*by, F.coalesce("_both", F.when(F.col("_a").isNotNull() & F.col("_f").isNotNull(), F.least("_a", "_f")), "_any").alias("_end"))
    return rows.join(ends, by).where((F.col(ts) <= F.col("_end")) & (F.col(ts) >= F.col("_end") - F.make_dt_interval(F.lit(days)))).drop("_end")


def split_scores(df: DataFrame, by: list[str], y: str = "y", p: str = "y_hat") -> DataFrame:
    e = error_columns(F.col(y), F.col(p))
    return df.groupBy(*by).agg(*[e[k].alias(k) for k in ("n", "mae", "rmse")])


def compare_models(df: DataFrame, y: str, models: dict[str, str], dataset: str = "split") -> DataFrame:
    """(model, dataset, mae, rmse, n): each forecast column against `base` on the rows where both are finite.

    The first of `models` is the one that the others are compared with; each other gives two rows.
    """
    (base, base_col), *others = models.items()
    reports = []
    for name, c in others:
        ok = both_finite(F.col(y), F.col(c)) & is_finite(F.col(base_col))
        for label, col in ((name, c), (f"{base} on {name}", base_col)):
            e = error_columns(F.when(ok, F.col(y)), F.col(col))
            reports.append(F.struct(F.lit(label).alias("model"), *[e[k].alias(k) for k in ("mae", "rmse", "n")]))
    # One scan and one aggregation for all of them.
    got = df.groupBy(F.col(dataset).alias("dataset")).agg(F.array(*reports).alias("_r")).select("dataset", F.explode("_r").alias("_r"))
    return got.select("_r.model", "dataset", "_r.mae", "_r.rmse", "_r.n").where("n > 0")


def horizon_metrics(long: DataFrame, by: list[str], splits: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """(by, split, var, h, n, mae, rmse) of forecasts (…, split, var, h, y, y_hat)."""
    return split_scores(long.where(F.col("split").isin(*splits)), [*by, "split", "var", "h"])


def horizon_summary(metrics: DataFrame, by: list[str], last_h: int = 24) -> DataFrame:
    """Means over horizons, each horizon weighing the same, the last horizon's values, and counts."""
    at = lambda c: F.max(F.when(F.col("h") == last_h, F.col(c)))
    return metrics.groupBy(*by, "split", "var").agg(
        F.avg("mae").alias("all_mae"),
        F.avg("rmse").alias("all_rmse"),
        at("mae").alias("last_mae"),
        at("rmse").alias("last_rmse"),
        F.sum("n").alias("valid_points_all"),
        F.coalesce(at("n"), F.lit(0)).alias("valid_points_last"),
        (F.sum("n") == 0).alias("no_valid_points"),
    )


def last_days(long: DataFrame, keys: list[str], tgt_time: str, h: int = 24, days: int = 7) -> DataFrame:
    """The rows at horizon `h` of the last `days` distinct target days of each series, finite pairs only."""
    rows = long.where((F.col("h") == h) & both_finite(F.col("y"), F.col("y_hat"))).withColumn("_day", F.to_date(tgt_time))
    order = Window.partitionBy(*keys).orderBy(F.desc("_day"))
    return rows.withColumn("_k", F.dense_rank().over(order)).where(F.col("_k") <= days).drop("_k", "_day")


def masked_huber(df: DataFrame, by: list[str], y: str, p: str, delta: float = 2.0) -> DataFrame:
    """(by, huber): the mean Huber loss of finite pairs, 0 without any."""
    e = F.abs(F.when(both_finite(F.col(y), F.col(p)), F.col(p) - F.col(y)))
    loss = F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.when(e.isNotNull(), loss)), F.lit(0.0)).alias("huber"))


def consolidate(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def overview(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    return df.select(*keys, ts, *columns).orderBy(*keys, ts)
