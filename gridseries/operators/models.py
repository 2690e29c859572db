"""Regressions: many small ridge models by normal equations, and boosted trees for segments.

A group's ridge needs X'X and X'y only, so those sums are aggregated and no group's rows are ever
collected; just the small matrices are solved in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.operators.clean import is_finite
from gridseries.sources.shared import checkpointed


def usable_counts(rows: DataFrame, by: list[str], ok: Column) -> DataFrame:
    """(by, n): training rows that can be used, 0 for a group whose rows are all of other splits."""
    return rows.groupBy(*by).agg(F.count_if((F.col("split") == "train") & ok).alias("n"))


def require_usable(counts: DataFrame) -> None:
    if empty := counts.where("n = 0").count():
        raise ValueError(f"{empty} groups have no usable training row")


def _solve(features: list[str], by: list[str], penalty: float):
    k = len(features) + 1

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples(index=False):
            a = np.zeros((k, k))
            a[np.triu_indices(k)] = r.xx
            a = a + np.triu(a, 1).T
            reg = penalty * np.eye(k)
            reg[0, 0] = 0  # the intercept is free
            out.append([getattr(r, b) for b in by] + [np.linalg.lstsq(a + reg, np.array(r.xy, float), rcond=None)[0].tolist(), int(r.xx[0])])
        return pd.DataFrame(out, columns=[*by, "coefficients", "n_train"])

    return run


def fit_ridge(rows: DataFrame, by: list[str], features: list[str], y: str, ok: Column | None = None, weight: str | None = None, penalty: float = 1e-3) -> DataFrame:
    """(by, coefficients, n_train): intercept first; missing features count as 0, rows without a target don't count."""
    use = rows.where(F.col("split") == "train").where(is_finite(F.col(y)))
    use = use.where(ok) if ok is not None else use
    x = [F.lit(1.0), *[F.coalesce(F.when(is_finite(F.col(f)), F.col(f).cast("double")), F.lit(0.0)) for f in features]]
    w = F.col(weight) if weight else F.lit(1.0)
    k = len(x)
    use = use.select(*by, F.array(*x).alias("_x"), F.col(y).cast("double").alias("_y"), w.alias("_w"))
    at = lambda i: F.col("_x")[i]
    sums = use.groupBy(*by).agg(F.array(*[F.sum(at(i) * at(j) * F.col("_w")) for i in range(k) for j in range(i, k)]).alias("xx"), F.array(*[F.sum(at(i) * F.col("_y") * F.col("_w")) for i in range(k)]).alias("xy"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", coefficients array<double>, n_train long"
    solve = _solve(features, by, penalty)
    return sums.mapInPandas(lambda frames: (solve(f) for f in frames if len(f)), schema)


def predict_ridge(rows: DataFrame, model: DataFrame, by: list[str], features: list[str], name: str = "r_hat") -> DataFrame:
    """`rows` with the prediction of their group's model; null where there is no model."""
    x = F.array(F.lit(1.0), *[F.coalesce(F.when(is_finite(F.col(f)), F.col(f).cast("double")), F.lit(0.0)) for f in features])
    dot = F.aggregate(F.zip_with("coefficients", x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.join(model.select(*by, "coefficients"), by, "left").withColumn(name, dot).drop("coefficients")


def vector(columns: list[Column]) -> Column:
    """The columns as an array of doubles, 0 for what is not finite."""
    return F.array(*[F.coalesce(F.when(is_finite(c.cast("double")), c.cast("double")), F.lit(0.0)) for c in columns])


def _groups(keys: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """(the distinct keys, the rows in the order of their key, where each key's rows begin in that, and the end)."""
    code = np.zeros(keys.num_rows, np.int64)
    for column in keys.columns:
        encoded = column.dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * len(encoded.dictionary) + encoded.indices.to_numpy(), return_inverse=True)
    order = np.argsort(code, kind="stable")
    begin = np.flatnonzero(np.diff(code[order], prepend=-1))
    return keys.take(pa.array(order[begin])), order, np.append(begin, len(order))


def _gram(by: list[str], limit: int):
    """One row (by, sums) of each group that a task has met: the upper triangle of X'X, then X'y; nothing where no row counts.

    Sums of more groups than `limit` bytes hold leave early and are added further on.
    """

    def out(held: dict[tuple, np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        keys = [pa.array(c, schema.field(b).type) for b, c in zip(by, zip(*held))]
        return pa.RecordBatch.from_arrays([*keys, pa.array(list(held.values()), pa.list_(pa.float64()))], names=[*by, "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        size = 0
        for batch in batches:
            keys, order, begin = _groups(batch.select(by))
            counts = batch.column("x").is_valid().to_numpy(zero_copy_only=False)
            place = np.cumsum(counts) - 1
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            x = x.reshape(int(counts.sum()), -1) if counts.any() else x.reshape(0, 0)
            x, y = np.hstack([np.ones((len(x), 1)), x]), batch.column("y").to_numpy(zero_copy_only=False)[counts]
            upper = np.triu_indices(x.shape[1])
            for g, key in enumerate(zip(*(c.to_pylist() for c in keys.columns))):
                rows = order[begin[g] : begin[g + 1]]
                rows = place[rows[counts[rows]]]
                part = x[rows]
                sums = np.concatenate([(part.T @ part)[upper], part.T @ y[rows]]) if len(rows) else np.zeros(0)
                before = held.get(key)
                size += 200 + sums.nbytes if before is None else sums.nbytes - before.nbytes if not len(before) else 0
                held[key] = sums if before is None or not len(before) else before + sums if len(sums) else before
            if size > limit:
                yield out(held, batch.schema)
                held, size = {}, 0
        if held:
            yield out(held, batch.schema)

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """The sums of a group, added up as they come: one array is held, however many rows there are."""
    total = np.zeros(0)
    for batch in batches:
        column = batch.column("sums")
        full = np.flatnonzero(np.diff(column.offsets.to_numpy()))
        if len(full):
            part = column.flatten().to_numpy().reshape(len(full), -1).sum(axis=0)
            total = total + part if len(total) else part
    return total


def _row(key: tuple, names: list[str], **values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), *values.values()], names=[*names, *values])


def _add_sums(by: list[str]):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _row(key[: len(by)], by, sums=pa.array([_total(batches)], pa.list_(pa.float64())))

    return run


def _solve_sums(by: list[str], penalty: float, relative: bool):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coefficients, n = _solved(_total(batches), penalty, relative)
        yield _row(key, by, coefficients=pa.array([coefficients], pa.list_(pa.float64())), n_train=pa.array([n], pa.int64()))

    return run


def _solved(sums: np.ndarray, penalty: float, relative: bool) -> tuple[list[float] | None, int]:
    """(coefficients, rows) of k (k + 1) / 2 + k sums; none of no rows."""
    if not len(sums):
        return None, 0
    k = int((np.sqrt(9 + 8 * len(sums)) - 3) / 2)
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = sums[: k * (k + 1) // 2]
    n, means, b = a[0, 0], a[0, 1:] / a[0, 0], sums[k * (k + 1) // 2 :]
    # Centred, so that the intercept is free of the penalty, and in units of each feature's deviation.
    centred = a[1:, 1:] + np.triu(a[1:, 1:], 1).T - n * np.outer(means, means)
    spread = np.maximum(np.diag(centred), 0)
    unit = np.where(spread > 1e-12 * np.maximum(n * means**2, 1e-300), np.sqrt(spread), np.inf)  # a constant feature gets 0
    held = penalty if relative else penalty / unit**2
    slopes = np.linalg.lstsq(centred / np.outer(unit, unit) + np.diag(held * np.ones(k - 1)), (b[1:] - b[0] * means) / unit, rcond=None)[0] / unit
    return [float(b[0] / n - means @ slopes), *slopes.tolist()], int(round(n))


def fit_vectors(rows: DataFrame, by: list[str], y: Column, ok: Column, penalty: float = 1e-3, relative: bool = False, limit: int = 64 << 20, branches: int | None = None) -> DataFrame:
    """(by, coefficients, n_train) of rows with the features `x`, an array of one length: ridge with any number of features.

    A task adds up the sums of each group over all its batches and sends one row a group; those rows are added up in
    `branches` parts of each group (the root of the shuffle partitions) and then in one place, one array at a time, so memory grows with the
    features and not with rows or tasks.  Rows that aren't of training, not `ok` or without a finite target
    don't count; a group of which none does has n_train 0 and no coefficients.  A `relative` penalty is a share
    of each feature's squared deviations, so that features of any scale are held alike.
    """
    kinds = dict(rows.dtypes)
    keys = ", ".join(f"`{b}` {kinds[b]}" for b in by)
    counts = (F.col("split") == "train") & ok & is_finite(y)
    use = rows.select(*by, F.when(counts, F.col("x")).alias("x"), y.cast("double").alias("y"))
    sums = use.mapInArrow(_gram(by, limit), f"{keys}, sums array<double>")
    return _branched(sums, by, branches).groupBy(*by).applyInArrow(_solve_sums(by, penalty, relative), f"{keys}, coefficients array<double>, n_train long")


def _branched(sums: DataFrame, by: list[str], branches: int | None = None) -> DataFrame:
    """(by, sums), added up in `branches` parts of each group."""
    branches = branches or max(1, round(int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    return sums.groupBy(*by, F.pmod(F.spark_partition_id(), F.lit(branches)).alias("_branch")).applyInArrow(_add_sums(by), sums.schema)


def added(sums: DataFrame, by: list[str]) -> DataFrame:
    """(by, sums) of rows (by, sums): the arrays of a group added up, in parts first and then in one place."""
    return _branched(sums, by).groupBy(*by).applyInArrow(_add_sums(by), sums.schema)


def require_fitted(model: DataFrame) -> DataFrame:
    """`model`, stored, if every group had a usable training row; else an error."""
    model = checkpointed(model)
    require_usable(model.select(F.col("n_train").alias("n")))
    return model


def predict_vectors(rows: DataFrame, model: DataFrame, by: list[str], name: str = "r_hat") -> DataFrame:
    """`rows` with the prediction of their group's model from `x`; null where there is no model."""
    x = F.concat(F.array(F.lit(1.0)), "x")
    dot = F.aggregate(F.zip_with("coefficients", x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.join(model.select(*by, "coefficients"), by, "left").withColumn(name, F.when(F.col("coefficients").isNotNull(), dot)).drop("coefficients")


def fit_segments(table: DataFrame, features: list[str], label: str = "y", weight: str = "weight", segments: tuple[int, ...] = (0, 1, 2), seed: int = 42, **gbt) -> dict:
    """One boosted-tree model for each hour segment, on imputed features with a missing flag each."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    gbt = {"maxIter": 600, "stepSize": 0.05, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85"} | gbt
    out = {}
    for s in segments:
        train = filled(table.where((F.col("split") == "train") & (F.col("segment") == s)), features)
        assembler = VectorAssembler(inputCols=[*features, *[f"{f}_gone" for f in features]], outputCol="_features")
        model = GBTRegressor(featuresCol="_features", labelCol=label, weightCol=weight, predictionCol="y_hat", seed=seed, **gbt)
        out[s] = Pipeline(stages=[assembler, model]).fit(train)
    return out


def filled(df: DataFrame, features: list[str]) -> DataFrame:
    ok = {f: is_finite(F.col(f)) for f in features}
    return df.withColumns({**{f"{f}_gone": (~ok[f]).cast("double") for f in features}, **{f: F.when(ok[f], F.col(f).cast("double")).otherwise(0.0) for f in features}})


def predict_segments(table: DataFrame, models: dict, features: list[str]) -> DataFrame:
    parts = [m.transform(filled(table.where(F.col("segment") == s), features)).drop("_features", *[f"{f}_gone" for f in features]) for s, m in models.items()]
    return reduce(DataFrame.unionByName, parts)
