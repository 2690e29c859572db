"""The strongest directions of whole look-back windows of many columns.

A window of `look_back` rows and C columns has look_back * C numbers and shares all but C of them with the next one,
so windows are never made as rows: a task forms them of its own bucket of the series, as views of one array.
The sums of products of training windows are added up in each task and then in a tree; their strongest
eigenvectors are the projection, which tasks apply to all windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.functions.calendar import STEP_MINUTES
from gridseries.operators import models, scan
from gridseries.operators.clean import is_finite
from gridseries.operators.windows import with_copies

LOOK_BACK = 192
#: Numbers of a window; the sums of their products, eight bytes each, have to fit a task and the driver.
MAX_WIDTH = 6000
#: Windows that are multiplied at a time.
_STEP = 512


@dataclass
class Projection:
    """Of windows (oldest row first, row by row): their mean, directions of length 1 by strength, and the share of variance in those."""

    mean: np.ndarray
    components: np.ndarray
    explained: float

    def frame(self, spark: SparkSession) -> DataFrame:
        """(direction, values), direction 0 being the mean."""
        return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([self.mean, *self.components])], "direction int, values array<double>")


def filled_windows(x: np.ndarray, look_back: int) -> np.ndarray:
    """(windows, look_back, columns) of the rows x: in each window gaps hold its last value before them, else its first after them, else 0."""
    n, at = len(x), np.arange(len(x))[:, None]
    known = np.isfinite(x)
    before = np.maximum.accumulate(np.where(known, at, -1), axis=0)
    after = np.minimum.accumulate(np.where(known, at, n)[::-1], axis=0)[::-1]
    view = lambda a: np.lib.stride_tricks.sliding_window_view(a, look_back, axis=0).transpose(0, 2, 1)
    start = np.arange(n - look_back + 1)[:, None, None]
    first = after[: n - look_back + 1][:, None, :]
    place = np.where(view(before) >= start, view(before), np.broadcast_to(first, (len(start), look_back, x.shape[1])))
    inside = place < start + look_back
    values = np.take_along_axis(np.where(known, x, 0.0), np.where(inside, place, 0).reshape(-1, x.shape[1]), axis=0).reshape(place.shape)
    return np.where(inside, values, 0.0)


def _series_of(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, which come one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in batch.select(by).columns]
        new = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
        for a, b in zip([0, *new], [*new, batch.num_rows]):
            part = batch.slice(int(a), int(b - a))
            if held and part.select(by).slice(0, 1).to_pylist() != held[0].select(by).slice(0, 1).to_pylist():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _windows(rows: pa.Table, columns: list[str], use: np.ndarray, look_back: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, windows) of the marked rows that have a whole look-back, some at a time."""
    x = np.column_stack([rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])
    ends = np.flatnonzero(use)
    ends = ends[ends >= look_back - 1]
    for at in range(0, len(ends), _STEP):
        some = ends[at : at + _STEP]
        lo = some[0] - look_back + 1
        yield some, filled_windows(x[lo : some[-1] + 1], look_back)[some - some[0]].reshape(len(some), -1)


def _spread(df: DataFrame, keys: list[str], ts: str, columns: list[str], look_back: int, days: int) -> DataFrame:
    """The rows of buckets with their halo, each bucket in one task and in order; `_mine` are its own."""
    by = [*keys, scan.BUCKET]
    finite = [F.when(is_finite(F.col(f"`{c}`")), F.col(f"`{c}`").cast("double")).alias(c) for c in columns]
    frame = df.select(*keys, ts, *finite, *[c for c in df.columns if c == "_use"])
    return with_copies(frame, ts, look_back, STEP_MINUTES, days).withColumn("_mine", F.col("_own") == F.col(scan.BUCKET)).drop("_own").repartition(*by).sortWithinPartitions(*by, ts)


def fit(df: DataFrame, train: DataFrame, keys: list[str], ts: str, columns: list[str], rank: int, look_back: int = LOOK_BACK, days: int = 28) -> Projection:
    """The projection of windows of `columns`, scaled and on a continuous grid, that end at the training times (keys, t_dec)."""
    if look_back * len(columns) > MAX_WIDTH:
        raise ValueError(f"a window of {look_back} rows and {len(columns)} columns has more than {MAX_WIDTH} numbers")
    marked = df.join(train.select(*keys, F.col("t_dec").alias(ts), F.lit(True).alias("_use")).distinct(), [*keys, ts], "left")
    by = [*keys, scan.BUCKET]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in _series_of(batches, by):
            use = rows.column("_mine").to_numpy(zero_copy_only=False) & np.asarray(rows.column("_use").fill_null(False))
            for _, w in _windows(rows, columns, use, look_back):
                w = np.hstack([np.ones((len(w), 1)), w])
                total = w.T @ w if total is None else total + w.T @ w
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total[np.triu_indices(len(total))]], pa.list_(pa.float64()))], names=["g", "sums"])

    sums = _spread(marked, keys, ts, columns, look_back, days).mapInArrow(run, "g long, sums array<double>")
    got = models.added(sums, ["g"]).toArrow()  # one row of the width's square, which MAX_WIDTH bounds
    if not got.num_rows:
        raise ValueError("no training time has a whole look-back")
    k = look_back * len(columns) + 1
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = got.column("sums").combine_chunks().flatten().to_numpy()
    a = a + np.triu(a, 1).T
    mean = a[0, 1:] / a[0, 0]
    values, vectors = np.linalg.eigh(a[1:, 1:] / a[0, 0] - np.outer(mean, mean))
    values, components = np.maximum(values[::-1], 0), vectors.T[::-1][:rank]
    signs = np.sign(components[np.arange(len(components)), np.abs(components).argmax(axis=1)])
    return Projection(mean, components * signs[:, None], float(values[:rank].sum() / max(values.sum(), 1e-300)))


def project(df: DataFrame, projection: Projection, keys: list[str], ts: str, columns: list[str], look_back: int = LOOK_BACK, days: int = 28) -> DataFrame:
    """(keys, t_dec, look_back): the coordinates of each whole window of `columns` in the projection's directions."""
    by, shared = [*keys, scan.BUCKET], df.sparkSession.sparkContext.broadcast((projection.mean, projection.components))  # MAX_WIDTH x rank
    kinds = dict(df.dtypes)
    names = [*keys, "t_dec", "look_back"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, components = shared.value
        for rows in _series_of(batches, by):
            for at, w in _windows(rows, columns, rows.column("_mine").to_numpy(zero_copy_only=False), look_back):
                z = (w - mean) @ components.T
                taken = rows.select([*keys, ts]).take(pa.array(at)).combine_chunks()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                yield from pa.table([*taken.columns, lists], names=names).to_batches()

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"t_dec {kinds[ts]}", "look_back array<double>"])
    return _spread(df, keys, ts, columns, look_back, days).mapInArrow(run, schema)
