"""Quality rules: fixed text statistics, and a calibrated classifier of hashed n-grams.

The classifier is a logistic regression over word unigrams, word bigrams and 4-byte character
n-grams, hashed to one weight table each; a feature's value is its share of the text's n-grams.  It
is fitted on a bounded sample of labelled rows, calibrated by Platt scaling on a part it was not
fitted on, and scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.arrowtext import SPACE, Words, mix, small_batches, texts_of
from gridseries.llm.labelled import labelled_sample

BITS = 18
#: Fixed thresholds.
KEEP_PROBABILITY = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The sample that teaches: rows, and characters of each.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 8000
_SLICE = 200
COLUMN = "quality"

_symbols = np.zeros(256, np.int64)
_symbols[list(b"#*$%&|<>")] = 1
_starts_char = (np.arange(256) & 0xC0) != 0x80
_word_char = (_starts_char & ~SPACE).astype(np.int64)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each range of `values`, by itself: so a text's sum doesn't depend on its neighbours' in the last bits."""
    out, full = np.zeros(len(bounds) - 1, values.dtype), np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values[: bounds[-1]], bounds[full])
    return out


def statistics(words: Words, texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    dup = []
    for t in texts:
        lines = [x for x in (t or b"").split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    at, grams = words.grams(3)
    _, which, count = np.unique(grams ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    often = at[count[which] > 1]
    edges = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edges, often, 1)
    np.add.at(edges, often + 3, -1)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": _sums(_word_char[words.data], words.doc_start),
        "n_symbols": _sums(_symbols[words.data], words.doc_start),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": _sums((np.cumsum(edges[:-1]) > 0).astype(np.int64), words.first),
    }


def _features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each weight table: the index of every n-gram, and where each text's n-grams begin."""
    shift = np.uint64(64 - BITS)
    yield words.hash >> shift, words.first
    at, pairs = words.grams(2)
    yield pairs >> shift, np.searchsorted(words.doc[at], np.arange(words.n_docs + 1))
    data = np.concatenate([words.data, np.zeros(3, np.uint8)]).astype(np.uint32)
    n = len(words.data)
    quads = data[:n] | data[1 : n + 1] << np.uint32(8) | data[2 : n + 2] << np.uint32(16) | data[3 : n + 3] << np.uint32(24)
    for k in (1, 2, 3):  # a text's last n-grams end with it
        near = words.doc_start[1:] - k
        quads[near[near >= 0]] &= np.uint32((1 << 8 * k) - 1)
    yield (quads * np.uint32(2654435761)) >> np.uint32(32 - BITS), words.doc_start


@dataclass
class Model:
    weights: np.ndarray  # 3 tables of 2 ** BITS
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, words: Words) -> np.ndarray:
        out = np.full(words.n_docs, self.bias)
        for table, (index, bounds) in zip(self.weights, _features(words)):
            out += _sums(table[index].astype(np.float64), bounds) / np.maximum(1, np.diff(bounds))
        return out

    def probabilities(self, words: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(words) + self.offset, -30, 30)))


def _descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit(sample: list[tuple[bytes, int]], steps: int = 40) -> Model:
    """The model of (text, label) rows; with no row, or one label only, everything gets that label's side."""
    labels = np.array([y for _, y in sample], float)
    if len(set(labels)) < 2:
        return Model(np.zeros((3, 1 << BITS), np.float32), 5.0 if not len(labels) or labels[0] else -5.0)
    fold = np.arange(len(sample)) % 5 == 0  # calibrates
    rows, columns, values = [], [], []
    for at in range(0, len(sample), _SLICE):  # so that no array holds every n-gram of the sample
        part = Words([t for t, _ in sample[at : at + _SLICE]])
        for k, (index, bounds) in enumerate(_features(part)):
            n = np.diff(bounds)
            doc = np.repeat(np.arange(part.n_docs), n)
            cells, count = np.unique(doc << BITS | index.astype(np.int64), return_counts=True)
            rows.append(((cells >> BITS) + at).astype(np.int32))
            columns.append(((cells & (1 << BITS) - 1) + (k << BITS)).astype(np.int32))
            values.append((count / np.maximum(1, n)[cells >> BITS]).astype(np.float32))
    rows, columns, values = np.concatenate(rows), np.concatenate(columns), np.concatenate(values)
    size = 3 << BITS
    share = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) * ~fold  # classes weigh the same

    def gradient(w: np.ndarray) -> np.ndarray:
        z = np.bincount(rows, values * w[columns], len(sample)) + w[size]
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(sample)
        return np.append(np.bincount(columns, values * error[rows], size), error.sum()) + 1e-7 * w

    w = _descend(gradient, size + 1, steps, 0.5)
    model = Model(w[:size].reshape(3, -1).astype(np.float32), float(w[size]))
    z = model.margins(Words([t for (t, _), held in zip(sample, fold) if held]))
    y = np.where(labels[fold] == 1, (labels[fold].sum() + 1) / (labels[fold].sum() + 2), 1 / ((1 - labels[fold]).sum() + 2))  # Platt's targets
    platt = _descend(lambda p: np.array([((e := 1 / (1 + np.exp(-np.clip(p[0] * z + p[1], -30, 30))) - y) * z).mean() + 1e-4 * p[0], e.mean()]), 2, 400, 0.05)
    model.slope, model.offset = (float(platt[0]), float(platt[1])) if platt[0] > 0 else (1.0, 0.0)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with a struct column `quality`, which replaces one of that name: the statistics, base_failed, probability and kept.

    A null text is scored like an empty one: no words, so base_failed.  Other columns stay.  Repeated rows
    are scored alike; an empty table gives no rows.
    """
    docs = docs.drop(COLUMN)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 MB, whatever the data
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = docs.withColumn(COLUMN, F.lit(None).cast("struct<" + ",".join(f"{c}:bigint" for c in counts) + ",base_failed:boolean,probability:double,kept:boolean>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = texts_of(batch)
            words = Words(texts)
            s = statistics(words, texts)
            failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
            p = shared.value.probabilities(words)
            column = pa.StructArray.from_arrays([*(pa.array(s[c]) for c in counts), pa.array(failed), pa.array(p), pa.array(~failed & (p >= KEEP_PROBABILITY))], names=[*counts, "base_failed", "probability", "kept"])
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, COLUMN])

    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """Fits on a sample of the labelled documents that are not held out, and scores all.

    Null texts have no words and fail the fixed rules; rows without a label, and labels without a document, teach nothing;
    repeated rows are judged alike; an empty table gives no rows.  A text has to fit a task's memory.
    """
    return score(docs, fit(labelled_sample(docs, labels, "quality", sample_rows, sample_chars)))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", f"{COLUMN}.*")
