"""Substring deduplication by relative Lempel-Ziv parsing.

The reference of a document is all text of documents with a smaller doc_id, in blocks: chunks of
documents with consecutive doc_ids.  A passage is parsed greedily against a block: the factor at a word
is the longest run of words that the block has too, from the first place of the `window` words that
begin there; the parse goes on at the first window that the factor doesn't hold whole, so windows across a
factor's boundary are looked up as well.  Factors of at least `window` words, compared word for word,
become duplicate spans, and name their source.

To parse every document against every block is quadratic, so a router says which blocks can hold a
factor: the fingerprints of all windows, dealt to tasks by fingerprint, tell each chunk the chunk before it
that has each of its windows.  A run of windows that earlier documents of the chunk itself have, or else
one earlier chunk, is sent there as one passage, is parsed there, and its factors come back.  So of the
copies of a text in a chunk only the first asks another chunk, and of all chunks that hold a window only
the next one asks about it: no chunk is asked about more than its own windows, however many copies there are.

A fingerprint only routes.  What it routes wrongly fails the comparison of words and stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.arrowtext import Words, or_empty, texts_of
from gridseries.llm.session import shuffle_partitions

WINDOW = 13
_LAST = np.iinfo(np.int64).max


def by_doc_range(docs: DataFrame, chunks: int) -> DataFrame:
    """`docs` with the column chunk: ranges of doc_id with about as many rows each; a null doc_id comes last."""
    ordered = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    shares = [i / chunks for i in range(1, chunks)]
    found = docs.agg(F.percentile_approx(ordered, F.array(*map(F.lit, shares)), F.lit(max(10_000, 20 * chunks)))).first()[0] if shares else []
    bounds = docs.sparkSession.sparkContext.broadcast(np.array(sorted(set(found or [])), np.int64))  # a number a chunk

    @F.pandas_udf("int")
    def chunk_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, ids.to_numpy(), "right").astype(np.int32))

    return docs.withColumn("chunk", chunk_of(ordered))


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each key, in the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def split(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Where each block's keys begin in the sorted `keys`, and their end."""
    return np.searchsorted(block_of(keys, blocks), np.arange(blocks + 1, dtype=np.uint64))


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the bytes of their differences, all first bytes first: the high ones are mostly zero, which the shuffle compresses."""
    return np.ascontiguousarray(np.diff(keys, prepend=keys.dtype.type(0)).view(np.uint8).reshape(-1, keys.itemsize).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _in_order(chunk: pa.Table) -> pa.Table:
    """Rows by doc_id, so that each reader of a chunk numbers its documents alike; rows that tie are equal in id and text."""
    return chunk.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _ids(chunk: pa.Table) -> np.ndarray:
    return np.asarray(chunk.column("doc_id").cast(pa.int64()).fill_null(_LAST))


def _send(blocks: int, window: int):
    def run(chunk: pa.Table) -> pa.Table:
        keys = np.unique(Words(texts_of(chunk)).grams(window)[1])
        at = split(keys, blocks)
        full = np.flatnonzero(np.diff(at))
        n = chunk.column("chunk")[0].as_py()
        return pa.table({"block": pa.array(full, pa.int32()), "chunk": pa.array(np.full(len(full), n), pa.int32()), "keys": pa.array([packed(keys[at[b] : at[b + 1]]) for b in full], pa.binary())})

    return run


def _route(block: pa.Table) -> pa.Table:
    """For the keys of each chunk: a bit, does an earlier chunk have it, and of those that do the last such chunk."""
    block = block.sort_by("chunk")
    parts = [unpacked(k) for k in block.column("keys").to_pylist()]
    ends = np.cumsum([len(p) for p in parts])
    keys = np.concatenate(parts)
    of = np.repeat(block.column("chunk").to_numpy(), [len(p) for p in parts]).astype(np.int32)
    order = np.argsort(keys, kind="stable")  # equal keys are in the order of their chunks
    before = np.full(len(keys), -1, np.int32)
    before[order[1:]] = np.where(keys[order][1:] == keys[order][:-1], of[order][:-1], -1)
    bits, sources = [], []
    for p, e in zip(parts, ends):
        here = slice(e - len(p), e)
        earlier = before[here] >= 0
        bits.append(np.packbits(earlier).tobytes())
        sources.append(np.ascontiguousarray(before[here][earlier].view(np.uint8).reshape(-1, 4).T).tobytes())
    return pa.table({"chunk": block.column("chunk"), "block": block.column("block"), "bits": pa.array(bits, pa.binary()), "sources": pa.array(sources, pa.binary())})


def _sources(keys: np.ndarray, answers: pa.Table, blocks: int) -> np.ndarray:
    """For each of the sorted keys of a chunk the last earlier chunk that has it, or -1."""
    out = np.full(len(keys), -1, np.int32)
    at = split(keys, blocks)
    for b, bits, sources in zip(*(answers.column(c).to_pylist() for c in ("block", "bits", "sources"))):
        earlier = np.unpackbits(np.frombuffer(bits, np.uint8), count=at[b + 1] - at[b]).astype(bool)
        out[at[b] + np.flatnonzero(earlier)] = np.ascontiguousarray(np.frombuffer(sources, np.uint8).reshape(4, -1).T).view(np.int32).ravel()
    return out


_ASKED = "chunk int, asker int, passage binary, places binary"


def _ask(blocks: int, window: int):
    """The passages of a chunk that may be repeats, each for the chunk that can tell."""
    empty = pa.schema([("chunk", pa.int32()), ("asker", pa.int32()), ("passage", pa.binary()), ("places", pa.binary())]).empty_table()

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return empty
        own = chunk.column("chunk")[0].as_py()
        chunk = _in_order(chunk)
        words = Words(texts_of(chunk))
        at, grams = words.grams(window)
        if not len(at):
            return empty
        keys, first, which = np.unique(grams, return_index=True, return_inverse=True)
        source = _sources(keys, or_empty(answers, block=pa.int32(), bits=pa.binary(), sources=pa.binary()), blocks)[which]
        ids, doc = _ids(chunk), words.doc[at]
        source[ids[doc[first]][which] < ids[doc]] = own  # rows are in the order of doc_id
        # Runs of consecutive windows that one chunk can tell of.
        new = np.ones(len(at), bool)
        new[1:] = (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(at)) - 1
        text, offset = words.spaced
        places: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for a, b in zip(starts[source[starts] >= 0].tolist(), ends[source[starts] >= 0].tolist()):
            w = int(at[a])
            passage = text[offset[w] : offset[at[b] + window] - 1]
            places.setdefault((int(source[a]), passage), []).append((int(doc[a]), w - int(words.first[doc[a]])))
        return pa.table(
            {
                "chunk": pa.array([c for c, _ in places], pa.int32()),
                "asker": pa.array(np.full(len(places), own), pa.int32()),
                "passage": pa.array([p for _, p in places], pa.binary()),
                "places": pa.array([np.array(x, np.int64).tobytes() for x in places.values()], pa.binary()),
            }
        )

    return run


def factors(passage: Words, i: int, block: Words, first: np.ndarray, keys: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """(word, words, word of the block) of the factors of passage i, by a greedy parse against the block.

    `first` has the first place in the block of each of the passages' windows (`keys`: index into it), or -1.
    """
    lo, n = int(passage.first[i]), int(passage.counts[i])
    (text, at), (reference, ref_at) = passage.spaced, block.spaced
    w = 0
    while w + window <= n:
        g = int(first[keys[lo + w]])
        if g < 0:
            w += 1
            continue
        most = min(n - w, int(block.first[block.doc[g] + 1]) - g)
        differ = np.flatnonzero(passage.hash[lo + w : lo + w + most] != block.hash[g : g + most])
        m = int(differ[0]) if len(differ) else most
        while m and text[at[lo + w] : at[lo + w + m]] != reference[ref_at[g] : ref_at[g + m]]:
            m -= 1  # two words with one hash
        if m < window:
            w += 1
            continue
        yield w, m, g
        w += m - window + 1  # the first window that reaches over the boundary


def _tell(window: int):
    """The factors of the passages that others ask a chunk about, against the chunk's text."""
    empty = pa.schema([("chunk", pa.int32()), ("places", pa.binary()), ("factors", pa.binary())]).empty_table()

    def run(chunk: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows or not chunk.num_rows:
            return empty
        chunk = _in_order(chunk)
        block, passages = Words(texts_of(chunk)), Words(asked.column("passage").to_pylist())
        at, grams = block.grams(window)
        p_at, p_grams = passages.grams(window)
        wanted, which = np.unique(p_grams, return_inverse=True)
        number = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
        found = np.flatnonzero(wanted[number] == grams)
        first = np.full(len(wanted), -1, np.int64)
        first[number[found[::-1]]] = at[found[::-1]]  # the first of each is written last
        keys = np.zeros(len(passages.hash), np.int64)
        keys[p_at] = which
        ids, out = _ids(chunk), []
        for i in range(passages.n_docs):
            rows = [(w, m, ids[block.doc[g]], g - block.first[block.doc[g]]) for w, m, g in factors(passages, i, block, first, keys, window)]
            out.append(np.array(rows, np.int64).tobytes())
        return pa.table({"chunk": asked.column("asker"), "places": asked.column("places"), "factors": pa.array(out, pa.binary())})

    return run


def _lists(doc: np.ndarray, n: int, columns: dict[str, np.ndarray]) -> pa.ListArray:
    """Lists of structs for documents 0 to n - 1; `doc` is sorted."""
    structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), structs)


def _apply(names: list[str]):
    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        chunk = _in_order(chunk)
        words, n = Words(texts_of(chunk)), chunk.num_rows
        rows = []
        told = or_empty(told, places=pa.binary(), factors=pa.binary())
        for places, found in zip(told.column("places").to_pylist(), told.column("factors").to_pylist()):
            place, f = np.frombuffer(places, np.int64).reshape(-1, 2), np.frombuffer(found, np.int64).reshape(-1, 4)
            doc, start = np.repeat(place[:, 0], len(f)), np.repeat(place[:, 1], len(f))
            f = np.tile(f, (len(place), 1))
            rows.append(np.column_stack([doc, start + f[:, 0], f[:, 1:]]))
        doc, start, size, source, word = np.concatenate(rows).T if rows else np.zeros((5, 0), np.int64)
        order = np.lexsort((size, start, doc))
        doc, start, size, source, word = (x[order] for x in (doc, start, size, source, word))
        edge = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(edge, words.first[doc] + start, 1)
        np.add.at(edge, words.first[doc] + start + size, -1)
        gone = np.cumsum(edge[:-1]) > 0
        # Factors that overlap or touch at a boundary make one span.
        border = np.zeros(len(gone) + 1, bool)
        border[words.first] = True
        begins = np.flatnonzero(gone & (border[:-1] | ~np.concatenate([[False], gone[:-1]])))
        stops = np.flatnonzero(gone & (border[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
        span_doc = words.doc[begins]
        text, at = words.spaced
        left = np.frombuffer(text, np.uint8)[~np.repeat(gone, np.diff(at))].tobytes()
        left_at = np.concatenate([[0], np.cumsum(np.diff(at) * ~gone)])[words.first]
        kept = [left[left_at[i] : max(left_at[i], left_at[i + 1] - 1)] for i in range(n)]
        removed = np.concatenate([[0], np.cumsum(gone)])[words.first]
        parsed = pa.StructArray.from_arrays(
            [
                pa.array(words.counts.astype(np.int64)),
                pa.array(np.diff(removed).astype(np.int64)),
                _lists(span_doc, n, {"start": begins - words.first[span_doc], "n_words": stops - begins}),
                _lists(doc, n, {"start": start, "n_words": size, "source_doc": source, "source_word": word}),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            names=["n_words", "n_removed", "spans", "factors", "kept"],
        )
        return chunk.select(names).append_column("parsed", parsed)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunks: int | None = None, blocks: int | None = None) -> DataFrame:
    """`docs` with a struct column `parsed`: n_words, n_removed, the duplicate spans, the factors, and the words kept.

    Words are what lies between white space, unchanged; kept words are joined by one space.  A factor is
    (start, n_words, source_doc, source_word): so many words from `start` on are those of document
    source_doc from its word source_word on; factors may overlap, spans are their union.  A null
    text has no words.  Rows with the same doc_id are no reference of each other; a null doc_id is
    larger than any other.  Other columns stay, but for earlier ones named parsed or chunk.  An empty
    table gives no rows.
    """
    n = shuffle_partitions(docs.sparkSession)
    blocks, chunks = blocks or n, chunks or 2 * n
    docs = docs.drop("parsed", "chunk")
    dealt = by_doc_range(docs, chunks).repartition(n, "chunk")
    # All columns here too: so the texts are shuffled once, and all readers share that exchange.
    by_chunk = lambda df: df.groupBy("chunk")
    sent = by_chunk(dealt).applyInArrow(_send(blocks, window), "block int, chunk int, keys binary")
    answers = sent.groupBy("block").applyInArrow(_route, "chunk int, block int, bits binary, sources binary")
    asked = by_chunk(dealt).cogroup(by_chunk(answers)).applyInArrow(_ask(blocks, window), _ASKED)
    told = by_chunk(dealt).cogroup(by_chunk(asked)).applyInArrow(_tell(window), "chunk int, places binary, factors binary")
    kind = "struct<n_words:bigint,n_removed:bigint,spans:array<struct<start:bigint,n_words:bigint>>,factors:array<struct<start:bigint,n_words:bigint,source_doc:bigint,source_word:bigint>>,kept:string>"
    schema = docs.withColumn("parsed", F.lit(None).cast(kind)).schema
    return by_chunk(dealt).cogroup(by_chunk(told)).applyInArrow(_apply(docs.columns), schema)


def op2(spark, sf_dir: str) -> DataFrame:
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "parsed.n_words", "parsed.n_removed", F.sha2("parsed.kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS first_id FROM g GROUP BY g),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE first_id < doc_id),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT t.doc_id, count(x.p) AS n_removed, string_agg(word, ' ' ORDER BY t.p) FILTER (x.p IS NULL) AS kept
      FROM t LEFT JOIN x USING (doc_id, p) GROUP BY t.doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
