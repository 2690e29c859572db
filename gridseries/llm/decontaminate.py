"""Benchmark decontamination with suffix arrays over the training text.

Each shard (some megabytes of training text) gets the suffix array of its words.  Every suffix of the
benchmark items is binary-searched in it, word by word, which gives the places of all its verbatim
matches of a whole window; matches that follow on one diagonal are one longest match, with its place in
the document and in the item.  Words inside a match are hit.

A window is `window` consecutive words of an item; an item of fewer words is one window.  Words that no
item has are one number, 0, as is the end of a text: suffixes that begin with it match nothing and
aren't sorted.

The benchmark is prepared once, in blocks of bounded size, as flat arrays that are broadcast one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.arrowtext import PUNCT, Words, small_batches, texts_of
from gridseries.llm.session import checkpointed

WINDOW = 13
#: A document is contaminated when this many times its hit words reach its words.
HIT_FACTOR = 20
#: Characters of benchmark text that are searched at a time; what is collected and broadcast is bounded by it.
BLOCK_CHARS = 8_000_000
SHARD_BYTES = 1 << 22
#: Places of matches that are held at a time, unless one document has more.
_PLACES = 1 << 21
COLUMN = "contamination"
_TYPE = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,stop:bigint>>,matches:array<struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>>>"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of `text` that aren't 0, in the order of the next `depth` numbers or more, by prefix doubling."""
    at = np.flatnonzero(text)
    rank, order, h = text.astype(np.int64), np.argsort(text[at], kind="stable"), 1
    while h < depth and len(at):
        following = np.zeros(len(rank), np.int64)
        following[:-h] = rank[h:]
        key = rank[at] * (rank.max() + 1) + following[at]
        order = np.argsort(key, kind="stable")
        new = np.ones(len(at), np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.zeros(len(rank), np.int64)
        rank[at[order]] = np.cumsum(new)
        h *= 2
    return at[order]


def _lower_bound(text: np.ndarray, suffixes: np.ndarray, j: int, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """In each range of `suffixes`, which is ordered by its numbers at `j`, the first place that isn't below `wanted`."""
    lo, hi = lo.copy(), hi.copy()
    while (todo := np.flatnonzero(lo < hi)).size:
        mid = (lo[todo] + hi[todo]) >> 1
        below = text[suffixes[mid] + j] < wanted[todo]
        lo[todo[below]] = mid[below] + 1
        hi[todo[~below]] = mid[~below]
    return lo


class Benchmark:
    """The suffixes of some items that have a whole window, as flat arrays."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        items = sorted((str(i), t or "") for i, t in items)
        words = Words([t.encode() for _, t in items], PUNCT, lower=True)
        self.window = window
        self.ids = sorted({i for i, _ in items})
        rank = {i: k for k, i in enumerate(self.ids)}
        self.vocabulary, number = np.unique(words.hash, return_inverse=True)
        self.text = np.concatenate([number.astype(np.int32) + 1, np.zeros(window, np.int32)])
        size = np.minimum(window, words.counts)
        many = np.where(words.counts > 0, words.counts - size + 1, 0)
        item = np.repeat(np.arange(len(items)), many)
        start = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        at, size = words.first[item] + start, size[item]
        rows = np.where(np.arange(window) < size[:, None], self.text[at[:, None] + np.arange(window)], 0)
        order = np.lexsort(rows.T[::-1]) if len(rows) else np.zeros(0, np.int64)
        new = np.ones(len(order), bool)
        new[1:] = (rows[order][1:] != rows[order][:-1]).any(axis=1)
        first = np.flatnonzero(new)
        #: Of each distinct window, in order: its words, and where its places begin in `item` and `start`.
        self.words, self.size = rows[order][first].astype(np.int32), size[order][first]
        self.places = np.append(first, len(order))
        self.item, self.start = np.array([rank[items[i][0]] for i in item[order].tolist()], np.int64), start[order]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, window) of every occurrence of a window in `words`, by word."""
        # A 0 after each text, and room behind the last.
        text = np.zeros(len(words.hash) + words.n_docs + self.window, np.int32)
        text[np.arange(len(words.hash)) + words.doc] = self.numbers(words.hash)
        suffixes = suffix_array(text, self.window)
        which = np.arange(len(self.size))
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(suffixes), np.int64)
        for j in range(self.window):
            live = np.flatnonzero((self.size[which] > j) & (lo < hi))
            wanted = self.words[which[live], j]
            low = _lower_bound(text, suffixes, j, lo[live], hi[live], wanted)
            hi[live] = _lower_bound(text, suffixes, j, low, hi[live], wanted + 1)
            lo[live] = low
            alive = lo < hi
            which, lo, hi = which[alive], lo[alive], hi[alive]
        count = hi - lo
        at = suffixes[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
        which = np.repeat(which, count)
        order = np.argsort(at, kind="stable")
        at, which = at[order], which[order]
        return at - np.searchsorted(words.first[1:] + np.arange(1, words.n_docs + 1), at, "right"), which


def _each(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, first[i] + k) for every k below count[i]."""
    i = np.repeat(np.arange(len(count)), count)
    return i, np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


def _matches(bench: Benchmark, words: Words, at: np.ndarray, which: np.ndarray) -> list[np.ndarray]:
    """(text, word, item, word of the item, words) of the longest matches, from the occurrences of windows."""
    i, place = _each(bench.places[which], np.diff(bench.places)[which])
    doc, item, q = words.doc[at][i], bench.item[place], bench.start[place]
    p, size = at[i] - words.first[doc], bench.size[which][i]
    order = np.lexsort((p, p - q, item, doc))
    doc, item, p, q, size = (x[order] for x in (doc, item, p, q, size))
    new = np.ones(len(p), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] > p[:-1] + size[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(p)) - 1
    return [doc[begin], p[begin], item[begin], q[begin], p[end] + size[end] - p[begin]] if len(begin) else [np.zeros(0, np.int64)] * 5


def _lists(doc: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), values)


def _digest(bench: Benchmark, texts: list[bytes | None]) -> pa.StructArray:
    """The struct of COLUMN for each text."""
    words, n = Words(texts, PUNCT, lower=True), len(texts)
    at, which = bench.search(words)
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + bench.size[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    border = np.zeros(len(hit) + 1, bool)
    border[words.first] = True
    starts = np.flatnonzero(hit & (border[:-1] | ~np.concatenate([[False], hit[:-1]])))
    stops = np.flatnonzero(hit & (border[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
    # Slices of whole texts, so that a shard full of matches takes no more memory than one text may.
    held = np.cumsum(np.diff(bench.places)[which])
    found, a = [], 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(held, (held[a - 1] if a else 0) + _PLACES, "right")))
        b = int(np.searchsorted(words.doc[at], words.doc[at[b - 1]], "right"))
        found.append(_matches(bench, words, at[a:b], which[a:b]))
        a = b
    doc, p, item, q, size = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 5
    pair = np.unique(np.stack([doc, item]), axis=1)
    order = np.lexsort((q, item, p, doc))
    doc, p, item, q, size = (x[order] for x in (doc, p, item, q, size))
    ids = pa.array(bench.ids, pa.string())
    n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.first])
    longs = lambda *columns: [pa.array(c, pa.int64()) for c in columns]
    span_doc = words.doc[starts]
    return pa.StructArray.from_arrays(
        [
            *longs(words.counts, n_hit),
            _lists(pair[0], n, ids.take(pa.array(pair[1], pa.int64()))),
            _lists(span_doc, n, pa.StructArray.from_arrays(longs(starts - words.first[span_doc], stops - words.first[span_doc]), names=["start", "stop"])),
            _lists(doc, n, pa.StructArray.from_arrays([ids.take(pa.array(item, pa.int64())), *longs(p, q, size)], names=["item_id", "doc_word", "item_word", "n_words"])),
        ],
        names=["n_words", "n_hit", "items", "spans", "matches"],
    )


def _merge(rows: pa.Table) -> pa.Table:
    """What the blocks of the benchmark found in one text, as one row."""
    got = rows.column(COLUMN).to_pylist()
    spans: list[list[int]] = []
    for s in sorted((s["start"], s["stop"]) for g in got for s in g["spans"]):
        if spans and s[0] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], s[1])
        else:
            spans.append(list(s))
    one = {
        "n_words": got[0]["n_words"],
        "n_hit": sum(b - a for a, b in spans),
        "items": sorted({i for g in got for i in g["items"]}),
        "spans": [{"start": a, "stop": b} for a, b in spans],
        "matches": sorted((m for g in got for m in g["matches"]), key=lambda m: (m["doc_word"], m["item_id"], m["item_word"])),
    }
    return pa.table({"text_key": rows.column("text_key").slice(0, 1), COLUMN: pa.array([one], rows.schema.field(COLUMN).type)})


def _search_block(rows: DataFrame, bench: Benchmark, hits_only: bool) -> tuple[DataFrame, object]:
    """`rows` with COLUMN, and the broadcast that it reads; or (text_key, COLUMN) of the texts with a hit."""
    shared = rows.sparkSession.sparkContext.broadcast(bench)  # bounded by the characters of a block

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", SHARD_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, _digest(shared.value, texts_of(batch))], names=[*batch.schema.names, COLUMN])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", SHARD_BYTES):
            texts = texts_of(batch)
            column = _digest(shared.value, texts)
            some = np.flatnonzero(np.asarray(column.field("n_hit")))
            keys = pa.array([hashlib.sha256(texts[i]).hexdigest() for i in some], pa.string())
            yield pa.RecordBatch.from_arrays([keys, column.take(pa.array(some, pa.int64()))], names=["text_key", COLUMN])

    if hits_only:
        return rows.select("text").mapInArrow(hits, f"text_key string, {COLUMN} {_TYPE}"), shared
    return rows.mapInArrow(whole, rows.withColumn(COLUMN, F.lit(None).cast(_TYPE)).schema), shared


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`docs` with a struct column `contamination`, which replaces one of that name; all other columns and rows stay.

    It has n_words, n_hit, the sorted item ids (as strings) that occur, the hit spans and all longest
    verbatim matches: item, first word in the document and in the item, words.  Null texts have no
    words; items without a word never occur; a null item_id is reported as "".  Repeated rows are
    searched alike.  An empty table gives no rows, an empty benchmark no hits.

    A benchmark of more than `block_chars` characters is searched block by block, one pass over the texts
    and one broadcast each, which is given up before the next; what the passes find is joined by the
    hash of the text.  So memory doesn't grow with the benchmark, and results don't depend on
    `block_chars`.  An item has to fit a block.
    """
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").alias("text")).where("text is not null")
    total = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    docs = docs.drop(COLUMN)
    prepared = lambda part: Benchmark([(r["item_id"], r["text"]) for r in part.collect()], window)
    if blocks == 1:
        return _search_block(docs, prepared(bench), hits_only=False)[0]
    found = None
    for b in range(blocks):
        hits, shared = _search_block(docs, prepared(bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)), hits_only=True)
        hits = checkpointed(hits.dropDuplicates(["text_key"]))
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("text_key").applyInArrow(_merge, found.schema)
    key = "_" * (1 + max(map(len, docs.columns))) + "key"
    joined = docs.withColumn(key, F.sha2("text", 256)).join(found.withColumnRenamed("text_key", key), key, "left")
    n_words = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    none = F.struct(n_words, F.lit(0).cast("long"), F.array(), F.array(), F.array()).cast(_TYPE)
    return joined.select(*docs.columns, F.coalesce(F.col(COLUMN), none).alias(COLUMN))


def is_contaminated():
    c = F.col(COLUMN)
    return (c["n_hit"] > 0) & (c["n_hit"] * HIT_FACTOR >= c["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return find_matches(docs, benchmark, **options).where(~is_contaminated()).select(*docs.columns)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = find_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    c = F.col(COLUMN)
    return got.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, dw.k AS k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
