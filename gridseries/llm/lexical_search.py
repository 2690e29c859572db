"""Ranked lexical search: range-maximum tables over posting lists, searched best first.

Every shard of documents (some megabytes of text) is indexed by itself: of each term that any query asks
for, its postings in the order of doc_id with their impacts, and a sparse table that answers in which posting of
any range the impact is largest.  A query begins with the shard as one interval of documents.  The sum of
its terms' range maxima bounds every score inside.  The interval with the highest bound is split at the document
of its largest impact: that document is scored, what is left and right of it becomes two intervals with bounds of
their own, and intervals that can't reach the query's tenth best document so far are given up.  All
queries advance together, each with its best few intervals, as flat arrays.

The terms' document frequencies come from one pass over all documents before it.  Terms are equal when
their 64-bit hashes are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseries.llm.arrowtext import PUNCT, Words, small_batches, texts_of

K = 10
SHARD_BYTES = 8 << 20
#: Characters of queries that are searched at a time; what is collected and broadcast is bounded by it.
BLOCK_CHARS = 8_000_000
#: Intervals of a query that are split at once.
WIDTH = 8
#: Postings of the queries that advance together, over all their terms.
GROUP_TERMS = 1 << 16
_NO_ID = np.iinfo(np.int64).max


class Queries:
    """Distinct terms of some queries: query q has `terms[first[q]:first[q + 1]]`, numbers of `vocabulary`."""

    def __init__(self, texts: list[str | None]):
        words = Words([(t or "").encode() for t in texts], PUNCT, lower=True)
        self.vocabulary, number = np.unique(words.hash, return_inverse=True)
        pairs = np.unique(words.doc * (len(self.vocabulary) + 1) + number)
        self.terms = pairs % (len(self.vocabulary) + 1)
        self.first = np.searchsorted(pairs // (len(self.vocabulary) + 1), np.arange(len(texts) + 1))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Of each hash its number, or -1."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


def _postings(queries: Queries, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, text, occurrences), by term and text."""
    number = queries.numbers(words.hash)
    some = np.flatnonzero(number >= 0)
    key, tf = np.unique(number[some] * words.n_docs + words.doc[some], return_counts=True)
    return key // max(words.n_docs, 1), key % max(words.n_docs, 1), tf


def _lengths_part(words: Words, total: int, n_docs: int) -> np.ndarray:
    """Of each text 100 - 90 + (90 * n * N) div L, without overflow."""
    n = words.counts
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([10 + (90 * int(x) * n_docs) // total for x in n], np.int64)
    return 10 + (90 * n * n_docs) // total


class Index:
    """The posting lists of a shard, one after the other, and one sparse table over them all.

    `key` is term * documents + document.  best[j, i] is the place of the largest impact, the first of
    equal ones, among the 2^j postings from i on; a range that is asked for lies in one list.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        self.n_docs, self.doc, self.impact = n_docs, doc, impact
        self.key = term * n_docs + doc
        self.first = np.searchsorted(term, np.arange(n_terms + 1))
        longest = int(np.diff(self.first).max(initial=0))
        levels = [np.arange(len(doc), dtype=np.int32)]
        for j in range(1, max(longest, 1).bit_length()):
            last, step = levels[-1], 1 << (j - 1)
            level = last.copy()
            level[:-step] = np.where(impact[last[step:]] > impact[last[:-step]], last[step:], last[:-step])
            levels.append(level)
        self.best = np.stack(levels)
        self._log = np.array([0, 0, *(x.bit_length() - 1 for x in range(2, longest + 1))], np.int8)

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of the largest impact in each range, none of which is empty."""
        j = self._log[hi - lo]
        a, b = self.best[j, lo], self.best[j, hi - (1 << j.astype(np.int64))]
        return np.where(self.impact[b] > self.impact[a], b, a)


class Best:
    """The best documents so far of each query: scores, highest first, and ids, smallest first among equals."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.zeros((n, k), np.int64), np.full((n, k), _NO_ID)

    def offer(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        some = score > 0
        query, ids, score = query[some], ids[some], score[some]
        k = self.score.shape[1]
        asked = np.unique(query)
        q = np.concatenate([np.repeat(asked, k), query])
        s, d = np.concatenate([self.score[asked].ravel(), score]), np.concatenate([self.id[asked].ravel(), ids])
        order = np.lexsort((d, -s, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[place < k]
        self.score[asked], self.id[asked] = s[order].reshape(-1, k), d[order].reshape(-1, k)

    def open(self, query: np.ndarray, bound: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        """Whether a document of an interval may still come in: bounds reach the last one, ties by id."""
        last = self.score[query, -1]
        return (bound > last) | ((bound == last) & (bound > 0) & (first_id < self.id[query, -1]))


def _search(queries: Queries, index: Index, ids: np.ndarray, best: Best, width: int, some: np.ndarray) -> None:
    """Searches the queries `some`.  An interval is (query, range of its postings of each of its terms)."""
    count = queries.first[some + 1] - queries.first[some]
    term = queries.terms[np.repeat(queries.first[some] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    lo, hi, owner = index.first[term], index.first[term + 1], np.repeat(np.arange(len(some)), count)
    pool = _intervals(index, ids, best, some, owner, term, lo, hi)
    while len(pool[0]):
        query, bound, first, term, lo, hi = pool
        order = np.lexsort((-bound, query))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        now = place < width
        size = np.diff(first)
        of = np.repeat(np.arange(len(query)), size)
        mine = now[of]
        q, t, l, h = query[now], term[mine], lo[mine], hi[mine]
        number = (np.cumsum(now) - 1)[of[mine]]
        starts = np.concatenate([[0], np.cumsum(size[now])])[:-1]
        place = index.largest(l, h)
        impact = index.impact[place]
        most = np.maximum.reduceat(impact, starts)
        # The first of the postings with the largest impact says where to split.
        top = np.flatnonzero(impact == most[number])
        at = index.doc[place[top[np.searchsorted(number[top], np.arange(len(q)))]]]
        cut = np.searchsorted(index.key, t * index.n_docs + at[number])
        hit = (cut < h) & (index.doc[np.minimum(cut, len(index.doc) - 1)] == at[number])
        best.offer(q, ids[at], np.add.reduceat(np.where(hit, index.impact[np.minimum(cut, len(index.doc) - 1)], 0), starts))
        new = _intervals(index, ids, best, np.concatenate([q, q]), np.concatenate([number, number + len(q)]), np.concatenate([t, t]), np.concatenate([l, cut + hit]), np.concatenate([cut, h]))
        # What is left of the others, after the scores of this round.
        keep = ~now
        rest_first = np.concatenate([[0], np.cumsum(size[keep])])
        rest = (query[keep], bound[keep], rest_first, term[~mine], lo[~mine], hi[~mine])
        pool = _joined(_opened(index, ids, best, rest), new)


def _intervals(index: Index, ids: np.ndarray, best: Best, query: np.ndarray, owner: np.ndarray, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query, bound, first, term, lo, hi) of the intervals that are open; `owner` numbers them, in order."""
    some = lo < hi
    owner, term, lo, hi = owner[some], term[some], lo[some], hi[some]
    bound = np.zeros(len(query), np.int64)
    np.add.at(bound, owner, index.impact[index.largest(lo, hi)])
    first = np.searchsorted(owner, np.arange(len(query) + 1))
    return _opened(index, ids, best, (query, bound, first, term, lo, hi))


def _opened(index: Index, ids: np.ndarray, best: Best, pool: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    query, bound, first, term, lo, hi = pool
    size = np.diff(first)
    filled = np.flatnonzero(size)
    first_id = np.full(len(query), _NO_ID)
    if len(filled):
        first_id[filled] = ids[np.minimum.reduceat(index.doc[lo], first[:-1][filled])]
    keep = (size > 0) & best.open(query, bound, first_id)
    mine = np.repeat(keep, size)
    return query[keep], bound[keep], np.concatenate([[0], np.cumsum(size[keep])]), term[mine], lo[mine], hi[mine]


def _joined(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    q, bound, first, *rest = (np.concatenate(x) for x in zip(a, b))
    return q, bound, np.concatenate([a[2], b[2][1:] + a[2][-1]]), *rest


def search_shard(queries: Queries, weight: np.ndarray, n_docs: int, total: int, texts: list[bytes | None], ids: np.ndarray, best: Best, width: int = WIDTH) -> None:
    """Offers the best documents of a shard, whose ids are in order, to `best`."""
    words = Words(texts, PUNCT, lower=True)
    term, doc, tf = _postings(queries, words)
    if not len(term):
        return
    m = _lengths_part(words, total, n_docs)
    impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    some = impact > 0
    index = Index(term[some], doc[some], impact[some], len(queries.vocabulary), words.n_docs)
    if not len(index.doc):
        return
    # Queries go in groups, so that what advances together is bounded, unless one query has more terms.
    ends, at = queries.first[1:], 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, queries.first[at] + GROUP_TERMS, "right")))
        _search(queries, index, ids, best, width, np.arange(at, to))
        at = to


def _statistics(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms, documents of each term asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        n, total, df = 0, 0, np.zeros(len(queries.vocabulary), np.int64)
        for batch in small_batches(batches):
            words = Words(texts_of(batch), PUNCT, lower=True)
            n, total = n + int((words.counts > 0).sum()), total + len(words.start)
            df += np.bincount(_postings(queries, words)[0], minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], seen])), pa.array(np.concatenate([[n, total], df[seen]]))], names=["term", "n"])

    counts = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # the terms of a block, at most
    found = {r["term"]: r["n"] for r in counts}
    df = np.zeros(len(shared.value.vocabulary), np.int64)
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    return found.get(-2, 0), found.get(-1, 0), df


def _search_block(docs: DataFrame, items: list, id_type: str, block: int, k: int, shard_bytes: int) -> DataFrame:
    """(item, item_id, doc_id, score): of each item at least its `k` best documents."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(Queries([i["text"] for i in items]))  # bounded by the characters of a block
    n_docs, total, df = _statistics(docs, shared)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        best = Best(len(queries.first) - 1, k)
        for batch in small_batches(batches, most=shard_bytes):
            order = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            texts, by_id = texts_of(batch), np.argsort(order, kind="stable")
            search_shard(queries, weight, n_docs, total, [texts[i] for i in by_id], order[by_id], best)
        item, place = np.nonzero(best.score)
        ids = best.id[item, place]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == _NO_ID), pa.array(best.score[item, place])], names=["item", "doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "item long, doc_id long, score long")
    names = docs.sparkSession.createDataFrame([(n, i["item_id"]) for n, i in enumerate(items)], f"item long, item_id {id_type}")
    return found.join(F.broadcast(names), "item").withColumn("block", F.lit(block))


def search(docs: DataFrame, items: DataFrame, k: int = K, block_chars: int = BLOCK_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the `k` documents that score highest, equal scores by doc_id.

    Terms are runs of ASCII letters, ASCII digits and other non-ASCII characters, A-Z lower-cased.  Null
    and empty texts have none: such documents are in no result, such items have no result.  doc_id is an
    integer, or a cast error is raised; a null one comes after all others among equal scores.  Repeated rows of
    documents are documents of their own; items that repeat an id and a text are one, items that only share
    the id are ranked each for itself.  Empty tables give no rows.  A document has to fit a task's memory.

    `items` of more than `block_chars` characters are searched block by block, two passes over the documents each.
    """
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType.simpleString()
    asked = items.select(F.col("item_id").alias("item_id"), F.col("text").alias("text")).where("text is not null").distinct()
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks, out = max(1, -(-size // block_chars)), None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if not part:
            continue
        found = _search_block(docs, part, id_type, b, k, shard_bytes)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # Tasks first meet in groups, so no task reads what all tasks found for an item.
    out = out.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item", "part").orderBy(*order))).where(F.col("rank") <= k)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item").orderBy(*order))).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return search(read("documents"), read("benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) AS docs, sum(len(w)) AS total FROM d WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY r, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
i AS (SELECT p.r, p.t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + CAST((90 * len(w) * docs) // total AS BIGINT)))) AS impact
      FROM p JOIN f ON p.t = f.t JOIN d ON p.r = d.r, c),
s AS (SELECT item_id, text, d.r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM b JOIN i ON b.t = i.t JOIN d ON i.r = d.r GROUP BY item_id, text, d.r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""
