"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted target / size times; the whole part is taken outright and the
fraction is rounded.  Pivotal rounding pairs two open fractions and moves mass between them, up or
down at random so that no expectation changes, until one of the two is 0 or 1.  Mass is counted in
words, so the words a source gives are its target's except for the last document left open.

The documents of a source are dealt into buckets of about `bucket_rows` rows, by their number alone;
each bucket rounds all but one of its documents, and what is left open climbs a tree of ever fewer
buckets.  Sources that fit one bucket share a task with others.  Rows carry no texts, and no bucket
grows with a source.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseries.llm.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: A document is taken this often at most.
MAX_COPIES = 3
#: Rows that one bucket rounds.
BUCKET_ROWS = 5_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, n_rows, target) of `sizes` (source, size).

    Sources are ordered by code point, null last, and weigh `weights` in turn.  Their targets share
    the total size by weight; a target stops at max_copies times its source's size, and the excess is
    shared again by weight among the others.  That fixed point is found in closed form: in the order
    of cap / weight, sources are capped as long as the share left for them is above their cap.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    # One row for each source: these windows order sources, never documents.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    cap = (F.col("source_size") * max_copies).cast("double")
    fill = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("cap", cap)
    by = by.withColumns({"capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "used": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "total": F.sum("source_size").over(every).cast("double"), "weights": F.sum("weight").over(every)})
    # The level (words for each unit of weight) if all sources before this one are capped and it isn't.
    level = (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("used"))
    by = by.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    by = by.withColumn("level", F.first("level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return by.select("source", "source_size", "n_rows", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _pivotal(size: np.ndarray, p: np.ndarray, seed: int) -> int:
    """Rounds `p` in place, in this order, keeping sum(size * p) as it is; returns the index left open or -1.

    A document that is more than twice as large as its next partner is paired with all that follow at
    once, where they can bear its mass: else it would stay open to the end and the miss be its size.
    Sizes do not rise, so that happens once for each halving of the size at most.
    """
    coins = np.random.default_rng(seed).random(2 * len(p))
    i, rest = -1, None

    def suffixes(j: int) -> tuple:
        """From each index on, of the open documents: their words, smallest and largest fraction; `j` is where they begin."""
        is_open = (p[j:] > 0.0) & (p[j:] < 1.0)
        words = np.cumsum((size[j:] * is_open)[::-1])[::-1]
        return j, words, np.minimum.accumulate(np.where(is_open, p[j:], 1.0)[::-1])[::-1], np.maximum.accumulate(np.where(is_open, p[j:], 0.0)[::-1])[::-1]

    for j in range(len(p)):
        if i >= 0 and 0.0 < p[j] < 1.0 and size[i] > 2 * size[j]:
            rest = rest or suffixes(j)
            words, least, most = (x[j - rest[0]] for x in rest[1:])
            x = p[i]
            up, down = (1.0 - x) * size[i] / words, x * size[i] / words
            if up <= least and down <= 1.0 - most:
                rises = coins[len(p) + j] < x
                p[i] = 1.0 if rises else 0.0
                followers = j + np.flatnonzero((p[j:] > 0.0) & (p[j:] < 1.0))
                p[followers] += -up if rises else down
                i, rest = -1, None
        if not 0.0 < p[j] < 1.0:
            continue
        if i < 0:
            i = j
            continue
        a, b, x, y = size[i], size[j], p[i], p[j]
        up = min((1.0 - x) * a, y * b)  # words that i can gain from j
        down = min(x * a, (1.0 - y) * b)
        if coins[j] * (up + down) < down:
            move, full_i, full_j = up, (1.0 - x) * a <= y * b, y * b <= (1.0 - x) * a
            x, y = (1.0 if full_i else x + move / a), (0.0 if full_j else y - move / b)
        else:
            move, full_i, full_j = down, x * a <= (1.0 - y) * b, (1.0 - y) * b <= x * a
            x, y = (0.0 if full_i else x - move / a), (1.0 if full_j else y + move / b)
        p[i], p[j] = x, y
        if 0.0 < y < 1.0:
            i = j
        elif not 0.0 < x < 1.0:
            i = -1
    return i


def _round_group(rows: pa.Table) -> pa.Table:
    """Rounds each (source, bucket) of the rows of one task group; doc_id is only carried along."""
    # From large to small: what is left open at the end is a small document, and the miss is no larger.
    rows = rows.sort_by([("source", "ascending"), ("bucket", "ascending"), ("size", "descending"), ("ticket", "ascending"), ("doc_id", "ascending")])
    fraction = rows.column("fraction").to_numpy().copy()
    size = rows.column("size").to_numpy().astype(float)
    source, bucket = rows.column("source").to_pylist(), rows.column("bucket").to_numpy()
    level, seed = rows.column("level")[0].as_py(), rows.column("seed")[0].as_py()
    last = rows.column("parts").to_numpy() == 1
    names = np.unique([repr(x) for x in source], return_inverse=True)[1]
    edges = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (bucket[1:] != bucket[:-1]), [True]]))
    for a, b in zip(edges[:-1], edges[1:]):
        key = int.from_bytes(hashlib.blake2b(f"{seed}/{level}/{bucket[a]}/{source[a]!r}".encode(), digest_size=8).digest(), "little")
        p = fraction[a:b]
        left = _pivotal(size[a:b], p, key)
        if left >= 0 and last[a]:
            p[left] = 1.0 if np.random.default_rng(key + 1).random() < p[left] else 0.0
    return rows.set_column(rows.schema.get_field_index("fraction"), "fraction", pa.array(fraction))


def mix(sizes: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES, bucket_rows: int = BUCKET_ROWS, fan_in: int = 64) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of `sizes` (doc_id, source, size).

    `copies` is how often the mix takes a row, from 0 to max_copies.  Rows of no words are never
    taken.  Repeated rows are rounded apart from each other.  doc_id may be of any type that sorts, and
    null.  Reruns give the same copies, on any cluster and with any number of shuffle partitions: all
    randomness comes from `seed`, the bucket and the row, and buckets from the number of a source's rows.
    Rows are dealt to buckets by id and size, so null ids don't meet; only rows that are equal in both share one.
    Other columns of `sizes` are not in the result.  An empty table gives no row.
    """
    sizes = sizes.select("doc_id", F.col("source").cast("string").alias("source"), F.col("size").cast("long").alias("size"))
    targets = source_targets(sizes, weights, max_copies)
    parts = F.ceil(F.col("n_rows") / bucket_rows).cast("long")
    targets = checkpointed(targets.withColumn("parts", parts))  # a row a source
    shape = targets.agg(F.max("parts").alias("most"), F.sum(F.when(F.col("parts") == 1, F.col("n_rows"))).alias("few")).first()
    key = F.struct(F.col("source").isNull(), F.coalesce(F.col("source"), F.lit("")))
    sized = sizes.withColumn("_key", key).join(targets.withColumn("_key", key).drop("source"), "_key").drop("_key")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_copies)))).otherwise(0.0)
    whole = F.when(F.col("size") > 0, F.floor(ratio + 1e-12)).otherwise(0)
    fraction = F.when((F.col("size") > 0) & (ratio - whole > 1e-12), ratio - whole).otherwise(0.0)
    ticket = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", F.lit(seed))
    rows = sized.select("doc_id", "source", "size", "source_size", "target", whole.cast("long").alias("whole"), fraction.alias("fraction"), ticket.alias("ticket"), F.lit(seed).alias("seed"), "parts", F.pmod("ticket", "parts").alias("bucket"))
    # Sources of one bucket are packed into groups of about that many rows together.
    packs = max(1, -(-(shape["few"] or 0) // bucket_rows))
    group = F.when(F.col("parts") > 1, F.xxhash64("source", "bucket")).otherwise(F.pmod(F.xxhash64("source"), F.lit(packs)))
    settled, at, level, most = [], rows, 0, shape["most"] or 1
    while True:
        staged = at.withColumns({"level": F.lit(level), "_group": group})
        got = staged.groupBy(F.col("parts") == 1, "_group").applyInArrow(_round_group, staged.schema).drop("_group", "level")
        if most == 1:
            settled.append(got)
            break
        got = checkpointed(got)
        is_open = (F.col("fraction") > 0) & (F.col("fraction") < 1)
        settled.append(got.where(~is_open))
        most, level = -(-most // fan_in), level + 1
        at = got.where(is_open).withColumn("parts", F.ceil(F.col("parts") / fan_in).cast("long")).withColumn("bucket", F.pmod("bucket", "parts"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("fraction").cast("long")).alias("copies"))


def mix_documents(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """`mix` of documents (doc_id, text, source), sized by their words; a null text has none.

    Words are counted once: ids and sizes are checkpointed.  Nulls, repeated rows and empty tables as in `mix`.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return mix(checkpointed(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))), seed, **options)


def op10(spark, sf_dir: str) -> DataFrame:
    got = mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
