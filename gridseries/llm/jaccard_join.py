"""Exact Jaccard join of word-shingle sets, and its connected components.

Documents with the same text count as one (their smallest doc_id).  The document frequency of every
shingle over all documents gives the global token order, rare first.  A set's prefix is as many of
its first tokens as two linked sets cannot both miss.  Then

* rare tokens of the prefix (in 2 to `rare` documents) are indexed one by one;
* a set whose prefix reaches frequent tokens may meet its partners in those alone.  It extends to
  all its frequent tokens and indexes combinations of them: two linked sets of the same sizes differ
  in at most D tokens, so of D + 1 classes into which a hash deals the frequent tokens one holds the
  same combination in both (all k-combinations would grow with a power of the length);
* tokens of one document only are never indexed.

Sets that share a signature are candidates, and are verified as whole sets.  First each signature's
documents of one chunk are verified against the smallest of them, and those smallest ones against the
smallest of all: about one pair for each document.  Signatures whose documents are of one component
then are done.  In the others, pairs of documents of different components are verified: all of them at
once in a group of `SMALL` documents at most.  The documents of larger groups are gathered around the
groups' smallest document, as the many signatures of near copies mostly have that in common, and compared
in pairs of blocks, which tell only the links that tie components together.  A pair is compared if both
have a signature, never because a chain of candidates leads from one to the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.arrowtext import Words, mix, or_empty, texts_of
from gridseries.llm.components import components, merged
from gridseries.llm.session import checkpointed, shuffle_partitions
from gridseries.llm.substring_dedup import block_of, packed, split

SHINGLE = 4
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A token in more documents than this is frequent.
RARE = 16
#: All pairs of components of a signature with so many documents at most are verified at once.
SMALL = 16
#: Documents of a block of those around one pivot.
BLOCK_DOCS = 1024


def shingle_sets(texts: list[bytes | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of all sets, sorted: distinct n-word shingles, or all words of a shorter text."""
    words = Words(texts, lower=True)
    at, grams = words.grams(n)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        whole = []
        for i in short:
            acc = int(words.counts[i])
            for h in words.hash[words.first[i] : words.first[i + 1]].tolist():
                acc = (acc * 0xD6E8FEB86659FD93 + h) % (1 << 64)
            whole.append(acc)
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, mix(np.array(whole, np.uint64))])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[new], grams[new]


def size_bands(largest: int, percent: int = PERCENT) -> np.ndarray:
    """Lower bounds of size bands such that linked sets are in one band or in two that adjoin."""
    bounds = [1]
    while bounds[-1] <= largest * 2 + 2:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array(bounds, np.int64)


def signatures(tokens: np.ndarray, frequency: np.ndarray, bands: np.ndarray, percent: int = PERCENT, rare: int = RARE) -> np.ndarray:
    """The signatures of one set (distinct tokens and their document frequencies)."""
    n = len(tokens)
    prefix = n - (percent * n + 99) // 100 + 1
    order = np.lexsort((tokens, frequency))[:prefix]
    first = frequency[order]
    out = [tokens[order][(first > 1) & (first <= rare)]]
    if first[-1] > rare:
        frequent = tokens[frequency > rare]
        band = int(np.searchsorted(bands, n, "right")) - 1
        for group in {max(band - 1, 0), band}:
            a = int(bands[group + 1]) - 1  # the largest smaller set of the group, and its largest partner
            most = (100 - percent) * (a + a * 100 // percent) // (100 + percent)
            classes = most + 1 + max(2, most // 10)
            salted = mix(frequent ^ np.uint64(0x5851F42D4C957F2D * (group + 1) & (1 << 64) - 1))
            of = (salted % np.uint64(classes)).astype(np.int64)
            sums, sizes = np.zeros(classes, np.uint64), np.bincount(of, minlength=classes)
            np.add.at(sums, of, mix(salted))
            combined = mix(sums + mix(np.arange(classes, dtype=np.uint64) + np.uint64(classes << 32)))
            # Empty classes say nothing, and `classes` has some to spare for them; a set that has more keeps them.
            out.append(combined if (sizes == 0).sum() > classes - most - 1 else combined[sizes > 0])
    return np.unique(np.concatenate(out))


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _rows_of(chunk: pa.Table, notes: pa.Table) -> tuple[pa.Table, list[int]]:
    """One row for each doc_id of the chunk that stands for its text; notes name those that don't."""
    copies = set(or_empty(notes, doc_id=pa.int64()).column("doc_id").to_pylist())
    chosen: dict[int, tuple[str, int]] = {}
    for i, (d, key) in enumerate(zip(chunk.column("doc_id").to_pylist(), chunk.column("text_key").to_pylist())):
        if d not in copies and (d not in chosen or key < chosen[d][0]):
            chosen[d] = key, i
    rows = chunk.take(pa.array(sorted(i for _, i in chosen.values()), pa.int64()))
    return rows, rows.column("doc_id").to_pylist()


def _low(keys: np.ndarray, blocks: int) -> np.ndarray:
    """The 32 bits after those that make the block, in the order of the keys; with the block they tell tokens apart well enough for an order."""
    return ((keys * np.uint64(blocks)) >> np.uint64(32)).astype(np.uint32)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each is there, 255 at most."""
    keys, count = np.unique(keys, return_counts=True)
    return keys, np.minimum(count, 255).astype(np.uint8)


def _send(blocks: int, n: int):
    def run(chunk: pa.Table, notes: pa.Table) -> pa.Table:
        rows, _ = _rows_of(chunk, notes) if chunk.num_rows else (chunk, [])
        keys, count = _counted(shingle_sets(texts_of(rows), n)[1] if rows.num_rows else np.zeros(0, np.uint64))
        at = split(keys, blocks)
        full = np.flatnonzero(np.diff(at))
        number = chunk.column("chunk")[0].as_py() if chunk.num_rows else 0
        parts = [slice(at[b], at[b + 1]) for b in full]
        low = _low(keys, blocks)
        return pa.table({"block": pa.array(full, pa.int32()), "chunk": pa.array(np.full(len(full), number), pa.int32()), "keys": pa.array([packed(low[p]) for p in parts], pa.binary()), "counts": pa.array([count[p].tobytes() for p in parts], pa.binary())})

    return run


def _low_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


def _count(block: pa.Table) -> pa.Table:
    """For the keys that each chunk sent, in their order: in how many documents they are, 255 at most."""
    parts = [_low_keys(k) for k in block.column("keys").to_pylist()]
    ends = np.cumsum([len(p) for p in parts])
    _, which = np.unique(np.concatenate(parts), return_inverse=True)
    own = np.frombuffer(b"".join(block.column("counts").to_pylist()), np.uint8)
    frequency = np.minimum(np.bincount(which, own), 255).astype(np.uint8)[which]
    return pa.table({"chunk": block.column("chunk"), "block": block.column("block"), "doc_id": pa.nulls(len(parts), pa.int64()), "counts": pa.array([frequency[e - len(p) : e].tobytes() for p, e in zip(parts, ends)], pa.binary())})


_FOUND = "block int, doc_id long, partner long, n long, tokens binary, signatures binary, doc_ids binary"
_FOUND_ARROW = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("partner", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("signatures", pa.binary()), ("doc_ids", pa.binary())])


def _with_smallest(signature: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The distinct pairs (smallest document of the signature, another one of it)."""
    order = np.lexsort((doc, signature))
    s, d = signature[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    pivot = np.repeat(d[first], np.diff(np.append(first, len(s))))
    return np.unique(np.stack([pivot, d], 1)[pivot != d], axis=0)


def _find(blocks: int, n: int, percent: int, rare: int):
    """Of each chunk: (doc_id, n, tokens, signatures) of its sets, (doc_id, partner) to verify, and its signatures and
    their documents for each block."""

    def run(chunk: pa.Table, notes: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return _FOUND_ARROW.empty_table()
        notes = or_empty(notes, block=pa.int32(), doc_id=pa.int64(), counts=pa.binary())
        answered = notes.filter(pc.is_valid(notes.column("counts"))).sort_by("block")
        rows, ids = _rows_of(chunk, notes.filter(pc.is_valid(notes.column("doc_id"))))
        if not ids:
            return _FOUND_ARROW.empty_table()
        doc, tokens = shingle_sets(texts_of(rows), n)
        _, which = np.unique(tokens, return_inverse=True)
        frequency = np.frombuffer(b"".join(answered.column("counts").to_pylist()), np.uint8)[which].astype(np.int64)
        bounds = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        bands = size_bands(int(np.diff(bounds).max(initial=1)), percent)
        out, all_signatures, owners = [], [], []
        for i, doc_id in enumerate(ids):
            own, often = tokens[bounds[i] : bounds[i + 1]], frequency[bounds[i] : bounds[i + 1]]
            found = signatures(own, often, bands, percent, rare) if len(own) else own
            out.append({"doc_id": doc_id, "n": len(own), "tokens": own.tobytes() if len(found) else None, "signatures": found.tobytes() if len(found) else None})
            all_signatures.append(found)
            owners.append(np.full(len(found), doc_id, np.int64))
        found, owner = np.concatenate(all_signatures), np.concatenate(owners)
        out += [{"doc_id": a, "partner": b} for a, b in _with_smallest(found, owner).tolist()]
        order = np.lexsort((owner, found))
        found, owner = found[order], owner[order]
        at = split(found, blocks)
        for b in np.flatnonzero(np.diff(at)):
            s = slice(at[b], at[b + 1])
            out.append({"block": int(b), "signatures": found[s].tobytes(), "doc_ids": owner[s].tobytes()})
        return pa.Table.from_pylist(out, _FOUND_ARROW)

    return run


def _first_of_chunk(batches):
    """Of each signature of a chunk the smallest document only."""
    for batch in batches:
        signature, doc = [], []
        for s, d in zip(batch.column("signatures").to_pylist(), batch.column("doc_ids").to_pylist()):
            own, first = np.unique(np.frombuffer(s, np.uint64), return_index=True)
            signature.append(own.tobytes())
            doc.append(np.frombuffer(d, np.int64)[first].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(signature, pa.binary()), pa.array(doc, pa.binary())], names=["block", "signatures", "doc_ids"])


def _pivot_pairs(block: pa.Table) -> pa.Table:
    """(a, b): the smallest document of each signature with the smallest ones of its chunks."""
    s = np.frombuffer(b"".join(block.column("signatures").to_pylist()), np.uint64)
    d = np.frombuffer(b"".join(block.column("doc_ids").to_pylist()), np.int64)
    pairs = _with_smallest(s, d)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) that are linked."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("tokens").alias(f"tokens_{x}"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = intersection(p, q) if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) else 0
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long")


def _signed_rows(batches):
    """(signature, label) of each document's signatures."""
    for batch in batches:
        found = [np.frombuffer(s, np.int64) for s in batch.column("signatures").to_pylist()]
        label = np.repeat(batch.column("label").to_numpy(), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.int64)]), pa.int64()), pa.array(label, pa.int64())], names=["signature", "label"])


def _members(batches):
    """(signature, doc_id) of those signatures of a chunk that are wanted of its block."""
    for batch in batches:
        signature, doc = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, d, wanted in zip(*(batch.column(c).to_pylist() for c in ("signatures", "doc_ids", "wanted"))):
            s = np.frombuffer(s, np.int64)
            has = np.isin(s, np.array(wanted, np.int64))
            signature.append(s[has])
            doc.append(np.frombuffer(d, np.int64)[has])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signature), pa.int64()), pa.array(np.concatenate(doc), pa.int64())], names=["signature", "doc_id"])


def _small_pairs(percent: int):
    """The pairs of documents of different components of the small signatures of one bucket, if their sizes may be linked."""

    def run(rows: pa.Table) -> pa.Table:
        signature, doc, label, n = (rows.column(c).to_numpy() for c in ("signature", "doc_id", "label", "n"))
        order = np.lexsort((doc, signature))
        signature, doc, label, n = signature[order], doc[order], label[order], n[order]
        found = [np.zeros((0, 2), np.int64)]
        for step in range(1, SMALL):  # of each document, its neighbour that many places on
            a, b = slice(None, -step), slice(step, None)
            if step >= len(doc):
                break
            ok = (signature[a] == signature[b]) & (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            found.append(np.stack([doc[a][ok], doc[b][ok]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


def _join_block(percent: int):
    """Of two blocks of documents around one pivot: links that tie components together, of those that share a signature."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        ids, labels, mine = (rows.column(c).to_pylist() for c in ("doc_id", "label", "mine"))
        low, high = (rows.column(c)[0].as_py() for c in ("low", "high"))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        starts = np.concatenate([[0], np.cumsum(size)])
        names, number = np.unique(np.concatenate(sets), return_inverse=True)
        own = [np.array(x, np.int64) for x in rows.column("own").to_pylist()]
        own_starts = np.cumsum([0, *map(len, own)])
        own_names, signature = np.unique(np.concatenate(own), return_inverse=True)
        root, block, label, found = {x: x for x in labels}, np.array(mine), np.array(labels), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in np.flatnonzero(block == low).tolist():
            # Pairs across two blocks; within a block, those with later documents.
            others = block == high if low != high else np.arange(len(ids)) > i
            others &= (label != label[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            if not others.any():
                continue
            shared = np.zeros(len(own_names), bool)
            shared[signature[own_starts[i] : own_starts[i + 1]]] = True
            j = np.flatnonzero(others & np.logical_or.reduceat(shared[signature], own_starts[:-1]))
            if not len(j):
                continue
            flag = np.zeros(len(names), np.int64)
            flag[number[starts[i] : starts[i + 1]]] = 1
            at = np.concatenate([number[starts[k] : starts[k + 1]] for k in j])
            both = np.add.reduceat(flag[at], np.cumsum(size[j]) - size[j])
            for k in j[100 * both >= percent * (size[j] + size[i] - both)].tolist():
                x, y = find(labels[i]), find(labels[k])
                if x != y:
                    root[x] = y
                    found.append((ids[i], ids[k]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _go_through(packed_rows: DataFrame, sets: DataFrame, pairs: DataFrame, labels: DataFrame, percent: int, blocks: int, block_docs: int) -> DataFrame:
    """`labels` after all links between documents of different components that share a signature.

    A signature has documents of several components only if a pair that was verified in it has, so
    those pairs tell which signatures to look at.
    """
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("label_a", "a").alias("label_a"), F.coalesce("label_b", "b").alias("label_b")).where("label_a <> label_b")
    ends = checkpointed(apart.select(F.col("a").alias("doc_id"), F.col("label_a").alias("label")).unionByName(apart.select(F.col("b").alias("doc_id"), F.col("label_b").alias("label"))).distinct())
    signed = sets.select("doc_id", "signatures").join(ends, "doc_id").select("signatures", "label").mapInArrow(_signed_rows, "signature long, label long")
    wanted = signed.groupBy("signature").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("signature")
    # The block of a signature, as in block_of.
    block = F.shiftrightunsigned(F.shiftrightunsigned("signature", 32) * blocks, 32).cast("int")
    by_block = wanted.groupBy(block.alias("block")).agg(F.collect_list("signature").alias("wanted"))
    found = packed_rows.join(by_block, "block").select("signatures", "doc_ids", "wanted").mapInArrow(_members, "signature long, doc_id long")
    info = sets.select("doc_id", "n").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", F.coalesce("label", "doc_id").alias("label"))
    members = checkpointed(found.join(info, "doc_id").select("signature", "doc_id", "n", "label"))
    groups = checkpointed(members.groupBy("signature").agg(F.count("*").alias("size"), F.min("doc_id").alias("pivot")))

    small = members.join(groups.where(F.col("size") <= SMALL).select("signature"), "signature").withColumn("bucket", F.pmod("signature", F.lit(blocks)))
    more = small.groupBy("bucket").applyInArrow(_small_pairs(percent), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
    links = _verify(checkpointed(more), sets, percent)

    around = members.join(groups.where(F.col("size") > SMALL), "signature").groupBy("pivot", "doc_id", "label").agg(F.collect_list("signature").alias("own"))
    around = checkpointed(around)
    parts = around.groupBy("pivot").agg(F.ceil(F.count("*") / block_docs).cast("int").alias("parts"))
    rows = around.join(parts, "pivot").withColumn("mine", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("pivot", "doc_id", "label", "own", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    more_links = rows.join(sets.select("doc_id", "tokens"), "doc_id").groupBy("pivot", "low", "high").applyInArrow(_join_block(percent), "a long, b long")
    return merged(labels, checkpointed(links.unionByName(more_links)))


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, rare: int = RARE, chunks: int | None = None, blocks: int | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of `docs` (doc_id, text), one row for each row with a doc_id.

    Sets are the distinct n-word shingles of the text with A-Z lower-cased; shorter texts are one
    shingle; null and empty texts have none and are linked with nothing.  Rows without doc_id give no
    row.  Of rows that share a doc_id the text with the smallest hash counts for all of them.  doc_id has
    to be an integer; other columns of `docs` are not in the result.  An empty table gives no rows.
    """
    parts = shuffle_partitions(docs.sparkSession)
    blocks, chunks = blocks or parts, chunks or 2 * parts
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("text_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    own = docs.groupBy("doc_id").agg(F.min("text_key").alias("text_key"), F.count("*").alias("rows"))
    classes = own.groupBy("text_key").agg(F.min("doc_id").alias("rep"))
    members = checkpointed(own.join(classes, "text_key").select("doc_id", "rep", "rows"))

    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk")
    dealt = docs.select("*", chunk).repartition(parts, "chunk")
    copies = members.where("doc_id <> rep").select(chunk, "doc_id")
    sent = dealt.groupBy("chunk").cogroup(copies.groupBy("chunk")).applyInArrow(_send(blocks, n), "block int, chunk int, keys binary, counts binary")
    counted = sent.groupBy("block").applyInArrow(_count, "chunk int, block int, doc_id long, counts binary")
    notes = counted.unionByName(copies, allowMissingColumns=True)
    found = checkpointed(dealt.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(_find(blocks, n, percent, rare), _FOUND))

    sizes = found.where("n is not null").select("doc_id", "n")
    sets = found.where("tokens is not null").select("doc_id", "n", "tokens", "signatures")
    by_block = found.where("block is not null").select("block", "signatures", "doc_ids")
    in_chunks = found.where("partner is not null").select(F.col("doc_id").alias("a"), F.col("partner").alias("b"))
    across = by_block.mapInArrow(_first_of_chunk, "block int, signatures binary, doc_ids binary").groupBy("block").applyInArrow(_pivot_pairs, "a long, b long")
    pairs = checkpointed(in_chunks.unionByName(across).distinct())
    labels = checkpointed(components(_verify(pairs, sets, percent)))
    labels = _go_through(by_block, sets, pairs, labels, percent, blocks, block_docs)

    reps = sizes.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").select(F.col("doc_id").alias("rep"), "n", F.coalesce("label", "doc_id").alias("label"))
    out = members.join(reps, "rep").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("doc_id")).alias("component_id"), "rows")
    return out.select("doc_id", "n_shingles", "component_id", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("_")).drop("_")


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT l.b AS a, r.c FROM r JOIN l ON l.a = r.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(c) FROM r WHERE r.a = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
