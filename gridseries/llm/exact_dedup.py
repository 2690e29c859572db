"""Exact deduplication: radix tries over whole texts name the owner of each text.

Texts are equal when they are the same bytes after every run of ASCII white space became one space.

1. Map tasks put the texts they read into a compressed radix trie, whose terminal nodes hold the smallest
   doc_id and the number of rows.  A trie that outgrows its budget spills its largest subtrees: their
   terminals leave as rows, and what they had is put together again further on.
2. Rows are dealt by length and content hash, so equal texts meet.  A text that a map task saw more than
   once is dealt over `SALTS` partitions, so that a text that a third of all rows hold is no task's alone.
3. Each partition's rows come in the order of their bytes, so a subtree that the insertion has left is
   complete: it is spilled and its memory freed.  A task holds a few paths of its trie, whatever its size.
4. From there on no text moves.  The owners that the tries of one text's salts have named are combined, and
   rows find their owner, by the SHA-256 of the text, which is an output column.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.llm.session import checkpointed

#: Bytes of labels and nodes that a trie holds before it spills subtrees.
TRIE_BYTES = 48 << 20
#: Partitions over which the rows of a text that map tasks have seen repeatedly are dealt.
SALTS = 16
COLUMN = "copies"
#: Rows and bytes of an Arrow batch that a task gives out.
_OUT_ROWS, _OUT_BYTES = 8192, 8 << 20
#: Rows between two spills of complete subtrees.
_STEP = 64
#: Memory of a node beside its label.
_NODE_BYTES = 250
_SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, " ")


def _common(a: bytes, i: int, b: bytes) -> int:
    """How many bytes of a[i:] and b are equal from their beginnings on."""
    n = min(len(a) - i, len(b))
    if a.startswith(b[:n], i):
        return n
    lo, step = 0, 16
    while a.startswith(b[lo : lo + step], i + lo):  # they differ before n
        lo += step
        step *= 2
    hi = min(lo + step, n)
    while hi - lo > 1:
        mid = (lo + hi) >> 1
        lo, hi = (mid, hi) if a.startswith(b[lo:mid], i + lo) else (lo, mid)
    return lo


class Node:
    """An edge's label and what follows: children by first byte; of a terminal node its smallest id and rows."""

    __slots__ = ("label", "children", "owner", "rows", "ties")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.rows, self.ties = label, {}, None, 0, 0

    def add(self, owner, rows: int, ties: int) -> None:
        """`ties` is the number of rows with the smallest id.  No id is larger than null."""
        if not self.rows or (owner is not None and (self.owner is None or owner < self.owner)):
            self.owner, self.ties = owner, ties
        elif owner == self.owner:
            self.ties += ties
        self.rows += rows

    def size(self) -> int:
        total, todo = 0, [self]
        while todo:
            node = todo.pop()
            total += len(node.label) + _NODE_BYTES
            todo.extend(node.children.values())
        return total

    def terminals(self, before: bytes) -> Iterator[tuple[bytes, Node]]:
        """(whole text, node) in the order of bytes."""
        todo = [(self, before)]
        while todo:
            node, prefix = todo.pop()
            text = prefix + node.label
            if node.rows:
                yield text, node
            todo.extend((node.children[c], text) for c in sorted(node.children, reverse=True))


class PatriciaTrie:
    """A compressed radix trie of byte strings; no node but the root has a single child and no rows."""

    def __init__(self) -> None:
        self.root, self.bytes = Node(b""), 0

    def insert(self, text: bytes, owner, rows: int = 1, ties: int = 1) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.bytes += len(text) - at + _NODE_BYTES
                at, node = len(text), child
                break
            same = _common(text, at, child.label)
            if same < len(child.label):
                between = Node(child.label[:same])
                child.label = child.label[same:]
                between.children[child.label[0]] = child
                node.children[text[at]] = child = between
                self.bytes += _NODE_BYTES
            at, node = at + same, child
        node.add(owner, rows, ties)

    def __iter__(self) -> Iterator[tuple[bytes, Node]]:
        return self.root.terminals(b"")

    def spill_largest(self, keep: int) -> Iterator[tuple[bytes, Node]]:
        """Cuts the largest subtrees off until about `keep` bytes stay, and gives their terminals."""
        heap, number = [], 0
        for parent in (self.root,):
            for c, child in parent.children.items():
                heap.append((-child.size(), number, parent, c, b""))
                number += 1
        heapq.heapify(heap)
        while self.bytes > keep and heap:
            size, _, parent, c, prefix = heapq.heappop(heap)
            node = parent.children[c]
            if -size > max(keep, 1) and node.children:  # too large to go as a whole
                for d, child in node.children.items():
                    heapq.heappush(heap, (-child.size(), number, node, d, prefix + node.label))
                    number += 1
                continue
            yield from node.terminals(prefix)
            del parent.children[c]
            self.bytes += size

    def spill_before(self, text: bytes) -> Iterator[tuple[bytes, Node]]:
        """Cuts off what lies before the path of `text`: where texts come in order, nothing there grows any more."""
        node, at = self.root, 0
        while True:
            for c in sorted(c for c in node.children if at >= len(text) or c < text[at]):
                child = node.children.pop(c)
                self.bytes -= child.size()
                yield from child.terminals(text[:at])
            child = node.children.get(text[at]) if at < len(text) else None
            if child is None:
                return
            same = _common(text, at, child.label)
            if same < len(child.label):
                if at + same < len(text) and child.label[same] < text[at + same]:
                    del node.children[text[at]]
                    self.bytes -= child.size()
                    yield from child.terminals(text[:at])
                return
            at, node = at + same, child


def _batches(rows: Iterator[tuple[bytes, Node]], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Terminals as batches of (text, owner, n, ties), of bounded size."""
    schema = pa.schema([("text", pa.binary()), ("owner", id_type), ("n", pa.int64()), ("ties", pa.int64())])
    held, size = [], 0
    full = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    for text, node in rows:
        held.append((text, node.owner, node.rows, node.ties))
        size += len(text)
        if len(held) == _OUT_ROWS or size >= _OUT_BYTES:
            yield full()
            held, size = [], 0
    if held:
        yield full()


def _inserted(trie: PatriciaTrie, batches: Iterator[pa.RecordBatch], budget: int, in_order: bool) -> Iterator[tuple[bytes, Node]]:
    """Puts the rows into `trie`; gives terminals as they are spilled, and at the end all that are left."""
    for batch in batches:
        for i, row in enumerate(zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("owner", "n", "ties")))):
            text = row[0].as_py()
            trie.insert(text, *row[1:])
            if in_order and (i % _STEP == 0 or trie.bytes > budget):
                yield from trie.spill_before(text)
            elif trie.bytes > budget:
                yield from trie.spill_largest(budget // 4)
    yield from trie


def _tries(in_order: bool, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            chained = (b for part in ((first,), batches) for b in part)
            yield from _batches(_inserted(PatriciaTrie(), chained, budget, in_order), first.schema.field("owner").type)

    return run


def owners(docs: DataFrame, budget: int = TRIE_BYTES, salts: int = SALTS) -> DataFrame:
    """(sha, keep_id, group_size, ties): of each distinct text its SHA-256, smallest doc_id, rows, and rows with that id."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    one = F.lit(1).cast("long")
    rows = docs.select(normalised(F.col("text")).cast("binary").alias("text"), F.col("doc_id").alias("owner"), one.alias("n"), one.alias("ties"))
    made = f"text binary, owner {id_type}, n long, ties long"
    seen = rows.mapInArrow(_tries(False, budget), made)
    salt = F.when(F.col("n") > 1, F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(-1)
    dealt = seen.withColumn("salt", salt).repartition(F.length("text"), F.xxhash64("text"), "salt").drop("salt").sortWithinPartitions("text")
    partial = dealt.mapInArrow(_tries(True, budget), made).select(F.unhex(F.sha2("text", 256)).alias("sha"), "owner", "n", "ties")
    by_owner = partial.groupBy("sha", "owner").agg(F.sum("n").alias("n"), F.sum("ties").alias("ties"))
    first = F.struct(F.col("owner").isNull(), F.col("owner"))
    return by_owner.groupBy("sha").agg(F.min("owner").alias("keep_id"), F.sum("n").alias("group_size"), F.min_by("ties", first).alias("ties"))


def mark_copies(docs: DataFrame, budget: int = TRIE_BYTES, salts: int = SALTS) -> DataFrame:
    """`docs` with a struct column `copies`, which replaces one of that name; all other columns and rows stay.

    It has keep_id (the doc_id of the row that stays), group_size (rows of equal text), kept and
    text_sha256 (of the normalised text).  The row with the smallest doc_id stays; a null id is larger than
    any other.  Exactly one row of each group is kept: where rows repeat the smallest id too, the first
    in the order read.  A null text is an empty one, and all empty texts are equal, as are texts of white
    space of any length; leading and trailing white space counts as one space.  doc_id has any type with an
    order.  A text has to fit a task's memory three times.  An empty table gives no rows.
    """
    docs = docs.drop(COLUMN)
    names = [f"`{c}`" for c in docs.columns]
    found = checkpointed(owners(docs, budget, salts))
    sha, row = (x + "_" * max(map(len, docs.columns)) for x in ("sha", "row"))
    found = found.withColumnRenamed("sha", sha).select(sha, F.struct("keep_id", "group_size", "ties").alias(COLUMN))
    hashed = docs.withColumn(sha, F.unhex(F.sha2(normalised(F.col("text")), 256)))
    own = F.col("doc_id").eqNullSafe(F.col(COLUMN)["keep_id"])
    if found.where(F.col(COLUMN)["ties"] > 1).isEmpty():
        joined = hashed.join(found, sha)
    else:  # rows of equal text and id: they need names that don't change from one pass to the next
        hashed = checkpointed(hashed.withColumn(row, F.monotonically_increasing_id()))
        joined = hashed.join(found, sha)
        first = joined.where(own).groupBy(sha).agg(F.min(row).alias("first" + row))
        joined = joined.join(first, sha)
        own = F.col(row) == F.col("first" + row)
    marked = F.struct(F.col(COLUMN)["keep_id"].alias("keep_id"), F.col(COLUMN)["group_size"].alias("group_size"), own.alias("kept"), F.lower(F.hex(sha)).alias("text_sha256"))
    return joined.select(*names, marked.alias(COLUMN))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """One document of each text, with its own columns; handling as in `mark_copies`."""
    kept = COLUMN + "_" * max(map(len, docs.columns))
    own = docs.withColumnRenamed(COLUMN, kept) if COLUMN in docs.columns else docs
    return mark_copies(own, **options).where(F.col(COLUMN)["kept"]).drop(COLUMN).toDF(*docs.columns)


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mark_copies(docs).select("doc_id", f"{COLUMN}.*")


OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY n ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
"""
