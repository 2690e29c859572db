"""Line deduplication with a tree of log templates.

A line goes down a tree of fixed depth: first its token count, then its leading tokens, where tokens
with a digit count as a variable field.  At its leaf every other token is held against the lines that
ended there: a token that fewer than `min_docs` lines of documents have at that place is a variable
field too.  What is left is the line's template, if no more than a quarter of its tokens became fields
and at least half are none.  Templates in at least `min_docs` documents are boilerplate: their lines go
from all documents but the one with the smallest doc_id.

Lines that are the same word for word need fewer documents the longer they are, from 50 tokens on two.  A
document that would lose half of its tokens or all its lines to those keeps them: it is a copy, which is
for a join of documents.  Lines too short for the tree need more documents, and are compared as masked.

Leaves and templates are counted, never gathered, so one of any size takes no task's memory.  Tokens
are looked up for the distinct lines of leaves only where some line is too rare by itself; all else are
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.arrowtext import Words, mix, small_batches, texts_of
from gridseries.llm.session import checkpointed

#: Fixed parameters: leading tokens on the path, documents, tokens of a line.
DEPTH = 3
MIN_DOCS = 10
MIN_TOKENS = 3
#: Documents of a line too short for the tree.
SHORT_DOCS = 50
#: A list of lines that is joined by broadcast has so many at most (8 bytes each); a longer one is shuffled.
BROADCAST_LINES = 500_000

_digit = np.zeros(256, bool)
_digit[0x30:0x3A] = True
_letter = np.zeros(256, bool)
_letter[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FIELD = Words([b"<*>"]).hash[0]
_SALT = mix(np.arange(1, 5, dtype=np.uint64))


def exact_docs(n_tokens: int) -> int:
    """In how many documents a line of so many tokens recurs that is the same word for word: 10 to 2."""
    return max(2, min(MIN_DOCS, MIN_DOCS + 2 - n_tokens // 5))


class Lines:
    """The lines with a token of some texts: `doc`, `number` (from 0, in its text), `n` (tokens), `first`
    (its first token) and the hashes `template`, `leaf`, `whole` and `short`, 0 where a line has none."""

    def __init__(self, texts: list[bytes | None]):
        words = Words(texts)
        breaks = np.flatnonzero(words.data == 0x0A)  # each text's end is one too
        line = np.searchsorted(breaks, words.start)
        self.first = np.flatnonzero(np.diff(line, prepend=-1))
        self.n = np.diff(np.append(self.first, len(line)))
        self.doc = words.doc[self.first]
        self.number = line[self.first] - np.searchsorted(breaks, words.doc_start)[self.doc]
        count = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[words.data])])[np.stack([words.start, words.end])], axis=0)[0] > 0
        field = count(_digit) | (words.hash == _FIELD)
        #: Of every token: its hash, where fields have that of <*>, and whether it is one.
        self.token, self.field = np.where(field, _FIELD, words.hash), field
        per_line = lambda x: np.add.reduceat(x, self.first) if len(x) else x
        place = np.arange(len(line)) - np.repeat(self.first, self.n)
        salt = mix(place.astype(np.uint64) + np.uint64(1))
        masked, size = mix(self.token ^ salt), mix(self.n.astype(np.uint64))
        fields, says = per_line(field.astype(np.int64)), per_line((count(_letter) & ~field).astype(np.int64)) > 0
        whole = per_line(masked)
        tree = (self.n >= MIN_TOKENS) & (2 * fields <= self.n)
        self.template = np.where(tree, mix(whole ^ size ^ _SALT[0]), np.uint64(0)).view(np.int64)
        self.leaf = mix(per_line(np.where(place < DEPTH, masked, np.uint64(0))) ^ size ^ _SALT[1]).view(np.int64)
        self.needed = np.clip(MIN_DOCS + 2 - self.n // 5, 2, MIN_DOCS)
        self.whole = np.where((self.n >= MIN_TOKENS) & (self.needed < MIN_DOCS), mix(per_line(mix(words.hash ^ salt)) ^ size ^ _SALT[2]), np.uint64(0)).view(np.int64)
        self.short = np.where((self.n < MIN_TOKENS) & says, mix(whole ^ size ^ _SALT[3]), np.uint64(0)).view(np.int64)


_LINES = "doc_id long, line long, leaf long, needed int"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct lines of each text; those compared as a whole have no leaf, others no `needed`."""
    for batch in small_batches(batches):
        lines, ids = Lines(texts_of(batch)), np.asarray(batch.column("doc_id"))
        doc, key, leaf, needed = [], [], [], []
        for hashes, least in ((lines.template, None), (lines.whole, lines.needed), (lines.short, np.full(len(lines.n), SHORT_DOCS))):
            has = np.flatnonzero(hashes)
            has = has[np.lexsort((hashes[has], lines.doc[has]))]
            has = has[np.concatenate([[True], (np.diff(lines.doc[has]) != 0) | (np.diff(hashes[has]) != 0)])[: len(has)]]
            doc.append(lines.doc[has])
            key.append(hashes[has])
            leaf.append(pa.array(lines.leaf[has], pa.int64()) if least is None else pa.nulls(len(has), pa.int64()))
            needed.append(pa.nulls(len(has), pa.int32()) if least is None else pa.array(least[has], pa.int32()))
        columns = [pa.array(ids[np.concatenate(doc)], pa.int64()), pa.array(np.concatenate(key), pa.int64()), pa.concat_arrays(leaf), pa.concat_arrays(needed)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "leaf", "needed"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, tokens, fields) of the lines that are wanted of each text: token hashes, and whether each is a field."""
    for batch in small_batches(batches):
        lines, wanted = Lines(texts_of(batch)), batch.column("wanted")
        asked = np.asarray(wanted.flatten())
        of = np.repeat(np.arange(batch.num_rows), np.asarray(wanted.value_lengths()))
        found = _among(lines.doc, lines.template, of, asked)
        rows = [slice(a, a + n) for a, n in zip(lines.first[found], lines.n[found])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(lines.template[found], pa.int64()),
                pa.array([lines.token[r].view(np.int64) for r in rows], pa.list_(pa.int64())),
                pa.array([lines.field[r] for r in rows], pa.list_(pa.bool_())),
            ],
            names=["line", "tokens", "fields"],
        )


def _among(doc: np.ndarray, hashes: np.ndarray, of: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The indices at which (doc, hash) is one of (of, asked); a hash of 0 never is."""
    mixed = lambda d, h: mix(h.astype(np.int64).view(np.uint64) ^ mix(d.astype(np.uint64) + np.uint64(1)))
    return np.flatnonzero(np.isin(mixed(doc, hashes), mixed(of, asked)) & (hashes != 0))


def _dropped(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            drop, texts = batch.column("_drop").fill_null([]), texts_of(batch)
            hit = np.flatnonzero(np.asarray(drop.value_lengths()))
            lines = Lines([texts[i] for i in hit])
            asked, of = np.asarray(drop.flatten()), np.repeat(np.arange(len(hit)), np.asarray(drop.value_lengths())[hit])
            goes, rare = np.zeros(len(lines.n), bool), np.zeros(len(lines.n), bool)
            goes[_among(lines.doc, lines.template, of, asked)] = True
            goes[_among(lines.doc, lines.short, of, asked)] = True
            rare[_among(lines.doc, lines.whole, of, asked)] = True
            bounds = np.searchsorted(lines.doc, np.arange(len(hit) + 1))
            n_lines = np.array([0 if t is None else t.count(b"\n") + 1 for t in texts], np.int64)
            n_dropped = np.zeros(batch.num_rows, np.int64)
            for k, i in enumerate(hit.tolist()):
                own = slice(bounds[k], bounds[k + 1])
                out = goes[own] | rare[own]
                n = lines.n[own]
                if out.all() or 2 * n[rare[own] & ~goes[own]].sum() >= n.sum():  # a copy, which is for the join of documents
                    out = goes[own]
                gone = set(lines.number[own][out].tolist())
                texts[i] = b"\n".join(x for j, x in enumerate(texts[i].split(b"\n")) if j not in gone)
                n_dropped[i] = len(gone)
            columns = {n: batch.column(n) for n in batch.schema.names if n != "_drop"}
            columns |= {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines), "n_dropped": pa.array(n_dropped)}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return run


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, line, leaf, needed), one for each line of each document that could recur."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_lines, _LINES).distinct()


def generalised(docs: DataFrame, by_line: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(line, template) of the lines of leaves where some line is in fewer than `min_docs` documents.

    `by_line` has line, leaf, n (its documents) and at (the smallest).  Only templates of several lines
    are told; any other line is its own template.
    """
    tree = by_line.where("leaf is not null")
    leaves = tree.groupBy("leaf").agg(F.sum("n").alias("pairs"), F.count("*").alias("n_lines"), F.min("n").alias("least"))
    wanted = checkpointed(tree.join(leaves.where((F.col("pairs") >= min_docs) & (F.col("n_lines") > 1) & (F.col("least") < min_docs)).select("leaf"), "leaf"))
    by_doc = wanted.groupBy(F.col("at").alias("doc_id")).agg(F.collect_set("line").alias("wanted"))
    if wanted.count() <= BROADCAST_LINES:
        by_doc = F.broadcast(by_doc)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(by_doc, "doc_id").select("text", "wanted")
    tokens = texts.mapInArrow(_tokens, "line long, tokens array<long>, fields array<boolean>").dropDuplicates(["line"])
    at_place = checkpointed(tokens.join(wanted, "line").select("leaf", "line", "n", F.posexplode(F.arrays_zip("tokens", "fields")).alias("place", "t")))
    at_place = at_place.select("leaf", "line", "n", "place", F.col("t.tokens").alias("token"), F.col("t.fields").alias("field"))
    common = at_place.groupBy("leaf", "place", "token").agg(F.sum("n").alias("often")).where(F.col("often") >= min_docs).select("leaf", "place", "token", F.lit(True).alias("common"))
    held = at_place.join(common, ["leaf", "place", "token"], "left").withColumn("new", ~F.col("field") & F.col("common").isNull())
    sign = F.when(F.col("new") | F.col("field"), F.xxhash64("place")).otherwise(F.xxhash64("place", "token"))
    lines = held.groupBy("leaf", "line", "n").agg(F.bit_xor(sign).alias("sign"), F.sum(F.col("new").cast("int")).alias("new"), F.sum(F.col("field").cast("int")).alias("fields"), F.count("*").alias("size"))
    lines = checkpointed(lines.where("4 * new <= size and 2 * (size - new - fields) >= size").select("line", "n", F.xxhash64("leaf", "sign").alias("template")))
    several = lines.groupBy("template").agg(F.count("*").alias("n_lines"), F.sum("n").alias("pairs")).where((F.col("n_lines") > 1) & (F.col("pairs") >= min_docs)).select("template")
    return lines.join(several, "template").select("line", "template")


def recurring(docs: DataFrame, every: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(line, keeper) of the lines that recur, with the document that keeps them, from the rows of `line_rows`."""
    by_line = checkpointed(every.groupBy("line", "leaf", "needed").agg(F.count("*").alias("n"), F.min("doc_id").alias("at")))
    needed = F.when(F.coalesce("needed", F.lit(MIN_DOCS)) >= MIN_DOCS, F.coalesce("needed", F.lit(min_docs))).otherwise(F.least("needed", F.lit(min_docs)))
    single = by_line.where(F.col("n") >= needed).select("line", F.col("at").alias("keeper"))
    several = checkpointed(generalised(docs, by_line, min_docs))
    by_template = every.join(several, "line").select("template", "doc_id").distinct().groupBy("template").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper"))
    joint = several.join(by_template.where(F.col("n") >= min_docs), "template").select("line", "keeper")
    return single.unionByName(joint).groupBy("line").agg(F.min("keeper").alias("keeper"))


def drop_templates(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` with boilerplate lines gone from `text`, and n_lines and n_dropped; other columns stay.

    Lines are what \\n separates.  Lines without a token, and those of fewer than MIN_TOKENS tokens
    without a letter, always stay.  A null text stays null and has no line; an empty one has one, empty,
    line.  doc_id has to be an integer.  Rows that share a doc_id count as one document; rows without
    doc_id neither count nor lose lines.  Earlier columns n_lines and n_dropped are replaced.  An empty
    table gives no rows.  A document that copies another in half of its tokens or more loses no line for that.
    """
    docs = docs.drop("n_lines", "n_dropped", "_drop")
    every = checkpointed(line_rows(docs))
    drop = every.join(recurring(docs, every, min_docs), "line").where("doc_id <> keeper").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line").alias("_drop"))
    schema = docs.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    return docs.join(drop, docs["doc_id"].cast("long") == drop["_id"], "left").drop("_id").mapInArrow(_dropped(schema.names), schema)


def op7(spark, sf_dir: str) -> DataFrame:
    got = drop_templates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
r AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
w AS (SELECT doc_id, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM r),
m AS (SELECT doc_id, i, w, len(w) AS n, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m FROM w WHERE len(w) > 0),
f AS MATERIALIZED (SELECT *, len(list_filter(m, lambda x: x = '<*>')) AS f, len(list_filter(m, lambda x: x <> '<*>' AND regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) > 0 AS says FROM m),
k AS MATERIALIZED (
  SELECT doc_id, i, 'T ' || array_to_string(m, ' ') AS line, n || ' ' || array_to_string(m[1:{DEPTH}], ' ') AS leaf, {MIN_DOCS} AS needed, m, n, f FROM f WHERE n >= {MIN_TOKENS} AND 2 * f <= n
  UNION ALL SELECT doc_id, i, 'W ' || array_to_string(w, ' '), NULL, greatest(2, {MIN_DOCS + 2} - n // 5), NULL, n, f FROM f WHERE {MIN_DOCS + 2} - n // 5 < {MIN_DOCS}
  UNION ALL SELECT doc_id, i, 'S ' || array_to_string(m, ' '), NULL, {SHORT_DOCS}, NULL, n, f FROM f WHERE n < {MIN_TOKENS} AND says),
e AS MATERIALIZED (SELECT DISTINCT doc_id, line FROM k WHERE doc_id IS NOT NULL),
b AS MATERIALIZED (SELECT line, leaf, needed, any_value(m) AS m, any_value(n) AS n, any_value(f) AS f, count(DISTINCT doc_id) AS docs, min(doc_id) AS keeper FROM k WHERE doc_id IS NOT NULL GROUP BY line, leaf, needed),
p AS (SELECT line, leaf, docs, n, place, m[place] AS token FROM (SELECT *, unnest(range(1, n + 1)) AS place FROM b WHERE leaf IS NOT NULL)),
c AS (SELECT leaf, place, token FROM p GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
t AS (SELECT p.leaf, p.line, p.n, count(*) FILTER (p.token <> '<*>' AND c.token IS NULL) AS fresh, count(*) FILTER (p.token = '<*>') AS f,
        string_agg(CASE WHEN c.token IS NULL THEN '<*>' ELSE p.token END, ' ' ORDER BY p.place) AS template
      FROM p LEFT JOIN c ON p.leaf = c.leaf AND p.place = c.place AND p.token = c.token GROUP BY p.leaf, p.line, p.n),
u AS MATERIALIZED (SELECT line, leaf || ' ' || template AS template FROM t WHERE 4 * fresh <= n AND 2 * (n - fresh - f) >= n),
g AS (SELECT template, count(DISTINCT doc_id) AS docs, min(doc_id) AS keeper FROM u JOIN e USING (line) GROUP BY template),
x AS (SELECT line, min(keeper) AS keeper FROM (
        SELECT line, keeper FROM b WHERE docs >= needed
        UNION ALL SELECT line, g.keeper FROM u JOIN g USING (template) WHERE g.docs >= {MIN_DOCS}) GROUP BY line),
z AS (SELECT doc_id, i, bool_or(k.line NOT LIKE 'W %') AS always FROM k JOIN x USING (line) WHERE doc_id <> keeper GROUP BY doc_id, i),
a AS (SELECT f.doc_id, count(*) = count(z.i) OR 2 * coalesce(sum(n) FILTER (NOT z.always), 0) >= sum(n) AS bare FROM f LEFT JOIN z USING (doc_id, i) GROUP BY f.doc_id),
o AS (SELECT r.doc_id, count(*) AS n_lines, count(*) FILTER (z.i IS NOT NULL AND (z.always OR NOT coalesce(a.bare, FALSE))) AS n_dropped,
        string_agg(r.line, chr(10) ORDER BY r.i) FILTER (z.i IS NULL OR NOT (z.always OR NOT coalesce(a.bare, FALSE))) AS kept
      FROM r LEFT JOIN z USING (doc_id, i) LEFT JOIN a USING (doc_id) GROUP BY r.doc_id)
SELECT d.doc_id, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_dropped, 0) AS n_dropped, sha256(coalesce(o.kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""
