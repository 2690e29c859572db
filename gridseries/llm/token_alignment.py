"""Cross-tokenizer alignment: where the tokens of two vocabularies end together in a text.

Vocabulary A is a byte-level BPE, B a piece model with byte fallback.  Both are given a text with one space before
it, and their tokens are ranges of its bytes.  Alignment is a merge of two ordered lists of ends, for many texts
at once: one NumPy state vector holds an A and a B pointer of each text that isn't finished; a step compares
the ends at all pointers, emits a link and a cut where they are equal, moves the pointers whose end isn't
larger, and drops the finished texts from the vector.

What the vector holds are pieces of documents: a document is cut before a space that follows a character that is none,
where no token of either vocabulary can go across, so a long document is many short entries and doesn't hold
up the others.  A piece that a task has met before is not aligned again.  Vocabularies that have tokens across
such spaces are given whole documents.

How often a pair of ids is linked in the whole corpus is counted by a join of the distinct pairs of each chunk of
documents; nothing is broadcast but one number for each id of B.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries.llm.arrowtext import small_batches, texts_of
from gridseries.llm.session import checkpointed

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
COLUMN = "alignment"
#: Bytes of the texts of a chunk, whose pairs are counted together.
CHUNK_BYTES = 8 << 20
#: Pieces and their bytes that a task remembers.
KNOWN_PIECES, KNOWN_BYTES = 1 << 18, 16 << 20
#: Bytes of pieces that are encoded at a time.
_ENCODE_BYTES = 1 << 20
_SPACE = "▁"
_B_BITS = 32
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def merge_lockstep(a_end: np.ndarray, a_first: np.ndarray, b_end: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, i, j) of all links, by text and place: A's token i and B's token j end at one byte of a text.

    Text t has A's tokens a_first[t] to a_first[t + 1], whose ends in the text are in a_end; B's likewise.
    """
    text = np.flatnonzero((np.diff(a_first) > 0) & (np.diff(b_first) > 0))
    i, j, i_stop, j_stop = a_first[text], b_first[text], a_first[text + 1], b_first[text + 1]
    links = []
    while len(text):
        a, b = a_end[i], b_end[j]
        both = a == b
        links.append((text[both], i[both], j[both]))
        i, j = i + (a <= b), j + (b <= a)
        on = (i < i_stop) & (j < j_stop)
        if not on.all():
            text, i, j, i_stop, j_stop = text[on], i[on], j[on], i_stop[on], j_stop[on]
    found = [np.concatenate(x) for x in zip(*links)] if links else [np.zeros(0, np.int64)] * 3
    order = np.argsort(found[1], kind="stable")  # A's tokens are numbered by text and place
    return tuple(x[order] for x in found)


def _char_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones stand for themselves."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: The split of byte-level vocabularies before their merges; a fixed value.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Flat:
    """Byte strings one after the other: string i is data[first[i]:first[i + 1]]."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.length = np.fromiter(map(len, strings), np.int64, len(strings))
        self.first = np.concatenate([[0], np.cumsum(self.length)])

    def joined(self, which: np.ndarray) -> np.ndarray:
        return self.data[_dealt(self.first, which)[1]]


class Vocabularies:
    """Both tokenizers of a task, and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import sentencepiece

        with open(byte_bpe, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        added = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        of, tokens = _char_bytes(), {i: t for t, i in model["vocab"].items()}
        byte_level = lambda t: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        size = 1 + max([*tokens, *added])
        own = {i: byte_level(t) for i, t in tokens.items() if i not in added}
        self.a_bytes = Flat([own[i] if i in own else added.get(i, "").encode() for i in range(size)])
        words = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranked = words and sorted(own) == list(range(len(own))) and len(own) == 256 + len(merges) and all(model["vocab"][x + y] == 256 + k for k, (x, y) in enumerate(merges))
        self.a_encode = self._ranked({t: i for i, t in own.items()}) if ranked else self._general(byte_bpe)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = Flat([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)])
        self.space = self.b.piece_to_id(_SPACE)
        #: Whether no token goes across a space that follows another character.
        self.cut = bool(words) and not any(_SPACE in p.lstrip(_SPACE) for p in pieces) and self.b.encode("a a ") == [*self.b.encode("a") * 2, self.space]

    @staticmethod
    def _ranked(ranks: dict[bytes, int]):
        """Where ids are in the order of the merges, merging by rank is the same and several times faster."""
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [own(t) for t in texts]

    @staticmethod
    def _general(byte_bpe: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(byte_bpe)
        own.encode_special_tokens = True
        return lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of texts that begin with a space."""
        texts = [t.decode() for t in texts]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return self.a_encode(texts), [ids if ids or t != " " else [self.space] for ids, t in zip(b, texts)]


@lru_cache(maxsize=2)
def vocabularies(byte_bpe: str, piece_bpe: str) -> Vocabularies:
    """Both tokenizers; a worker process reads their files once."""
    return Vocabularies(byte_bpe, piece_bpe)


def pieces_of(data: np.ndarray, first: np.ndarray, cut: bool) -> np.ndarray:
    """Where the pieces of some texts, which begin at `first`, begin in `data`, and the end."""
    if not cut:
        return first
    at = np.flatnonzero(data[3:] == 0x20) + 3
    before = data[at - 1]
    # Not after white space of any kind: that of two bytes begins with C2, that of three with E1, E2, E3 or EF, as does the piece model's own sign.
    visible = (before > 0x20) & (before < 0x7F)
    other = (before >= 0x80) & (data[at - 2] != 0xC2) & ~np.isin(data[at - 3], [0xE1, 0xE2, 0xE3, 0xEF])
    starts = np.zeros(len(data) + 1, bool)
    starts[at[visible | other]] = True
    starts[first] = True
    return np.flatnonzero(starts)


class Known:
    """Distinct pieces, each with its tokens and links.

    Piece p has links first[p] to first[p + 1] in `pair`, which are numbers of `pairs`, ids of A times 2^32 plus ids of B.
    """

    def __init__(self, vocabularies: Vocabularies):
        self.vocabularies = vocabularies
        biggest = max(len(vocabularies.a_bytes.length), len(vocabularies.b_bytes.length))
        self._digits = Flat([b"%d," % i for i in range(biggest)])
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bytes, self.groups = 0, []
        self.n_a = self.n_b = np.zeros(0, np.int64)
        self.good, self.pair, self.pairs, self.first = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece; those not met before are encoded and aligned."""
        if len(self.number) > KNOWN_PIECES or self.bytes > KNOWN_BYTES:
            self._clear()
        new = [p for p in pieces if p not in self.number]
        at, size = 0, 0
        for k, p in enumerate(new):
            size += len(p)
            if size >= _ENCODE_BYTES or k == len(new) - 1:
                self._add(new[at : k + 1])
                at, size = k + 1, 0
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def _add(self, new: list[bytes]) -> None:
        a, b = self.vocabularies.encode(new)
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a, b))
        a_id, b_id = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((a, n_a), (b, n_b)))
        a_first, b_first = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        a_end = _restarted(self.vocabularies.a_bytes.length[a_id], a_first)
        b_end = _restarted(self.vocabularies.b_bytes.length[b_id], b_first)
        good = self._given_back(Flat(new), (a_id, a_first, a_end), (b_id, b_first, b_end))
        text, i, j = merge_lockstep(a_end, a_first, b_end, b_first)
        keep = good[text]
        text, i, j = text[keep], i[keep], j[keep]
        strings = self._strings(good, (a_id, a_first, i), (b_id, b_first, j), text)
        both = (a_id[i] << _B_BITS) | b_id[j]
        more = np.setdiff1d(both, self.pairs)
        self.pairs = np.concatenate([self.pairs, more])
        order = np.argsort(self.pairs)
        self.pair = np.concatenate([self.pair, order[np.searchsorted(self.pairs, both, sorter=order)]])
        self.first = np.concatenate([self.first, self.first[-1] + np.searchsorted(text, np.arange(1, len(new) + 1))])
        self.n_a, self.n_b, self.good = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b]), np.concatenate([self.good, good])
        self.number.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
        self.groups.extend(strings)
        self.bytes += sum(map(len, new))

    def _given_back(self, pieces: Flat, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
        """Whether both vocabularies' tokens have the bytes of a piece."""
        last = lambda x: np.where(np.diff(x[1]) > 0, x[2][np.maximum(x[1][1:] - 1, 0)] if len(x[2]) else 0, 0)
        good = (last(a) == pieces.length) & (last(b) == pieces.length)
        use = np.flatnonzero(good)
        if len(use):
            wanted = pieces.joined(use)
            of = lambda x, flat: flat.joined(x[0][_dealt(x[1], use)[1]])
            same = (of(a, self.vocabularies.a_bytes) == wanted) & (of(b, self.vocabularies.b_bytes) == wanted)
            good[use] = np.logical_and.reduceat(same, np.cumsum(pieces.length[use]) - pieces.length[use])
        return good

    def _strings(self, good: np.ndarray, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], text: np.ndarray) -> list[bytes]:
        """Of each piece its groups as `a1,a2|b1;`; nothing of those whose bytes aren't given back."""
        ids, keys, ends = [], [], []
        for side, (own, first, last) in enumerate((a, b)):
            token = np.flatnonzero(np.repeat(good, np.diff(first)))
            ids.append(own[token])
            keys.append(np.searchsorted(last, token) * 2 + side)
            ends.append(last[np.searchsorted(last, token)] == token)
        ids, keys, ends = np.concatenate(ids), np.concatenate(keys), np.concatenate(ends)
        order = np.argsort(keys, kind="stable")
        ids, keys, ends = ids[order], keys[order], ends[order]
        out, at = self._digits.joined(ids), np.cumsum(self._digits.length[ids])
        out[at[ends] - 1] = np.where(keys[ends] % 2, ord(";"), ord("|"))
        group = at[ends & (keys % 2 == 1)]  # where the string of each group stops
        stops = np.concatenate([[0], group])[np.searchsorted(text, np.arange(len(good) + 1))].tolist()
        whole = out.tobytes()
        return [whole[x:y] for x, y in zip(stops, stops[1:])]


def _restarted(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at every `first`."""
    sums = np.concatenate([[0], np.cumsum(lengths)])
    return sums[1:] - np.repeat(sums[first[:-1]], np.diff(first))


def _dealt(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, place) for every place of the range of first[which[k]]."""
    count = first[which + 1] - first[which]
    return np.repeat(np.arange(len(which)), count), np.repeat(first[which] - np.cumsum(count) + count, count) + np.arange(count.sum())


class Chunk:
    """The alignment of some texts: counts, the strings of their groups, and how often each holds which pair."""

    def __init__(self, known: Known, texts: list[bytes | None]):
        full = np.flatnonzero([bool(t) for t in texts])
        joined = [b" " + t for t in texts if t]
        data = np.frombuffer(b"".join(joined), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(t) for t in joined])]).astype(np.int64)
        starts = pieces_of(data, first, known.vocabularies.cut)
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        piece = known.numbers(array.dictionary.to_pylist())[np.asarray(array.indices)] if len(joined) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(joined)), np.diff(np.searchsorted(starts[:-1], first)))
        good = np.ones(len(joined), bool)
        good[doc[~known.good[piece]]] = False
        piece, doc = piece[good[doc]], doc[good[doc]]
        bounds = np.searchsorted(doc, np.arange(len(joined) + 1))
        links = np.diff(known.first)
        #: Every group ends in a link, and every link ends a group.
        self.numbers = {n: self._spread(len(texts), full, values[piece], bounds) for n, values in (("n_a", known.n_a), ("n_b", known.n_b), ("n_groups", links), ("n_links", links))}
        self.groups = [b""] * len(texts)
        names, bounds = piece.tolist(), bounds.tolist()
        for k, s, e in zip(full.tolist(), bounds, bounds[1:]):
            self.groups[k] = b"".join(map(known.groups.__getitem__, names[s:e]))[:-1]
        # (text, pair, times), by text and pair.
        k, place = _dealt(known.first, piece)
        n = max(len(known.pairs), 1)
        keys = np.sort(full[doc[k]] * n + known.pair[place])
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        self.times = np.diff(np.append(new, len(keys)))
        seen = np.flatnonzero(np.bincount(keys[new] % n, minlength=n)) if len(keys) else np.zeros(0, np.int64)
        seen = seen[np.argsort(known.pairs[seen])]
        rank = np.zeros(n, np.int64)
        rank[seen] = np.arange(len(seen))
        #: The pairs in order; the pairs of the texts as places in that, and where each text's begin.
        self.pairs, self.which = known.pairs[seen], rank[keys[new] % n]
        self.first = np.searchsorted(keys[new] // n, np.arange(len(texts) + 1))

    @staticmethod
    def _spread(n: int, full: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[full] = np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])
        return out


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, np.int64).view(np.uint8))


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int64)


_PACKED = ("pairs", "which", "times", "first")


def _aligned_chunks(docs: DataFrame, byte_bpe: str, piece_bpe: str, with_groups: bool, chunk_bytes: int) -> DataFrame:
    """One row of each chunk: its documents with their counts, and the packed arrays of its pairs."""
    kept = docs.select(F.struct(*[f"`{c}`" for c in docs.columns if c != "text"]).alias("kept"), F.col("text").alias("text"))
    numbers = [T.StructField(n, T.LongType()) for n in _NUMBERS]
    texts = [T.StructField(n, T.StringType()) for n in ("groups_sha256", *(("groups",) if with_groups else ()))]
    row = T.StructType([kept.schema["kept"], *numbers, *texts])
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rows", T.ArrayType(row)), *(T.StructField(n, T.BinaryType()) for n in _PACKED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, number = Known(vocabularies(byte_bpe, piece_bpe)), TaskContext.get().partitionId() << 32
        for batch in small_batches(batches, most=chunk_bytes):
            chunk = Chunk(known, texts_of(batch))
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in chunk.groups]
            columns = [batch.column("kept"), *(pa.array(chunk.numbers[n]) for n in _NUMBERS), pa.array(digests, pa.string()), *([pa.array(chunk.groups, pa.string())] if with_groups else [])]
            rows = pa.StructArray.from_arrays(columns, names=row.names)
            packed = [pa.array([_packed(getattr(chunk, n))], pa.binary()) for n in _PACKED]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), *packed], names=schema.names)
            number += 1

    return kept.mapInArrow(run, schema)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            pairs = _unpacked(r["pairs"])
            n = np.bincount(_unpacked(r["which"]), _unpacked(r["times"]), len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.full(len(pairs), r["chunk"])), pa.array(n)], names=["pair", "chunk", "n"])


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count, best): links of each pair of ids, and whether no pair of its B id has more."""
    counts = chunks.select("chunk", "pairs", "which", "times").mapInArrow(_pairs, "pair long, chunk long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    b = F.col("pair").bitwiseAND((1 << _B_BITS) - 1)
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))  # the ids of B at most
    return counts.withColumn("b", b).join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _answered(chunk: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a chunk with the sums over their links."""
    one = chunk.to_batches()[0]
    rows = one.column("rows").flatten()
    columns = dict(zip((f.name for f in rows.type), rows.flatten()))
    which, times, first = (_unpacked(one.column(n)[0].as_py()) for n in ("which", "times", "first"))
    if len(which):
        order = np.argsort(counts.column("pair").to_numpy(), kind="stable")
        count, best = counts.column("count").to_numpy()[order][which], counts.column("best").to_numpy(zero_copy_only=False)[order][which]
    else:
        count = best = np.zeros(0, np.int64)
    sums = lambda values: pa.array(np.diff(np.concatenate([[0], np.cumsum(values)])[first]), pa.int64())
    columns |= {"n_best": sums(times * best), "count_sum": sums(times * count)}
    return pa.table(columns)


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, with_groups: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The columns of `docs` but the text, and a struct column `alignment`, which replaces one of that name.

    It has n_a and n_b (tokens of each vocabulary), n_groups, n_links, groups_sha256, n_best (links whose
    pair is linked as often as any of its B id in all of `docs`), count_sum (the links' counts, summed), and
    `groups`, the string a1,a2|b1;a3|b2,b3 of ids, if asked for.  Null and empty texts, and texts whose bytes a
    vocabulary doesn't give back, have zeros and "".  All rows are counted, repeated ones each.  Ties for the
    highest count are all best.  A text has to fit a task's memory some twenty times, as its tokens do.
    An empty table gives no rows.  The files of the vocabularies are read by every task.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c != COLUMN])
    chunks = checkpointed(_aligned_chunks(docs, byte_bpe, piece_bpe, with_groups, chunk_bytes))
    asked = chunks.select("chunk", "pairs", "which", "times").mapInArrow(_pairs, "pair long, chunk long, n long").select("pair", "chunk")
    answers = asked.join(pair_counts(chunks), "pair")
    row = chunks.schema["rows"].dataType.elementType
    schema = T.StructType([*row.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    found = chunks.select("chunk", "rows", "which", "times", "first").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_answered, schema)
    return found.select("kept.*", F.struct(*[c for c in schema.names if c != "kept"]).alias(COLUMN))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return align(docs).select("doc_id", *[f"{COLUMN}.{c}" for c in (*_NUMBERS, "n_best", "count_sum", "groups_sha256")])
