"""Exact dedup, lexical search and token alignment against brute force, on odd tables."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridseries.llm import exact_dedup, lexical_search, token_alignment

WORDS = [f"w{i}" for i in range(40)]


def spread(*rows):
    return [tuple(r) for r in rows]


# ---- exact dedup


@pytest.mark.parametrize("in_order", [False, True])
def test_trie_gives_every_text_its_owner(in_order):
    rng = random.Random(1)
    for _ in range(40):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(200)]
        want = {}
        for i, t in enumerate(texts):
            owner, n = want.get(t, (i, 0))
            want[t] = (min(owner, i), n + 1)
        rows = sorted((t, i) for i, t in enumerate(texts)) if in_order else [(t, i) for i, t in enumerate(texts)]
        ones = pa.array([1] * len(rows))
        batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.binary()), pa.array([i for _, i in rows]), ones, ones], names=["text", "owner", "n", "ties"])
        got, given = {}, 0
        for text, node in exact_dedup._inserted(exact_dedup.PatriciaTrie(), iter([batch]), 3000, in_order):
            owner, n = got.get(text, (node.owner, 0))
            got[text], given = (min(owner, node.owner), n + node.rows), given + 1
        assert got == want
        assert not in_order or given == len(want)  # in order, no text leaves twice


def test_trie_in_order_holds_a_path_only():
    rng = random.Random(2)
    texts = sorted({bytes(rng.choice(b"abcdef") for _ in range(30)) for _ in range(5000)})
    trie, most = exact_dedup.PatriciaTrie(), 0
    for t in texts:
        trie.insert(t, 1)
        list(trie.spill_before(t))
        most = max(most, trie.bytes)
    assert most < 30 * exact_dedup._NODE_BYTES


def brute_copies(rows):
    groups = {}
    for at, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((doc_id is None, doc_id or 0, at))
    out = Counter()
    for text, members in groups.items():
        first = min(members)
        for m in members:
            out[(None if m[0] else m[1], None if first[0] else first[1], len(members), m == first, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def test_copies_of_odd_rows(spark):
    long = "very long text " * 40_000
    rows = spread((5, "a b"), (3, "a\t\n b"), (9, " a b"), (None, "a b"), (None, None), (4, ""), (4, ""), (7, "   "), (8, " "), (1, long), (2, long), (6, long + "x"), (None, "alone"), (None, "alone"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"budget": 2000, "salts": 3}):
        got = exact_dedup.mark_copies(docs, **options).select("doc_id", "copies.*").collect()
        assert Counter(tuple(r) for r in got) == brute_copies(rows)


def test_hot_text_is_dealt_and_meets_again(spark):
    rng = random.Random(3)
    rows = [(i, "the hot text" if rng.random() < 0.4 else f"text {rng.randint(0, 900)}") for i in range(6000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_dedup.mark_copies(docs, budget=5000).select("doc_id", "copies.*").collect()
    assert Counter(tuple(r) for r in got) == brute_copies(rows)


def test_same_id_on_all_rows_keeps_one(spark):
    docs = spark.createDataFrame([(1, "same") for _ in range(3000)] + [(None, "other") for _ in range(3000)], "doc_id long, text string").repartition(6)
    got = exact_dedup.mark_copies(docs).groupBy("copies.keep_id", "copies.group_size").agg({"copies.kept": "count"}).collect()
    assert sorted((r[1], r[2]) for r in got) == [(3000, 3000), (3000, 3000)]
    assert exact_dedup.mark_copies(docs).where("copies.kept").count() == 2


def test_dedup_keeps_columns_and_clashing_names(spark):
    docs = spark.createDataFrame([("b", "x", 1, "p"), ("a", "x ", 2, "q"), ("c", "x", 3, "r")], "doc_id string, text string, copies int, sha string")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [("a", "x ", 2, "q"), ("b", "x", 1, "p")]
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0
    assert exact_dedup.mark_copies(docs).columns == ["doc_id", "text", "sha", "copies"]


# ---- lexical search


def brute_search(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [Counter(term.findall((t or "").translate(lower))) for _, t in docs]
    n, total = sum(bool(c) for c in terms), sum(sum(c.values()) for c in terms)
    df = Counter(t for c in terms for t in c)
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        scored = []
        for (doc_id, _), c in zip(docs, terms):
            m = 10 + (90 * sum(c.values()) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(term.findall(text.translate(lower))) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, null, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if null else doc_id, -score))
    return Counter(out)


def test_range_maxima():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 64, 65):
        impact = rng.integers(1, 9, n)
        index = lexical_search.Index(np.zeros(n, np.int64), np.arange(n), impact, 1, n)
        lo, hi = np.triu_indices(n + 1, 1)
        want = [a + int(np.argmax(impact[a:b])) for a, b in zip(lo, hi)]
        assert index.impact[index.largest(lo, hi)].tolist() == impact[want].tolist()


@pytest.mark.parametrize("width, shard", [(1, 300), (8, 1 << 20), (3, 2000)])
def test_search_against_brute_force(spark, width, shard, monkeypatch):
    rng = random.Random(width)
    docs = [(i if i % 17 else None, " ".join(rng.choice(WORDS[: rng.randint(2, 40)]) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    docs += [(3, "w1 W2"), (3, "w1 W2"), (900, None), (901, ""), (902, "?!"), (903, "w5 " * 60_000), (904, "Étoile étoile ñ"), (905, "étoile")]
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))) for i in range(25)] + [(1, "w1"), (1, "w1"), (None, "w2 w3"), (77, None), (78, "?"), (79, "étoile Étoile"), (80, "nowhere")]
    monkeypatch.setattr(lexical_search, "WIDTH", width)
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(docs, items)
    for options in ({}, {"block_chars": 300}):
        got = lexical_search.search(*frames, shard_bytes=shard, **options).collect()
        assert Counter(tuple(r) for r in got) == want


def test_search_gives_up_most_documents():
    rng = random.Random(5)
    rare = [f"r{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(WORDS) for _ in range(60)) + " " + " ".join(rng.choice(rare) for _ in range(3)) for _ in range(4000)]
    queries = lexical_search.Queries([" ".join(WORDS[:3] + [rare[i], rare[i + 1]]) for i in range(20)])
    best, scored = lexical_search.Best(20, 10), []
    offer = best.offer
    best.offer = lambda q, ids, score: (scored.append(len(q)), offer(q, ids, score))
    df = np.array([sum(1 for _ in ()) + 100] * len(queries.vocabulary))
    weight = np.array([math.floor(1000 * math.log(8002 / (2 * x + 1))) for x in df])
    lexical_search.search_shard(queries, weight, 4000, 4000 * 63, [t.encode() for t in texts], np.arange(4000), best)
    assert sum(scored) < 0.9 * 20 * 4000


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, score int"), spark.createDataFrame([("x", "a", 0)], "item_id string, text string, rank int")
    assert [tuple(r) for r in lexical_search.search(docs, items).select("item_id", "rank", "doc_id").collect()] == [("x", 1, 1)]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        got = lexical_search.search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


# ---- token alignment

needs_files = pytest.mark.skipif(not os.path.exists(token_alignment.BYTE_BPE), reason="no vocabulary files")


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_alignment.PIECE_BPE)
    of = token_alignment._char_bytes()
    out, links = [], []
    for text in texts:
        out.append([0, 0, 0, ""]), links.append([])
        if not text:
            continue
        a_id, b_id = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_bytes = [bytes(of[c] for c in a.id_to_token(i)) for i in a_id]
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_id]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            continue
        ends = dict(zip(np.cumsum([len(x) for x in a_bytes]).tolist(), range(len(a_id))))
        groups, i, j = [], 0, 0
        for q, end in enumerate(np.cumsum([len(x) for x in b_bytes]).tolist()):
            if end in ends:
                p = ends[end]
                groups.append(",".join(map(str, a_id[i : p + 1])) + "|" + ",".join(map(str, b_id[j : q + 1])))
                links[-1].append((a_id[p], b_id[q]))
                i, j = p + 1, q + 1
        out[-1] = [len(a_id), len(b_id), len(groups), ";".join(groups)]
    counts = Counter(x for own in links for x in own)
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(highest.get(y, 0), n)
    return [(*n, len(own), sum(counts[x] == highest[x[1]] for x in own), sum(counts[x] for x in own)) for n, own in zip(out, links)]


def odd_texts(n, seed=6):
    rng = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", " ", "▁", "　", " x", "'s", "<|endoftext|>", "<s>", "日本", "​", "😀", "1", "23", ".", "à", "\x00", "\x1c", "\u0085", " ", "ﬁ", "é", " ́", "﻿", "Straße"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)] + [None, "", " ", "   ", "tion " * 5000]


def test_lockstep_merge_against_sets():
    rng = random.Random(7)
    ends = lambda n: sorted(rng.sample(range(1, n), rng.randint(0, n - 1))) + [n]
    texts = [(ends(n), ends(n)) for n in (rng.randint(1, 30) for _ in range(200))] + [([], [])]
    first = lambda side: np.concatenate([[0], np.cumsum([len(t[side]) for t in texts])])
    flat = lambda side: np.array([e for t in texts for e in t[side]], np.int64)
    got = token_alignment.merge_lockstep(flat(0), first(0), flat(1), first(1))
    want = [(t, int(first(0)[t] + a.index(e)), int(first(1)[t] + b.index(e))) for t, (a, b) in enumerate(texts) for e in a if e in set(b)]
    assert list(zip(*(x.tolist() for x in got))) == want


@needs_files
@pytest.mark.parametrize("cut, general", [(True, False), (False, False), (True, True)])
def test_chunk_against_brute_force(cut, general):
    vocabularies = token_alignment.Vocabularies(token_alignment.BYTE_BPE, token_alignment.PIECE_BPE)
    assert vocabularies.cut
    vocabularies.cut = cut
    if general:
        vocabularies.a_encode = vocabularies._general(token_alignment.BYTE_BPE)
    texts = odd_texts(3000)
    chunk = token_alignment.Chunk(token_alignment.Known(vocabularies), [None if t is None else t.encode() for t in texts])
    got = [(*(int(chunk.numbers[n][k]) for n in ("n_a", "n_b", "n_groups")), chunk.groups[k].decode(), int(chunk.numbers["n_links"][k])) for k in range(len(texts))]
    assert got == [w[:5] for w in brute_alignment(texts)]


@needs_files
def test_alignment_against_brute_force(spark):
    texts = odd_texts(500)
    texts += texts[:40]
    docs = spark.createDataFrame(list(enumerate(texts)), "kept long, text string").withColumnRenamed("kept", "n_a").repartition(5)
    want = {k: w for k, w in enumerate(brute_alignment(texts))}
    for chunk_bytes in (500, 1 << 20):
        rows = token_alignment.align(docs, with_groups=True, chunk_bytes=chunk_bytes).collect()
        assert len(rows) == len(texts)
        for r in rows:
            c = r["alignment"]
            assert (c["n_a"], c["n_b"], c["n_groups"], c["groups"], c["n_links"], c["n_best"], c["count_sum"]) == want[r["n_a"]]
            assert c["groups_sha256"] == (hashlib.sha256(c["groups"].encode()).hexdigest() if c["groups"] else "")


@needs_files
def test_alignment_of_tables_without_links(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", None), (None, "", None)], "doc_id long, text string, alignment string")
    rows = token_alignment.align(docs).collect()
    assert sorted((r["doc_id"] is None, r["alignment"]["n_links"], r["alignment"]["count_sum"], r["alignment"]["groups_sha256"]) for r in rows) == [(False, 0, 0, ""), (True, 0, 0, ""), (True, 0, 0, "")]
    assert token_alignment.align(docs.limit(0)).count() == 0


# ---- the entry, and ids that say nothing


def test_all_text_queries_are_registered():
    import __spark_entry__ as entry

    names = {q for q in entry.queries() if q.startswith("op") or q == "pipeline"}
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("ids", ["null", "one a language"])
def test_languages_are_learned_whatever_the_ids(spark, ids):
    from gridseries.llm import language_id

    rng = random.Random(8)
    words = {"xx": ["alpha", "beta", "gamma", "delta", "kappa"], "yy": ["один", "два", "три", "четыре", "пять"]}
    rows = [(None if ids == "null" else k, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for k, lang in enumerate(words) for _ in range(1500)]
    rows += [(None, "one text only " * 5, "zz")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    learned = language_id.fit(docs)
    assert set(learned) == {"xx", "yy", "zz"} and max(map(len, learned.values())) <= 1 << 18
    got = language_id.classify(docs, learned).groupBy("lang", "language.lang_pred").count().collect()
    assert sum(r["count"] for r in got if r["lang"] == r["lang_pred"]) > 0.98 * 5000


def test_null_ids_share_no_bucket(spark):
    from pyspark.sql import functions as F

    from gridseries.llm import mixing

    sizes = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), (F.col("id") + 1).alias("size"))
    out = mixing.mix(sizes, bucket_rows=200)
    assert out.count() == 6000
    ticket = F.xxhash64(F.lit(""), "size", F.lit(7))  # as mix has it
    assert sizes.groupBy("source", F.pmod(ticket, F.lit(10))).count().agg(F.max("count")).first()[0] < 300
    again = {(r["size"], r["copies"]) for r in mixing.mix(sizes.repartition(3), bucket_rows=200).collect()}
    assert {(r["size"], r["copies"]) for r in out.collect()} == again
