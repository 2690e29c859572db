"""The operators that compare documents, the mix, the chats and the pipeline, against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseries.llm import chat, jaccard_join, line_dedup, mixing, substring_dedup
from gridseries.llm.components import components, merged

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def corpus(seed, n=120):
    """Documents with exact and near copies, shared passages, repeats, short and empty texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    make = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages, texts = [make(20) for _ in range(3)], []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            t = rng.choice(texts)
        elif texts and kind < 0.55:
            t = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            t = " ".join(t)
        else:
            t = make(rng.choice([1, 2, 3, 4, 12, 13, 40, 90]))
            if rng.random() < 0.5:
                at = rng.randrange(len(t) + 1)
                t[at:at] = rng.choice(passages)
            t = " ".join(t)
        texts.append(t)
    return [*enumerate(texts), (900, None), (901, ""), (902, " \n "), (903, "W1 w2\tW3"), (904, "w1 W2 w3")]


# ---- substring deduplication


def kept_words(docs, window=13):
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, w in words:
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for k in range(window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("chunks,blocks", [(1, 1), (5, 3)])
def test_substring_dedup_is_brute_force(spark, chunks, blocks):
    docs = corpus(1) + [(5, "repeated id " * 12), (5, "repeated id " * 12), (6, "z " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"parsed": F.lit(1), "chunk": F.lit("x"), "extra": F.lit("e")}).repartition(3)
    got = substring_dedup.remove_repeats(df, chunks=chunks, blocks=blocks)
    assert set(got.columns) == {"doc_id", "text", "extra", "parsed"}
    assert sorted((r["doc_id"], *(r["parsed"][k] for k in ("n_words", "n_removed", "kept"))) for r in got.collect()) == kept_words(docs)


def test_factors_name_their_source(spark):
    docs = [(d, t) for d, t in corpus(11, 80)]
    words = {d: WORD.findall(t or "") for d, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    n = 0
    for r in substring_dedup.remove_repeats(df, chunks=7, blocks=3).collect():
        p, covered = r["parsed"], set()
        for f in p["factors"]:
            n += 1
            assert f["n_words"] >= 13 and f["source_doc"] < r["doc_id"]
            own, source = words[r["doc_id"]], words[f["source_doc"]]
            assert own[f["start"] : f["start"] + f["n_words"]] == source[f["source_word"] : f["source_word"] + f["n_words"]]
            a, b = f["start"] + f["n_words"], f["source_word"] + f["n_words"]
            assert a == len(own) or b == len(source) or own[a] != source[b] or any(g["start"] < a < g["start"] + g["n_words"] for g in p["factors"])
            covered |= set(range(f["start"], a))
        assert covered == {w for s in p["spans"] for w in range(s["start"], s["start"] + s["n_words"])} and len(covered) == p["n_removed"]
    assert n > 50


def test_wrong_routes_remove_nothing():
    passages, block = substring_dedup.Words([b"a b c d e"]), substring_dedup.Words([b"a b x d e", b"b c d e"])
    keys = np.array([0, 1, 2, 3, 4])
    assert list(substring_dedup.factors(passages, 0, block, np.array([0, 5, -1, -1, -1]), keys, 3)) == [(1, 4, 5)]


def test_substring_dedup_of_no_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a " * 14), (None, "a " * 14), (3, "a " * 13)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["parsed"]["n_removed"]) for r in substring_dedup.remove_repeats(df, chunks=2).collect())
    assert got == [(-1, 14), (-1, 14), (3, 0)]
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


# ---- Jaccard join


def jaccard_components(docs, n=4, percent=85):
    sets = {}
    for d, t in docs:
        w = WORD.findall(lower(t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return sorted((d, len(s), find(d)) for d, s in sets.items())


@pytest.mark.parametrize("seed,rare", [(2, 16), (3, 1), (4, 2)])
def test_jaccard_join_is_brute_force(spark, seed, rare):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard_join.near_duplicates(df, rare=rare).collect()))
    assert got == jaccard_components(docs)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    docs = []
    for d in range(150):
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        docs.append((d, " ".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = jaccard_components(docs)
    assert 5 < len({c for _, _, c in want}) < 140
    for block_docs in (256, 20):
        assert sorted(map(tuple, jaccard_join.near_duplicates(df, block_docs=block_docs).collect())) == want


def test_compared_pairs_grow_with_documents(spark, monkeypatch):
    """Documents of eight paragraphs from a stock in which each is in about eight documents: no links, one candidate cluster."""
    rng, counted = random.Random(12), []

    def texts(n):
        stock = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(n)]
        offsets = rng.sample(range(n), 8)
        return [(d, " ".join(stock[(d + k) % n] for k in offsets)) for d in range(n)]

    verify = jaccard_join._verify

    def verified(pairs, *rest):
        counted[-1] += pairs.count()
        return verify(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_verify", verified)
    for n in (200, 600):
        counted.append(0)
        docs = texts(n)
        got = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), chunks=2, blocks=3).collect()
        assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == n
    assert n < counted[1] < 3.6 * counted[0]


def test_jaccard_join_of_odd_rows(spark):
    docs = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.near_duplicates(df).collect())) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (95, 95), (7, 3), (7, 3), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 90, 90: 90, 95: 90}
    more = merged(components(spark.createDataFrame([(1, 2), (5, 6)], "a long, b long")), spark.createDataFrame([(6, 2), (8, 9)], "a long, b long"))
    assert dict(map(tuple, more.collect())) == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- lines


def test_recurring_templates_go_but_for_the_first(spark):
    body = lambda d: " ".join(chr(97 + d) * k for k in range(3, 9))
    docs = [(d, f"{body(d)}\nPosted by user{d} on day {d} of May\nshort one\nAll rights are reserved here") for d in range(14)]
    docs += [(50, None), (51, ""), (52, "All rights are reserved here"), (52, "All rights are reserved here"), (None, "All rights are reserved here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_lines": F.lit("x"), "keep": F.lit(1)})
    got = defaultdict(list)
    for r in line_dedup.drop_templates(df).collect():
        got[r["doc_id"]].append((r["text"], r["n_lines"], r["n_dropped"]))
    assert got[0] == [(docs[0][1], 4, 0)]
    assert all(got[d] == [(f"{body(d)}\nshort one", 4, 2)] for d in range(1, 14))
    assert got[50] == [(None, 0, 0)] and got[51] == [("", 1, 0)] and got[52] == [("", 1, 1)] * 2
    assert got[None] == [("All rights are reserved here", 1, 0)]


def test_rare_lines_stay(spark):
    docs = [(d, "one line that nine documents share") for d in range(9)]
    assert line_dedup.drop_templates(spark.createDataFrame(docs, "doc_id long, text string")).where("n_dropped > 0").count() == 0
    assert line_dedup.drop_templates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_that_differ_in_a_word_are_one_template(spark):
    colours = ["red", "blue", "green", "black", "white", "brown", "grey", "pink", "gold", "teal", "lime", "navy"]
    docs = [(i, f"we sell the finest {c} paint in town today") for i, c in enumerate(colours)]
    docs += [(50 + i, f"{c} is {c}er than {c}") for i, c in enumerate(colours)] + [(70 + i, f"{i} {i} {i} of {i}") for i in range(12)]
    got = line_dedup.drop_templates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.where("n_dropped > 0").collect()} == set(range(1, 12))


def test_long_lines_and_short_lines_recur_by_their_length(spark):
    passage = " ".join(f"{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(51))
    middle = " ".join(passage.split()[:30])
    numbers = lambda d: " ".join(f"{d}{i}" for i in range(60))
    docs = [(d, f"alone {chr(97 + d % 26) * (1 + d // 26)}\nAdvertisement\n}}\n17\n\n{numbers(d)}") for d in range(60)]
    own = lambda d: f"own{'z' * (d - 99)} " * 80
    docs += [(100, passage), (101, f"{own(101)}\n{passage}"), (102, middle), (103, middle), (104, "Read more"), (105, "Read more"), (106, f"{passage}\nso")]
    docs += [(d, f"{middle} end\n{own(d)}") for d in range(110, 116)] + [(120, passage)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_templates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[100] == passage and got[101] == own(101) and got[102] == got[103] == middle and got[105] == "Read more"
    assert got[106] == f"{passage}\nso"  # half of it is a copy, which is for the join of documents
    assert got[110].startswith(middle) and all(got[d] == own(d) for d in range(111, 116)) and got[120] == passage
    assert "Advertisement" in got[0] and all("Advertisement" not in got[d] and "\n}\n17\n" in got[d] and "alone" in got[d] for d in range(1, 60))
    assert [line_dedup.exact_docs(n) for n in (3, 10, 15, 49, 50, 900)] == [10, 10, 9, 3, 2, 2]


def by_sql(tmp_path, docs):
    """What the operator's SQL says of (doc_id, text) rows."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    return sorted(con.execute(line_dedup.OP7_SQL).fetchall())


def dropped(df):
    got = line_dedup.drop_templates(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    return sorted(map(tuple, got))


def test_templates_are_the_sql_whatever_the_size_of_a_leaf(spark, tmp_path):
    rng = random.Random(6)
    leaf = lambda: " ".join(["Come", "and", "see", *(rng.choice("ppppqqqqrst") if i not in (2, 4) else str(rng.randint(0, 10**6)) if i == 2 else "x" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for i in range(7))])
    lines = list({leaf() for _ in range(7000)})
    docs = [(d, "\n".join(lines[d::500])) for d in range(500)]
    want = by_sql(tmp_path, docs)
    assert len({x[:12] for x in lines}) == 1 and len(lines) > 6000 and 100 < sum(x[2] for x in want) < 7000
    assert dropped(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == want


def test_line_dedup_is_the_sql_on_odd_texts(spark, tmp_path):
    rng = random.Random(16)
    bits = ["a", "bb", "<*>", "7", "x9", "é", "-", "\t", "\r", "", " ", "longer"]
    line = lambda: " ".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 16, 55])))
    stock = [line() for _ in range(60)]
    docs = [(d, "\n".join(rng.choice(stock) if rng.random() < 0.8 else line() for _ in range(rng.randint(0, 12)))) for d in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "\n".join(stock * 50)), (1004, stock[-1]), (1005, stock[-1])]
    assert dropped(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == by_sql(tmp_path, docs)


# ---- chats


def test_snapshots_collapse(spark):
    turns = []

    def say(conv, *texts):
        turns.extend((conv, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts))

    say(1, "hi", "hello")
    say(2, "hi", "hello", "bye")
    say(3, "hi", "hello", "bye")
    say(4, "hi", "other")
    say(5, "hi")
    say(6, "hi hello")
    turns += [(7, 0, None, None), (None, 0, "user", "lost"), (4, 0, "user", "hi"), (8, 0, "user", "x<|im_end|>y")]
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {2, 4, 6, 7, 8} and got[2][:2] == (3, 2) and got[4][0] == 2
    assert got[7][2] == "<|im_start|>unknown\n<|im_end|>" and got[8][2].count("<|im_end|>") == 1
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_roles_and_lengths_keep_turns_apart(spark):
    rows = [(1, 0, "user", "ab"), (2, 0, "usera", "b"), (2, 1, "x", "y")]
    assert chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == 2


def test_a_long_conversation(spark):
    rows = [(c, i, "user", f"turn {i}") for c, n in ((1, 3000), (2, 2999), (3, 3000)) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prefix", F.lit("x"))
    assert [(r["conv_id"], r["n_turns"], r["n_copies"]) for r in chat.collapse(df).collect()] == [(1, 3000, 2)]


# ---- the mix


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Repeated sharing, as the rule says."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    t, total, full = {}, sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free} | {s: cap * sizes[s] for s in full}
        over = {s for s in free if t[s] > cap * sizes[s]}
        if not over:
            return t
        full |= over


def test_targets_are_the_fixed_point(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 5, 100, 1000, 5000]) for s in ["a", "b", "é", "Z", "", None, "c1", "c2"]}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), " ".join(["w"] * rng.choice([0, 1, 5, 30, 200]))) for i in range(3000)]
    rows += [(5000, "d", None), (7, "a", "w w"), (7, "a", "w w"), (None, "b", "w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_documents(df, bucket_rows=100, fan_in=4).toPandas()
    assert len(got) == len(rows) and got["copies"].between(0, 3).all() and (got.loc[got["size"] == 0, "copies"] == 0).all()
    got["taken"] = got["copies"] * got["size"]
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by["taken"] - by["target"]).abs() <= 200).all()
    again = mixing.mix_documents(df.repartition(5), bucket_rows=100, fan_in=4).toPandas()
    key = ["doc_id", "source", "size", "copies"]
    assert got[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_mix_keeps_large_and_text_ids(spark):
    rows = [(2**60 + i, "a" if i % 3 else "b", 5 + i) for i in range(50)] + [(None, "a", 4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("extra", F.lit(1))
    got = mixing.mix(df, bucket_rows=10).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows} and len(got) == 51 and "extra" not in got[0].asDict()
    text = mixing.mix(df.withColumn("doc_id", F.concat(F.lit("é"), F.col("doc_id").cast("string"))), bucket_rows=10)
    assert text.select("doc_id").distinct().count() == 51


def test_mix_does_not_depend_on_partitions(spark):
    rows = [(i, ["a", "a", "a", "b", None, f"rare{i}"][i % 6], 1 + (i * 37) % 400) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n, parts in ((4, 3), (9, 7)):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append(sorted(map(repr, mixing.mix(df.repartition(parts), bucket_rows=90, fan_in=3).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_a_large_document_does_not_make_the_miss():
    rng = random.Random(6)
    for seed in range(50):
        size = np.sort(np.array([5000.0, 900.0] + [rng.randint(1, 60) for _ in range(600)]))[::-1].copy()
        p = np.full(len(size), 0.4)
        left = mixing._pivotal(size, p, seed)
        assert left < 0 or size[left] <= 60
        assert size @ p == pytest.approx(0.4 * size.sum())


def test_rounding_keeps_expectations():
    size, total = np.array([30.0, 7.0, 5.0, 4.0, 2.0]), np.zeros(5)
    for seed in range(4000):
        p = np.array([0.3, 0.5, 0.7, 0.2, 0.6])
        left = mixing._pivotal(size, p, seed)
        assert size @ p == pytest.approx(30 * 0.3 + 7 * 0.5 + 5 * 0.7 + 4 * 0.2 + 2 * 0.6)
        assert all(x in (0, 1) for i, x in enumerate(p) if i != left)
        total += p
    assert np.abs(total / 4000 - [0.3, 0.5, 0.7, 0.2, 0.6]).max() < 0.03


# ---- the pipeline


def test_pipeline_joins_at_its_own_values(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = [f"u{i}" for i in range(200)]
    copy = [f"n{i}" if i in (30, 80, 120, 170) else x for i, x in enumerate(base)]
    docs = corpus(8) + [(1000, " ".join(base)), (1001, " ".join(copy))]
    left = corpus_pipeline.join_near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "")
    want = [d for d, _, c in jaccard_components(docs, 5, 80) if c == d]
    assert sorted(r["doc_id"] for r in left.collect()) == want and 1000 in want and 1001 not in want

def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    stems = {"xx": ["tha", "ing", "er", "on"], "yy": ["oux", "ié", "que", "lle"]}
    make = lambda l, n: " ".join("".join(rng.choice(stems[l]) for _ in range(rng.randint(2, 5))) for _ in range(n))
    item = make("xx", 20)
    rows = [(i, make(l, 60), l, f"s{i % 3}", 1) for i, l in enumerate(["xx", "yy"] * 30)]
    rows += [(100, rows[0][1], "xx", "s0", 1), (101, item, "xx", "s1", 1), (102, "12 34", "xx", "s1", 1), (103, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        out = str(tmp_path / f"out{k}")
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "mix_sources"]
    clean = set(range(60))
    assert left[0] == clean | {100, 101} and left[1] == left[0] and left[2] == clean | {101} and left[3] == left[4] == clean
    ran = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert ran == sorted(map(tuple, docs.collect()))


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Columns of the operators' own names, repeated rows, no rows: every stage but the last gives back the columns it got."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(14)
    make = lambda: " ".join("".join(rng.choices(["tha", "ing", "er", "on"], k=3)) for _ in range(60))
    rows = [(i, make(), "xx", "s", 1) for i in range(30)]
    rows += [rows[3], rows[3], (50, None, "xx", None, None), (51, "", None, "s", 0), (None, rows[4][1], "xx", "s", 5)]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["language", "contamination", "n_lines", "n_dropped", "component_id", "_copy", "size", "x.y"]
    docs = own.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for n in names})
    spark.createDataFrame([(1, make())], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, table, str(tmp_path))
            assert got.columns == docs.columns
            left = got.collect()
            assert all(r[n] == f"{n}{'' if r['doc_id'] is None else r['doc_id']}" for r in left for n in names)
            by = sorted(str(r["doc_id"]) for r in left)
            want = sorted(str(r[0]) for r in rows if name != "language_id" or r[0] not in (50, 51)) if table is docs else []
            assert by == want, name
    assert corpus_pipeline.mix_sources(spark, docs, "").count() == len(rows)
