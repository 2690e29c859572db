"""Toxicity: a learned lexicon, matched through misspellings, and the context of each match.

The lexicon holds words, and stems that stand for all words they begin, which labelled toxic texts
have far more often than others.  A Levenshtein automaton of each text word is run over the trie of
the lexicon's words and of those behind its stems, so that misspelled ones match too: within one edit,
or two for long words, a swap of neighbours being one edit.  A window around each match tells quotation
(quote marks, words of reporting) from abuse (words of address); a logistic regression weighs direct,
misspelled and quoted matches, and those that come together.

What is learned is counted where the sample's texts are: tasks count terms and the words around matches by
label, and make numbers of the texts; terms that pass and six numbers a text reach the driver, no text does.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.arrowtext import small_batches, texts_of
from gridseries.llm.labelled import sample_frame
from gridseries.llm.session import checkpointed, held_out, shuffle_partitions

#: The sample that teaches: rows, and characters of each.
SAMPLE_ROWS = 8000
SAMPLE_CHARS = 20_000
#: A strong term is this many times likelier in toxic texts, a weak one that many; both are in so many
#: toxic texts at least, and in that share of them.
STRONG_LIFT, WEAK_LIFT = 60.0, 8.0
STRONG_TEXTS, STRONG_SHARE = 6, 0.005
WEAK_TEXTS, WEAK_SHARE = 12, 0.015
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: Longer words teach nothing.
TERM_LENGTH = 40
#: Lexicon words of fewer letters are matched exactly only; from LONG_LENGTH letters on two edits are allowed.
FUZZY_LENGTH, LONG_LENGTH = 5, 9
#: Words near the lexicon that are in so many clean texts are words of their own.
KNOWN_TEXTS = 3
WINDOW = 6
COLUMN = "toxicity"
#: A word of so many texts with a match of each label, so many times likelier by the match with one label, tells quotation from abuse.
CONTEXT_TEXTS, CONTEXT_LIFT = 20, 4.0
# Fixed word lists of reporting and of address, in the languages of the texts: where the sample says nothing else.
REPORTING = set("said says wrote writes quoted quote called reported claimed sagte sagt schrieb zitierte nannte dit écrit cité appelé dijo dice escribió citó llamó".split())
ADDRESS = set("you your you're u du dich dein ihr tu toi ton vous votre tú usted tu eres".split())
_QUOTES = re.compile("[\"“”„«»]")
_WORD = re.compile(r"[^\W_]+")


def lowered(text: bytes | None) -> str:
    """What is learned and matched of a text; its words are the runs of letters and digits of any script."""
    return (text or b"").decode(errors="replace").lower()


def edit_limit(letters: int) -> int:
    """How many edits a lexicon word of so many letters is matched through."""
    return 0 if letters < FUZZY_LENGTH else 1 if letters < LONG_LENGTH else 2


def deletions(word: str, most: int) -> set[str]:
    """`word` without up to `most` letters.  Words within so many edits or swaps have one of these in common."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sets of letters and of pairs of neighbours of each word, as 64 bits; several may share a bit.  Words are not empty."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(list(map(len, words)))
    bit = lambda x: np.uint64(1) << (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58))
    pairs = bit(codes * np.uint64(1 << 21) + np.append(codes[1:], np.uint64(0)))
    pairs[ends - 1] = 0
    return tuple(np.bitwise_or.reduceat(x, np.append(0, ends[:-1])) for x in (bit(codes), pairs))


class Trie:
    """A lexicon as a trie; a stem accepts every word that goes on from it."""

    END, STEM = "", "*"

    def __init__(self, words: set[str], stems: set[str]):
        self.root: dict = {}
        for w in words:
            self._add(w, self.END)
        for s in stems:
            self._add(s, self.STEM)

    def _add(self, word: str, end: str) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[end] = word

    def finds(self, word: str) -> bool:
        """Whether `word` is a word of the lexicon or goes on from a stem."""
        node = self.root
        for c in word:
            if self.STEM in node:
                return True
            node = node.get(c)
            if node is None:
                return False
        return self.END in node or self.STEM in node

    def within(self, word: str, edits: int, swaps: bool = False, limit: Callable[[int], int] | None = None) -> tuple[str, int] | None:
        """The closest lexicon word within `edits` of `word`, ties by word: the automaton of `word`
        accepts what is that close to it, and only trie paths that keep one of its states alive are walked.

        With `swaps` two neighbouring letters in the other order are one edit; `limit` gives the most
        edits by the lexicon word's length.
        """
        n = len(word)

        def closure(states: dict[int, int]) -> dict[int, int]:
            for i in range(n):  # skipping a letter of `word` costs an edit
                if i in states and states[i] < edits and states[i] + 1 < states.get(i + 1, edits + 1):
                    states[i + 1] = states[i] + 1
            return states

        best: tuple[int, str] | None = None
        todo = [(self.root, closure({0: 0}))]
        while todo:
            node, states = todo.pop()
            if self.END in node and n in states and (limit is None or states[n] <= limit(len(node[self.END]))) and (best is None or (states[n], node[self.END]) < best):
                best = states[n], node[self.END]
            for c, below in node.items():
                if len(c) != 1 or c == self.STEM:
                    continue
                new: dict[int, int] = {}
                for i, e in states.items():
                    if i < 0:  # within a swap: the second letter is read, the first is due
                        if word[-i - 1] == c and e < new.get(1 - i, edits + 1):
                            new[1 - i] = e
                        continue
                    if swaps and e < edits and i + 1 < n and word[i + 1] == c != word[i]:
                        new[-i - 1] = min(e + 1, new.get(-i - 1, edits))
                    if i < n:
                        cost = e + (word[i] != c)
                        if cost <= edits and cost < new.get(i + 1, edits + 1):
                            new[i + 1] = cost
                    if e < edits and e + 1 < new.get(i, edits + 1):
                        new[i] = e + 1
                if new:
                    todo.append((below, closure(new)))
        return (best[1], best[0]) if best else None


@dataclass
class Lexicon:
    words: set[str] = field(default_factory=set)
    stems: set[str] = field(default_factory=set)
    #: Words that are also looked for through misspellings.
    fuzzy: set[str] = field(default_factory=set)
    #: Words and stems (with *) that say less.
    weak: set[str] = field(default_factory=set)
    #: Words near the lexicon that clean texts use: no misspellings.
    known: set[str] = field(default_factory=set)
    #: Words whose nearness tells quotation, and abuse.
    reporting: set[str] = field(default_factory=lambda: set(REPORTING))
    address: set[str] = field(default_factory=lambda: set(ADDRESS))


def terms_of(text: bytes | None) -> set[str]:
    """The distinct words of a text that may teach, and the stems (with *) of those that may be terms."""
    words = {w for w in _WORD.findall(lowered(text)) if len(w) <= TERM_LENGTH + edit_limit(TERM_LENGTH)}
    return words | {w[:n] + "*" for w in words if len(w) <= TERM_LENGTH for n in STEM_LENGTHS if len(w) >= n}


#: In how many texts a term is: (of label 1, of label 0).
Counts = dict[str, tuple[int, int]]


def lexicon_of(counts: Counts, toxic: int, clean: int, behind: Callable[[set[str]], Iterable[str]]) -> Lexicon:
    """The terms that mark the texts with label 1, from those of `counts` in STRONG_TEXTS toxic texts at least.

    `behind` gives the words of more than one toxic text that begin with one of some stems.
    """
    lift = {t: ((n + 0.5) / (toxic + 1)) / ((m + 0.5) / (clean + 1)) for t, (n, m) in counts.items() if len(t) <= TERM_LENGTH}
    marks = lambda least, texts, share: {t for t, x in lift.items() if x >= least and counts[t][0] >= max(texts, share * toxic)}
    strong, weak = marks(STRONG_LIFT, STRONG_TEXTS, STRONG_SHARE), marks(WEAK_LIFT, WEAK_TEXTS, WEAK_SHARE)
    words = {t for t in strong if not t.endswith("*")}
    stems: set[str] = set()
    for t in sorted((t for t in strong if t.endswith("*")), key=lambda t: (len(t), t)):
        stem = t[:-1]
        whole = max((counts[w][0] for w in words if w.startswith(stem)), default=0)
        # A stem that is hardly more frequent than one word of it is that word.
        if whole < 0.8 * counts[t][0] and not any(stem.startswith(s) for s in stems):
            stems.add(stem)
    stem_trie = Trie(set(), stems)
    # Strong words, those behind a stem too, and what else recurs behind a stem.
    fuzzy = {t for t in words | set(behind(stems)) if edit_limit(len(t)) and len(t) <= TERM_LENGTH}
    words = {w for w in words if not stem_trie.finds(w)}
    return Lexicon(words, stems, fuzzy, {t for t in weak - strong if not any(t.startswith(s) for s in stems | words)})


def is_known(n: int, m: int, toxic: int, clean: int) -> bool:
    """Whether a word near the lexicon, in n toxic and m clean texts, is used by clean ones about as often."""
    return m >= KNOWN_TEXTS and (n + 0.5) / (toxic + 1) < WEAK_LIFT * (m + 0.5) / (clean + 1)


def learn_lexicon(sample: list[tuple[bytes, int]]) -> Lexicon:
    """The lexicon of a sample that is at hand; `fit` counts one where it is."""
    seen = Counter(), Counter()
    for text, y in sample:
        seen[0 if y else 1].update(terms_of(text))
    counts = {t: (seen[0][t], seen[1][t]) for t in seen[0].keys() | seen[1].keys()}
    toxic = sum(1 for _, y in sample if y)
    clean = len(sample) - toxic
    inside = lambda stems: (t for t, (n, _) in counts.items() if n > 1 and not t.endswith("*") and Trie(set(), stems).finds(t))
    lexicon = lexicon_of(counts, toxic, clean, inside)
    matcher = Matcher(lexicon)
    lexicon.known = {t for t, (n, m) in counts.items() if is_known(n, m, toxic, clean) and not t.endswith("*") and matcher.kind(t) == MISSPELLED}
    return lexicon


DIRECT, MISSPELLED, QUOTED, WEAK, SEVERAL, SIZE = range(6)


@dataclass
class Matcher:
    lexicon: Lexicon
    cache: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        x = self.lexicon
        strip = lambda stem: {t.rstrip("*") for t in x.weak if t.endswith("*") == stem}
        self.exact, self.fuzzy, self.weak = Trie(x.words, x.stems), Trie(x.fuzzy, set()), Trie(strip(False), strip(True))
        self.near = {d for w in x.fuzzy for d in deletions(w, edit_limit(len(w)))}
        self.longest = max(map(len, x.fuzzy), default=0)
        self.edits = edit_limit(self.longest)

        by_length: dict[int, list[str]] = {}
        for w in sorted(x.fuzzy):
            by_length.setdefault(len(w), []).append(w)
        self.letters = {n: list(zip(*letters_of(w))) for n, w in by_length.items()}

    def _misspelled(self, word: str, most: int) -> bool:
        """Only words that share a deletion with the lexicon, as all in reach do, run through the automaton."""
        if not FUZZY_LENGTH - 1 <= len(word) <= self.longest + self.edits or word in self.lexicon.known or word in self.lexicon.weak:
            return False
        return not self.near.isdisjoint(deletions(word, most)) and self.fuzzy.within(word, most, True, edit_limit) is not None

    def _reach(self, words: list[str]) -> np.ndarray:
        """By how many edits at most each word may be a lexicon word, told by lengths, letters and pairs of neighbours.

        An edit takes one letter and three pairs (a swap) out of a set at most, and brings as many.
        """
        (own, own_pairs), sizes = letters_of(words), np.array([len(w) for w in words], np.int64)
        out = np.zeros(len(words), np.int64)
        for n, sets in sorted(self.letters.items(), reverse=True):  # long lexicon words allow most edits
            most = edit_limit(n)
            at = np.flatnonzero((out < most) & (np.abs(sizes - n) <= most))
            count = np.bitwise_count
            for letters, pairs in sets:
                near = at[(count(own[at] & ~letters) <= most) & (count(letters & ~own[at]) <= most)]
                near = near[(count(own_pairs[near] & ~pairs) <= 3 * most) & (count(pairs & ~own_pairs[near]) <= 3 * most)]
                out[near] = most
        return out

    def kinds(self, words: Iterable[str]) -> dict[str, int | None]:
        """Of each distinct word DIRECT: in the lexicon, MISSPELLED: near a word of it, WEAK: a weak term, or None."""
        if len(self.cache) > 300_000:
            self.cache.clear()
        out = {w: self.cache.get(w, -1) for w in words}
        new = [w for w, k in out.items() if k == -1]
        for w, most in zip(new, self._reach(new).tolist() if new else []):
            if self.exact.finds(w):
                k = DIRECT
            elif most and self._misspelled(w, most):
                k = MISSPELLED
            else:
                k = WEAK if self.weak.finds(w) else None
            out[w] = k
            if len(w) <= 2 * TERM_LENGTH:
                self.cache[w] = k
        return out

    def kind(self, word: str) -> int | None:
        return self.kinds([word])[word]

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        """For each text: direct, misspelled, quoted and weak matches (3 at most), whether a direct one has company, and words on a log scale."""
        out = np.zeros((len(texts), 6))
        lower = list(map(lowered, texts))
        words_of = list(map(_WORD.findall, lower))
        kinds = self.kinds(set().union(*words_of))
        for d, (text, words) in enumerate(zip(lower, words_of)):
            out[d, SIZE] = np.log1p(len(words)) / 10
            hits = [(i, k) for i, k in enumerate(map(kinds.get, words)) if k is not None]
            if not hits:
                continue
            spans = [m.span() for m in _WORD.finditer(text)]
            for i, k in hits:
                out[d, QUOTED if k != WEAK and self._quoted(text, words, spans, i) else k] += 1
        out[:, SEVERAL] = (out[:, DIRECT] > 0) & (out[:, DIRECT] + out[:, MISSPELLED] > 1)
        out[:, :SEVERAL] = np.minimum(out[:, :SEVERAL], 3)
        return out

    def context(self, text: bytes | None) -> set[str]:
        """Of a text with a match: its words other than matches, and with + those in the windows around matches."""
        words = _WORD.findall(lowered(text))
        kinds = self.kinds(set(words))
        hits = [i for i, w in enumerate(words) if kinds[w] in (DIRECT, MISSPELLED)]
        near = {words[j] for i in hits for j in range(max(0, i - WINDOW), min(len(words), i + WINDOW + 1))}
        plain = lambda found: {w for w in found if kinds[w] is None and len(w) <= TERM_LENGTH}
        return plain(words) | {"+" + w for w in plain(near)} if hits else set()

    def _quoted(self, text: str, words: list[str], spans: list[tuple[int, int]], i: int) -> bool:
        """Whether the window around word i speaks of quotation rather than abuse."""
        a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        before, after = text[spans[a][0] : spans[i][0]], text[spans[i][1] : spans[b - 1][1]]
        near = words[a:i] + words[i + 1 : b]
        marks = 2 if len(_QUOTES.findall(before)) % 2 and _QUOTES.search(after) else 0
        quotation = marks + sum(x in self.lexicon.reporting for x in near)
        return quotation > sum(x in self.lexicon.address for x in near)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float


#: A toxic text that is missed counts as many times a clean one that is marked.
MISS_COST = 2.0
#: What the weights are drawn to where the sample says nothing: misspelled matches count, quoted ones little.
PRIOR = np.array([2.0, 1.0, 0.3, 0.3, 1.0, 0.0])


_COUNTED = ["term", "toxic", "clean"]


def _counts_by_label(terms: Callable[[bytes | None], Iterable[str]]):
    """(term, toxic, clean): in how many texts of a batch the terms are, by the label of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            seen = Counter(), Counter()
            for text, y in zip(texts_of(batch), batch.column("label").to_pylist()):
                seen[0 if y else 1].update(terms(text))
            found = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([s[t] for t in found], pa.int64()) for s in seen)], names=_COUNTED)

    return run


def _summed(sample: DataFrame, run) -> DataFrame:
    return sample.select("text", "label").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_lexicon(sample: DataFrame, toxic: int, clean: int) -> Lexicon:
    """The lexicon of a sample (text, label), of which only terms that pass the bounds reach the driver."""
    spark = sample.sparkSession
    is_stem = F.col("term").endswith("*")
    counts = checkpointed(_summed(sample, _counts_by_label(terms_of)).where((F.col("toxic") > 1) | ~is_stem & (F.col("clean") >= KNOWN_TEXTS)))
    lift = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    marks = counts.where((lift >= min(STRONG_LIFT, WEAK_LIFT) * 0.999) & (F.col("toxic") >= min(STRONG_TEXTS, WEAK_TEXTS)))
    marks = marks.where(F.col("toxic") >= min(STRONG_SHARE, WEAK_SHARE) * toxic)

    def behind(stems: set[str]) -> list[str]:
        begins = F.lit(False)
        for n in STEM_LENGTHS:
            begins |= F.substring("term", 1, n).isin([s for s in stems if len(s) == n])
        return [r["term"] for r in counts.where((F.col("toxic") > 1) & ~is_stem & begins).select("term").collect()]

    lexicon = lexicon_of({r["term"]: (r["toxic"], r["clean"]) for r in marks.collect()}, toxic, clean, behind)
    shared = spark.sparkContext.broadcast(lexicon)  # bounded by the sample

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in _COUNTED))
            kinds = matcher.kinds([t for t, n, m in rows if is_known(n, m, toxic, clean)])
            yield pa.RecordBatch.from_arrays([pa.array([t for t, k in kinds.items() if k == MISSPELLED], pa.string())], names=["term"])

    words = counts.where(~is_stem & (F.col("clean") >= KNOWN_TEXTS)).select(*_COUNTED)
    lexicon.known = {r["term"] for r in words.mapInArrow(near, "term string").collect()}
    _learn_context(sample, lexicon)
    return lexicon


def _learn_context(sample: DataFrame, lexicon: Lexicon) -> None:
    """Adds the words that stand by matches with one label far more often to those of reporting and of address.

    Of the texts with a match that have a word, the share that has it in a window is compared between
    the labels, and with that of all words: what a label's texts are about, or their language, has no part in it.
    """
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counts_by_label(Matcher(shared.value).context)(batches)

    enough = (F.col("toxic") >= CONTEXT_TEXTS) & (F.col("clean") >= CONTEXT_TEXTS)
    rows = _summed(sample, run).where(enough | F.col("term").startswith("+")).collect()
    counts = {r["term"]: (r["toxic"], r["clean"]) for r in rows}
    words = {w: (*counts.get("+" + w, (0, 0)), *n) for w, n in counts.items() if not w.startswith("+")}
    if not words:
        return
    by_toxic, by_clean, toxic, clean = np.sum(list(words.values()), axis=0) + 0.5
    for word, (n, m, of_n, of_m) in words.items():
        # Expected by the shares of all words, against what is there.
        lift = (m + 0.5) / (of_m * by_clean / clean + 0.5) / ((n + 0.5) / (of_n * by_toxic / toxic + 0.5))
        if n + m >= CONTEXT_TEXTS and lift >= CONTEXT_LIFT:
            lexicon.reporting.add(word)
            lexicon.address.discard(word)
        elif n + m >= CONTEXT_TEXTS and lift <= 1 / CONTEXT_LIFT:
            lexicon.address.add(word)
            lexicon.reporting.discard(word)


def fit(sample: DataFrame, steps: int = 100) -> Model:
    """Learns the lexicon and the weights of a sample (text, label) of bounded size; a sample of one label scores everything on that label's side."""
    sample = checkpointed(sample.select("text", (F.col("label") != 0).cast("int").alias("label")).repartition(shuffle_partitions(sample.sparkSession)))
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model(Lexicon(), PRIOR.copy(), 3.0 if 1 in sizes else -3.0)
    lexicon = fit_lexicon(sample, sizes[1], sizes[0])
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the sample

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in small_batches(batches):
            x = matcher.features(texts_of(batch))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column("label")], names=[*(f"x{k}" for k in range(6)), "y"])

    rows = np.array(sample.mapInArrow(numbers, ", ".join(f"x{k} double" for k in range(6)) + ", y int").collect(), float)
    rows = rows[np.lexsort(rows.T)]  # sums of one order, whatever the tasks' order
    return _weighed(lexicon, np.hstack([rows[:, :6], np.ones((len(rows), 1))]), rows[:, 6], steps)


def _weighed(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, steps: int) -> Model:
    prior, strength = np.append(PRIOR, 0.0), np.array([1.0, 4.0, 4.0, 1.0, 1.0, 1.0, 1e-3])

    cost = np.where(y == 1, MISS_COST, 1.0)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((cost * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (strength * (w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(steps):  # damped Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (cost * p * (1 - p))[:, None]).T @ x + np.diag(strength)
        step = np.linalg.solve(h, x.T @ (cost * (p - y)) + strength * (w - prior))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if size * np.abs(step).max() < 1e-8:
            break
    return Model(lexicon, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with a struct column `toxicity`, which replaces one of that name: score, predicted, direct, misspelled, quoted, weak.

    A null or empty text has no match and gets the score of a text without words.  Other columns stay.
    Repeated rows are scored alike; an empty table gives no rows.
    """
    docs = docs.drop(COLUMN)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    counts = ["direct", "misspelled", "quoted", "weak"]
    schema = docs.withColumn(COLUMN, F.lit(None).cast("struct<score:double,predicted:int,direct:bigint,misspelled:bigint,quoted:bigint,weak:bigint>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        matcher = Matcher(m.lexicon)
        for batch in small_batches(batches):
            x = matcher.features(texts_of(batch))
            p = 1 / (1 + np.exp(-np.clip(x @ m.weights + m.bias, -30, 30)))
            column = pa.StructArray.from_arrays([pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *(pa.array(x[:, k].astype(np.int64)) for k in range(4))], names=["score", "predicted", *counts])
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, COLUMN])

    return docs.mapInArrow(run, schema)


def detect(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """Fits on a sample of the labelled documents that are not held out, and scores all.

    Null and empty texts are scored as texts without a term; rows without a label, and labels without a document, teach nothing;
    repeated rows are scored alike; an empty table gives no rows.  A text has to fit a task's memory.
    """
    return score(docs, fit(sample_frame(docs, labels, "toxic", sample_rows, sample_chars)))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = detect(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), f"{COLUMN}.*")
