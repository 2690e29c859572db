"""Language identification by compression against per-language dictionaries.

Each language gets a raw-content zstandard dictionary made of sample texts.  A text is compressed
block by block with every dictionary; the language whose dictionary gives the fewest bytes wins, and
the answer is rejected where the runner-up is too close.

Learning is bounded: about `sample_rows` labelled rows for each language, chosen by a hash of their
doc_id, each giving at most `piece_chars` characters from a place drawn in it, up to `dictionary_bytes`
for each language.  Beyond `max_languages` languages all are still learned, from fewer rows and bytes each.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.arrowtext import small_batches
from gridseries.llm.session import held_out

#: Fixed thresholds: texts are rejected when the runner-up needs less than this share of bytes more.
MIN_MARGIN = 0.01
BLOCK_BYTES = 1024
LEVEL = 3
UNKNOWN = "und"


class _Letters(dict):
    """Code points to themselves where they are letters or marks, as vowel signs are, else to a space."""

    def __missing__(self, code: int) -> str:
        self[code] = chr(code) if unicodedata.category(chr(code))[0] in "LM" else " "
        return self[code]


_LETTERS = _Letters()
_ASCII = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def normalised(text: str) -> bytes:
    """Lower-cased letters with their marks; each run of anything else becomes one space; nothing without a letter."""
    if text.isascii():
        return b" ".join(text.encode().translate(_ASCII).split())
    words = text.translate(_LETTERS).lower().split()
    return " ".join(words).encode() if any(c.isalpha() for w in words for c in w) else b""


def fit(docs: DataFrame, sample_rows: int = 400, piece_chars: int = 1500, dictionary_bytes: int = 1 << 18, max_languages: int = 200) -> dict[str, bytes]:
    """The dictionary content of each language, learned from `text` and `lang` of `docs`.

    Rows with a null text or lang teach nothing; doc_id may be null or repeated.  The counts of languages cover all
    rows, rows of equal id and text counting once (by a sketch, as the counts only size the sample); the sample is a
    range of a hash of id and text.  The sample and the dictionaries of `max_languages` languages are the budget
    that more languages share evenly.  A language whose sample has under 8 letters isn't learned.
    """
    own = lambda seed: F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"), F.lit(seed))
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", own(17).alias("key"), own(19).alias("at"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("count"))
    n = counts.count()
    if not n:
        return {}
    if n > max_languages:
        sample_rows, dictionary_bytes = max(8, sample_rows * max_languages // n), max(1024, dictionary_bytes * max_languages // n)
    space = 1 << 30
    shares = F.broadcast(counts.select("lang", F.ceil(F.lit(space * sample_rows) / F.col("count")).alias("share")))  # a row a language
    ticket = F.pmod(F.col("key"), F.lit(space))
    start = F.pmod(F.col("at"), F.greatest(F.length("text") - piece_chars + 1, F.lit(1))).cast("int") + 1
    sample = rows.join(shares, "lang").where(ticket < F.col("share")).select("lang", ticket.alias("ticket"), F.substring("text", start, F.lit(piece_chars)).alias("piece"))
    sample = sample.groupBy("lang", "ticket").agg(F.min("piece").alias("piece"))  # repeated rows are one before they leave their task
    by: dict[str, list] = defaultdict(list)
    for r in sample.collect():
        by[r["lang"]].append((r["ticket"], r["piece"]))
    out = {}
    for lang, pieces in by.items():
        content = b" ".join(dict.fromkeys(normalised(p) for _, p in sorted(pieces)))[:dictionary_bytes]
        if len(content) >= 8:  # zstandard takes no shorter dictionary
            out[lang] = content
    return out


class Classifier:
    """Compressors for each learned language."""

    def __init__(self, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN):
        self.min_margin = min_margin
        self.languages = sorted(dictionaries)
        self.compress = []
        for lang in self.languages:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected)."""
        data = normalised(text) if text else b""
        if not data or not self.languages:
            return UNKNOWN, 0.0, 0.0, True
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(compress(b)) for b in blocks) for compress in self.compress]
        best = min(sizes)
        i = sizes.index(best)
        others = sizes[:i] + sizes[i + 1 :]
        margin = (min(others) - best) / min(others) if others else 1.0
        score = 1 / sum(math.exp(-min(50.0, 0.5 * (s - best))) for s in sizes)
        return self.languages[i], score, margin, margin < self.min_margin


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """`docs` with struct column `language` (lang_pred, score, margin, rejected), which replaces one of that name; other columns stay.

    A null text, or one without a letter, is `und` with score 0 and rejected.  Ties go to the
    language that sorts first and are rejected, as their margin is 0.  Repeated rows get the same answer;
    an empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(dictionaries)  # max_languages * dictionary_bytes, or 1 kB a language
    column = "language"
    if column in docs.columns:
        docs = docs.drop(column)
    out_type = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])
    schema = docs.withColumn(column, F.lit(None).cast("struct<lang_pred:string,score:double,margin:double,rejected:boolean>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value, min_margin)
        for batch in small_batches(batches, text):
            got = [dict(zip(("lang_pred", "score", "margin", "rejected"), classifier.predict(t))) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, out_type)], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, min_margin: float = MIN_MARGIN, **bounds: int) -> DataFrame:
    """Fits on the rows of `docs` that are not held out, then classifies all of them.

    Null texts and texts without a letter are rejected as `und`; rows with a null lang are classified and teach nothing; a tie of
    sizes goes to the first language by name and is rejected; repeated rows fare alike; an empty table gives no rows.
    """
    train = docs.where(~held_out("doc_id"))
    return classify(docs, fit(train, **bounds), min_margin=min_margin)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = classify(docs.select("doc_id", "text"), fit(docs.where(~held_out("doc_id"))))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "language.lang_pred", "language.score", "language.margin", "language.rejected")
