"""From raw documents to a weighted mix: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of `docs`, whatever other columns there are and whatever their names.  An empty table
gives no rows in each of them.  doc_id has to be an integer, or null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from gridseries.llm.session import checkpointed

#: Near duplicates of the pipeline: sets of five-word shingles, Jaccard 0.8 or more (op3's contract has its own values).
SHINGLE, PERCENT = 5, 80


_OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _beside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`stage` of `docs` while columns that documents don't have go under names that clash with nothing."""
    aside = {c: f"_extra_{i}" for i, c in enumerate(docs.columns) if c not in _OWN}
    back = {v: k for k, v in aside.items()}
    got = stage(docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in docs.columns]))
    return got.select(*[F.col(aside.get(c, c)).alias(back.get(aside.get(c, c), c)) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is rejected: null, no letters, or too narrow a margin.  Repeated rows fare alike."""
    return _beside(docs, lambda d: language_id.identify(d).where(~F.col("language.rejected")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines of recurring templates, and without documents that consist of nothing else; n_chars counts what is left.

    A null text stays null; rows without doc_id lose no line; rows that share a doc_id count as one document.
    """

    def stage(d: DataFrame) -> DataFrame:
        got = line_dedup.drop_templates(d)
        got = got.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        return got.select(*[F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in d.dtypes])

    return _beside(docs, stage)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates.

    Rows without doc_id stay, as do null and empty texts; rows that share a doc_id are one document, and stay or go together.
    """
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text"), n=SHINGLE, percent=PERCENT)
    copies = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_copy")).distinct()
    return _beside(docs, lambda d: d.join(copies, d["doc_id"].cast("long") == copies["_copy"], "left_anti"))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold enough of the benchmark; null texts hold none.  Repeated rows fare alike."""
    return _beside(docs, lambda d: decontaminate.decontaminate(d, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each row: its copies and its words times those.  A null text has no word and isn't taken; a null
    source is a source; repeated rows are rounded apart."""
    got = mixing.mix_documents(docs)
    return got.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("jaccard_join", join_near_duplicates),
    ("decontaminate", remove_contaminated),
    ("mix_sources", mix_sources),
]

#: Compression and random rounding have no SQL form.  Tests hold the line, Jaccard and benchmark stages against SQL or brute
#: force, language ID against its classifier row by row, and the mix against its targets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
