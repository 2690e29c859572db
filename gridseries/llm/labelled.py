"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.llm.session import held_out


PIECES = 8


def pieces(text: Column, doc_id: Column, chars: int) -> Column:
    """A text of up to `chars` characters whole, of a longer one a piece from each of PIECES equal parts."""
    part, size = F.floor(F.length(text) / PIECES).cast("int"), max(1, chars // PIECES)
    start = lambda j: j * part + F.pmod(F.xxhash64(doc_id.cast("string"), j), F.greatest(part - size + 1, F.lit(1))).cast("int") + 1
    drawn = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda j: F.substring(text, start(j), F.lit(size)))
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(drawn, "\n"))


def sample_frame(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int) -> DataFrame:
    """About `rows` (ticket, id, text, label) of labelled documents that are not held out.

    The sample is a range of a hash of doc_id, sized by the number of labels; of each text `chars`
    characters teach, of a longer one as PIECES pieces drawn from equal parts of the whole text.  A document with several labels counts with the smallest one.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min(label).alias("label"))
    n = own.count()
    space = 1 << 30
    ticket = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(29)), F.lit(space))
    chosen = own.where(ticket < min(space, -(-space * rows // max(1, n)))).select(F.col("doc_id").alias("id"), "label", ticket.alias("ticket"))
    texts = docs.where("text is not null").where(~held_out("doc_id")).select("doc_id", "text")
    # About `rows` rows.
    return texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["id"]).select("ticket", "id", pieces(F.col("text"), F.col("id"), chars).alias("text"), "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int) -> list[tuple[bytes, int]]:
    """(text, label) of the rows of `sample_frame`, in a fixed order."""
    got = sample_frame(docs, labels, label, rows, chars).collect()
    return [(r["text"].encode(), int(r["label"])) for r in sorted(got, key=lambda r: (r["ticket"], str(r["id"]), r["text"]))]
