"""What operators need of the Spark session."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, written to the cluster's shared checkpoint folder and read back: its lineage ends here.

    The folder is the session's spark.checkpoint.dir.  Where that is unset a local session makes a
    temporary one; on a cluster that is an error, as executors would write to disks of their own.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    # New aliases: a checkpoint keeps the attributes of its plan, which confuses cogroups with their origin.
    return df.checkpoint().select(*[F.col(f"`{c}`").alias(c) for c in df.columns])


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text", "lang", "source", "n_chars")))
