"""The folder that all executors share, for what is written once and read again."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder in a local session without it, an error on a cluster."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
    folder = folder or tempfile.mkdtemp(prefix="checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder and read back: what is made of it several times is computed once."""
    shared_folder(df.sparkSession)
    # New aliases: a checkpoint keeps the attributes of its plan, which joins with their origin confuse.
    return df.checkpoint().select(*[F.col(f"`{c}`").alias(c) for c in df.columns])
