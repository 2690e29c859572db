"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.session import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger, or the smaller ones and itself) are tied to the smallest of all."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    if large:
        tied = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        tied = both.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        tied = tied.unionByName(least.select("u", F.col("least").alias("v")))
    return tied.where("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one larger end only or is the centre of a star."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    by = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not by.where("out > 1 or (out > 0 and into > 0)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of `links` (a, b): the smallest node that can be reached.

    Rounds go on until all edges are stars around their smallest node; each round is checkpointed.
    Null ends and links of a node with itself count for nothing; a node without links is not in the
    result.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(edges):
        edges = checkpointed(_star(_star(edges, True), False))
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` after more `links` (a, b), between any nodes."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    new = components(ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")))
    new = new.select(F.col("node").alias("old"), F.col("label").alias("new"))
    moved = labels.join(new, labels["label"] == new["old"], "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = new.join(labels.select("node"), new["old"] == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    return checkpointed(moved.unionByName(fresh))
