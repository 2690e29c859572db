"""Exact quantiles of groups of any size.

A group's values are counted, value by value.  Where a group has few distinct values, Spark's `percentile`
over (value, count) gives its quantile.  In a larger one the values around the wanted rank are found by
refinement: pivots from a sketch deal the values into buckets, the buckets' counts say in which one the
rank is, and that bucket is dealt again, until few values are left.  Counts are exact, so the sketch
decides only how fast it goes.  No buffer holds more than `few` distinct values or the sketch's own bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.operators import keyed
from gridseries.sources.shared import checkpointed

#: Distinct values of a group that one buffer may hold.
FEW = 100_000
#: Pivots of a round, and the accuracy of the sketch that they come from.
PIVOTS, ACCURACY = 63, 1000
#: Groups that are refined by a broadcast of their state; more are joined.
BROADCAST_GROUPS = 10_000


def quantiles(df: DataFrame, by: list[str], c: Column, q: float, name: str, weight: Column | None = None, few: int = FEW, accuracy: int | None = None) -> DataFrame:
    """(by, name, n): the quantile `q` of the values of `c` that aren't null, and how many there are.

    Between two ranks it is interpolated.  A value counts `weight` times, an integer of at least 1, once
    without it.  `by` may be empty; null keys are a group.  NaN is the largest value.  With `accuracy` the
    quantile is a value of a sketch whose rank is wrong by n / accuracy at most, in one pass; that has no weights.
    """
    if accuracy:
        if weight is not None:
            raise ValueError("an approximate quantile has no weights")
        return df.where(c.isNotNull()).groupBy(*by).agg(F.percentile_approx(c.cast("double"), q, accuracy).alias(name), F.count("*").alias("n"))
    times = F.sum(weight) if weight is not None else F.count("*")
    counted = df.where(c.isNotNull()).groupBy(*by, c.cast("double").alias("_v")).agg(times.alias("_f"))
    counted = checkpointed(counted)
    sizes = counted.groupBy(*by).agg(F.sum("_f").alias("n"), F.count("*").alias("_d"))
    large = checkpointed(sizes.where(F.col("_d") > few))
    how_many = large.count()
    if not how_many:
        return _direct(counted, by, q, name)
    small = _but(counted, large, by, how_many)
    refined = _refined(counted, large, by, q, name, few, how_many)
    return _direct(small, by, q, name).unionByName(refined)


def _direct(counted: DataFrame, by: list[str], q: float, name: str) -> DataFrame:
    got = counted.groupBy(*by).agg(F.percentile("_v", q, F.col("_f")).alias(name), F.sum("_f").alias("n"))
    return got if by else got.where("n is not null")  # without keys an empty table has a row


def _shared(state: DataFrame, how_many: int) -> DataFrame:
    return F.broadcast(state) if how_many <= BROADCAST_GROUPS else state


def _but(counted: DataFrame, large: DataFrame, by: list[str], how_many: int) -> DataFrame:
    keys = large.select(*by) if by else large.select(F.lit(1))
    return keyed.join(counted, _shared(keys, how_many), by, how="left_anti")


def _refined(counted: DataFrame, large: DataFrame, by: list[str], q: float, name: str, few: int, how_many: int) -> DataFrame:
    """The quantiles of `large` groups.  A group's state is the range of values that still holds both of its ranks, and the count below it."""
    rank = (F.col("n") - 1) * q
    inf = float("inf")
    state = large.select(*by, "n", F.floor(rank).alias("_i"), F.ceil(rank).alias("_j"), F.lit(-inf).alias("_a"), F.lit(float("nan")).alias("_b"), F.lit(0).cast("long").alias("_below"), F.col("_d"))
    done = None
    while True:
        inside = _inside(counted, state, by, how_many)
        pivots = inside.groupBy(*by).agg(F.percentile_approx("_v", [(k + 1) / (PIVOTS + 1) for k in range(PIVOTS)], ACCURACY).alias("_p"))
        dealt = _inside(counted, keyed.join(state, pivots, by), by, how_many)
        bucket = F.size(F.filter("_p", lambda p: p <= F.col("_v")))
        counts = dealt.groupBy(*by, bucket.alias("_k")).agg(F.sum("_f").alias("_f"), F.count("*").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.col("_below") + F.sum("_f").over(Window.partitionBy(*by).orderBy("_k"))  # a bucket a pivot
        placed = keyed.join(counts.withColumnRenamed("_d", "_e"), state, by).withColumn("_upto", upto)
        first, last = F.col("_i") < F.col("_upto"), F.col("_j") < F.col("_upto")
        low = F.min_by(F.struct(F.col("_k"), "_lo", "_hi", (F.col("_upto") - F.col("_f")).alias("_before"), "_e"), F.when(first, F.col("_k")))
        high = F.min_by(F.struct(F.col("_k"), "_lo", "_hi"), F.when(last, F.col("_k")))
        found = placed.groupBy(*by, "n", "_i", "_j").agg(low.alias("_low"), high.alias("_high"))
        # Ranks in two buckets are the end of one and the beginning of the other.
        apart = F.col("_low._k") != F.col("_high._k")
        settled = apart | (F.col("_low._e") == 1)
        found = checkpointed(found.withColumns({"_settled": settled, "_x": F.when(apart, F.col("_low._hi")).otherwise(F.col("_low._lo")), "_y": F.col("_high._lo")}))
        ready = found.where("_settled").select(*by, "n", "_i", "_j", "_x", "_y")
        done = ready if done is None else done.unionByName(ready)
        state = found.where("not _settled").select(*by, "n", "_i", "_j", F.col("_low._lo").alias("_a"), F.col("_low._hi").alias("_b"), F.col("_low._before").alias("_below"), F.col("_low._e").alias("_d"))
        largest = state.agg(F.max("_d")).first()[0]
        if largest is None or largest <= few:
            break
    # What is left is few values a group: their running counts say which ones have the ranks.
    rest = _inside(counted, state, by, how_many)
    upto = F.col("_below") + F.sum("_f").over(Window.partitionBy(*by).orderBy("_v"))
    rest = rest.withColumn("_upto", upto).groupBy(*by, "n", "_i", "_j").agg(F.min(F.when(F.col("_i") < F.col("_upto"), F.col("_v"))).alias("_x"), F.min(F.when(F.col("_j") < F.col("_upto"), F.col("_v"))).alias("_y"))
    x, y = F.col("_x"), F.col("_y")
    between = F.when(x == y, x).otherwise((F.col("_j") - rank) * x + (rank - F.col("_i")) * y)
    return done.unionByName(rest).select(*by, between.alias(name), "n")


def _inside(counted: DataFrame, state: DataFrame, by: list[str], how_many: int) -> DataFrame:
    """The values in the range of their group's state, with that state."""
    return keyed.join(counted, _shared(state, how_many), by, (F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_b")))
