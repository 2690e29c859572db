"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold one conversation many times, each time a turn longer.  A rolling hash over the
turns gives the hash of each prefix; a conversation whose whole hash is a proper prefix of another
one is a snapshot and goes, as do repeated copies but the one with the smallest conv_id.  The
maximal conversations are rendered to one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _esc(c):
    """The text with control markers broken up, so that no text can open or close a turn."""
    return F.regexp_replace(F.regexp_replace(c, r"<\|im_start\|>", "<|im_start |>"), r"<\|im_end\|>", "<|im_end |>")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the ordered turns of each conversation.

    `turns` has conv_id, turn, role, text.  Rows without conv_id go.  Repeated rows count once; turns
    are ordered by (turn, role, text), null first; a null role is "unknown", a null text empty.  Other
    columns are not in the result; an empty table gives no rows.  A conversation is one training record
    and has to fit a row.
    """
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # collect_set drops repeats in the map tasks already, so a flood of copies of a turn never meets in one task.
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))


def prefixes(convs: DataFrame) -> DataFrame:
    """(conv_id, at, n, prefix): of each conversation of n turns the hash of its first `at` turns, at from 1 to n.

    The hash rolls: each turn's own hash, of its place, role and text, is added to that of the turns before it
    (twice 56 bits, and the number of turns).
    """
    said = lambda t, i: F.concat_ws("\x1f", i.cast("string"), F.length(t["role"]).cast("string"), t["role"], t["text"])
    one = convs.select("conv_id", F.size("turns").alias("n"), F.posexplode(F.transform("turns", lambda t, i: F.sha2(said(t, i), 256))).alias("at", "hash"))
    # The aggregation left the rows of a conversation in one place, so this window shuffles nothing.
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = [F.sum(F.conv(F.substring("hash", first, 14), 16, 10).cast("decimal(38,0)")).over(before).cast("string") for first in (1, 15)]
    return one.select("conv_id", (F.col("at") + 1).alias("at"), "n", F.concat_ws("/", *rolled, (F.col("at") + 1).cast("string")).alias("prefix"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, n_turns, n_copies): the maximal conversations.

    Of conversations with the same turns the smallest conv_id stays and n_copies counts them.  The
    prefixes of all conversations are made distinct before they meet, so a first turn that many
    conversations share is one row.
    """
    convs = conversations(turns)
    rolled = prefixes(convs)
    whole = rolled.where("at = n").groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = rolled.where("at < n").select("prefix").distinct()
    maximal = whole.join(inner, "prefix", "left_anti")
    return convs.join(maximal.drop("prefix"), "conv_id").select("conv_id", "turns", F.size("turns").cast("long").alias("n_turns"), "n_copies")


def render(maximal: DataFrame) -> DataFrame:
    """`collapse`'s rows with the column `rendered`: each turn between start and end markers."""
    line = lambda t: F.concat(F.lit(START), _esc(t["role"]), F.lit("\n"), _esc(t["text"]), F.lit(END))
    return maximal.withColumn("rendered", F.array_join(F.transform("turns", line), "\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """The maximal conversations of `turns`, rendered: `collapse`, then `render`, whose docstrings say what nulls, ties and repeats give.

    An empty table gives no rows; one conversation has to fit a row.
    """
    return render(collapse(turns))


def op9(spark, sf_dir: str) -> DataFrame:
    got = format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return got.select("conv_id", "n_turns", "n_copies", F.sha2("rendered", 256).alias("rendered_sha256"))


OP9_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, list(sha256(length(role) || '/' || role || '/' || text) ORDER BY i) AS h,
        string_agg('{START}' || replace(replace(role, '{START}', '<|im_start |>'), '{END}', '<|im_end |>') || chr(10)
          || replace(replace(text, '{START}', '<|im_start |>'), '{END}', '<|im_end |>') || '{END}', chr(10) ORDER BY i) AS rendered
      FROM r GROUP BY conv_id),
k AS (SELECT array_to_string(h, '') AS whole, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY 1),
p AS (SELECT DISTINCT array_to_string(h[1:n], '') AS whole FROM (SELECT h, unnest(range(1, len(h))) AS n FROM c))
SELECT c.conv_id, c.n_turns, k.n_copies, sha256(c.rendered) AS rendered_sha256
FROM k JOIN c USING (conv_id) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.whole = k.whole)
"""
