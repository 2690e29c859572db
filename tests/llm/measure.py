"""Figures of the README that no SQL gives: `python tests/llm/measure.py [SF_DIR]`, on documents that taught nothing.

Prints language accuracy, quality AUC and verdicts, toxicity recall and clean documents marked, lines
dropped and how many planted-like recurring lines that is, and the largest miss of a source's target.
"""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def auc(rows):
    """Of (score, label) pairs: the share of pairs of a 1 and a 0 in order; ties count half."""
    rows, at, ranks, ones = sorted(rows), 0, 0.0, sum(y for _, y in rows)
    while at < len(rows):
        to = at
        while to < len(rows) and rows[to][0] == rows[at][0]:
            to += 1
        ranks += sum(y for _, y in rows[at:to]) * (at + 1 + to) / 2
        at = to
    return (ranks - ones * (ones + 1) / 2) / max(1, ones * (len(rows) - ones))


def main(sf_dir):
    scratch = tempfile.mkdtemp(prefix="spark-")
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.local.dir": scratch, "spark.checkpoint.dir": f"{scratch}/checkpoints", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = entry.queries()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")

    got = queries["op1_language_id"](spark, sf_dir).where("held_out").join(docs.select("doc_id", "lang").where("lang is not null"), "doc_id")
    n, right, rejected, kept_right = got.agg(F.count("*"), F.count_if(F.col("lang_pred") == F.col("lang")), F.count_if("rejected"), F.count_if((F.col("lang_pred") == F.col("lang")) & ~F.col("rejected"))).first()
    print(f"op1: {right} of {n} held-out documents right ({right / n:.3f}); {rejected} rejected, {kept_right} of the others right")

    held = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    rows = queries["op5_quality_rules"](spark, sf_dir).join(held.where("quality is not null"), "doc_id").select("probability", "quality", "base_failed", "kept").collect()
    judged = [r for r in rows if not r["base_failed"]]
    print(f"op5: AUC {auc([(r['probability'], r['quality']) for r in rows]):.4f} over {len(rows)} held-out documents; {sum(r['kept'] == bool(r['quality']) for r in judged)} of {len(judged)} that pass the fixed rules judged as labelled")

    rows = queries["op6_toxicity"](spark, sf_dir).join(held.where("toxic is not null"), "doc_id").select("score", "predicted", "toxic").collect()
    toxic = [r for r in rows if r["toxic"]]
    marked = sum(r["predicted"] for r in rows if not r["toxic"])
    print(f"op6: recall {sum(r['predicted'] for r in toxic)} of {len(toxic)} ({sum(r['predicted'] for r in toxic) / max(1, len(toxic)):.3f}), {marked} of {len(rows) - len(toxic)} clean ones marked, AUC {auc([(r['score'], r['toxic']) for r in rows]):.4f}")

    lines, dropped, some = queries["op7_line_dedup"](spark, sf_dir).agg(F.sum("n_lines"), F.sum("n_dropped"), F.count_if(F.col("n_dropped") > 0)).first()
    print(f"op7: {dropped} of {lines} lines dropped, from {some} documents")

    words, removed = queries["op2_substring_dedup"](spark, sf_dir).agg(F.sum("n_words"), F.sum("n_removed")).first()
    print(f"op2: {removed} of {words} words removed")

    by = queries["op10_mix_sources"](spark, sf_dir).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    print(f"op10: largest miss {max(abs(r['taken'] - r['target']) / r['target'] for r in by if r['target']):.4%} of a target, over {len(by)} sources")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
