"""Wall time and shuffled bytes of the four workloads over $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line each."""

from __future__ import annotations

import glob
import json
import os
import tempfile
import time


def shuffled(log: str, begin: float) -> int:
    """Bytes that tasks which ended since `begin` wrote for shuffles, of the event log."""
    total = 0
    for path in glob.glob(f"{log}/**/*", recursive=True):
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as file:
                for line in file:
                    if '"SparkListenerTaskEnd"' in line:
                        e = json.loads(line)
                        if e["Task Info"]["Finish Time"] / 1000 >= begin:
                            total += (e.get("Task Metrics") or {}).get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
    return total


def main() -> None:
    from pyspark.sql import SparkSession

    cpus, sf_dir = os.environ.get("BENCH_CPUS", "4"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    scratch = tempfile.mkdtemp(prefix="spark-")
    log = f"{scratch}/events"
    os.makedirs(log)
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.local.dir": scratch, "spark.checkpoint.dir": f"{scratch}/checkpoints",
        "spark.driver.memory": "8g", "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log}", "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false", "spark.eventLog.buffer.kb": "1k",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from gridseries.plans import jobs, queries_audit
    from gridseries.sources import fixtures

    w = fixtures.dense15(spark, sf_dir)
    source = f"{scratch}/in"
    w.withColumnRenamed("slot", "时间").withColumnsRenamed(queries_audit.HEADERS).dropna().write.parquet(source)
    rows = spark.read.parquet(source).count()
    runs = {
        "W1 audit": lambda: jobs.audit_job(spark, source, f"{scratch}/w1", ["site"]),
        "W2 day ahead": lambda: jobs.day_ahead_job(spark, source, f"{scratch}/w2", ["site"], 5, 5, maxIter=10, maxDepth=4),
        "W3 exogenous": lambda: jobs.exogenous_job(spark, source, f"{scratch}/w3", ["site"]),
        "W4 real time": lambda: jobs.real_time_job(spark, source, f"{scratch}/w3", f"{scratch}/w4", ["site"], drop_invalid=False),
    }
    for name, run in runs.items():
        began, wall = time.time(), time.perf_counter()
        run()
        wall = time.perf_counter() - wall
        time.sleep(1)  # the log is written behind
        print(json.dumps({"workload": name, "rows": rows, "seconds": round(wall, 1), "shuffle_mb": round(shuffled(log, began) / 1e6, 1), "cpus": cpus, "sf": os.path.basename(sf_dir.rstrip("/"))}, ensure_ascii=False), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
