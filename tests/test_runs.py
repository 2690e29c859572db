"""Runs beside each other, reruns, and readers that take complete runs only."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from gridseries.sources.runs import Run, complete_run, read_parts


def written(spark, out, run_id, n, finish=True):
    run = Run(spark, out, run_id)
    got = run.write(spark.range(n).withColumn("var", F.concat(F.lit("v"), F.col("id") % 2)), "rows", ("var",))
    run.report(spark.range(3), "summary", single=True)
    if finish:
        run.finish(val_days=3, cutoff={"mode": "x"})
    return got


def test_runs_do_not_replace_each_other(spark, tmp_path):
    out = str(tmp_path / "out")
    assert written(spark, out, "a", 10).count() == 10
    assert written(spark, out, "b", 4).count() == 4
    assert spark.read.parquet(f"{out}/rows").count() == 14
    written(spark, out, "a", 6)  # again, with fewer rows
    assert {r[0]: r[1] for r in spark.read.parquet(f"{out}/rows").groupBy("run_id").count().collect()} == {"a": 6, "b": 4}
    chosen, parts = read_parts(spark, out, ["rows"])
    assert chosen == "a" and parts["rows"].count() == 6 and set(parts["rows"].columns) == {"id", "var"}
    assert read_parts(spark, out, ["rows"], "b")[1]["rows"].count() == 4
    assert {r["run_id"]: r["val_days"] for r in spark.read.json(f"{out}/metadata").collect()} == {"a": 3, "b": 3}


def test_unfinished_runs_are_not_read(spark, tmp_path):
    out = str(tmp_path / "out")
    written(spark, out, "a", 10)
    written(spark, out, "b", 4, finish=False)
    assert complete_run(spark, out)[0] == "a"
    with pytest.raises(ValueError, match="no complete run b"):
        read_parts(spark, out, ["rows"], "b")
    Run(spark, out, "a")  # a rerun that stops at once
    with pytest.raises(ValueError, match="no complete run"):
        complete_run(spark, out)


def test_lost_files_and_absent_parts_are_errors(spark, tmp_path):
    out = str(tmp_path / "out")
    written(spark, out, "a", 10)
    with pytest.raises(ValueError, match="no part"):
        read_parts(spark, out, ["other"])
    os.remove(glob.glob(f"{out}/rows/run_id=a/var=v0/*.parquet")[0])
    with pytest.raises(ValueError, match="the run wrote 10"):
        read_parts(spark, out, ["rows"])


def test_a_rerun_without_rows_does_not_keep_old_ones(spark, tmp_path):
    out = str(tmp_path / "out")
    written(spark, out, "a", 10)
    with pytest.raises(ValueError, match="earlier run"):
        written(spark, out, "a", 0)
    assert written(spark, out, "c", 0).count() == 0
