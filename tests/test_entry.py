"""The driver contract, and jobs end to end."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_query_but_models_has_sql():
    own = {q for q in entry.queries() if not q.startswith("op") and q != "pipeline"}
    assert own - set(entry.oracle_sql()) == {"md5_segment_trees"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1


@needs_data
@pytest.mark.parametrize("name", ["cl3_keep_last", "au10_missing_blocks", "ix6_split_by_day", "jo3_as_of_daily", "fc3_lag_residual", "me1_pair_report"])
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    for t in ("events", "lineitem", "part", "orders"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    show = lambda v: str(v)[:19]
    got = sorted(tuple(show(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(show(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())


@needs_data
def test_jobs(spark, tmp_path):
    from gridseries.plans import jobs
    from gridseries.sources import fixtures, tables

    tables.write_parquet(fixtures.dense15(spark, SF).withColumnRenamed("slot", "datetime"), str(tmp_path / "in"))
    jobs.audit_job(spark, str(tmp_path / "in"), str(tmp_path / "audit"), ["site"])
    jobs.forecast_job(spark, str(tmp_path / "in"), str(tmp_path / "fc"), ["site"], ("load", "pv"))
    assert spark.read.json(str(tmp_path / "audit/time_axis")).count() == 4
    assert spark.read.option("header", True).csv(str(tmp_path / "fc/summary")).count() == 8
    assert {r["var"] for r in spark.read.parquet(str(tmp_path / "fc/long")).select("var").distinct().collect()} == {"load", "pv"}


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """A table under the headers of users' tables: two regular series, prices that follow the day, and own forecasts."""
    from pyspark.sql import functions as F

    days, path = 18, str(tmp_path_factory.mktemp("source") / "in")
    t = F.col("id") % (96 * days)
    wave = F.sin(t / 96 * 6.2832)
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000
    site = F.floor(F.col("id") / (96 * days)).alias("site")
    rows = spark.range(2 * 96 * days).select(
        site,
        F.timestamp_add("MINUTE", (15 * t).cast("int"), F.lit("2024-03-01").cast("timestamp_ntz")).alias("时间"),
        (50 + 10 * wave + noise(1)).alias("实时出清电价"),
        (48 + 11 * wave + noise(2)).alias("日前出清电价"),
        (900 + 100 * wave + 5 * noise(3)).alias("系统负荷实际值"),
        F.greatest(F.lit(0.0), 300 * -wave + 5 * noise(4)).alias("光伏实际值"),
        (70 + 9 * wave + noise(5)).alias("联络线实际值"),
        (20 + 2 * wave + noise(6)).alias("上旋备用实际值"),
        (25 - 2 * wave + noise(7)).alias("下旋备用实际值"),
        (905 + 100 * wave).alias("系统负荷预测值"),
        (47 + 11 * wave).alias("日前电价预测值"),
    )
    rows.write.parquet(path)
    return path


def csv(spark, path):
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def test_exogenous_and_real_time_jobs(spark, source, tmp_path):
    from gridseries.plans import jobs

    exog, out = str(tmp_path / "exog"), str(tmp_path / "rt")
    jobs.exogenous_job(spark, source, exog, ["site"], methods="load=lag1d_residual,pv=pv_day_residual,line=direct", run_id="r1")
    by = {(r["tag"], r["split"], r["var"]): r["all_mae"] for r in csv(spark, f"{exog}/summary").collect()}
    assert {k[2] for k in by} == {"load", "pv", "line", "ru", "rd"} and {k for k in by if k[0] == "source"} == {("source", "val", "load"), ("source", "test", "load")}
    assert all(by["model", "test", v] < 3 * by["lag1d", "test", v] for v in ("load", "line", "ru", "rd"))
    long = spark.read.parquet(f"{exog}/long")
    assert dict(long.select("var", "method").distinct().collect()) == {"load": "lag1d_residual", "pv": "pv_day_residual", "line": "direct", "ru": "prior_residual", "rd": "prior_residual"}
    wide = spark.read.parquet(f"{exog}/wide")
    assert wide.count() == spark.read.parquet(f"{exog}/index").count() and {"load_h01", "rd_h24", "model_version"} <= set(wide.columns)
    meta = spark.read.json(f"{exog}/metadata").first()
    assert meta["run_id"] == "r1" and meta["headers"]["load"] == "系统负荷实际值" and meta["first_days"]["test"] > meta["first_days"]["val"]

    jobs.real_time_job(spark, source, exog, out, ["site"])
    by = {(r["tag"], r["split"]): r["all_mae"] for r in csv(spark, f"{out}/summary").collect()}
    assert set(by) == {(t, s) for t in ("model", "lag1d") for s in ("val", "test")} and by["model", "test"] < 3 * by["lag1d", "test"]
    got = csv(spark, f"{out}/as_of").collect()
    assert len(got) == 2 * 24 and all(30 < r["rt_pred"] < 70 for r in got)
    assert spark.read.parquet(f"{out}/samples").where("base_ratio < 1").count() == 0


def test_jobs_on_csv_with_times_as_users_write_them(spark, tmp_path):
    from gridseries.plans import jobs
    from gridseries.sources.runs import read_parts

    first, step = __import__("datetime").datetime(2024, 1, 1), __import__("datetime").timedelta(minutes=15)
    lines = [f"{t.year}/{t.month}/{t.day} {t.hour}:{t.minute:02d},{100 + i % 96},{i % 7}.5" for i, t in ((i, first + i * step) for i in range(96 * 16))]
    lines += ["2024/99/99 0:15,1,1", "not a time,1,1", "2024/1/3 0:15,0x10,1d", "2024/1/3 0:30,1,2,3,4"]
    (tmp_path / "in.csv").write_text("\n".join(["时间,load,pv", *lines]) + "\n")
    source, out = str(tmp_path / "in.csv"), str(tmp_path / "out")
    jobs.audit_job(spark, source, out, format="csv", days=3)
    axis = spark.read.json(f"{out}/time_axis").first()
    assert (axis["n_rows"], axis["n_parsed"], axis["n_slots"], axis["n_missing"], axis["n_rejected"], axis["rejected_first"], axis["rejected_last"]) == (96 * 16 + 4, 96 * 16 + 2, 96 * 16, 0, 2, "2024/99/99 0:15", "not a time")
    malformed = spark.read.json(f"{out}/malformed").first()
    assert malformed["n_malformed"] == 1 and malformed["first"] == "2024/1/3 0:30,1,2,3,4"
    series = {r["slot"]: (r["load"], r["pv"]) for r in read_parts(spark, out, ["series"])[1]["series"].collect()}
    assert series[first + (2 * 96 + 1) * step] == (None, None)  # neither hexadecimal digits nor a letter behind make a number
    assert spark.read.json(f"{out}/metadata").first()["time_column"] == "时间"

    clean = [x for x in lines if x.count(",") == 2 and "0x" not in x]
    (tmp_path / "clean.csv").write_text("\n".join(["时间,load,pv", *clean]) + "\n")
    fc = str(tmp_path / "fc")
    jobs.forecast_job(spark, str(tmp_path / "clean.csv"), fc, variables=("load", "pv"), val_days=2, test_days=2, format="csv", days=3)
    by = {(r["tag"], r["split"], r["var"]): r["all_mae"] for r in csv(spark, f"{fc}/summary").collect()}
    assert by["lag1d_residual", "test", "load"] == 0 and by["lag1d", "test", "pv"] > 0
    ranges = {r["split"]: r["days"] for r in spark.read.json(f"{fc}/split_ranges").collect()}
    assert ranges["val"] == ranges["test"] == 2

    (tmp_path / "lost.csv").write_text("时间,load\n" + "soon,1\n" * 3)
    with pytest.raises(ValueError, match="3 texts of 时间 are none, as 'soon'"):
        jobs.audit_job(spark, str(tmp_path / "lost.csv"), str(tmp_path / "lost"), format="csv")


def test_jobs_refuse_what_they_cannot_do(spark, source, tmp_path):
    from gridseries.plans import jobs

    for methods in ("load=magic", "load=pv_day_residual"):
        with pytest.raises(ValueError):
            jobs.exogenous_job(spark, source, str(tmp_path / "x"), ["site"], methods=methods)
    from pyspark.sql import functions as F

    spark.read.parquet(source).withColumn("光伏实际值", F.lit(None).cast("double")).write.parquet(str(tmp_path / "empty"))
    spark.read.parquet(source).drop("光伏实际值").write.parquet(str(tmp_path / "lacks"))
    with pytest.raises(ValueError, match="pv"):
        jobs.exogenous_job(spark, str(tmp_path / "lacks"), str(tmp_path / "y"), ["site"])
    with pytest.raises(ValueError, match="no usable"):
        jobs.exogenous_job(spark, str(tmp_path / "empty"), str(tmp_path / "z"), ["site"])


def test_day_ahead_and_forecast_jobs_on_headers(spark, source, tmp_path):
    from gridseries.plans import jobs

    out = str(tmp_path / "da")
    jobs.day_ahead_job(spark, source, out, ["site"], 3, 3, maxIter=2, maxDepth=2)
    features = spark.read.parquet(f"{out}/features").columns
    assert {"x_load", "x_pv", "x_line", "x_ru", "x_rd"} <= set(features)
    assert {r["model"] for r in csv(spark, f"{out}/comparison").collect()} == {"da_fcst", "model on da_fcst"}
    assert set(spark.read.parquet(f"{out}/overview").columns) == {"site", "slot", "split", "y", "y_hat", "da_fcst", "run_id"}
    bare = spark.read.parquet(source).withColumnsRenamed({"系统负荷实际值": "load", "光伏实际值": "pv", "联络线实际值": "line"})
    bare.write.parquet(str(tmp_path / "bare"))
    jobs.forecast_job(spark, str(tmp_path / "bare"), str(tmp_path / "fc"), ["site"])
    assert csv(spark, str(tmp_path / "fc/summary")).count() == 2 * 2 * 3
    jobs.accuracy_job(spark, source, str(tmp_path / "acc"), recent_days=2)
    assert spark.read.parquet(str(tmp_path / "acc/recent")).count() == 2 * (2 * 96 + 1)
    got = csv(spark, str(tmp_path / "acc/accuracy")).collect()
    assert [(r["variable"], r["actual_col"], r["forecast_col"]) for r in got] == [("系统负荷", "系统负荷实际值", "系统负荷预测值")]


def test_a_missing_dependency_is_told(tmp_path):
    """Where the text operators are absent or can't be imported the rest works, and what they lack is not hidden."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    bare = tmp_path / "bare"
    bare.mkdir()
    for name in ("gridseries", "__spark_entry__.py", "corpus_pipeline.py"):
        src = os.path.join(root, name)
        if os.path.isdir(src):
            shutil.copytree(src, bare / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(src):
            shutil.copy(src, bare / name)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=bare, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    got = run()
    assert got.returncode == 0 and got.stdout.split()[1] == "False", got.stderr
    (bare / "corpus_pipeline.py").write_text("import no_such_library")
    (bare / "gridseries/llm").mkdir()
    (bare / "gridseries/llm/queries.py").write_text("")
    got = run()
    assert got.returncode == 0 and got.stdout.split()[1] == "False" and "no_such_library" in got.stderr
