"""What one run of a job writes: parts that other runs don't touch, and a manifest that is written last.

Each part is a folder with one partition `run_id=...` a run, replaced as a whole by dynamic partition overwrite:
a rerun replaces its own rows only, and never a part by half, as Spark moves files into place when all
tasks are done.  A run says in the manifest that it writes before it begins and that it is complete when it ends,
with the rows of every part; a reader takes complete runs only and checks those numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridseries.sources import tables

MANIFEST = "manifest"
_FIELDS = "state string, written timestamp, parts map<string,bigint>"


class Run:
    """A run that writes below `out`."""

    def __init__(self, spark: SparkSession, out: str, run_id: str = "run"):
        self.spark, self.out, self.run_id, self.parts = spark, out, run_id, {}
        self._say("writing")

    def _say(self, state: str) -> None:
        rows = self.spark.createDataFrame([(self.run_id, state, self.parts)], "run_id string, state string, parts map<string,bigint>")
        self._save(rows.withColumn("written", F.current_timestamp()).select("run_id", "state", "written", "parts"), MANIFEST, "json")

    def _save(self, df: DataFrame, name: str, format: str, partition_by: tuple[str, ...] = ()) -> None:
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", *partition_by)
        (writer.option("header", True) if format == "csv" else writer).format(format).save(f"{self.out}/{name}")

    def write(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """`df`, written as Parquet once and read by all that comes after.

        Overwriting by partition leaves what was there where there are no rows now, which is an error.
        """
        written = Observation()
        counted = df.observe(written, F.count(F.lit(1)).alias("n"))
        self._save(counted.withColumn("run_id", F.lit(self.run_id)), name, "parquet", partition_by)
        whole = self.spark.read.schema(df.withColumn("run_id", F.lit(self.run_id)).schema).parquet(f"{self.out}/{name}")
        got = whole.where(F.col("run_id") == self.run_id).drop("run_id")
        self.parts[name] = got.count()  # of the files' footers
        if self.parts[name] != written.get["n"]:
            raise ValueError(f"part {name} of run {self.run_id} has {self.parts[name]} rows, {written.get['n']} were written: it holds rows of an earlier run of that name")
        return got

    def report(self, df: DataFrame, name: str, format: str = "csv", single: bool = False) -> None:
        """A report; `single` for true summaries, which are one file."""
        marked = df.withColumn("run_id", F.lit(self.run_id))
        self._save(marked.coalesce(1) if single else marked, name, format)

    def finish(self, **metadata) -> None:
        """Writes what the run was made with, and then the manifest."""
        if metadata:
            one = self.spark.range(1).select(*tables.report(run_id=self.run_id, **metadata))
            self._save(one.coalesce(1), "metadata", "json")
        self._say("complete")


def complete_run(spark: SparkSession, out: str, run_id: str | None = None) -> tuple[str, dict[str, int]]:
    """(run_id, rows of each part) of a complete run: the one asked for, or the last one."""
    runs = spark.read.schema(f"{_FIELDS}, run_id string").json(f"{out}/{MANIFEST}").where("state = 'complete'")
    runs = runs.where(F.col("run_id") == run_id) if run_id is not None else runs
    last = runs.orderBy(F.desc("written")).limit(1).collect()
    if not last:
        raise ValueError(f"{out} has no complete run{f' {run_id}' if run_id is not None else ''}")
    return last[0]["run_id"], last[0]["parts"]


def read_parts(spark: SparkSession, out: str, names: list[str], run_id: str | None = None) -> tuple[str, dict[str, DataFrame]]:
    """The parts of one complete run; an error if a part is absent or doesn't have the rows that the run wrote."""
    chosen, rows = complete_run(spark, out, run_id)
    if absent := sorted(set(names) - set(rows)):
        raise ValueError(f"run {chosen} of {out} has no part {absent}")
    parts = {n: spark.read.option("basePath", f"{out}/{n}").parquet(f"{out}/{n}/run_id={chosen}").drop("run_id") for n in names}
    for n, part in parts.items():
        if (there := part.count()) != rows[n]:
            raise ValueError(f"part {n} of run {chosen} has {there} rows, the run wrote {rows[n]}")
    return chosen, parts
