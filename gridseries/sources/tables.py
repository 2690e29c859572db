"""Reading the input table and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None) -> DataFrame:
    """A wide table from Parquet, ORC, CSV with a header, or JSON lines.  CSV and JSON need a schema to be typed."""
    reader = spark.read.schema(schema) if schema else spark.read
    if format == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(format).load(path)


#: The column of `read_marked` that has the lines that aren't as the header says.
MALFORMED = "_malformed"


def read_marked(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """CSV with a header, or JSON lines, and a column MALFORMED with each line that isn't as the others; what it gives is kept.

    Columns of CSV are texts.
    """
    seen = read_table(spark, path, format)
    schema = T.StructType([*(f for f in seen.schema.fields if not f.name.startswith("_corrupt")), T.StructField(MALFORMED, T.StringType())])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED)
    return (reader.option("header", True).option("enforceSchema", False) if format == "csv" else reader).format(format).load(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_forecasts(long: DataFrame, path: str) -> None:
    """One folder for each variable."""
    write_parquet(long, path, ["var"])


def write_report_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """A report with a header, in one file; not `single` where its rows grow with the series or days."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_report_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def report(**parts) -> list:
    """Columns of a one-row report; dicts become structs."""
    as_column = lambda v: F.struct(*[as_column(x).alias(k) for k, x in v.items()]) if isinstance(v, dict) else v if hasattr(v, "alias") else F.lit(v)
    return [as_column(v).alias(k) for k, v in parts.items()]
