"""Every registered query of the library's own operators, with its SQL.

A query is (function, SQL after the fixtures' common table expressions).  Doubles are rounded to four
places on both sides, as sums run in different orders; before that a small offset takes means of
cents off the exact halves, where the last bit of a sum would decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.plans import queries_audit, queries_features, queries_forecast, queries_metrics
from gridseries.sources.fixtures import SQL

OFFSET = 0.0000003
FLAGSHIP = "flagship_daily_coverage"


def _rounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*[(F.round(F.col(f"`{c}`") + OFFSET, 4) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])

    return run


def _sql(text: str) -> str:
    """`text` after the fixtures, with the columns named after `-- round:` rounded."""
    body, _, doubles = text.partition("-- round:")
    replace = ", ".join(f"round({c} + {OFFSET}, 4) + 0.0 AS {c}" for c in doubles.split())
    return f"{SQL}, res AS ({body.strip()}) SELECT *{f' REPLACE ({replace})' if replace else ''} FROM res"


_ALL: dict[str, tuple] = {}
for module in (queries_audit, queries_metrics, queries_features, queries_forecast):
    _ALL |= module.QUERIES

QUERIES = {name: _rounded(q) for name, (q, _) in _ALL.items()}
ORACLE_SQL = {name: _sql(text) for name, (_, text) in _ALL.items() if text}
