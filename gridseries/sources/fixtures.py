"""Time-series frames derived from the tables `events`, `lineitem`, `part` and `orders`.

`events` becomes one wide 15-minute table for each of four sites; its sparse columns stand for prices
and loads.  All frames grow with the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.functions.calendar import floor_time
from gridseries.operators import clean, index, lookups
from gridseries.sources.shared import checkpointed, shared_folder
from gridseries.sources.tables import read_table

KEYS = ["site"]
#: Event types and the column that each one stands for.
TYPES = {"click": "rt", "view": "da", "purchase": "load", "signup": "pv", "error": "line"}
COLUMNS = [*TYPES.values(), "ru", "rd"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share, for what is written and read back; a temporary one in a local session."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, event_type, event_id, user_id, ts, value, slot)."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 4).alias("site"), "event_type", "event_id", "user_id", "ts", "value", floor_time(F.col("ts")).alias("slot"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, event_type, slot, value): the last observation of each slot."""
    o = observations(spark, sf_dir).drop("user_id")
    return clean.keep_last(o, ["site", "event_type"], "slot", ["ts", "event_id"]).select("site", "event_type", "slot", "value")


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, slot, value): the last observation of each user's slots; the number of series grows with the table."""
    o = observations(spark, sf_dir).select("user_id", "slot", "ts", "event_id", "value")
    return clean.keep_last(o, ["user_id"], "slot", ["ts", "event_id"]).select("user_id", "slot", "value")


def wide15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, slot, rt, da, load, pv, line, ru, rd) on the full grid of each site; nulls are genuine."""
    s = slots(spark, sf_dir).groupBy("site", "slot").pivot("event_type", list(TYPES)).agg(F.first("value"))
    s = s.select("site", "slot", *[F.col(k).alias(v) for k, v in TYPES.items()])
    n = observations(spark, sf_dir).groupBy("site", "slot").agg(F.count("*").cast("double").alias("ru"), F.countDistinct("user_id").cast("double").alias("rd"))
    return clean.on_grid(s.join(n, ["site", "slot"]), KEYS, "slot").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("ru", "rd")})


def dense15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.fill_forward(wide15(spark, sf_dir), KEYS, "slot", COLUMNS)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision index of `wide15`, before the cut-off, split into 5 val and 6 test days."""
    return _split(wide15(spark, sf_dir))


def _split(w: DataFrame) -> DataFrame:
    cut = index.cutoff(w, KEYS, "slot", list(TYPES.values()))
    return index.split_by_day(index.before_cutoff(index.decision_index(w, KEYS, "slot"), cut, KEYS), KEYS, 5, 6)


def forecasts(spark: SparkSession, sf_dir: str, c: str = "load") -> DataFrame:
    """(site, t_dec, split, h, tgt_time, y, base) of one variable, base being the value a day before."""
    return _forecasts(decisions(spark, sf_dir), dense15(spark, sf_dir), c)


def _forecasts(idx: DataFrame, dense: DataFrame, c: str) -> DataFrame:
    rows = lookups.future_values(idx.select("site", "t_dec", "split"), dense, KEYS, "slot", c)
    return lookups.target_lag(rows, dense, KEYS, "slot", c)


class Stored:
    """The frames of the four sites, stored: for queries that use them many times."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.wide = checkpointed(wide15(spark, sf_dir))
        self.dense = checkpointed(clean.fill_forward(self.wide, KEYS, "slot", COLUMNS))
        self.index = checkpointed(_split(self.wide))

    def forecasts(self, c: str = "load") -> DataFrame:
        return _forecasts(self.index, self.dense, c)


def price_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, ts, actual, forecast): extended prices and quantity times retail price."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    j = li.join(p, li["l_partkey"] == p["p_partkey"])
    return j.select(F.col("p_brand").alias("grp"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.col("l_extendedprice").cast("double").alias("actual"), (F.col("l_quantity") * F.col("p_retailprice")).cast("double").alias("forecast"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, price): orders as a series with absent days."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").cast("double").alias("price"))


#: The same frames in DuckDB's SQL, as common table expressions.
SQL = """
WITH ev AS (SELECT user_id % 4 AS site, event_type, event_id, user_id, ts, value, time_bucket(INTERVAL '15 minutes', ts) AS slot FROM events),
sl AS (SELECT site, event_type, slot, value FROM (SELECT *, row_number() OVER (PARTITION BY site, event_type, slot ORDER BY ts DESC, event_id DESC) AS k FROM ev) WHERE k = 1),
us AS (SELECT user_id, slot, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY ts DESC, event_id DESC) AS k FROM ev) WHERE k = 1),
gr AS (SELECT site, unnest(generate_series(a, b, INTERVAL '15 minutes')) AS slot FROM (SELECT site, min(slot) AS a, max(slot) AS b FROM ev GROUP BY site)),
pv0 AS (SELECT site, slot, max(value) FILTER (event_type = 'click') AS rt, max(value) FILTER (event_type = 'view') AS da, max(value) FILTER (event_type = 'purchase') AS load,
        max(value) FILTER (event_type = 'signup') AS pv, max(value) FILTER (event_type = 'error') AS line FROM sl GROUP BY site, slot),
cn AS (SELECT site, slot, CAST(count(*) AS DOUBLE) AS ru, CAST(count(DISTINCT user_id) AS DOUBLE) AS rd FROM ev GROUP BY site, slot),
wide AS (SELECT site, slot, rt, da, load, pv, line, coalesce(ru, 0.0) AS ru, coalesce(rd, 0.0) AS rd FROM gr LEFT JOIN pv0 USING (site, slot) LEFT JOIN cn USING (site, slot)),
dense AS (SELECT site, slot, last_value(rt IGNORE NULLS) OVER w AS rt, last_value(da IGNORE NULLS) OVER w AS da, last_value(load IGNORE NULLS) OVER w AS load,
          last_value(pv IGNORE NULLS) OVER w AS pv, last_value(line IGNORE NULLS) OVER w AS line, ru, rd FROM wide WINDOW w AS (PARTITION BY site ORDER BY slot)),
idx0 AS (SELECT site, slot AS t_dec, slot + INTERVAL 6 HOUR AS tgt_max_time, CAST(slot + INTERVAL 6 HOUR AS DATE) AS date_tgt_max
         FROM (SELECT site, slot, row_number() OVER (PARTITION BY site ORDER BY slot) AS rn, count(*) OVER (PARTITION BY site) AS n FROM wide) WHERE rn >= 192 AND rn <= n - 24),
cut AS (SELECT site, least(max(slot) FILTER (rt IS NOT NULL), max(slot) FILTER (da IS NOT NULL), max(slot) FILTER (load IS NOT NULL), max(slot) FILTER (pv IS NOT NULL), max(slot) FILTER (line IS NOT NULL)) AS cutoff FROM wide GROUP BY site),
idx1 AS (SELECT idx0.* FROM idx0 JOIN cut USING (site) WHERE tgt_max_time <= cutoff),
dd AS (SELECT site, date_tgt_max, row_number() OVER (PARTITION BY site ORDER BY date_tgt_max DESC) AS k FROM idx1 GROUP BY site, date_tgt_max HAVING count(*) = 96),
idx AS (SELECT idx1.*, CASE WHEN k <= 6 THEN 'test' WHEN k <= 11 THEN 'val' ELSE 'train' END AS split FROM idx1 JOIN dd USING (site, date_tgt_max)),
hz AS (SELECT site, t_dec, split, h, t_dec + h * INTERVAL 15 MINUTE AS tgt_time FROM (SELECT *, unnest(range(1, 25)) AS h FROM idx)),
fc AS (SELECT hz.site AS site, hz.t_dec AS t_dec, hz.split AS split, CAST(hz.h AS INTEGER) AS h, hz.tgt_time AS tgt_time, d.load AS y, p.load AS base FROM hz LEFT JOIN dense d ON d.site = hz.site AND d.slot = hz.tgt_time
       LEFT JOIN dense p ON p.site = hz.site AND p.slot = hz.tgt_time - INTERVAL 1 DAY),
pp AS (SELECT p_brand AS grp, CAST(l_shipdate AS TIMESTAMP) AS ts, CAST(l_extendedprice AS DOUBLE) AS actual, CAST(l_quantity * p_retailprice AS DOUBLE) AS forecast FROM lineitem JOIN part ON l_partkey = p_partkey),
od AS (SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_totalprice AS DOUBLE) AS price FROM orders)
"""
