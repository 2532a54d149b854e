"""Readers: the driver tables, and the domain relations as adapter views on them.

An adapter is a list of SQL expressions that mean the same in Spark and in the oracle's dialect, so a query and
its twin start from equal rows. Timestamps stay without a zone from end to end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Observations: one report a row, key (station, obs_time, event_id).
OBS = [
    "user_id AS station", "ts AS obs_time", "event_id", "value",
    "CASE WHEN event_type = 'error' THEN 'SPECI' ELSE 'METAR' END AS report_type",
    "event_type = 'purchase' AS corrected",
    "CAST(floor(value * 7) AS BIGINT) % 360 AS wind_dir",
    "CAST(floor(value) AS BIGINT) % 40 AS wind_speed",
    "CASE WHEN event_type = 'click' THEN CAST(floor(value) AS BIGINT) % 40 + 10 END AS gust",
    "CASE WHEN event_id % 3 <> 0 THEN (CAST(floor(value * 13) AS BIGINT) % 60) * 100 END AS ceiling_ft",
    "CASE WHEN event_id % 11 <> 0 THEN (CAST(floor(value * 17) AS BIGINT) % 100) * 100 END AS vis_m",
    "CASE event_type WHEN 'click' THEN 'RA' WHEN 'error' THEN 'TSRA' WHEN 'purchase' THEN 'FG BR' WHEN 'signup' THEN 'FZRA' END AS weather",
    "CAST(floor(value * 3) AS BIGINT) % 45 - 10 AS temp_c",
    "2950 + event_id % 100 AS altimeter",
]
#: The forecast cube: tall rows of a model's run, valid time, place, variable, member and value.
CUBE = [
    "l_suppkey AS loc_id", "o_orderdate AS run", "l_shipdate AS valid_time", "l_returnflag AS model", "l_linestatus AS variable",
    "l_linenumber AS member", "l_quantity AS value", "l_extendedprice AS price", "l_orderkey",
]
#: Forecast documents: issue and validity per station; the priority tells routine bulletins from amendments.
TAFS = [
    "o_orderkey AS taf_id", "o_custkey AS station", "o_orderdate AS issue",
    "CASE WHEN o_orderpriority LIKE '1%' THEN 'AMD' WHEN o_orderpriority LIKE '2%' THEN 'COR' ELSE 'TAF' END AS kind",
    "o_totalprice AS value", "o_orderstatus AS status",
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*OBS)


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return lines.join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*CUBE)


def tafs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*TAFS)


OBS_SQL = f"obs AS (SELECT {', '.join(OBS)} FROM events)"
CUBE_SQL = f"cube_ AS (SELECT {', '.join(CUBE)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
TAFS_SQL = f"tafs AS (SELECT {', '.join(TAFS)} FROM orders)"
