"""The four rules of the latest run; each consumer names its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest_per(frame: DataFrame, by: list[str], order: str, tie: list[str]) -> DataFrame:
    """One row a key, the newest by order; ties by the smallest of `tie`."""
    w = W.partitionBy(*by).orderBy(F.desc(order), *tie)
    return frame.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")


def newest_rows_per(frame: DataFrame, by: list[str], order: str) -> DataFrame:
    """All rows of a key's newest run; the maximum is pre-aggregated and joined back."""
    top = frame.groupBy(*by).agg(F.max(order).alias("_top"))
    return frame.join(top, by).where(F.col(order) == F.col("_top")).drop("_top")


def newest_k(frame: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """Rows of a key's k newest runs, with the run's rank."""
    return frame.withColumn("run_rank", F.dense_rank().over(W.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("run_rank") <= k)
