"""Structured Streaming forms of the cron jobs: idempotent polls, hourly counts, late corrections (ST01-ST06)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wxspark.operators import writes


def idempotent(stream: DataFrame, ts: str, *parts: str, late: str = "1 day") -> DataFrame:
    """ST01: one row a content id; ids are remembered as long as late rows may come."""
    return stream.withColumn("id", writes.content_id(*parts)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["id"])


def hourly(stream: DataFrame, ts: str, by: list[str], late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """ST02-ST04: counts by tumbling window, final once the grace period is over."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), *by).agg(F.count("*").alias("n"))


BUCKETS = 64


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table that `upsert_sink` keeps: of each bucket the newest version, before an epoch if one is given; None if there is none."""
    try:
        t = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    t = t if before is None else t.where(F.col("wx_version") < before)
    newest = t.groupBy("wx_bucket").agg(F.max("wx_version").alias("wx_version"))  # BUCKETS rows at most
    return t.join(F.broadcast(newest), ["wx_bucket", "wx_version"], "left_semi")


def upsert_sink(path: str, keys: list[str], corrected: str, arrival: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """ST06: a foreachBatch sink that keeps first reports and lets corrections replace them.

    Rows lie in buckets of their keys. A batch reads and writes the buckets of its own keys alone, as path/wx_version=<epoch>/wx_bucket=<n>; a batch
    that is run again writes the same version again. Read the table with `current`.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        new = batch.withColumn("wx_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        stored = current(batch.sparkSession, path, epoch)
        stored = new.limit(0) if stored is None else stored.join(F.broadcast(new.select("wx_bucket").distinct()), "wx_bucket", "left_semi").select(*new.columns)
        writes.correct(stored, new, [*keys, "wx_bucket"], corrected, arrival).write.mode("overwrite").partitionBy("wx_bucket").parquet(f"{path}/wx_version={epoch}")

    return sink
