"""Write policies as set operations: what a table holds after a batch is written. Files are the caller's choice."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _first_by(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in frame.columns if c not in keys]
    picked = frame.groupBy(*keys).agg(F.min(F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), *rest)).alias("_m"))
    return picked.select(*(c if c in keys else F.col(f"_m.{c}").alias(c) for c in frame.columns))


def keep_first(stored: DataFrame, batch: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """SK01, SK03: rows already stored stay; of a batch's equal keys the first to arrive enters."""
    fresh = batch.join(stored.select(*keys).distinct(), keys, "left_anti")
    return stored.unionByName(_first_by(fresh, keys, [F.col(arrival)]), allowMissingColumns=True)


def correct(stored: DataFrame, batch: DataFrame, keys: list[str], corrected: str, arrival: str) -> DataFrame:
    """SK02: a correction replaces what isn't one; a stored correction is never replaced; else the first stays."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    best = _first_by(both, keys, [(~F.coalesce(F.col(corrected), F.lit(False))).cast("int"), F.col("_new"), F.col(arrival)])
    return best.drop("_new")


def replace(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """SK04: rows of the batch's keys are replaced by the batch."""
    return stored.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch, allowMissingColumns=True)


def append_new(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """SK07: rows whose id is stored already add nothing, whatever they hold; ids that repeat in the batch count once."""
    fresh = batch.join(stored.select(key), key, "left_anti").select(*batch.columns)
    return stored.unionByName(_first_by(fresh, [key], [F.col(key)]))


def copy_slice(source: DataFrame | None, places: DataFrame, at: list[str], run: str, cutoff: Column) -> DataFrame | None:
    """SK10: the source's rows at places (their columns `at`), with runs up to the cutoff; a source that isn't there (`archive`) gives none."""
    return None if source is None else source.where(F.col(run) <= cutoff).join(places.select(*at).distinct(), at, "left_semi").select(*source.columns)


def archive(spark: SparkSession, path: str) -> DataFrame | None:
    """SC02: another archive, read beside this one by its own path; None if it isn't there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def append_slice(stored: DataFrame, taken: DataFrame | None, keys: list[str]) -> DataFrame:
    """SK09-SK11: stored and the rows of a slice whose keys it doesn't have; what is stored stays."""
    return stored if taken is None else stored.unionByName(taken.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys).select(*stored.columns))


def content_id(*parts: str | Column, length: int = 12) -> Column:
    """SK07, X42: the first digits of the SHA-256 of the parts joined by a bar; a null part is empty."""
    text = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *text).cast("binary"), 256), 1, length)


def rebuild_partitions(batch: DataFrame, path: str, by: list[str]) -> None:
    """SK05: the batch's partitions are dropped and written anew, others stay."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
