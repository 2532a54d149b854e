"""Half-open intervals: building, clipping, hourly bins, islands and merges. Overlaps are equi joins on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wxspark.operators.asof import micros


def hour_of(ts: str | Column) -> Column:
    """The hour a time lies in, still without a zone."""
    return F.date_trunc("hour", F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


def intervalise(frame: DataFrame, by: list[str], ts: str, hold: str = "90 minutes", order: list[str] | None = None) -> DataFrame:
    """A state from each report to the next one or for `hold`, and a gap row where the next one is later than that."""
    nxt = F.lead(ts).over(W.partitionBy(*by).orderBy(ts, *(order or [])))
    held = F.col(ts) + F.expr(f"interval {hold}")
    cut = frame.withColumn("_next", nxt).withColumn("_held", held)
    state = F.struct(F.col(ts).alias("start"), F.when(F.col("_next") < F.col("_held"), F.col("_next")).otherwise(F.col("_held")).alias("end"), F.lit(False).alias("is_gap"))
    gap = F.struct(F.col("_held").alias("start"), F.col("_next").alias("end"), F.lit(True).alias("is_gap"))
    rows = cut.withColumn("_x", F.explode(F.when(F.col("_next") > F.col("_held"), F.array(state, gap)).otherwise(F.array(state))))
    return rows.select(*frame.columns, "_x.*").where("start < end")


def in_hours(frame: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """A row for each hour that [start, end) touches, with the seconds of it that lie in the hour."""
    last = hour_of(F.col(end) - F.expr("interval 1 microsecond"))
    hours = frame.withColumn("hour", F.explode(F.sequence(hour_of(start), last, F.expr("interval 1 hour"))))
    lo, hi = F.greatest(F.col(start), F.col("hour")), F.least(F.col(end), F.col("hour") + F.expr("interval 1 hour"))
    return hours.withColumn("seconds", (micros(hi) - micros(lo)) / 1e6)


def overlap_join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Pairs whose [start, end) overlap: both sides meet in the hour where the later of the two starts."""
    l = in_hours(left).select(*by, "hour", *(F.col(c).alias(f"l_{c}") for c in left.columns if c not in by))
    r = in_hours(right).select(*by, "hour", *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in by))
    lo = F.greatest("l_start", "r_start")
    return l.join(r, [*by, "hour"]).where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("hour") == hour_of(lo))).drop("hour").withColumn("start", lo).withColumn("end", F.least("l_end", "r_end"))


def unmet(left: DataFrame, right: DataFrame, by: list[str], tolerance: int, bin_size: int) -> DataFrame:
    """Rows of left whose closed [start, end] no right one of the key comes within `tolerance` of; times are whole numbers.

    Both sides are dealt to bins of `bin_size`, left ones widened by the tolerance, and meet in an equi join.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / bin_size), F.floor(hi / bin_size)))
    key = [*by, "start", "end"]
    l = left.select(*key).distinct().withColumn("_bin", bins(F.col("start") - tolerance, F.col("end") + tolerance))
    r = right.select(*by, F.col("start").alias("_s"), F.col("end").alias("_e")).withColumn("_bin", bins(F.col("_s"), F.col("_e")))
    met = l.join(r, [*by, "_bin"]).where((F.col("_s") <= F.col("end") + tolerance) & (F.col("_e") >= F.col("start") - tolerance)).select(*key).distinct()
    return left.join(met, key, "left_anti")


def islands(frame: DataFrame, by: list[str], order: list[str], flag: str) -> DataFrame:
    """Runs of consecutive rows whose flag is true: numbered within the key; other rows go."""
    w = W.partitionBy(*by).orderBy(*order)
    broken = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return frame.withColumn("island", broken).where(F.col(flag))


def collapse(frame: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """Run-length collapse: the run number of rows whose state equals their predecessor's (null equals null)."""
    w = W.partitionBy(*by).orderBy(*order)
    changed = ~F.col(state).eqNullSafe(F.lag(state).over(w)) | (F.row_number().over(w) == 1)
    return frame.withColumn("run_no", F.sum(changed.cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))


def merge_spans(frame: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or adjacent spans of a key joined into one."""
    w = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col(start) <= reach, 0).otherwise(1)
    numbered = frame.withColumn("_fresh", fresh).withColumn("_no", F.sum("_fresh").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy(*by, "_no").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_spans")).drop("_no")
