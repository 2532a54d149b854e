"""As-of and nearest joins in time, without a cross join: one sort of the tagged union per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without a zone; differences are exact."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _tagged(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str) -> DataFrame:
    l = left.select(*by, F.col(left_ts).alias("_t"), F.lit(0).alias("_tag"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*right.columns)).schema[0].dataType).alias("_r"))
    r = right.select(*by, F.col(right_ts).alias("_t"), F.lit(1).alias("_tag"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*right.columns).alias("_r"))
    return l.unionByName(r)


def backward(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, strict: bool = True, within_s: float | None = None, prefix: str = "r_", ties: list[str] | None = None) -> DataFrame:
    """Each left row with the last right row before it (at or before it if not strict), at most within_s old.

    Right rows at one time are ordered by `ties`, last wins. Keys and times that are null match nothing.
    """
    order = [F.col("_t"), F.col("_tag") if strict else F.col("_tag").desc(), *(F.col(f"_r.{c}") for c in ties or [])]
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = _tagged(left, right, by, left_ts, right_ts).withColumn("_hit", F.last("_r", ignorenulls=True).over(w)).where("_tag = 0")
    known = F.col(f"_hit.{right_ts}").isNotNull() & F.col("_t").isNotNull()
    for c in by:
        known = known & F.col(f"_l.{c}").isNotNull()
    if within_s is not None:
        known = known & (micros("_t") - micros(F.col(f"_hit.{right_ts}")) <= int(within_s * 1e6))
    return found.select("_l.*", *(F.when(known, F.col(f"_hit.{c}")).alias(prefix + c) for c in right.columns if c not in by))


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, within_s: float, prefix: str = "r_", ties: list[str] | None = None) -> DataFrame:
    """Each left row with the right row nearest in time, at most within_s away; of two as near the later wins."""
    more = [F.col(f"_r.{c}") for c in ties or []]
    # equal times count as later, so both directions see them through the forward window
    before = W.partitionBy(*by).orderBy(F.col("_t"), F.col("_tag"), *more).rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy(*by).orderBy(F.col("_t").desc(), F.col("_tag").desc(), *(c.desc() for c in more)).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = _tagged(left, right, by, left_ts, right_ts).withColumn("_b", F.last("_r", ignorenulls=True).over(before)).withColumn("_a", F.last("_r", ignorenulls=True).over(after)).where("_tag = 0")
    back, ahead = micros("_t") - micros(F.col(f"_b.{right_ts}")), micros(F.col(f"_a.{right_ts}")) - micros("_t")
    pick = F.when(ahead.isNotNull() & (back.isNull() | (ahead <= back)), F.col("_a")).otherwise(F.col("_b"))
    gap = F.least(F.coalesce(back, ahead), F.coalesce(ahead, back))
    ok = gap <= int(within_s * 1e6)
    return both.withColumn("_p", pick).select("_l.*", *(F.when(ok, F.col(f"_p.{c}")).alias(prefix + c) for c in right.columns if c not in by))


def latest_at_key(frame: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by `order`, as a pre-aggregated max of structs: no sort, no window."""
    rest = [c for c in frame.columns if c not in by]
    return frame.groupBy(*by).agg(F.max(F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), *rest)).alias("_m")).select(*by, *(F.col(f"_m.{c}").alias(c) for c in rest))
