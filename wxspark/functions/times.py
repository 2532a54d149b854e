"""Grids of valid times, as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def time_grid(anchor: Column, hours: int | Column, step_h: Column) -> Column:
    """From the anchor's hour on, every step up to `hours` later; a last step that isn't whole is left out."""
    start = F.date_trunc("hour", anchor).cast("timestamp_ntz")
    count = F.floor((F.lit(hours) if isinstance(hours, int) else hours) / step_h)
    return F.transform(F.sequence(F.lit(0), count.cast("int")), lambda k: start + _hours(k * step_h.cast("int")))


def snapped_grid(anchor: Column, hours: int, step_h: Column) -> Column:
    """A grid on multiples of the step from 00 UTC, begun at or before the anchor, and long enough to reach `hours` beyond it: the span is rounded up to a whole step."""
    over = F.hour(anchor) % step_h
    start = F.date_trunc("hour", anchor).cast("timestamp_ntz") - _hours(over)
    return time_grid(start, (F.ceil((F.lit(hours) + over) / step_h) * step_h), step_h)


def run_grid(run: Column, hours: int, step_h: Column, native_h: Column) -> Column:
    """A run's own ladder, from the run to `hours` later, at the step asked for or the model's own if that is coarser."""
    return time_grid(run, hours, F.greatest(step_h, F.coalesce(native_h, step_h)))


def ladder_percentile(rungs: list[tuple[float, Column]], percent: float) -> Column:
    """The value at which a ladder of (threshold, percent at or below) reaches `percent`, between the two rungs about it; null above the last one.

    Rungs that aren't known are skipped, and the ladder begins at (0, 0).
    """
    known = F.filter(F.array(*(F.struct(F.lit(float(t)).alias("t"), p.cast("double").alias("p")) for t, p in rungs)), lambda r: r["p"].isNotNull())
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("p"), F.lit(None).cast("double").alias("at"))

    def step(s: Column, r: Column) -> Column:
        span = r["p"] - s["p"]
        at = s["t"] + F.when(span <= 0, 0.0).otherwise((percent - s["p"]) / span) * (r["t"] - s["t"])
        return F.struct(r["t"].alias("t"), r["p"].alias("p"), F.coalesce(s["at"], F.when(r["p"] >= percent, at)).alias("at"))

    return F.aggregate(known, start, step, lambda s: s["at"])
