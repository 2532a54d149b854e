"""What changes afterwards: late reports and the truth they touch, versions of scores, ascents that are published in stages (ST05, ST08, ST10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wxspark.operators.intervals import hour_of

# --- late reports ----------------------------------------------------------------------------

#: Minutes that a report's state is held for, and the hours before an hour in which its reports may lie.
HOLD_MIN = 90
BACK_HOURS = -(-HOLD_MIN // 60)


def touched_hours(late: DataFrame, by: list[str], ts: str = "obs_time") -> DataFrame:
    """ST05: the hours whose truth a late report can change: those that [its time, 90 minutes later) meets.

    A report cuts the state before it short and holds its own; the state before it began earlier, so neither reaches farther.
    """
    last = F.col(ts) + F.expr(f"interval {HOLD_MIN} minutes") - F.expr("interval 1 microsecond")
    return late.where(F.col(ts).isNotNull()).select(*by, F.explode(F.sequence(hour_of(ts), hour_of(last), F.expr("interval 1 hour"))).alias("hour")).distinct()


def refresh(stored: DataFrame, reports: DataFrame, late: DataFrame, by: list[str], view: Callable[[DataFrame], DataFrame], ts: str = "obs_time") -> DataFrame:
    """ST05: stored (by, hour and what `view` makes of reports) after late reports came in, equal to the view of all reports.

    Only touched hours are made anew, of the reports of these hours and the two before; all other rows stay as they are.
    reports holds the late ones too.
    """
    touched = touched_hours(late, by, ts)
    needed = touched.select(*by, F.explode(F.array(*(F.col("hour") - F.expr(f"interval {k} hours") for k in range(BACK_HOURS + 1)))).alias("_h")).distinct()
    near = reports.withColumn("_h", hour_of(ts)).join(needed, [*by, "_h"], "left_semi").drop("_h")
    anew = view(near).join(touched, [*by, "hour"], "left_semi")
    return stored.join(touched, [*by, "hour"], "left_anti").unionByName(anew)


# --- versions of scores ----------------------------------------------------------------------

SCORE = ["evaluation", "scorer", "subject"]


def due(evaluations: DataFrame, results: DataFrame, targets: DataFrame, subjects: list[str], before: Column) -> DataFrame:
    """ST08: elapsed evaluations to be scored: pending ones, and finished ones that lack a target (scorer, scorer_version) for a subject.

    evaluations: evaluation, status, valid_to; a human subject may be missing for good, so it makes nothing due.
    """
    elapsed = evaluations.where(F.col("valid_to") <= before)
    wanted = targets.withColumn("subject", F.explode(F.array(*(F.lit(s) for s in subjects if s != "human"))))
    n = wanted.count()
    have = results.join(F.broadcast(wanted), ["scorer", "scorer_version", "subject"], "left_semi").select(*SCORE).distinct().groupBy("evaluation").agg(F.count("*").alias("_n"))
    joined = elapsed.join(have, "evaluation", "left")
    return joined.where((F.col("status") == "pending") | (F.col("status").isin("scored", "partial") & (F.coalesce("_n", F.lit(0)) < n))).drop("_n")


def append_versions(stored: DataFrame, scored: DataFrame) -> DataFrame:
    """ST08: stored and the scores that say something new, as its next versions; nothing that is stored changes.

    A score is new if its (scorer_version, policy_hash, truth_hash) isn't that of any stored version of its evaluation, scorer and subject. Scoring
    again on the same truth adds nothing, however often.
    """
    inputs = ["scorer_version", "policy_hash", "truth_hash"]
    same = F.lit(True)
    for c in [*SCORE, *inputs]:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}"))
    fresh = scored.dropDuplicates([*SCORE, *inputs]).alias("n").join(stored.select(*SCORE, *inputs).alias("s"), same, "left_anti")
    newest = stored.groupBy(*SCORE).agg(F.max("version").alias("_before"))
    number = F.row_number().over(W.partitionBy(*SCORE).orderBy(*inputs))
    rows = fresh.join(newest, SCORE, "left").withColumn("version", (F.coalesce("_before", F.lit(0)) + number).cast("int"))
    return stored.unionByName(rows.select(*stored.columns))


def newest_complete(stored: DataFrame) -> DataFrame:
    """ST08: of each evaluation, scorer and subject the newest version that is complete; one that is partial hides none."""
    best = F.max(F.struct("version", *(c for c in stored.columns if c not in [*SCORE, "version"]))).alias("m")
    return stored.where("complete").groupBy(*SCORE).agg(best).select(*SCORE, "m.*")


# --- ascents published in stages -------------------------------------------------------------

#: An ascent that reaches this pressure is complete; hours after which what there is counts as final.
COMPLETE_HPA, FINAL_H = 95.0, 4


def final_ascents(sightings: DataFrame, as_of: Column | None = None) -> DataFrame:
    """ST10, F16: one final sighting of each ascent (site, launched), and why; ascents that are still open have none.

    sightings: site, launched, seen_at, top_hpa, digest. The first complete sighting within four hours of the launch is
    final at once. Without one, the last sighting within them is final when they end; without any within them, the first later
    one is. as_of: the clock, for ascents whose four hours haven't ended; None: they all have.
    """
    age = F.unix_micros(F.col("seen_at").cast("timestamp")) - F.unix_micros(F.col("launched").cast("timestamp"))
    early, whole = age < FINAL_H * 3_600_000_000, F.coalesce(F.col("top_hpa") <= COMPLETE_HPA, F.lit(False))
    row = F.struct("seen_at", "digest", "top_hpa")
    picked = sightings.groupBy("site", "launched").agg(
        F.min(F.when(early & whole, row)).alias("complete"), F.max(F.when(early, row)).alias("staged"), F.min(F.when(~early, row)).alias("late")
    )
    over = F.lit(True) if as_of is None else as_of >= F.col("launched") + F.expr(f"interval {FINAL_H} hours")
    choice = F.when(F.col("complete").isNotNull(), F.struct(F.lit("complete").alias("why"), F.col("complete").alias("x"))).when(F.col("staged").isNotNull() & over, F.struct(F.lit("four hours old").alias("why"), F.col("staged").alias("x")))
    choice = choice.when(F.col("staged").isNull() & F.col("late").isNotNull(), F.struct(F.lit("seen late").alias("why"), F.col("late").alias("x")))
    return picked.withColumn("c", choice).where("c is not null").select("site", "launched", "c.why", "c.x.seen_at", "c.x.digest", "c.x.top_hpa")
