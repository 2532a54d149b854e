"""Hourly truth out of irregular reports: a conservative and a predominant view of every hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.operators import intervals

MIN_MINUTES = 30


def state_hours(obs: DataFrame, by: list[str], order: list[str], hold: str = "90 minutes") -> DataFrame:
    """Reports as states held until the next one, spread over the hours they touch."""
    return intervals.in_hours(intervals.intervalise(obs, by, "obs_time", hold, order).where("not is_gap"))


def conservative(hours: DataFrame, by: list[str]) -> DataFrame:
    """Worst ceiling and visibility, lowest altimeter, strongest wind (the earliest of equals), all weather.

    A ceiling is unlimited only if it is in every state; a visibility that is missing in every state is unknown.
    """
    wind = F.struct(F.col("wind_speed").alias("s"), (-F.unix_micros(F.col("start").cast("timestamp"))).alias("t"), (-F.col("event_id")).alias("e"), F.col("wind_dir").alias("d"))
    return hours.groupBy(*by, "hour").agg(
        F.min("ceiling_ft").alias("cons_ceiling"), F.bool_and(F.col("ceiling_ft").isNull()).alias("cons_unlimited"),
        F.min("vis_m").alias("cons_vis"), F.min("altimeter").alias("cons_altimeter"), F.max("gust").alias("cons_gust"),
        F.max(wind).alias("w"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("weather", " "))))), " ").alias("cons_weather"),
        F.round(F.sum("seconds") * 1e6).cast("long").alias("held_us"),
    ).withColumn("cons_speed", F.col("w.s")).withColumn("cons_dir", F.col("w.d")).drop("w")


def predominant(hours: DataFrame, by: list[str], field: str, least_minutes: float = MIN_MINUTES) -> DataFrame:
    """The value with most minutes in the hour, if at least half; ties go to the value seen first. Others are temporary."""
    per = hours.groupBy(*by, "hour", field).agg(F.sum("seconds").alias("sec"), F.min(F.struct("start", "event_id")).alias("seen"))
    # the most seconds first, then the earliest: the smallest of (-seconds, first seen)
    best = per.groupBy(*by, "hour").agg(F.min(F.struct((-F.col("sec")).alias("k"), "seen", F.col(field).alias("v"))).alias("b"), F.count("*").alias("n_values"))
    enough = -F.col("b.k") >= least_minutes * 60
    return best.select(*by, "hour", F.when(enough, F.col("b.v")).alias(f"pred_{field}"), enough.alias("pred_available"), (F.col("n_values") - enough.cast("long")).alias("n_temporary"))


def predominant_states(hours: DataFrame, by: list[str], least_minutes: float = MIN_MINUTES) -> DataFrame:
    """A28 for every field at once: by, hour and p_ fields: the value with most minutes of those the hour's states know, if it has half an hour.

    A ceiling that isn't there is unlimited, so p_ceiling_known tells an unlimited one from one without a predominant value; weather that
    isn't there is none.
    """
    text = lambda c: F.col(c).cast("string")
    sorted_weather = F.array_join(F.array_sort(F.split(F.coalesce("weather", F.lit("")), " ")), " ")
    values = {"ceiling_ft": F.coalesce(text("ceiling_ft"), F.lit("unlimited")), "weather": sorted_weather} | {c: text(c) for c in ("vis_m", "altimeter", "wind_speed", "wind_dir", "gust")}
    tall = hours.select(*by, "hour", "seconds", "start", "event_id", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), v.alias("value")) for c, v in values.items()))).alias("x")).where("x.value is not null")
    per = tall.groupBy(*by, "hour", "x.field", "x.value").agg(F.sum("seconds").alias("sec"), F.min(F.struct("start", "event_id")).alias("seen"))
    best = per.groupBy(*by, "hour").agg(*(F.min(F.when(F.col("field") == c, F.struct((-F.col("sec")).alias("k"), "seen", "value"))).alias(c) for c in values))
    held = lambda c: F.when(-F.col(f"{c}.k") >= least_minutes * 60, F.col(f"{c}.value"))
    whole = lambda c: F.expr("try_cast({} as bigint)".format(f"if(-`{c}`.k >= {least_minutes * 60}, `{c}`.value, null)"))
    return best.select(*by, "hour", held("ceiling_ft").isNotNull().alias("p_ceiling_known"), held("weather").alias("p_weather"), *(whole(c).alias(f"p_{c}") for c in values if c != "weather"))
