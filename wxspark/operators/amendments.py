"""When a forecast document should have been amended: six rules by hour, episodes, triggers, and hours without amendment service.

Times are whole microseconds and hours are their 3.6e9th parts, both from one origin, so that edges are exact. Documents are
(doc, station, vf, vt): validity [vf, vt). A rule's failures are rows (doc, rule, hour, reason).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wxspark.functions.weather import altimeter_band, apart, flight_category, weather_classes
from wxspark.operators import asof, intervals

MINUTE, HOUR = 60_000_000, 3_600_000_000
#: Knots by which speed and gust may differ, degrees by which direction may, from which strength on it counts.
SPEED_KT, GUST_KT, TURN_DEG, STRONG_KT = 10, 10, 30, 15
#: Minutes by which thunderstorms and changes may be late or early, and for which an early change has to last.
STORM_MIN, CHANGE_MIN, PERSIST_MIN = 30, 30, 30
STATE = ("wind_dir", "wind_speed", "gust", "vis_m", "ceiling_ft", "weather")


def hour_of(t: Column) -> Column:
    return F.floor(t / F.lit(HOUR)).cast("long")


# --- which reports a document is held against ------------------------------------------------


def reports_of(docs: DataFrame, reports: DataFrame) -> DataFrame:
    """A document's reports: the last one at or before its validity, those within, and the first one at or after its end.

    reports: station, at, id and fields. Reports within meet the document by station and hour; the two at the edges are as-of joins.
    """
    fields = [c for c in reports.columns if c != "station"]
    hours = docs.withColumn("_h", F.explode(F.sequence(hour_of(F.col("vf")), hour_of(F.col("vt") - 1))))
    inside = hours.join(reports.withColumn("_h", hour_of(F.col("at"))), ["station", "_h"]).where((F.col("vf") <= F.col("at")) & (F.col("at") < F.col("vt")))
    before = asof.backward(docs, reports, ["station"], "vf", "at", strict=False, ties=["id"]).where("r_at < vf")
    back = reports.withColumn("_t", -F.col("at")).withColumn("_i", -F.col("id"))
    after = asof.backward(docs.withColumn("_e", -F.col("vt")), back, ["station"], "_e", "_t", strict=False, ties=["_i"]).where("r_at is not null")
    named = lambda df: df.select(*docs.columns, *(F.col(f"r_{c}").alias(c) for c in fields))
    return inside.select(*docs.columns, *fields).unionByName(named(before)).unionByName(named(after))


# --- what agrees with what -------------------------------------------------------------------


def classes(weather: Column) -> Column:
    """The classes of a state's weather, an array."""
    return F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(weather, F.lit("")), " "), weather_classes)))


def wind_out(f: str, o: str) -> Column:
    """Speed, gust (a missing one is the other side's mean speed) or, where strong wind is expected, direction is out of tolerance."""
    c = lambda side, name: F.col(f"{side}{name}")
    fg, og, fm, om = c(f, "gust"), c(o, "gust"), c(f, "wind_speed"), c(o, "wind_speed")
    gust = F.when(fg.isNotNull() & og.isNotNull(), F.abs(fg - og) > GUST_KT).when(fg.isNotNull(), fg - om > GUST_KT).when(og.isNotNull(), og - fm > GUST_KT)
    strong = F.greatest(F.coalesce(fm, F.lit(0)), F.coalesce(fg, F.lit(0))) >= STRONG_KT
    no = F.lit(False)
    return F.coalesce(F.abs(fm - om) > SPEED_KT, no) | F.coalesce(gust, no) | (strong & F.coalesce(apart(c(f, "wind_dir"), c(o, "wind_dir")) > TURN_DEG, no))


def category(side: str, known: Column | None = None) -> Column:
    return flight_category(F.col(f"{side}ceiling_ft"), F.col(f"{side}vis_m"), known)


def meets(target: str, o: str, ceiling_known: Column | None = None) -> Column:
    """A state meets what a group says: its category, its classes of weather among the state's, its wind within tolerance.

    says_sky, says_wind and says_weather tell what the group says itself; the target's other fields are inherited.
    """
    yes = F.lit(True)
    sky = F.when(F.col("says_sky"), F.coalesce(category(target) == category(o, ceiling_known), F.lit(False))).otherwise(yes)
    weather = F.when(F.col("says_weather"), F.size(F.array_except(classes(F.col(f"{target}weather")), classes(F.col(f"{o}weather")))) == 0).otherwise(yes)
    wind = F.when(F.col("says_wind"), ~wind_out(target, o)).otherwise(yes)
    return sky & weather & wind


# --- rules by hour ---------------------------------------------------------------------------


def state_rules(candidates: DataFrame, predominant: DataFrame, on: tuple[str, ...] = ("doc", "hour")) -> DataFrame:
    """The predominant state of an hour against the prevailing state and its alternates.

    candidates: doc, hour, fields, altimeter, alternate; predominant: doc (or what else they meet on), hour and p_ fields. What isn't known fails nothing.
    """
    j = candidates.join(predominant, list(on))
    same = F.col("_fc") == F.col("_oc")
    hours = (
        j.withColumn("_fc", category("")).withColumn("_oc", category("p_", F.col("p_ceiling_known")))
        .groupBy("doc", "hour").agg(
            (F.bool_or(F.col("_fc").isNotNull() & F.col("_oc").isNotNull()) & ~F.coalesce(F.bool_or(same), F.lit(False))).alias("category"),
            F.bool_and(F.col("p_wind_speed").isNotNull() & wind_out("", "p_")).alias("wind"),
            F.bool_or(~F.col("alternate") & (altimeter_band(F.col("altimeter")) != altimeter_band(F.col("p_altimeter")))).alias("altimeter"),
        )
    )
    rules = F.array(*(F.when(F.col(r), F.struct(F.lit(r).alias("rule"), F.lit(f"{r} out").alias("reason"))) for r in ("category", "wind", "altimeter")))
    return hours.select("doc", "hour", F.explode(F.array_compact(rules)).alias("x")).select("doc", "x.rule", "hour", "x.reason")


def storm_spans(held: DataFrame, by: list[str]) -> DataFrame:
    """by, start, end of the observed thunderstorms: runs of reports with one, each of which holds until the next report, the last one to the end of the validity."""
    at = W.partitionBy(*by).orderBy("at", "id")
    seen = held.withColumn("until", F.coalesce(F.lead("at").over(at), F.greatest("vt", "at"))).withColumn("storm", F.coalesce(F.col("weather").contains("TS"), F.lit(False)))
    return intervals.islands(seen, by, ["at", "id"], "storm").groupBy(*by, "island").agg(F.min("at").alias("start"), F.max("until").alias("end")).drop("island")


def storms_of(documents: DataFrame, seen: DataFrame) -> DataFrame:
    """T03d as in `storms`, where many documents share their reports: documents are rows and no hour or report is dealt to one.

    documents: doc, h (first hour), hours and storm: the hours from h on with a forecast thunderstorm, as bits; and the columns by which
    seen: (those columns, seen: array of start, end, from `storm_spans`) is met.
    """
    on = [c for c in seen.columns if c != "seen"]
    bit = lambda k: f"(shiftright(storm, cast({k} as int)) & 1L = 1L)"
    places = "sequence(0L, cast(hours - 1 as bigint))"
    begins, ends = f"filter({places}, k -> {bit('k')} and (k = 0 or not {bit('(k - 1)')}))", f"filter({places}, k -> {bit('k')} and (k = hours - 1 or not {bit('(k + 1)')}))"
    rows = documents.join(seen, on, "left").where("storm <> 0 or seen is not null").withColumn("seen", F.coalesce("seen", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    rows = rows.withColumn("said", F.expr(f"zip_with({begins}, {ends}, (a, b) -> named_struct('start', (h + a) * {HOUR}, 'end', (h + b + 1) * {HOUR}))"))
    tol = STORM_MIN * MINUTE
    unforecast = f"transform(filter(seen, x -> not exists(said, y -> y.start <= x.start + {tol} and y.end >= x.start - {tol})), x -> named_struct('at', x.start, 'rank', 1))"
    unseen = f"transform(filter(said, y -> not exists(seen, x -> x.start <= y.end + {tol} and x.end >= y.start - {tol})), y -> named_struct('at', y.start, 'rank', 0))"
    rows = rows.select("doc", F.explode(F.expr(f"concat({unforecast}, {unseen})")).alias("x")).select("doc", hour_of(F.col("x.at")).alias("hour"), "x.rank")
    return _storm_fails(rows)


def storms(held: DataFrame, forecast: DataFrame) -> DataFrame:
    """T03d: an observed thunderstorm that begins over 30 minutes from any forecast one, and a forecast one without an observed one so near.

    held: `reports_of`; forecast: doc, hour, storm for every hour. Spans of both sides are merged first.
    """
    seen = storm_spans(held, ["doc"])
    said = intervals.islands(forecast, ["doc"], ["hour"], "storm").groupBy("doc", "island").agg((F.min("hour") * HOUR).alias("start"), ((F.max("hour") + 1) * HOUR).alias("end"))
    onset = seen.withColumn("end", F.col("start"))
    unforecast = intervals.unmet(onset, said, ["doc"], STORM_MIN * MINUTE, HOUR).select("doc", hour_of(F.col("start")).alias("hour"), F.lit(1).alias("rank"))
    unseen = intervals.unmet(said, seen, ["doc"], STORM_MIN * MINUTE, HOUR).select("doc", hour_of(F.col("start")).alias("hour"), F.lit(0).alias("rank"))
    return _storm_fails(unforecast.union(unseen))


def _storm_fails(rows: DataFrame) -> DataFrame:
    reason = F.element_at(F.array(F.lit("forecast storm did not occur"), F.lit("observed storm unforecast")), F.min("rank") + 1)
    return rows.groupBy("doc", "hour").agg(reason.alias("reason")).select("doc", F.lit("thunderstorm").alias("rule"), "hour", "reason")


def temporary(targets: DataFrame, predominant: DataFrame, on: tuple[str, ...] = ("doc", "hour")) -> DataFrame:
    """T03e: a temporary condition that was the predominant state of an hour of its window, or that never occurred in it.

    targets: doc, grp, start, end (hours), t_ fields and says_ flags; predominant: doc, hour, p_ fields and weather_seen, all
    weather of the hour. An hour's brief weather counts as an occurrence if the group speaks of weather.
    """
    hours = targets.withColumn("hour", F.explode(F.sequence("start", F.col("end") - 1))).join(predominant, list(on))
    brief = F.col("says_weather") & (F.size(F.array_except(classes(F.col("t_weather")), classes(F.col("weather_seen")))) == 0)
    met = hours.withColumn("_met", meets("t_", "p_", F.col("p_ceiling_known"))).withColumn("_brief", brief)
    each = met.groupBy("doc", "grp").agg(F.min(F.when(F.col("_met"), F.col("hour"))).alias("held"), F.min("hour").alias("first"), F.bool_or(F.col("_met") | F.col("_brief")).alias("occurred"))
    fails = each.where("held is not null or not occurred").select("doc", F.coalesce("held", "first").alias("hour"), F.col("held").isNotNull().alias("_held"))
    reason = F.when(F.bool_or("_held"), "temporary condition became predominant").otherwise("temporary condition never occurred")
    return fails.groupBy("doc", "hour").agg(reason.alias("reason")).select("doc", F.lit("tempo").alias("rule"), "hour", "reason")


def changes(targets: DataFrame, held: DataFrame, on: tuple[str, ...] = ("doc",)) -> DataFrame:
    """T03f: a change that isn't there within 30 minutes of its time, or that came early and lasted for 30 minutes.

    targets: doc, grp, due (the time), t_ fields and says_ flags; held: `reports_of` with o_ fields. The ordered pattern
    (first match from the due time on; runs of matches before it) is two aggregates over numbered runs.
    """
    rows = targets.join(held, list(on)).withColumn("met", meets("t_", "o_"))
    first = rows.groupBy("doc", "grp", "due", "vf", "vt").agg(F.min(F.when(F.col("met") & (F.col("at") >= F.col("due")), F.col("at"))).alias("first"))
    late = first.where(F.col("first").isNull() | (F.col("first") > F.col("due") + CHANGE_MIN * MINUTE)).select("doc", "vf", "vt", hour_of(F.when(F.col("due") < F.col("vt"), F.col("due")).otherwise(F.col("vt") - HOUR)).alias("hour"), F.lit(True).alias("late"))
    early = intervals.islands(rows.where("at < due"), ["doc", "grp"], ["at", "id"], "met").groupBy("doc", "grp", "vf", "vt", "island").agg(F.min("at").alias("start"), F.max("at").alias("end"))
    early = early.where(F.col("end") - F.col("start") >= PERSIST_MIN * MINUTE).select("doc", "vf", "vt", hour_of(F.col("start")).alias("hour"), F.lit(False).alias("late"))
    within = late.union(early).where((F.col("hour") >= hour_of(F.col("vf"))) & (F.col("hour") < hour_of(F.col("vt"))))
    reason = F.when(F.bool_or("late"), "change not established in time").otherwise("change early and persisting")
    return within.groupBy("doc", "hour").agg(reason.alias("reason")).select("doc", F.lit("change_timing").alias("rule"), "hour", "reason")


# --- episodes, triggers, headline ------------------------------------------------------------


def episodes(fails: DataFrame, available: DataFrame, gaps: DataFrame) -> DataFrame:
    """doc, rule, onset, hours, after_service: consecutive failing hours of a rule; after_service if all of them lie in service gaps.

    available: doc, hour of the hours that truth covers; failures in others don't count. gaps: doc, start, end (times).
    """
    return _episodes(_marked(fails, available, gaps))


def _marked(fails: DataFrame, available: DataFrame, gaps: DataFrame) -> DataFrame:
    """doc, hour, off, rules: the hours that truth covers, each with the rules that fail in it. Dealt by document once, which serves whatever is counted by document."""
    off = service_hours(available, gaps).select("doc", "hour", "off", F.lit(None).cast("string").alias("rule"))
    rows = off.unionByName(fails.select("doc", "hour", F.lit(None).cast("boolean").alias("off"), "rule")).repartition("doc")
    return rows.groupBy("doc", "hour").agg(F.max("off").alias("off"), F.collect_set("rule").alias("rules")).where("off is not null")


def _episodes(marked: DataFrame) -> DataFrame:
    rows = marked.select("doc", "hour", "off", F.explode_outer("rules").alias("rule")).where("rule is not null")
    number = F.row_number().over(W.partitionBy("doc", "rule").orderBy("hour"))
    return rows.withColumn("_run", F.col("hour") - number).groupBy("doc", "rule", "_run").agg(F.min("hour").alias("onset"), F.count("*").alias("hours"), F.bool_and("off").alias("after_service")).drop("_run")


def service_hours(available: DataFrame, gaps: DataFrame) -> DataFrame:
    """doc, hour, off: whether an hour begins inside a gap of its document. A document has a gap or two."""
    spans = gaps.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("_gaps"))
    inside = F.exists(F.coalesce("_gaps", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda g: (g["start"] <= F.col("hour") * HOUR) & (F.col("hour") * HOUR < g["end"]))
    return available.join(spans, "doc", "left").select("doc", "hour", inside.alias("off"))


def headline(fails: DataFrame, available: DataFrame, gaps: DataFrame) -> DataFrame:
    """T03g, A37: by document: hours scored, in spec and after service, and triggers inside and outside of service.

    Episodes with one onset are one trigger; one that lies in a gap from end to end is left out of the headline.
    """
    marked = _marked(fails, available, gaps)
    eps = _episodes(marked)
    triggers = eps.groupBy("doc", "onset").agg(F.bool_or(~F.col("after_service")).alias("counts")).groupBy("doc").agg(F.count_if("counts").alias("triggers"), F.count_if(~F.col("counts")).alias("triggers_after_service"))
    hours = marked.where("doc is not null")
    bad = (F.size("rules") > 0) & ~F.col("off")
    scored = hours.groupBy("doc").agg(F.count("*").alias("hours_scored"), F.count_if(~bad).alias("hours_in_spec"), F.count_if("off").alias("hours_after_service"))
    none = F.lit(0).cast("long")
    return scored.join(triggers, "doc", "left").select("doc", "hours_scored", "hours_in_spec", F.round(F.col("hours_in_spec") / F.col("hours_scored"), 6).alias("in_spec"), "hours_after_service", F.coalesce("triggers", none).alias("triggers"), F.coalesce("triggers_after_service", none).alias("triggers_after_service"))
