"""Truth and the scorers built on it: hit rates, amendment triggers, skill, contingency, ordinal distance."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wxspark.functions.weather import CEILING_STEPS, VIS_STEPS, altimeter_band, apart, circular_mean, contingency, flight_category, ladder, ladder_sql, turn
from wxspark.operators import intervals, truth
from wxspark.operators.matching import match_episodes
from wxspark.sources.tables import OBS_SQL, obs

HOURS = ["station"]


def _hours(spark, d):
    o = obs(spark, d).select("station", "obs_time", "event_id", "ceiling_ft", "vis_m", "altimeter", "gust", "wind_speed", "wind_dir", "weather")
    return truth.state_hours(o, HOURS, ["event_id"])


def t01_truth_conservative(spark, d):
    return truth.conservative(_hours(spark, d), HOURS)


def t01_truth_predominant(spark, d):
    return truth.predominant(_hours(spark, d), HOURS, "ceiling_ft")


def _expected(have):
    """station, from, to: every station with the window of all reports, first to last hour that any of them covers."""
    window = have.agg(F.min("hour").alias("from"), F.max("hour").alias("to"))  # one row
    return have.select("station").distinct().join(F.broadcast(window))


def a30_coverage(spark, d):
    """Share of the window's hours that truth covers at a station, and how many are missing."""
    have = _hours(spark, d).select("station", "hour").distinct()
    n = have.groupBy("station").agg(F.count("*").alias("n"))
    hours = F.floor((F.unix_micros(F.col("to").cast("timestamp")) - F.unix_micros(F.col("from").cast("timestamp"))) / 3_600_000_000) + 1
    return _expected(have).join(n, "station").select("station", "n", F.round(F.col("n") / hours, 6).alias("coverage"), (hours - F.col("n")).alias("missing"))


def a30_missing_hours(spark, d):
    """The missing hours themselves."""
    have = _hours(spark, d).select("station", "hour").distinct()
    spine = _expected(have).select("station", F.explode(F.sequence("from", "to", F.expr("interval 1 hour"))).alias("hour"))
    return spine.join(have, ["station", "hour"], "left_anti")


def _pairs(spark, d):
    """Each METAR (as forecast) with the next report of its station (as truth): the scorers' opportunities."""
    w = W.partitionBy("station").orderBy("obs_time", "event_id")
    cols = ["ceiling_ft", "vis_m", "wind_dir", "wind_speed", "gust", "altimeter", "temp_c", "weather"]
    o = obs(spark, d)
    return o.select("*", *(F.lead(c).over(w).alias(f"o_{c}") for c in cols), F.lead("event_id").over(w).alias("o_id")).where("report_type = 'METAR' and o_id is not null")


_CAT = {"f": "ceiling_ft", "o": "o_ceiling_ft"}
_PAIRS_SQL = "p AS (SELECT * FROM (SELECT *, lead(ceiling_ft) OVER w AS o_ceiling_ft, lead(vis_m) OVER w AS o_vis_m, lead(wind_dir) OVER w AS o_wind_dir, lead(wind_speed) OVER w AS o_wind_speed, lead(gust) OVER w AS o_gust, lead(altimeter) OVER w AS o_altimeter, lead(temp_c) OVER w AS o_temp_c, lead(weather) OVER w AS o_weather, lead(event_id) OVER w AS o_id FROM obs WINDOW w AS (PARTITION BY station ORDER BY obs_time, event_id)) WHERE report_type = 'METAR' AND o_id IS NOT NULL)"


def elements(p):
    """T02a-T02f: earned points of seven elements, null where an element isn't available."""
    cat = lambda c: F.coalesce(ladder(F.col(c), CEILING_STEPS, "E"), F.lit("E"))
    f, o = F.split("weather", " "), F.split("o_weather", " ")
    both = F.array_union(F.coalesce(f, F.array().cast("array<string>")), F.coalesce(o, F.array().cast("array<string>")))
    hit = F.array_intersect(F.coalesce(f, F.array().cast("array<string>")), F.coalesce(o, F.array().cast("array<string>")))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "ceiling": yes(cat("ceiling_ft") == cat("o_ceiling_ft")),
        "visibility": F.when(F.col("vis_m").isNotNull() & F.col("o_vis_m").isNotNull(), yes(ladder(F.col("vis_m"), VIS_STEPS, "E") == ladder(F.col("o_vis_m"), VIS_STEPS, "E"))),
        "speed": F.when(F.col("wind_speed") >= 6, yes(F.abs(F.col("wind_speed") - F.col("o_wind_speed")) <= 9)),
        "direction": F.when(F.col("o_wind_speed") > 6, yes(apart(F.col("wind_dir"), F.col("o_wind_dir")) <= F.when(F.col("o_wind_speed") >= 15, 30).otherwise(50))),
        "gust": F.when(F.col("gust").isNull() & F.col("o_gust").isNull(), 1.0).when(F.col("gust").isNull() | F.col("o_gust").isNull(), 0.0).otherwise(yes(F.abs(F.col("gust") - F.col("o_gust")) <= 10)),
        "weather": F.when(F.size(both) > 0, F.size(hit) / F.size(both)),
        "altimeter": yes(F.col("o_altimeter") >= F.col("altimeter") - 5),
    }


def t02_element_points(spark, d):
    """Points by element and report type, with all totals, as grouping sets."""
    p = _pairs(spark, d)
    e = elements(p)
    kind = F.when(F.col("corrected"), "TEMPO").otherwise("INITIAL").alias("grp")
    tall = p.select(kind, *(v.alias(k) for k, v in e.items())).unpivot(["grp"], list(e), "element", "earned").where("earned is not null")
    g = tall.groupingSets([["element", "grp"], ["element"], ["grp"], []], "element", "grp").agg(F.round(F.sum("earned"), 6).alias("earned"), F.count("*").alias("available"))
    return g.select(F.coalesce("element", F.lit("ALL")).alias("element"), F.coalesce("grp", F.lit("ALL")).alias("grp"), "earned", "available", F.round(100 * F.col("earned") / F.col("available"), 6).alias("pct"))


def t03_amendment_triggers(spark, d):
    """T03a-c, W10, J36, A37: failing rules to episodes, episodes of equal onset to triggers.

    Wind fails by speed, by gust (a missing gust is the mean speed), or by direction where the forecast's larger of speed and gust is strong.
    """
    p = _pairs(spark, d)
    gusts = F.col("gust").isNotNull() | F.col("o_gust").isNotNull()
    beyond = F.when(F.col("gust").isNotNull() & F.col("o_gust").isNotNull(), F.abs(F.col("gust") - F.col("o_gust")) > 10).when(gusts, F.coalesce(F.col("gust") - F.col("o_wind_speed"), F.col("o_gust") - F.col("wind_speed")) > 10).otherwise(False)
    rules = {
        "category": flight_category(F.col("ceiling_ft"), F.col("vis_m")) != flight_category(F.col("o_ceiling_ft"), F.col("o_vis_m")),
        "wind": (F.abs(F.col("wind_speed") - F.col("o_wind_speed")) > 10) | beyond | ((F.greatest("wind_speed", "gust") >= 15) & (apart(F.col("wind_dir"), F.col("o_wind_dir")) > 30)),
        "altimeter": altimeter_band(F.col("altimeter")) != altimeter_band(F.col("o_altimeter")),
    }
    tall = p.select("station", "obs_time", "event_id", *(F.coalesce(v, F.lit(False)).alias(k) for k, v in rules.items())).unpivot(["station", "obs_time", "event_id"], list(rules), "rule", "fails")
    eps = intervals.islands(tall, ["station", "rule"], ["obs_time", "event_id"], "fails").groupBy("station", "rule", "island").agg(F.min("obs_time").alias("onset"), F.count("*").alias("hours"))
    trig = eps.groupBy("station", "onset").agg(F.array_join(F.array_sort(F.collect_set("rule")), "+").alias("rules"), F.sum("hours").alias("hours"))
    return trig.groupBy("rules").agg(F.count("*").alias("n_triggers"), F.sum("hours").alias("hours"))


def t04_continuous_errors(spark, d):
    """Signed and absolute errors by element and lead bin, circular for direction."""
    p = _pairs(spark, d)
    e = p.select("station", "hr" if "hr" in p.columns else F.hour("obs_time").alias("hr"), (F.col("temp_c") - F.col("o_temp_c")).cast("double").alias("temp"), (F.col("wind_speed") - F.col("o_wind_speed")).cast("double").alias("speed"), turn(F.col("wind_dir"), F.col("o_wind_dir")).cast("double").alias("dir"))
    tall = e.unpivot(["station", "hr"], ["temp", "speed", "dir"], "element", "err").withColumn("bin", F.floor(F.col("hr") / 6).cast("int"))
    g = tall.groupingSets([["element", "bin"], ["element"]], "element", "bin").agg(F.count("*").alias("n"), F.round(F.avg("err"), 6).alias("bias"), F.round(F.avg(F.abs("err")), 6).alias("mae"), F.round(F.sqrt(F.avg(F.col("err") * F.col("err"))), 6).alias("rmse"))
    return g.select("element", F.coalesce("bin", F.lit(-1)).alias("bin"), "n", "bias", "mae", "rmse")


def t05_event_contingency(spark, d):
    """Event flags of both sides to cells and scores, null at a zero denominator."""
    p = _pairs(spark, d)
    events = {
        "ceil_lt_1000": ("coalesce(ceiling_ft, 99999) < 1000", "coalesce(o_ceiling_ft, 99999) < 1000"), "vis_lt_1600": ("vis_m < 1600", "o_vis_m < 1600"),
        "gust_ge_25": ("coalesce(gust, 0) >= 25", "coalesce(o_gust, 0) >= 25"), "ts": ("coalesce(weather, '') like '%TS%'", "coalesce(o_weather, '') like '%TS%'"), "never": ("wind_speed > 99", "o_wind_speed > 99"),
    }
    tall = p.select(F.explode(F.array(*(F.struct(F.lit(k).alias("event"), F.expr(f).alias("f"), F.expr(o).alias("o")) for k, (f, o) in events.items()))).alias("x")).select("x.*").where("f is not null and o is not null")
    c = tall.groupBy("event").agg(F.count_if(F.expr("f and o")).alias("a"), F.count_if(F.expr("o and not f")).alias("b"), F.count_if(F.expr("f and not o")).alias("c"), F.count_if(F.expr("not f and not o")).alias("d"))
    return c.select("event", "a", "b", "c", "d", *(F.round(v, 6).alias(k) for k, v in contingency(*(F.col(x) for x in "abcd")).items()))


def t05_episode_matching(spark, d):
    """Episodes of both sides matched one to one (no SQL twin; the tests hold it against brute force)."""
    o = obs(spark, d).withColumn("h", F.floor(F.unix_seconds(F.col("obs_time").cast("timestamp")) / 3600).cast("double"))
    f = o.where("report_type = 'SPECI'").select("station", F.lit("F").alias("side"), F.col("h").alias("onset_h"))
    return match_episodes(f.union(o.where("corrected").select("station", F.lit("O"), "h")), ["station"]).groupBy("station", "outcome").agg(F.count("*").alias("n"))


def t06_ordinal_distance(spark, d):
    """Mean absolute and signed category distance, and the worst excursion (the first of equals)."""
    letters = F.array(*map(F.lit, "ABCDE"))
    p = _pairs(spark, d)
    place = lambda c, v: F.array_position(letters, flight_category(F.col(c), F.col(v))).cast("long")
    x = p.withColumn("dist", place("ceiling_ft", "vis_m") - place("o_ceiling_ft", "o_vis_m")).where("dist is not null and vis_m is not null and o_vis_m is not null")
    return x.groupBy("station").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("dist")), 6).alias("mace"), F.round(F.avg("dist"), 6).alias("mean"), F.min(F.struct((-F.abs("dist")).alias("k"), "obs_time", "event_id", "dist")).alias("w")).select("station", "n", "mace", "mean", F.col("w.dist").alias("worst"), F.col("w.event_id").alias("worst_id"))


def a21_circular_mean(spark, d):
    return obs(spark, d).groupBy("station").agg(F.round(circular_mean(F.col("wind_dir")), 4).alias("mean_dir"))


_O = f"WITH {OBS_SQL}"
_H = ("iv AS (SELECT *, lead(obs_time) OVER (PARTITION BY station ORDER BY obs_time, event_id) AS nx, obs_time + INTERVAL 90 MINUTE AS held FROM obs), "
      "st AS (SELECT *, obs_time AS s, CASE WHEN nx < held THEN nx ELSE held END AS e FROM iv), h0 AS (SELECT *, unnest(range(date_trunc('hour', s), e, INTERVAL 1 HOUR)) AS hour FROM st WHERE s < e), "
      "h AS (SELECT *, (epoch_us(least(e, hour + INTERVAL 1 HOUR)) - epoch_us(greatest(s, hour))) / 1e6 AS seconds FROM h0)")
_L = lambda c: f"coalesce({ladder_sql(c, CEILING_STEPS, 'E')}, 'E')"
_V = lambda v: ladder_sql(v, VIS_STEPS, "E")
_F = lambda c, v: f"CASE WHEN {v} IS NOT NULL THEN least({_L(c)}, {_V(v)}) END"
_AP = "least((wind_dir - o_wind_dir + 720) % 360, 360 - (wind_dir - o_wind_dir + 720) % 360)"
QUERIES = {
    "t01_truth_conservative": (t01_truth_conservative, f"""{_O}, {_H}
SELECT station, hour, min(ceiling_ft) AS cons_ceiling, bool_and(ceiling_ft IS NULL) AS cons_unlimited, min(vis_m) AS cons_vis, min(altimeter) AS cons_altimeter, max(gust) AS cons_gust,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(string_split(weather, ' ')) FILTER (WHERE weather IS NOT NULL)))), ' '), '') AS cons_weather,
  CAST(round(sum(seconds) * 1e6) AS BIGINT) AS held_us, max(wind_speed) AS cons_speed, list(wind_dir ORDER BY wind_speed DESC, s, event_id)[1] AS cons_dir FROM h GROUP BY ALL"""),
    "t01_truth_predominant": (t01_truth_predominant, f"""{_O}, {_H}, v AS (SELECT station, hour, ceiling_ft, sum(seconds) AS sec, min((s, event_id)) AS seen FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY station, hour ORDER BY sec DESC, seen) AS rk, count(*) OVER (PARTITION BY station, hour) AS nv FROM v)
SELECT station, hour, CASE WHEN sec >= 1800 THEN ceiling_ft END AS pred_ceiling_ft, sec >= 1800 AS pred_available, nv - CAST(sec >= 1800 AS BIGINT) AS n_temporary FROM r WHERE rk = 1"""),
    "a30_coverage": (a30_coverage, f"{_O}, {_H}, w AS (SELECT (epoch_us(max(hour)) - epoch_us(min(hour))) // 3600000000 + 1 AS hours FROM h), x AS (SELECT station, count(DISTINCT hour) AS n FROM h GROUP BY 1) SELECT station, n, round(n / hours, 6) AS coverage, hours - n AS missing FROM x, w"),
    "a30_missing_hours": (a30_missing_hours, f"{_O}, {_H}, w AS (SELECT unnest(range(min(hour), max(hour) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour FROM h) SELECT station, hour FROM (SELECT DISTINCT station FROM h), w EXCEPT SELECT station, hour FROM h"),
    "t02_element_points": (t02_element_points, f"""{_O}, {_PAIRS_SQL}, q AS (SELECT CASE WHEN corrected THEN 'TEMPO' ELSE 'INITIAL' END AS grp, coalesce(string_split(weather, ' '), []) AS f, coalesce(string_split(o_weather, ' '), []) AS o, * FROM p),
e AS (SELECT grp, 'ceiling' AS element, CAST({_L('ceiling_ft')} = {_L('o_ceiling_ft')} AS DOUBLE) AS earned FROM q
UNION ALL SELECT grp, 'visibility', CAST({_V('vis_m')} = {_V('o_vis_m')} AS DOUBLE) FROM q
UNION ALL SELECT grp, 'speed', CASE WHEN wind_speed >= 6 THEN CAST(abs(wind_speed - o_wind_speed) <= 9 AS DOUBLE) END FROM q
UNION ALL SELECT grp, 'direction', CASE WHEN o_wind_speed > 6 THEN CAST({_AP} <= CASE WHEN o_wind_speed >= 15 THEN 30 ELSE 50 END AS DOUBLE) END FROM q
UNION ALL SELECT grp, 'gust', CASE WHEN gust IS NULL AND o_gust IS NULL THEN 1.0 WHEN gust IS NULL OR o_gust IS NULL THEN 0.0 ELSE CAST(abs(gust - o_gust) <= 10 AS DOUBLE) END FROM q
UNION ALL SELECT grp, 'weather', len(list_intersect(f, o)) / nullif(len(list_distinct(list_concat(f, o))), 0) FROM q
UNION ALL SELECT grp, 'altimeter', CAST(o_altimeter >= altimeter - 5 AS DOUBLE) FROM q)
SELECT coalesce(element, 'ALL') AS element, coalesce(grp, 'ALL') AS grp, round(sum(earned), 6) AS earned, count(*) AS available, round(100 * round(sum(earned), 6) / count(*), 6) AS pct FROM e WHERE earned IS NOT NULL GROUP BY GROUPING SETS ((element, grp), (element), (grp), ())"""),
    "t03_amendment_triggers": (t03_amendment_triggers, f"""{_O}, {_PAIRS_SQL}, r AS (
SELECT station, obs_time, event_id, 'category' AS rule, coalesce({_F('ceiling_ft', 'vis_m')} <> {_F('o_ceiling_ft', 'o_vis_m')}, false) AS fails FROM p
UNION ALL SELECT station, obs_time, event_id, 'wind', coalesce(abs(wind_speed - o_wind_speed) > 10 OR CASE WHEN gust IS NOT NULL AND o_gust IS NOT NULL THEN abs(gust - o_gust) > 10 WHEN gust IS NOT NULL THEN gust - o_wind_speed > 10 WHEN o_gust IS NOT NULL THEN o_gust - wind_speed > 10 ELSE false END OR (greatest(wind_speed, gust) >= 15 AND {_AP} > 30), false) FROM p
UNION ALL SELECT station, obs_time, event_id, 'altimeter', coalesce((altimeter >= 3100) <> (o_altimeter >= 3100) OR (altimeter < 2800) <> (o_altimeter < 2800), false) FROM p),
i AS (SELECT *, sum(CASE WHEN fails THEN 0 ELSE 1 END) OVER (PARTITION BY station, rule ORDER BY obs_time, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM r),
ep AS (SELECT station, rule, isl, min(obs_time) AS onset, count(*) AS hours FROM i WHERE fails GROUP BY ALL),
tr AS (SELECT station, onset, string_agg(DISTINCT rule, '+' ORDER BY rule) AS rules, sum(hours) AS hours FROM ep GROUP BY ALL)
SELECT rules, count(*) AS n_triggers, CAST(sum(hours) AS BIGINT) AS hours FROM tr GROUP BY 1"""),
    "t04_continuous_errors": (t04_continuous_errors, f"""{_O}, {_PAIRS_SQL}, e AS (SELECT 'temp' AS element, hour(obs_time) // 6 AS bin, CAST(temp_c - o_temp_c AS DOUBLE) AS err FROM p
UNION ALL SELECT 'speed', hour(obs_time) // 6, wind_speed - o_wind_speed FROM p UNION ALL SELECT 'dir', hour(obs_time) // 6, (wind_dir - o_wind_dir + 900) % 360 - 180 FROM p)
SELECT element, CAST(coalesce(bin, -1) AS INTEGER) AS bin, count(*) AS n, round(avg(err), 6) AS bias, round(avg(abs(err)), 6) AS mae, round(sqrt(avg(err * err)), 6) AS rmse FROM e GROUP BY GROUPING SETS ((element, bin), (element))"""),
    "t05_event_contingency": (t05_event_contingency, f"""{_O}, {_PAIRS_SQL}, e AS (
SELECT 'ceil_lt_1000' AS event, coalesce(ceiling_ft, 99999) < 1000 AS f, coalesce(o_ceiling_ft, 99999) < 1000 AS o FROM p UNION ALL SELECT 'vis_lt_1600', vis_m < 1600, o_vis_m < 1600 FROM p
UNION ALL SELECT 'gust_ge_25', coalesce(gust, 0) >= 25, coalesce(o_gust, 0) >= 25 FROM p UNION ALL SELECT 'ts', coalesce(weather, '') LIKE '%TS%', coalesce(o_weather, '') LIKE '%TS%' FROM p UNION ALL SELECT 'never', wind_speed > 99, o_wind_speed > 99 FROM p),
k AS (SELECT event, count(*) FILTER (WHERE f AND o) AS a, count(*) FILTER (WHERE o AND NOT f) AS b, count(*) FILTER (WHERE f AND NOT o) AS c, count(*) FILTER (WHERE NOT f AND NOT o) AS d FROM e WHERE f IS NOT NULL AND o IS NOT NULL GROUP BY 1),
x AS (SELECT *, ((a + b) * (a + c) + (c + d) * (b + d)) / nullif(a + b + c + d, 0) AS ch FROM k)
SELECT event, a, b, c, d, round(a / nullif(a + b, 0), 6) AS pod, round(c / nullif(a + c, 0), 6) AS far, round(a / nullif(a + b + c, 0), 6) AS csi, round((a + c) / nullif(a + b, 0), 6) AS bias, round((a + d - ch) / nullif(a + b + c + d - ch, 0), 6) AS hss FROM x"""),
    "t05_episode_matching": (t05_episode_matching, None),
    "t06_ordinal_distance": (t06_ordinal_distance, f"""{_O}, {_PAIRS_SQL}, x AS (SELECT *, CAST(strpos('ABCDE', {_F('ceiling_ft', 'vis_m')}) - strpos('ABCDE', {_F('o_ceiling_ft', 'o_vis_m')}) AS BIGINT) AS dist FROM p WHERE vis_m IS NOT NULL AND o_vis_m IS NOT NULL)
SELECT station, count(*) AS n, round(avg(abs(dist)), 6) AS mace, round(avg(dist), 6) AS mean, list(dist ORDER BY abs(dist) DESC, obs_time, event_id)[1] AS worst, list(event_id ORDER BY abs(dist) DESC, obs_time, event_id)[1] AS worst_id FROM x GROUP BY 1"""),
    "a21_circular_mean": (a21_circular_mean, f"{_O} SELECT station, round((degrees(atan2(avg(sin(radians(wind_dir))), avg(cos(radians(wind_dir))))) + 360) % 360, 4) AS mean_dir FROM obs GROUP BY 1"),
}
