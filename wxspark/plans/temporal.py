"""Latest runs, as-of and nearest joins, windows and islands."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wxspark.operators import asof, intervals, latest
from wxspark.operators.asof import micros
from wxspark.sources.tables import CUBE_SQL, OBS_SQL, TAFS_SQL, cube, obs, read, tafs


def w01_latest_run_per_place(spark, d):
    return latest.newest_per(cube(spark, d), ["loc_id", "model"], "run", ["valid_time", "l_orderkey", "member"]).select("loc_id", "model", "run", "valid_time", "l_orderkey", "member")


def w02_latest_value_per_time_variable(spark, d):
    """The newest run's value by valid time and variable; ties by the largest value."""
    return cube(spark, d).groupBy("valid_time", "variable").agg(F.max_by("value", F.struct("run", "value")).alias("value"), F.max("run").alias("run"))


def w03_latest_run_per_time(spark, d):
    """All members of the newest run at each valid time."""
    return latest.newest_rows_per(cube(spark, d), ["valid_time"], "run").groupBy("valid_time").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def w04_one_run_for_all(spark, d):
    return latest.newest_rows_per(cube(spark, d), ["loc_id", "model"], "run").select("loc_id", "model", "run", "valid_time", "value")


def w05_newest_three_runs(spark, d):
    """The three newest runs side by side, with the trend as text."""
    top = latest.newest_k(cube(spark, d), ["loc_id"], "run", 3).groupBy("loc_id", "run_rank").agg(F.sum("value").cast("long").alias("v"))
    return top.groupBy("loc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_rank", "v"))), lambda x: x["v"].cast("string")), " > ").alias("trend"))


def w09_span_to_next(spark, d):
    """Seconds to the next report, the station's median for the last one."""
    o = obs(spark, d)
    gap = (micros(F.lead("obs_time").over(W.partitionBy("station").orderBy("obs_time", "event_id"))) - micros("obs_time")) / 1e6
    g = o.withColumn("gap", gap)
    mid = g.groupBy("station").agg(F.percentile("gap", 0.5).alias("mid"))
    return g.join(mid, "station").select("event_id", F.round(F.coalesce("gap", "mid"), 3).alias("span_s"))


def w10_failure_episodes(spark, d):
    """Consecutive failing reports as episodes; an episode's end is its last report."""
    o = obs(spark, d).withColumn("fails", F.coalesce(F.col("vis_m") < 4000, F.lit(False)))
    e = intervals.islands(o, ["station"], ["obs_time", "event_id"], "fails")
    return e.groupBy("station", "island").agg(F.min("obs_time").alias("onset"), F.max("obs_time").alias("end"), F.count("*").alias("n"), F.bool_and("corrected").alias("all_corrected"), F.min_by("event_id", F.struct("obs_time", "event_id")).alias("first_id")).drop("island")


def w08_collapse(spark, d):
    """Equal neighbouring states collapse into runs."""
    r = intervals.collapse(obs(spark, d), ["station"], ["obs_time", "event_id"], "weather")
    return r.groupBy("station", "run_no").agg(F.min("obs_time").alias("start"), F.any_value("weather").alias("weather"), F.count("*").alias("n"))


def w12_merge_spans(spark, d):
    """Two-hour spans of error reports, merged where they touch."""
    s = obs(spark, d).where("report_type = 'SPECI'").select("station", F.col("obs_time").alias("start"), (F.col("obs_time") + F.expr("interval 12 hours")).alias("end"))
    return intervals.merge_spans(s, ["station"]).select("station", "start", "end", "n_spans")


def w14_running_total(spark, d):
    daily = obs(spark, d).groupBy("station", F.to_date("obs_time").alias("day")).agg(F.round(F.sum("value"), 4).alias("usd"))
    w = W.partitionBy("station").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.select("station", "day", F.round(F.sum("usd").over(w), 4).alias("running"))


def w15_thin_profile(spark, d):
    """A level is kept if it is a step below the last kept one; a fold over the sorted profile."""
    p = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set(F.col("l_quantity"))).alias("levels"))
    keep = "aggregate(reverse(levels), cast(array() as array<double>), (a, x) -> if(size(a) = 0 or a[size(a) - 1] - x >= if(x > 35, 5, 8), concat(a, array(x)), a))"
    return p.select("l_suppkey", F.expr(f"array_join(transform({keep}, x -> cast(cast(x as bigint) as string)), ',')").alias("kept"))


def w16_running_max(spark, d):
    """Clamped, never falling effective times."""
    w = W.partitionBy("station").orderBy("issue", "taf_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    eff = F.col("issue") + F.when(F.col("kind") == "AMD", F.expr("interval 400 days")).otherwise(F.expr("interval 0 days"))
    return tafs(spark, d).withColumn("eff", eff).select("taf_id", F.max("eff").over(w).alias("effective"))


def w06_intervals_and_gaps(spark, d):
    """W06, ST09: states held 90 minutes, and the gaps between."""
    o = obs(spark, d).select("station", "obs_time", "event_id")
    return intervals.intervalise(o, ["station"], "obs_time", "90 minutes", ["event_id"]).select("event_id", "start", "end", "is_gap")


def w07_change_points(spark, d):
    """From each document to the next one or a fixed end."""
    nxt = F.lead("issue", 1).over(W.partitionBy("station").orderBy("issue", "taf_id"))
    return tafs(spark, d).select("taf_id", F.col("issue").alias("start"), F.coalesce(nxt, F.lit("2002-01-01").cast("timestamp_ntz")).alias("end"))


def j11_nearest_capture(spark, d):
    """For each correction the nearest error report within two days, ties to the later one."""
    o = obs(spark, d)
    want = o.where("corrected").select("station", "obs_time", F.col("event_id").alias("want_id"))
    have = o.where("report_type = 'SPECI'").select("station", F.col("obs_time").alias("at"), "event_id")
    return asof.nearest(want, have, ["station"], "obs_time", "at", 2 * 86400, ties=["event_id"]).select("want_id", F.col("r_at").alias("at"))


def j12_asof_backward(spark, d):
    """The last report strictly before each correction, at most 90 minutes old."""
    o = obs(spark, d)
    left = o.where("corrected").select("station", "obs_time", F.col("event_id").alias("taf"))
    right = o.where("not corrected").select("station", F.col("obs_time").alias("at"), "event_id")
    return asof.backward(left, right, ["station"], "obs_time", "at", True, 90 * 60, ties=["event_id"]).select("taf", F.col("r_event_id").alias("ob"))


def j14_latest_correction(spark, d):
    """The last document of each station and kind."""
    return asof.latest_at_key(tafs(spark, d).select("station", "kind", "issue", "taf_id", "value"), ["station", "kind"], [F.col("issue"), F.col("taf_id")])


def j15_amendments_in_validity(spark, d):
    """Routine documents with the amendments issued while they hold; an equi join on station and quarter."""
    t = tafs(spark, d)
    q = lambda c: F.floor((F.year(c) * 12 + F.month(c) - 1) / 3).cast("long")
    r = t.where("kind = 'TAF'").select("station", F.col("taf_id").alias("routine"), F.col("issue").alias("lo"), (F.col("issue") + F.expr("interval 90 days")).alias("hi"))
    r = r.withColumn("q", F.explode(F.sequence(q(F.col("lo")), q(F.col("hi")))))
    a = t.where("kind <> 'TAF'").select("station", "taf_id", "issue", q(F.col("issue")).alias("q"))
    return r.join(a, ["station", "q"]).where((F.col("issue") >= F.col("lo")) & (F.col("issue") < F.col("hi"))).select("routine", "taf_id")


def j17_hours_of_intervals(spark, d):
    """States spread over the hours they touch, with their minutes."""
    o = obs(spark, d).select("station", "obs_time", "event_id")
    s = intervals.intervalise(o, ["station"], "obs_time", "90 minutes", ["event_id"]).where("not is_gap")
    return intervals.in_hours(s).groupBy("station", "hour").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 3).alias("seconds"))


def j18_overlaps(spark, d):
    """Overlapping spans of two kinds, each pair once."""
    o = obs(spark, d)
    a = o.where("report_type = 'SPECI'").select("station", F.col("event_id").alias("a"), F.col("obs_time").alias("start"), (F.col("obs_time") + F.expr("interval 5 hours")).alias("end"))
    b = o.where("corrected").select("station", F.col("event_id").alias("b"), F.col("obs_time").alias("start"), (F.col("obs_time") + F.expr("interval 3 hours")).alias("end"))
    return intervals.overlap_join(a, b, ["station"]).select(F.col("l_a").alias("a"), F.col("r_b").alias("b"), "start", "end")


def j24_snap_to_hour(spark, d):
    """One report an hour, snapped by half an hour; routine beats special, then the earliest."""
    o = obs(spark, d).withColumn("hour", intervals.hour_of(F.col("obs_time") + F.expr("interval 30 minutes")))
    pick = F.struct((F.col("report_type") != "METAR").cast("int").alias("k"), "obs_time", "event_id")
    return o.groupBy("station", "hour").agg(F.min(pick).alias("m")).select("station", "hour", "m.event_id")


def j26_range_minimum(spark, d):
    """The lowest altimeter inside each correction's six hours."""
    o = obs(spark, d)
    g = o.where("corrected").select("station", F.col("event_id").alias("grp"), F.col("obs_time").alias("lo"), (F.col("obs_time") + F.expr("interval 6 hours")).alias("hi"))
    g = g.withColumn("hour", F.explode(F.sequence(intervals.hour_of("lo"), intervals.hour_of("hi"), F.expr("interval 1 hour"))))
    r = o.select("station", "obs_time", "altimeter", intervals.hour_of("obs_time").alias("hour"))
    return g.join(r, ["station", "hour"]).where((F.col("obs_time") >= F.col("lo")) & (F.col("obs_time") < F.col("hi"))).groupBy("grp").agg(F.min("altimeter").alias("qnh"), F.count("*").alias("n"))


def j27_matched_hours_skill(spark, d):
    """Subject against baseline on matched hours only, skill 1 - s / b, null at a zero baseline."""
    o = obs(spark, d)
    s = o.where("report_type = 'METAR'").groupBy("station", F.hour("obs_time").alias("hr")).agg(F.avg(F.abs(F.col("temp_c") - 12)).alias("s"))
    b = o.where("report_type = 'SPECI'").groupBy("station", F.hour("obs_time").alias("hr")).agg(F.avg(F.abs(F.col("temp_c") - 10)).alias("b"))
    return s.join(b, ["station", "hr"]).groupBy("station").agg(F.count("*").alias("n"), F.round(1 - F.try_divide(F.avg("s"), F.avg("b")), 6).alias("skill"))


def r02_pivot_runs(spark, d):
    """Models as columns, with mean and range across them."""
    p = cube(spark, d).groupBy("loc_id", "variable").pivot("model", ["A", "N", "R"]).agg(F.round(F.avg("value"), 6))
    v = F.array_compact(F.array("A", "N", "R"))
    return p.withColumn("spread", F.round(F.array_max(v) - F.array_min(v), 6))


def r04_melt(spark, d):
    """Wide to tall, nulls left out."""
    return obs(spark, d).select("event_id", F.col("gust").cast("double").alias("gust"), F.col("ceiling_ft").cast("double").alias("ceiling"), F.col("vis_m").cast("double").alias("vis")).unpivot("event_id", ["gust", "ceiling", "vis"], "variable", "v").where("v is not null").groupBy("variable").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def r05_profiles(spark, d):
    """Tall levels to profiles; partial levels go, fewer than three levels are no profile."""
    l = read(spark, d, "lineitem")
    levels = l.groupBy("l_suppkey", "l_linenumber").agg(F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("t"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("rh"))
    full = levels.where("t is not null and rh is not null")
    return full.groupBy("l_suppkey").agg(F.count("*").alias("n_levels"), F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("levels")).where("n_levels >= 3")


def r12_chunks(spark, d):
    """Rows in chunks of 500 and the credits of a request."""
    s = read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("coords"), F.countDistinct("p_size").alias("times"))
    return s.select("p_brand", F.ceil(F.col("coords") / 500).cast("long").alias("chunks"), (F.col("times") * F.ceil(F.col("coords") / 500)).cast("long").alias("credits"))


def r14_request_expansion(spark, d):
    """Each run's hours up to its successor, from a floor on; one row a request hour."""
    runs = tafs(spark, d).select("station", "issue").distinct()
    nxt = F.lead("issue").over(W.partitionBy("station").orderBy("issue"))
    p = runs.withColumn("stop", F.least(F.coalesce(nxt, F.col("issue") + F.expr("interval 10 days")), F.col("issue") + F.expr("interval 10 days"))).withColumn("start", F.greatest("issue", F.lit("1996-01-01").cast("timestamp_ntz"))).where("start < stop")
    return p.withColumn("valid", F.explode(F.sequence("start", F.col("stop") - F.expr("interval 1 day"), F.expr("interval 1 day")))).groupBy("station").agg(F.count("*").alias("n"), F.min("valid").alias("first"), F.max("valid").alias("last"))


_O = f"WITH {OBS_SQL}"
_C = f"WITH {CUBE_SQL}"
_T = f"WITH {TAFS_SQL}"
_IV = "iv AS (SELECT station, event_id, obs_time, lead(obs_time) OVER (PARTITION BY station ORDER BY obs_time, event_id) AS nx, obs_time + INTERVAL 90 MINUTE AS held FROM obs), st AS (SELECT station, event_id, obs_time AS start, CASE WHEN nx < held THEN nx ELSE held END AS \"end\", false AS is_gap FROM iv UNION ALL SELECT station, event_id, held, nx, true FROM iv WHERE nx > held)"
QUERIES = {
    "w01_latest_run_per_place": (w01_latest_run_per_place, f"{_C} SELECT loc_id, model, run, valid_time, l_orderkey, member FROM cube_ QUALIFY row_number() OVER (PARTITION BY loc_id, model ORDER BY run DESC, valid_time, l_orderkey, member) = 1"),
    "w02_latest_value_per_time_variable": (w02_latest_value_per_time_variable, f"{_C} SELECT valid_time, variable, value, run FROM cube_ QUALIFY row_number() OVER (PARTITION BY valid_time, variable ORDER BY run DESC, value DESC) = 1"),
    "w03_latest_run_per_time": (w03_latest_run_per_time, f"{_C}, t AS (SELECT * FROM cube_ QUALIFY run = max(run) OVER (PARTITION BY valid_time)) SELECT valid_time, count(*) AS n, round(avg(value), 6) AS mean_value FROM t GROUP BY 1"),
    "w04_one_run_for_all": (w04_one_run_for_all, f"{_C} SELECT loc_id, model, run, valid_time, value FROM cube_ QUALIFY run = max(run) OVER (PARTITION BY loc_id, model)"),
    "w05_newest_three_runs": (w05_newest_three_runs, f"{_C}, r AS (SELECT loc_id, value, dense_rank() OVER (PARTITION BY loc_id ORDER BY run DESC) AS rk FROM cube_), s AS (SELECT loc_id, rk, CAST(sum(value) AS BIGINT) AS v FROM r WHERE rk <= 3 GROUP BY ALL) SELECT loc_id, string_agg(CAST(v AS VARCHAR), ' > ' ORDER BY rk) AS trend FROM s GROUP BY 1"),
    "w09_span_to_next": (w09_span_to_next, f"{_O}, g AS (SELECT station, event_id, (epoch_us(lead(obs_time) OVER (PARTITION BY station ORDER BY obs_time, event_id)) - epoch_us(obs_time)) / 1e6 AS gap FROM obs) SELECT event_id, round(coalesce(gap, median(gap) OVER (PARTITION BY station)), 3) AS span_s FROM g"),
    "w10_failure_episodes": (w10_failure_episodes, f"{_O}, f AS (SELECT *, coalesce(vis_m < 4000, false) AS fails FROM obs), i AS (SELECT *, sum(CASE WHEN fails THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY obs_time, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM f) SELECT station, min(obs_time) AS onset, max(obs_time) AS \"end\", count(*) AS n, bool_and(corrected) AS all_corrected, list(event_id ORDER BY obs_time, event_id)[1] AS first_id FROM i WHERE fails GROUP BY station, isl"),
    "w08_collapse": (w08_collapse, f"{_O}, c AS (SELECT *, CASE WHEN weather IS DISTINCT FROM lag(weather) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM obs WINDOW w AS (PARTITION BY station ORDER BY obs_time, event_id)), r AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY station ORDER BY obs_time, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_no FROM c) SELECT station, run_no, min(obs_time) AS start, max(weather) AS weather, count(*) AS n FROM r GROUP BY ALL"),
    "w12_merge_spans": (w12_merge_spans, f"{_O}, s AS (SELECT station, obs_time AS a, obs_time + INTERVAL 12 HOUR AS b FROM obs WHERE report_type = 'SPECI'), f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY station ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s), n AS (SELECT *, sum(fresh) OVER (PARTITION BY station ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS no FROM f) SELECT station, min(a) AS start, max(b) AS \"end\", count(*) AS n_spans FROM n GROUP BY station, no"),
    "w14_running_total": (w14_running_total, f"{_O}, d AS (SELECT station, CAST(obs_time AS DATE) AS day, round(sum(value), 4) AS usd FROM obs GROUP BY ALL) SELECT station, day, round(sum(usd) OVER (PARTITION BY station ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS running FROM d"),
    "w15_thin_profile": (w15_thin_profile, "WITH RECURSIVE lv AS (SELECT DISTINCT l_suppkey AS s, l_quantity AS q FROM lineitem), k(s, v) AS (SELECT s, max(q) FROM lv GROUP BY 1 UNION ALL SELECT k.s, max(q) FROM k JOIN lv ON lv.s = k.s AND k.v - q >= CASE WHEN q > 35 THEN 5 ELSE 8 END GROUP BY k.s, k.v) SELECT s AS l_suppkey, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY v DESC) AS kept FROM k GROUP BY 1"),
    "w16_running_max": (w16_running_max, f"{_T}, e AS (SELECT *, issue + CASE WHEN kind = 'AMD' THEN INTERVAL 400 DAY ELSE INTERVAL 0 DAY END AS eff FROM tafs) SELECT taf_id, max(eff) OVER (PARTITION BY station ORDER BY issue, taf_id ROWS UNBOUNDED PRECEDING) AS effective FROM e"),
    "w06_intervals_and_gaps": (w06_intervals_and_gaps, f"{_O}, {_IV} SELECT event_id, start, \"end\", is_gap FROM st WHERE start < \"end\""),
    "w07_change_points": (w07_change_points, f"{_T} SELECT taf_id, issue AS start, coalesce(lead(issue) OVER (PARTITION BY station ORDER BY issue, taf_id), TIMESTAMP '2002-01-01') AS \"end\" FROM tafs"),
    "j11_nearest_capture": (j11_nearest_capture, f"{_O}, w AS (SELECT station, obs_time, event_id FROM obs WHERE corrected), h AS (SELECT station, obs_time AS seen FROM obs WHERE report_type = 'SPECI'), p AS (SELECT w.event_id AS want_id, seen AS \"at\" FROM w LEFT JOIN h ON w.station = h.station AND abs(epoch_us(seen) - epoch_us(obs_time)) <= 172800000000 QUALIFY row_number() OVER (PARTITION BY w.event_id ORDER BY abs(epoch_us(seen) - epoch_us(obs_time)), seen DESC) = 1) SELECT * FROM p"),
    "j12_asof_backward": (j12_asof_backward, f"{_O}, r AS (SELECT station, obs_time AS seen, event_id FROM obs WHERE NOT corrected) SELECT l.event_id AS taf, r.event_id AS ob FROM (SELECT * FROM obs WHERE corrected) l LEFT JOIN r ON r.station = l.station AND seen < obs_time AND seen >= obs_time - INTERVAL 90 MINUTE QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY seen DESC, r.event_id DESC) = 1"),
    "j14_latest_correction": (j14_latest_correction, f"{_T} SELECT station, kind, issue, taf_id, value FROM tafs QUALIFY row_number() OVER (PARTITION BY station, kind ORDER BY issue DESC, taf_id DESC) = 1"),
    "j15_amendments_in_validity": (j15_amendments_in_validity, f"{_T} SELECT r.taf_id AS routine, a.taf_id FROM tafs r JOIN tafs a ON r.station = a.station AND r.kind = 'TAF' AND a.kind <> 'TAF' AND a.issue >= r.issue AND a.issue < r.issue + INTERVAL 90 DAY"),
    "j17_hours_of_intervals": (j17_hours_of_intervals, f"{_O}, {_IV}, h AS (SELECT station, start, \"end\", unnest(range(date_trunc('hour', start), \"end\", INTERVAL 1 HOUR)) AS hour FROM st WHERE NOT is_gap AND start < \"end\") SELECT station, hour, count(*) AS n, round(sum((epoch_us(least(\"end\", hour + INTERVAL 1 HOUR)) - epoch_us(greatest(start, hour))) / 1e6), 3) AS seconds FROM h GROUP BY ALL"),
    "j18_overlaps": (j18_overlaps, f"{_O}, a AS (SELECT station, event_id, obs_time AS s, obs_time + INTERVAL 5 HOUR AS e FROM obs WHERE report_type = 'SPECI'), b AS (SELECT station, event_id, obs_time AS s, obs_time + INTERVAL 3 HOUR AS e FROM obs WHERE corrected) SELECT a.event_id AS a, b.event_id AS b, greatest(a.s, b.s) AS start, least(a.e, b.e) AS \"end\" FROM a JOIN b ON a.station = b.station AND a.s < b.e AND b.s < a.e"),
    "j24_snap_to_hour": (j24_snap_to_hour, f"{_O} SELECT station, date_trunc('hour', obs_time + INTERVAL 30 MINUTE) AS hour, event_id FROM obs QUALIFY row_number() OVER (PARTITION BY station, date_trunc('hour', obs_time + INTERVAL 30 MINUTE) ORDER BY report_type <> 'METAR', obs_time, event_id) = 1"),
    "j26_range_minimum": (j26_range_minimum, f"{_O} SELECT g.event_id AS grp, min(o.altimeter) AS qnh, count(*) AS n FROM obs g JOIN obs o ON g.station = o.station AND g.corrected AND o.obs_time >= g.obs_time AND o.obs_time < g.obs_time + INTERVAL 6 HOUR GROUP BY 1"),
    "j27_matched_hours_skill": (j27_matched_hours_skill, f"{_O}, s AS (SELECT station, hour(obs_time) AS hr, avg(abs(temp_c - 12)) AS s FROM obs WHERE report_type = 'METAR' GROUP BY ALL), b AS (SELECT station, hour(obs_time) AS hr, avg(abs(temp_c - 10)) AS b FROM obs WHERE report_type = 'SPECI' GROUP BY ALL) SELECT station, count(*) AS n, round(1 - avg(s) / nullif(avg(b), 0), 6) AS skill FROM s JOIN b USING (station, hr) GROUP BY 1"),
    "r02_pivot_runs": (r02_pivot_runs, f"{_C}, p AS (SELECT loc_id, variable, round(avg(value) FILTER (WHERE model = 'A'), 6) AS \"A\", round(avg(value) FILTER (WHERE model = 'N'), 6) AS \"N\", round(avg(value) FILTER (WHERE model = 'R'), 6) AS \"R\" FROM cube_ GROUP BY ALL) SELECT *, round(greatest(\"A\", \"N\", \"R\") - least(\"A\", \"N\", \"R\"), 6) AS spread FROM p"),
    "r04_melt": (r04_melt, f"{_O} SELECT variable, count(*) AS n, sum(v) AS total FROM (SELECT 'gust' AS variable, CAST(gust AS DOUBLE) AS v FROM obs UNION ALL SELECT 'ceiling', CAST(ceiling_ft AS DOUBLE) FROM obs UNION ALL SELECT 'vis', CAST(vis_m AS DOUBLE) FROM obs) WHERE v IS NOT NULL GROUP BY 1"),
    "r05_profiles": (r05_profiles, "WITH l AS (SELECT l_suppkey, l_linenumber, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS t, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS rh FROM lineitem GROUP BY ALL) SELECT l_suppkey, count(*) AS n_levels, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS levels FROM l WHERE t IS NOT NULL AND rh IS NOT NULL GROUP BY 1 HAVING count(*) >= 3"),
    "r12_chunks": (r12_chunks, "SELECT p_brand, CAST(ceil(count(*) / 500) AS BIGINT) AS chunks, CAST(count(DISTINCT p_size) * ceil(count(*) / 500) AS BIGINT) AS credits FROM part GROUP BY 1"),
    "r14_request_expansion": (r14_request_expansion, f"{_T}, r AS (SELECT DISTINCT station, issue FROM tafs), p AS (SELECT station, greatest(issue, TIMESTAMP '1996-01-01') AS a, least(coalesce(lead(issue) OVER (PARTITION BY station ORDER BY issue), issue + INTERVAL 10 DAY), issue + INTERVAL 10 DAY) AS b FROM r), v AS (SELECT station, unnest(range(a, b, INTERVAL 1 DAY)) AS valid FROM p WHERE a < b) SELECT station, count(*) AS n, min(valid) AS first, max(valid) AS last FROM v GROUP BY 1"),
}
