"""Simple readers: filters, orders, set operations, key joins, counts (F, S, U, J04-J10, A01-A17)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wxspark.operators.asof import latest_at_key, micros
from wxspark.sources.tables import CUBE_SQL, OBS_SQL, TAFS_SQL, cube, obs, read, tafs

DAY1, DAY2 = "2024-01-10 00:00:00", "2024-01-12 00:00:00"


def _ts(text):
    return F.lit(text).cast("timestamp_ntz")


def f01_newest_first(spark, d, station=7, n=25):
    """A station's newest reports (the limit is the feature)."""
    return obs(spark, d).where(F.col("station") == station).orderBy(F.desc("obs_time"), F.desc("event_id")).limit(n).select("station", "obs_time", "event_id", "value")


def f02_inclusive_window(spark, d):
    return obs(spark, d).where(F.col("obs_time").between(_ts(DAY1), _ts(DAY2))).select("event_id", "obs_time")


def f03_half_open_window(spark, d):
    return obs(spark, d).where((F.col("obs_time") >= _ts(DAY1)) & (F.col("obs_time") < _ts(DAY2))).select("event_id", "obs_time")


def f04_in_list(spark, d):
    return cube(spark, d).where(F.col("variable").isin("F") & F.col("model").isin("A", "R")).groupBy("model", "variable").agg(F.count("*").alias("n"))


def f05_tuple_in_values(spark, d):
    """pairs of rounded coordinates, as a semi join with a literal relation."""
    wanted = spark.createDataFrame([(1, 0.1), (2, 0.05), (3, 0.0)], "line int, rate double")
    lines = read(spark, d, "lineitem").withColumn("rate", F.round("l_discount", 4))
    return lines.join(F.broadcast(wanted), (F.col("l_linenumber") == F.col("line")) & (lines["rate"] == wanted["rate"]), "left_semi").groupBy("l_linenumber").agg(F.count("*").alias("n"))


def f07_prefix(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_type").startswith("STANDARD").alias("standard")).agg(F.count("*").alias("n"))


def f08_weather_substring(spark, d):
    """substring semantics; a null weather counts as 0."""
    w = F.col("weather")
    flag = lambda p: F.sum(F.when(w.rlike(p), 1).otherwise(0)).cast("long")
    return obs(spark, d).groupBy("station").agg(flag("FG|BR").alias("fog"), flag("TS").alias("ts"), flag("RA").alias("rain"))


def f09_optional_predicate(spark, d, kind=None, status="F"):
    """a predicate is added only where its argument is given."""
    found = tafs(spark, d)
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    if status is not None:
        found = found.where(F.col("status") == status)
    return found.groupBy("kind").agg(F.count("*").alias("n"))


def f10_status_and_elapsed(spark, d):
    return tafs(spark, d).where(F.col("status").isin("O", "P") & (F.col("issue") + F.expr("interval 30 hours") <= _ts("1998-01-01"))).select("taf_id", "status", "issue")


def f11_existence(spark, d):
    """customers with an amendment, as a semi join."""
    c = read(spark, d, "customer").select("c_custkey")
    return c.join(tafs(spark, d).where("kind = 'AMD'").select("station"), F.col("c_custkey") == F.col("station"), "left_semi")


def f12_local_month_utc_hour(spark, d):
    """membership by local month (offset +5.5 h) while the hour stays UTC."""
    local = F.month(F.col("obs_time") + F.expr("interval 330 minutes"))
    return obs(spark, d).where(local.isin(1)).groupBy(F.hour("obs_time").alias("hr")).agg(F.count("*").alias("n"))


def f13_first_box(spark, d):
    """the first of ordered boxes that holds a point."""
    v, t = F.col("wind_dir"), F.col("temp_c")
    box = F.when(v.between(0, 90) & t.between(-10, 10), "a").when(v.between(45, 200) & t.between(0, 30), "b").when(t >= 20, "c").otherwise("none")
    return obs(spark, d).groupBy(box.alias("box")).agg(F.count("*").alias("n"))


def f14_not_superseded(spark, d):
    """rows of a place at or after its newest run."""
    w = W.partitionBy("loc_id", "model")
    return cube(spark, d).withColumn("top", F.max("run").over(w)).where(F.col("valid_time") >= F.col("top")).select("loc_id", "model", "valid_time", "l_orderkey", "member")


def f15_domain_pruning(spark, d):
    """only places that a model covers."""
    cover = spark.createDataFrame([("A", 1, 40), ("N", 20, 60), ("R", 90, 100)], "model string, lo long, hi long")
    c = cube(spark, d)
    return c.join(F.broadcast(cover), (c["model"] == cover["model"]) & F.col("loc_id").between(F.col("lo"), F.col("hi")), "left_semi").groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("loc_id").alias("n_loc"))


def f16_complete_profile(spark, d):
    """F16: profiles (here orders) whose smallest level reaches the bound."""
    p = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("levels"))
    return p.where(F.array_min("levels") <= 5).select("l_orderkey", F.size("levels").alias("n"), F.array_min("levels").alias("top"))


def f20_routine_elapsed(spark, d):
    return tafs(spark, d).where((F.col("kind") == "TAF") & (F.col("issue") < _ts("1996-01-01"))).select("taf_id", "station", "issue")


def s02_mixed_order(spark, d):
    """Rank by a custom order, unknown last, nulls last."""
    rank = F.coalesce(F.array_position(F.array(F.lit("COR"), F.lit("AMD")), F.col("kind")).cast("int"), F.lit(0))
    order = F.when(rank == 0, 9).otherwise(rank)
    w = W.partitionBy("status").orderBy(order, F.col("value").desc_nulls_last(), "taf_id")
    return tafs(spark, d).withColumn("rk", F.row_number().over(w)).where("rk <= 3").select("status", "rk", "taf_id", "kind")


def s05_snap(spark, d):
    """The offered step nearest to a target, ties to the first."""
    steps = F.array(*(F.lit(x) for x in (0, 6, 12, 24, 48)))
    pick = F.expr("array_min(transform(array(0, 6, 12, 24, 48), (s, i) -> named_struct('gap', abs(s - wind_speed), 'i', i, 's', s))).s")
    return obs(spark, d).withColumn("steps", steps).groupBy(pick.alias("step")).agg(F.count("*").alias("n"))


def u01_carry_in_window_terminator(spark, d):
    """The last report before a window, those inside and the first after it; the union drops repeats."""
    o = obs(spark, d).select("station", "obs_time", "event_id")
    before = latest_at_key(o.where(F.col("obs_time") <= _ts(DAY1)), ["station"], [F.col("obs_time"), F.col("event_id")])
    inside = o.where((F.col("obs_time") >= _ts(DAY1)) & (F.col("obs_time") < _ts(DAY2)))
    after = o.where(F.col("obs_time") >= _ts(DAY2)).groupBy("station").agg(F.min(F.struct("obs_time", "event_id")).alias("m")).select("station", "m.*")
    return before.unionByName(inside).unionByName(after).distinct()


def u02_padded_union(spark, d):
    a = obs(spark, d).where("report_type = 'SPECI'").select("station", "event_id", "gust")
    b = obs(spark, d).where("corrected").select("station", "event_id", "ceiling_ft")
    return a.unionByName(b, allowMissingColumns=True).select("station", "event_id", "gust", "ceiling_ft")


def u03_union_first_name(spark, d):
    """Two lists, a key's first name kept."""
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.lit(0).alias("src"))
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.lit(1).alias("src"))
    return s.union(c).groupBy("k").agg(F.min_by("name", F.struct("src", "name")).alias("name"))


def u04_matched_hours(spark, d):
    h = lambda t: obs(spark, d).where(F.col("report_type") == t).select("station", F.hour("obs_time").alias("hr"))
    return h("METAR").intersect(h("SPECI"))


def u05_class_sets(spark, d):
    """Set operations on weather classes."""
    f, o = F.split("weather", " "), F.array(F.lit("BR"), F.lit("RA"))
    return obs(spark, d).where("weather is not null").groupBy(
        F.array_join(F.array_sort(F.array_intersect(f, o)), ",").alias("hit"), F.array_join(F.array_sort(F.array_except(f, o)), ",").alias("extra"), (F.size(F.array_except(f, o)) == 0).alias("subset"),
    ).agg(F.count("*").alias("n"))


def u07_diff(spark, d):
    """U07, SK14: committed against recomputed, both ways."""
    a = read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    b = a.withColumn("n_regionkey", F.when(F.col("n_nationkey") % 7 == 0, 9).otherwise(F.col("n_regionkey")))
    return a.exceptAll(b).withColumn("side", F.lit("gone")).union(b.exceptAll(a).withColumn("side", F.lit("new")))


def j04_star(spark, d):
    """Tall rows to runs to evaluations, pooled earned over available; inner joins only."""
    l, o, c = (read(spark, d, t) for t in ("lineitem", "orders", "customer"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    earned = F.sum(F.col("l_quantity") * F.col("l_discount"))
    return j.groupBy("c_mktsegment", "l_returnflag").agg(F.count("*").alias("n"), F.round(earned, 4).alias("earned"), F.round(F.sum("l_quantity"), 4).alias("available"), F.round(100 * earned / F.sum("l_quantity"), 6).alias("pct"))


def j05_star_left(spark, d):
    """The star with an optional last leg."""
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


def j06_derived_key(spark, d):
    """A join on a part of an id."""
    r = read(spark, d, "orders").withColumn("evaluation_id", F.concat(F.lit("archdiff:"), "o_orderkey")).withColumn("key", F.substring("evaluation_id", 10, 99))
    t = tafs(spark, d).where("kind = 'COR'").withColumn("key", F.col("taf_id").cast("string"))
    return r.join(t, "key").groupBy("station").agg(F.count("*").alias("n"))


def j09_manifest(spark, d):
    """Manifest to keys to blobs, both left."""
    m = read(spark, d, "nation").select("n_nationkey", "n_name")
    k = read(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey").where("s_acctbal > 5000")
    b = read(spark, d, "region").select(F.col("r_regionkey").alias("blob"), "r_name")
    return m.join(k, "n_nationkey", "left").withColumn("blob", (F.col("s_suppkey") % 9).cast("int")).join(F.broadcast(b), "blob", "left").select("n_nationkey", "s_suppkey", "r_name")


def j28_paired_gap(spark, d):
    """One subject against another by evaluation, mean gap, its error and verdict."""
    per = cube(spark, d).where("model in ('A','N')").groupBy("loc_id").pivot("model", ["A", "N"]).agg(F.avg("value"))
    gap = per.where("A is not null and N is not null").select((F.col("A") - F.col("N")).alias("g"))
    se = F.stddev_samp("g") / F.sqrt(F.count("g"))
    out = gap.agg(F.count("*").alias("n"), F.avg("g").alias("m"), se.alias("s"))
    verdict = F.when(F.abs("m") > 2 * F.col("s"), "clear").when(F.abs("m") > F.col("s"), "lean").otherwise("tie")
    return out.select("n", F.round("m", 6).alias("gap"), F.round("s", 6).alias("se"), verdict.alias("verdict"))


def j30_anti(spark, d):
    """Parts never delivered late in the data's last years."""
    used = read(spark, d, "lineitem").where(F.col("l_shipdate") >= _ts("2000-06-01")).select("l_partkey")
    return read(spark, d, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_brand")


def a01_counts(spark, d):
    return obs(spark, d).groupBy("station", "report_type").agg(F.count("*").alias("n"), F.min("obs_time").alias("first"), F.max("obs_time").alias("last"))


def a08_models_by_place(spark, d):
    """The distinct models of a place as text."""
    return cube(spark, d).groupBy("loc_id").agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.countDistinct("run").alias("n_runs"), F.max("run").alias("newest"))


def a10_versions(spark, d):
    """Distinct values by length, then text."""
    v = read(spark, d, "part").select("p_brand").distinct()
    return v.select("p_brand", F.length("p_brand").alias("size")).orderBy("size", "p_brand")


def a12_by_element(spark, d):
    return cube(spark, d).groupBy("loc_id", "model", "variable").agg(F.round(F.sum("price"), 2).alias("earned"), F.sum("value").alias("available"), F.count("*").alias("n"))


def a13_lead_hours(spark, d):
    """Lead bins of ten days, the last one holds what lies beyond."""
    lead = (micros("valid_time") - micros("run")) / 86400000000
    bin_ = F.least(F.floor(lead / 10), F.lit(9)).cast("long")
    return cube(spark, d).groupBy(bin_.alias("lead_bin"), "model").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def a14_coverage_split(spark, d):
    """Errors where both sides are known, and how many rows aren't."""
    err = F.col("ceiling_ft") - F.col("vis_m")
    return obs(spark, d).groupBy("station").agg(F.count(err).alias("n_scored"), F.sum(F.when(err.isNull(), 1).otherwise(0)).cast("long").alias("n_unavailable"), F.round(F.avg(err), 6).alias("bias"), F.round(F.avg(F.abs(err)), 6).alias("mae"))


def a17_archive_stats(spark, d):
    """Counts, sum and a ratio guarded against zero."""
    p = read(spark, d, "pages")
    return p.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes"), F.countDistinct("html").alias("n_blobs"), F.round(F.try_divide(F.count("*"), F.countDistinct("html")), 6).alias("ratio"))


_D1, _D2 = f"TIMESTAMP '{DAY1}'", f"TIMESTAMP '{DAY2}'"
QUERIES = {
    "f01_newest_first": (f01_newest_first, f"WITH {OBS_SQL} SELECT station, obs_time, event_id, value FROM obs WHERE station = 7 ORDER BY obs_time DESC, event_id DESC LIMIT 25"),
    "f02_inclusive_window": (f02_inclusive_window, f"WITH {OBS_SQL} SELECT event_id, obs_time FROM obs WHERE obs_time BETWEEN {_D1} AND {_D2}"),
    "f03_half_open_window": (f03_half_open_window, f"WITH {OBS_SQL} SELECT event_id, obs_time FROM obs WHERE obs_time >= {_D1} AND obs_time < {_D2}"),
    "f04_in_list": (f04_in_list, f"WITH {CUBE_SQL} SELECT model, variable, count(*) AS n FROM cube_ WHERE variable IN ('F') AND model IN ('A', 'R') GROUP BY ALL"),
    "f05_tuple_in_values": (f05_tuple_in_values, "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE (l_linenumber, round(l_discount, 4)) IN (VALUES (1, 0.1::DOUBLE), (2, 0.05::DOUBLE), (3, 0.0::DOUBLE)) GROUP BY 1"),
    "f07_prefix": (f07_prefix, "SELECT p_type LIKE 'STANDARD%' AS standard, count(*) AS n FROM part GROUP BY 1"),
    "f08_weather_substring": (f08_weather_substring, f"WITH {OBS_SQL} SELECT station, CAST(sum(CASE WHEN regexp_matches(weather, 'FG|BR') THEN 1 ELSE 0 END) AS BIGINT) AS fog, CAST(sum(CASE WHEN regexp_matches(weather, 'TS') THEN 1 ELSE 0 END) AS BIGINT) AS ts, CAST(sum(CASE WHEN regexp_matches(weather, 'RA') THEN 1 ELSE 0 END) AS BIGINT) AS rain FROM obs GROUP BY 1"),
    "f09_optional_predicate": (f09_optional_predicate, f"WITH {TAFS_SQL} SELECT kind, count(*) AS n FROM tafs WHERE status = 'F' GROUP BY 1"),
    "f10_status_and_elapsed": (f10_status_and_elapsed, f"WITH {TAFS_SQL} SELECT taf_id, status, issue FROM tafs WHERE status IN ('O', 'P') AND issue + INTERVAL 30 HOUR <= TIMESTAMP '1998-01-01'"),
    "f11_existence": (f11_existence, f"WITH {TAFS_SQL} SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM tafs WHERE kind = 'AMD' AND station = c_custkey)"),
    "f12_local_month_utc_hour": (f12_local_month_utc_hour, f"WITH {OBS_SQL} SELECT CAST(hour(obs_time) AS INTEGER) AS hr, count(*) AS n FROM obs WHERE month(obs_time + INTERVAL 330 MINUTE) IN (1) GROUP BY 1"),
    "f13_first_box": (f13_first_box, f"WITH {OBS_SQL} SELECT CASE WHEN wind_dir BETWEEN 0 AND 90 AND temp_c BETWEEN -10 AND 10 THEN 'a' WHEN wind_dir BETWEEN 45 AND 200 AND temp_c BETWEEN 0 AND 30 THEN 'b' WHEN temp_c >= 20 THEN 'c' ELSE 'none' END AS box, count(*) AS n FROM obs GROUP BY 1"),
    "f14_not_superseded": (f14_not_superseded, f"WITH {CUBE_SQL} SELECT loc_id, model, valid_time, l_orderkey, member FROM cube_ QUALIFY valid_time >= max(run) OVER (PARTITION BY loc_id, model)"),
    "f15_domain_pruning": (f15_domain_pruning, f"WITH {CUBE_SQL} SELECT model, count(*) AS n, count(DISTINCT loc_id) AS n_loc FROM cube_ WHERE EXISTS (SELECT 1 FROM (VALUES ('A', 1, 40), ('N', 20, 60), ('R', 90, 100)) v(m, lo, hi) WHERE m = model AND loc_id BETWEEN lo AND hi) GROUP BY 1"),
    "f16_complete_profile": (f16_complete_profile, "SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, min(l_quantity) AS top FROM lineitem GROUP BY 1 HAVING min(l_quantity) <= 5"),
    "f20_routine_elapsed": (f20_routine_elapsed, f"WITH {TAFS_SQL} SELECT taf_id, station, issue FROM tafs WHERE kind = 'TAF' AND issue < TIMESTAMP '1996-01-01'"),
    "s02_mixed_order": (s02_mixed_order, f"WITH {TAFS_SQL} SELECT status, CAST(rk AS INTEGER) AS rk, taf_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY CASE kind WHEN 'COR' THEN 1 WHEN 'AMD' THEN 2 ELSE 9 END, value DESC NULLS LAST, taf_id) AS rk FROM tafs) WHERE rk <= 3"),
    "s05_snap": (s05_snap, f"WITH {OBS_SQL}, s AS (SELECT event_id, u.s, u.i, abs(u.s - wind_speed) AS gap FROM obs, (VALUES (0, 0), (6, 1), (12, 2), (24, 3), (48, 4)) u(s, i)), p AS (SELECT s FROM s QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap, i) = 1) SELECT CAST(s AS INTEGER) AS step, count(*) AS n FROM p GROUP BY 1"),
    "u01_carry_in_window_terminator": (u01_carry_in_window_terminator, f"WITH {OBS_SQL}, o AS (SELECT station, obs_time, event_id FROM obs) (SELECT * FROM o WHERE obs_time <= {_D1} QUALIFY row_number() OVER (PARTITION BY station ORDER BY obs_time DESC, event_id DESC) = 1) UNION (SELECT * FROM o WHERE obs_time >= {_D1} AND obs_time < {_D2}) UNION (SELECT * FROM o WHERE obs_time >= {_D2} QUALIFY row_number() OVER (PARTITION BY station ORDER BY obs_time, event_id) = 1)"),
    "u02_padded_union": (u02_padded_union, f"WITH {OBS_SQL} SELECT station, event_id, gust, NULL::BIGINT AS ceiling_ft FROM obs WHERE report_type = 'SPECI' UNION ALL SELECT station, event_id, NULL, ceiling_ft FROM obs WHERE corrected"),
    "u03_union_first_name": (u03_union_first_name, "SELECT k, name FROM (SELECT s_nationkey AS k, s_name AS name, 0 AS src FROM supplier UNION ALL SELECT c_nationkey, c_name, 1 FROM customer) QUALIFY row_number() OVER (PARTITION BY k ORDER BY src, name) = 1"),
    "u04_matched_hours": (u04_matched_hours, f"WITH {OBS_SQL} SELECT station, CAST(hour(obs_time) AS INTEGER) AS hr FROM obs WHERE report_type = 'METAR' INTERSECT SELECT station, CAST(hour(obs_time) AS INTEGER) FROM obs WHERE report_type = 'SPECI'"),
    "u05_class_sets": (u05_class_sets, f"WITH {OBS_SQL}, w AS (SELECT string_split(weather, ' ') AS f FROM obs WHERE weather IS NOT NULL) SELECT array_to_string(list_sort(list_filter(f, lambda x: x IN ('BR', 'RA'))), ',') AS hit, array_to_string(list_sort(list_filter(f, lambda x: x NOT IN ('BR', 'RA'))), ',') AS extra, len(list_filter(f, lambda x: x NOT IN ('BR', 'RA'))) = 0 AS subset, count(*) AS n FROM w GROUP BY ALL"),
    "u07_diff": (u07_diff, "WITH a AS (SELECT n_nationkey, n_regionkey FROM nation), b AS (SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN 9 ELSE n_regionkey END AS n_regionkey FROM a) SELECT *, 'gone' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'new' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"),
    "j04_star": (j04_star, "SELECT c_mktsegment, l_returnflag, count(*) AS n, round(sum(l_quantity * l_discount), 4) AS earned, round(sum(l_quantity), 4) AS available, round(100 * sum(l_quantity * l_discount) / sum(l_quantity), 6) AS pct FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL"),
    "j05_star_left": (j05_star_left, "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "j06_derived_key": (j06_derived_key, f"WITH {TAFS_SQL}, r AS (SELECT 'archdiff:' || o_orderkey AS evaluation_id FROM orders) SELECT station, count(*) AS n FROM r JOIN tafs ON CAST(taf_id AS VARCHAR) = substr(evaluation_id, 10) WHERE kind = 'COR' GROUP BY 1"),
    "j09_manifest": (j09_manifest, "SELECT n_nationkey, s_suppkey, r_name FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON s_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = s_suppkey % 9"),
    "j28_paired_gap": (j28_paired_gap, f"WITH {CUBE_SQL}, p AS (SELECT loc_id, avg(value) FILTER (WHERE model = 'A') - avg(value) FILTER (WHERE model = 'N') AS g FROM cube_ GROUP BY 1), x AS (SELECT count(g) AS n, avg(g) AS m, stddev_samp(g) / sqrt(count(g)) AS s FROM p WHERE g IS NOT NULL) SELECT n, round(m, 6) AS gap, round(s, 6) AS se, CASE WHEN abs(m) > 2 * s THEN 'clear' WHEN abs(m) > s THEN 'lean' ELSE 'tie' END AS verdict FROM x"),
    "j30_anti": (j30_anti, "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-06-01')"),
    "a01_counts": (a01_counts, f"WITH {OBS_SQL} SELECT station, report_type, count(*) AS n, min(obs_time) AS first, max(obs_time) AS last FROM obs GROUP BY ALL"),
    "a08_models_by_place": (a08_models_by_place, f"WITH {CUBE_SQL} SELECT loc_id, string_agg(DISTINCT model, ',' ORDER BY model) AS models, count(DISTINCT run) AS n_runs, max(run) AS newest FROM cube_ GROUP BY 1"),
    "a10_versions": (a10_versions, "SELECT DISTINCT p_brand, CAST(length(p_brand) AS INTEGER) AS size FROM part"),
    "a12_by_element": (a12_by_element, f"WITH {CUBE_SQL} SELECT loc_id, model, variable, round(sum(price), 2) AS earned, sum(value) AS available, count(*) AS n FROM cube_ GROUP BY ALL"),
    "a13_lead_hours": (a13_lead_hours, f"WITH {CUBE_SQL} SELECT CAST(least(floor((epoch_us(valid_time) - epoch_us(run)) / 86400000000.0 / 10), 9) AS BIGINT) AS lead_bin, model, count(*) AS n, round(avg(value), 6) AS mean_value FROM cube_ GROUP BY ALL"),
    "a14_coverage_split": (a14_coverage_split, f"WITH {OBS_SQL}, e AS (SELECT station, ceiling_ft - vis_m AS err FROM obs) SELECT station, count(err) AS n_scored, count(*) - count(err) AS n_unavailable, round(avg(err), 6) AS bias, round(avg(abs(err)), 6) AS mae FROM e GROUP BY 1"),
    "a17_archive_stats": (a17_archive_stats, "SELECT count(*) AS n, CAST(coalesce(sum(strlen(html)), 0) AS BIGINT) AS bytes, count(DISTINCT html) AS n_blobs, round(count(*) / nullif(count(DISTINCT html), 0), 6) AS ratio FROM pages"),
}
