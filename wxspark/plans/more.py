"""Category and class biases, extremes, graders, frames, gaps: the rest of the inventory that SQL can express."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wxspark.functions import weather as wx
from wxspark.operators import intervals
from wxspark.operators.asof import micros
from wxspark.plans.scores import _PAIRS_SQL, _pairs
from wxspark.sources.tables import OBS_SQL, obs, read


def a32_category_bias(spark, d):
    """Hours forecast over hours observed by category; a category never observed has no bias."""
    p = _pairs(spark, d)
    cat = lambda c: F.coalesce(wx.ladder(F.col(c), wx.CEILING_STEPS, "E"), F.lit("E"))
    f = p.groupBy(cat("ceiling_ft").alias("cat")).agg(F.count("*").alias("f"), F.count_if(cat("ceiling_ft") == cat("o_ceiling_ft")).alias("hit"))
    o = p.groupBy(cat("o_ceiling_ft").alias("cat")).agg(F.count("*").alias("o"))
    return f.join(o, "cat", "full").select("cat", F.coalesce("f", F.lit(0)).alias("f"), F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("hit", F.lit(0)).alias("hit"), F.round(F.try_divide(F.col("f"), F.col("o")), 6).alias("bias"))


def a33_class_bias(spark, d):
    """Weather classes of both sides, exploded and counted."""
    p = _pairs(spark, d)
    side = lambda c, s: p.select(F.explode(F.split(c, " ")).alias("cls")).groupBy("cls").agg(F.count("*").alias(s))
    return side("weather", "f").join(side("o_weather", "o"), "cls", "full").select("cls", F.coalesce("f", F.lit(0)).alias("f"), F.coalesce("o", F.lit(0)).alias("o"), F.round(F.try_divide(F.col("f"), F.col("o")), 6).alias("bias"))


def a42_outcomes(spark, d):
    """Outcomes over all runs and means by cell."""
    n = lambda s: F.count_if(F.col("o_orderstatus") == s).alias(s)
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(n("F"), n("O"), n("P"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


def a52_extremes(spark, d):
    """The largest and smallest value and when each was first seen."""
    return obs(spark, d).groupBy("station").agg(
        F.max("temp_c").alias("tx"), F.min(F.struct((-F.col("temp_c")).alias("k"), "obs_time")).alias("a"), F.min("temp_c").alias("tn"), F.min(F.struct(F.col("temp_c").alias("k"), "obs_time")).alias("b"),
    ).select("station", "tx", F.col("a.obs_time").alias("tx_time"), "tn", F.col("b.obs_time").alias("tn_time"))


def a53_arm_errors(spark, d):
    """Absolute error by model and arm, arms side by side."""
    l = read(spark, d, "lineitem")
    return l.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.avg(F.abs(F.col("l_quantity") - 25)), 6))


def a54_relief(spark, d):
    """Relief, the dominant difference by sector and a vote, out of sampled values."""
    s = obs(spark, d).select("station", F.floor(F.col("wind_dir") / 45).cast("int").alias("az"), (F.coalesce(F.col("ceiling_ft"), F.lit(0)) - 2500).alias("delta"))
    per = s.groupBy("station", "az").agg(F.max(F.struct(F.abs("delta").alias("k"), "delta")).alias("m"))
    g = per.groupBy("station").agg((F.max("m.delta") - F.min("m.delta")).alias("relief"), F.count_if(F.col("m.delta") > 0).alias("up"), F.count("*").alias("n"))
    return g.select("station", "relief", F.when(F.col("up") * 2 > F.col("n"), "valley").when(F.col("up") * 2 < F.col("n"), "ridge").otherwise("slope").alias("landform"))


def j32_nearest_guarded(spark, d):
    """The nearest of a literal roster within a distance, else none."""
    roster = spark.createDataFrame([("a", 10.0, 20.0), ("b", -40.0, 100.0), ("c", 50.0, -120.0)], "site string, rlat double, rlon double")
    s = read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 120 - 60).cast("double").alias("lat"), (F.col("s_suppkey") * 53 % 300 - 150).cast("double").alias("lon"))
    km = wx.distance_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon"))
    best = s.crossJoin(F.broadcast(roster)).withColumn("km", km).groupBy("s_suppkey").agg(F.min(F.struct(F.round("km", 6).alias("km"), "site")).alias("m"))  # a roster of three rows
    return best.select("s_suppkey", F.when(F.col("m.km") <= 5000, F.col("m.site")).alias("site"))


def s08_circular_hour(spark, d):
    """The synoptic hour nearest on the clock, the earlier of equals."""
    h = F.hour("obs_time")
    pick = F.expr("array_min(transform(array(0, 6, 12, 18), s -> named_struct('g', least(pmod(h - s, 24), 24 - pmod(h - s, 24)), 's', s))).s")
    return obs(spark, d).withColumn("h", h).groupBy(pick.alias("syn")).agg(F.count("*").alias("n"))


def w13_early_and_persisting(spark, d):
    """Runs of low visibility that last, from first to last report, half an hour or more."""
    e = intervals.islands(obs(spark, d).withColumn("low", F.coalesce(F.col("vis_m") < 6000, F.lit(False))), ["station"], ["obs_time", "event_id"], "low")
    g = e.groupBy("station", "island").agg((micros(F.max("obs_time")) - micros(F.min("obs_time"))).alias("us"), F.min("obs_time").alias("start"))
    return g.where("us >= 1800000000").select("station", "start", F.round(F.col("us") / 1e6, 3).alias("seconds"))


def w18_frames(spark, d):
    """Frames at anchor - k steps, snapped to captures within a tolerance, none twice."""
    o = obs(spark, d)
    anchor = o.groupBy("station").agg(F.max("obs_time").alias("anchor"))
    want = anchor.select("station", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.col("anchor") - F.make_dt_interval(F.lit(0), k.cast("int") * 12))).alias("k", "t"))
    near = want.join(o.select("station", "obs_time", "event_id"), "station").withColumn("gap", F.abs(micros("obs_time") - micros("t"))).where("gap <= 21600000000")
    best = near.groupBy("station", "k").agg(F.min(F.struct("gap", "event_id")).alias("m"))
    return best.groupBy("station", F.col("m.event_id").alias("event_id")).agg(F.min("k").alias("k"))


def x07_lead_bins(spark, d):
    """Six-hour bins, and three-hour bins whose last one takes the overflow."""
    h = F.hour("obs_time")
    return obs(spark, d).groupBy(F.floor(h / 6).cast("int").alias("six"), F.least(F.floor(h / 3), F.lit(5)).cast("int").alias("three")).agg(F.count("*").alias("n"))


def x37_weather_classes(spark, d):
    """Codes to classes: a code may have several; freezing changes rain and drizzle, thunder is a class beside its rain."""
    code = F.explode(F.split("weather", " ")).alias("code")
    c = obs(spark, d).where("weather is not null").select(code)
    return c.select(F.explode(wx.weather_classes(F.col("code"))).alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))


def x39_last_json(spark, d):
    """The last flat JSON object in free text, and one of its fields."""
    e = read(spark, d, "events").select("event_id", F.concat(F.lit('said {"k": 1} then '), "props", F.lit(" end")).alias("text"))
    last = F.element_at(F.regexp_extract_all("text", F.lit(r"(\{[^{}]*\})"), F.lit(1)), -1)
    return e.select("event_id", F.get_json_object(last, "$.k").cast("double").alias("k"))


def t10_chart_grader(spark, d):
    """Answers within a tolerance of the truth."""
    l = read(spark, d, "lineitem")
    hit = F.abs(F.round(F.col("l_quantity") / 5) * 5 - F.col("l_quantity")) <= 1
    return l.groupBy("l_linestatus").agg(F.count_if(hit).alias("hits"), F.count("*").alias("total"))


def t16_station_product(spark, d):
    """A roster's newest report, stations without one kept."""
    roster = read(spark, d, "customer").select(F.col("c_custkey").alias("station"))
    last = obs(spark, d).groupBy("station").agg(F.max(F.struct("obs_time", "event_id", "value")).alias("m"))
    return roster.join(last, "station", "left").select("station", "m.obs_time", "m.event_id", "m.value")


def t22_policy(spark, d):
    """Policy constants as a one-row relation with a hash in every row."""
    policy = spark.range(1).select(F.lit("v3").alias("version"), F.lit(3).alias("window_h"), F.sha2(F.lit('{"version": "v3", "window_h": 3}'), 256).alias("hash"))
    return read(spark, d, "region").crossJoin(F.broadcast(policy)).select("r_regionkey", "version", "window_h", F.substring("hash", 1, 12).alias("policy_id"))


_O = f"WITH {OBS_SQL}"
_K = lambda c: f"coalesce({wx.ladder_sql(c, wx.CEILING_STEPS, 'E')}, 'E')"
_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(rlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(rlat)) * pow(sin(radians(rlon - lon) / 2), 2))))"
QUERIES = {
    "a32_category_bias": (a32_category_bias, f"{_O}, {_PAIRS_SQL}, f AS (SELECT {_K('ceiling_ft')} AS cat, count(*) AS f, count(*) FILTER (WHERE {_K('ceiling_ft')} = {_K('o_ceiling_ft')}) AS hit FROM p GROUP BY 1), o AS (SELECT {_K('o_ceiling_ft')} AS cat, count(*) AS o FROM p GROUP BY 1) SELECT cat, coalesce(f, 0) AS f, coalesce(o, 0) AS o, coalesce(hit, 0) AS hit, round(f / nullif(o, 0), 6) AS bias FROM f FULL JOIN o USING (cat)"),
    "a33_class_bias": (a33_class_bias, f"{_O}, {_PAIRS_SQL}, f AS (SELECT cls, count(*) AS f FROM (SELECT unnest(string_split(weather, ' ')) AS cls FROM p) GROUP BY 1), o AS (SELECT cls, count(*) AS o FROM (SELECT unnest(string_split(o_weather, ' ')) AS cls FROM p) GROUP BY 1) SELECT cls, coalesce(f, 0) AS f, coalesce(o, 0) AS o, round(f / nullif(o, 0), 6) AS bias FROM f FULL JOIN o USING (cls)"),
    "a42_outcomes": (a42_outcomes, "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\", round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1"),
    "a52_extremes": (a52_extremes, f"{_O} SELECT station, max(temp_c) AS tx, list(obs_time ORDER BY temp_c DESC, obs_time)[1] AS tx_time, min(temp_c) AS tn, list(obs_time ORDER BY temp_c, obs_time)[1] AS tn_time FROM obs GROUP BY 1"),
    "a53_arm_errors": (a53_arm_errors, "SELECT l_returnflag, round(avg(abs(l_quantity - 25)) FILTER (WHERE l_linestatus = 'F'), 6) AS \"F\", round(avg(abs(l_quantity - 25)) FILTER (WHERE l_linestatus = 'O'), 6) AS \"O\" FROM lineitem GROUP BY 1"),
    "a54_relief": (a54_relief, f"{_O}, s AS (SELECT station, wind_dir // 45 AS az, coalesce(ceiling_ft, 0) - 2500 AS delta FROM obs), m AS (SELECT station, az, list(delta ORDER BY abs(delta) DESC, delta DESC)[1] AS delta FROM s GROUP BY ALL), g AS (SELECT station, max(delta) - min(delta) AS relief, count(*) FILTER (WHERE delta > 0) AS up, count(*) AS n FROM m GROUP BY 1) SELECT station, relief, CASE WHEN up * 2 > n THEN 'valley' WHEN up * 2 < n THEN 'ridge' ELSE 'slope' END AS landform FROM g"),
    "j32_nearest_guarded": (j32_nearest_guarded, f"WITH s AS (SELECT s_suppkey, CAST(s_suppkey * 37 % 120 - 60 AS DOUBLE) AS lat, CAST(s_suppkey * 53 % 300 - 150 AS DOUBLE) AS lon FROM supplier), p AS (SELECT s_suppkey, site, round({_KM}, 6) AS km FROM s, (VALUES ('a', 10.0::DOUBLE, 20.0::DOUBLE), ('b', -40.0::DOUBLE, 100.0::DOUBLE), ('c', 50.0::DOUBLE, -120.0::DOUBLE)) r(site, rlat, rlon)) SELECT s_suppkey, CASE WHEN km <= 5000 THEN site END AS site FROM p QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY km, site) = 1"),
    "s08_circular_hour": (s08_circular_hour, f"{_O}, x AS (SELECT event_id, s, least((hour(obs_time) - s + 24) % 24, 24 - (hour(obs_time) - s + 24) % 24) AS g FROM obs, (VALUES (0), (6), (12), (18)) v(s)), b AS (SELECT s FROM x QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY g, s) = 1) SELECT CAST(s AS INTEGER) AS syn, count(*) AS n FROM b GROUP BY 1"),
    "w13_early_and_persisting": (w13_early_and_persisting, f"{_O}, i AS (SELECT *, coalesce(vis_m < 6000, false) AS low, sum(CASE WHEN coalesce(vis_m < 6000, false) THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY obs_time, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM obs), g AS (SELECT station, isl, epoch_us(max(obs_time)) - epoch_us(min(obs_time)) AS us, min(obs_time) AS start FROM i WHERE low GROUP BY ALL) SELECT station, start, round(us / 1e6, 3) AS seconds FROM g WHERE us >= 1800000000"),
    "w18_frames": (w18_frames, f"{_O}, o AS (SELECT * FROM obs), w AS (SELECT station, k, max_t - to_hours(k * 12) AS t FROM (SELECT station, max(obs_time) AS max_t FROM o GROUP BY 1), range(6) r(k)), b AS (SELECT w.station, k, event_id FROM w JOIN o ON w.station = o.station AND abs(epoch_us(obs_time) - epoch_us(t)) <= 21600000000 QUALIFY row_number() OVER (PARTITION BY w.station, k ORDER BY abs(epoch_us(obs_time) - epoch_us(t)), event_id) = 1) SELECT station, event_id, CAST(min(k) AS INTEGER) AS k FROM b GROUP BY ALL"),
    "x07_lead_bins": (x07_lead_bins, f"{_O} SELECT CAST(hour(obs_time) // 6 AS INTEGER) AS six, CAST(least(hour(obs_time) // 3, 5) AS INTEGER) AS three, count(*) AS n FROM obs GROUP BY ALL"),
    "x37_weather_classes": (x37_weather_classes, f"{_O}, c AS (SELECT unnest(string_split(weather, ' ')) AS code FROM obs WHERE weather IS NOT NULL) SELECT cls, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(code, 'TS|SQ|FC|SS|DS|UP') THEN 'other' END, CASE WHEN regexp_matches(code, 'RA|DZ') THEN CASE WHEN code LIKE '%FZ%' THEN 'freezing' ELSE 'liquid' END END, CASE WHEN regexp_matches(code, 'SN|SG|IC|PL|GR|GS') THEN 'frozen' END, CASE WHEN regexp_matches(code, 'FG|BR|HZ|FU|VA|DU|SA|PY|PO') THEN 'obscuration' END], lambda x: x IS NOT NULL)) AS cls FROM c) GROUP BY 1"),
    "x39_last_json": (x39_last_json, "SELECT event_id, CAST(props->>'$.k' AS DOUBLE) AS k FROM events"),
    "t10_chart_grader": (t10_chart_grader, "SELECT l_linestatus, count(*) FILTER (WHERE abs(round(l_quantity / 5) * 5 - l_quantity) <= 1) AS hits, count(*) AS total FROM lineitem GROUP BY 1"),
    "t16_station_product": (t16_station_product, f"{_O}, l AS (SELECT station, obs_time, event_id, value FROM obs QUALIFY row_number() OVER (PARTITION BY station ORDER BY obs_time DESC, event_id DESC) = 1) SELECT c_custkey AS station, obs_time, event_id, value FROM customer LEFT JOIN l ON station = c_custkey"),
    "t22_policy": (t22_policy, "SELECT r_regionkey, 'v3' AS version, 3 AS window_h, substr(sha256('{\"version\": \"v3\", \"window_h\": 3}'), 1, 12) AS policy_id FROM region"),
}
