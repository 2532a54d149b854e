"""Model and ensemble analytics, geography, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wxspark.functions import weather as wx
from wxspark.operators import latest
from wxspark.sources.tables import CUBE_SQL, OBS_SQL, cube, obs, read


def _members(spark, d):
    """Ensemble members out of vectors: one row a member."""
    return read(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("member", "value"))


def a20_cross_model(spark, d):
    """A20, A25 input, X25: mean, range and a confidence flag across models, nulls skipped."""
    p = cube(spark, d).groupBy("loc_id", "model").agg(F.avg("value").alias("v"))
    g = p.groupBy("loc_id").agg(F.round(F.avg("v"), 6).alias("mean_v"), F.round(F.max("v") - F.min("v"), 6).alias("spread"), F.count("v").alias("n"))
    return g.withColumn("flag", F.when(F.col("spread") < 2, "HIGH").when(F.col("spread") < 4, "MED").otherwise("LOW"))


def a22_circular_spread(spark, d):
    """The largest pairwise angle of all directions: whole degrees, so a station has 360 different ones at most."""
    g = obs(spark, d).groupBy("station").agg(F.collect_set("wind_dir").alias("dirs"))
    pairs = "transform(dirs, a -> array_max(transform(dirs, b -> least(pmod(a - b, 360), 360 - pmod(a - b, 360)))))"
    return g.select("station", F.expr(f"array_max({pairs})").alias("spread"))


def a23_vector_wind(spark, d):
    """The mean wind of components, as a from-direction and a speed."""
    o = obs(spark, d).select("station", (-F.col("wind_speed") * F.sin(F.radians("wind_dir"))).alias("u"), (-F.col("wind_speed") * F.cos(F.radians("wind_dir"))).alias("v"))
    m = o.groupBy("station").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    return m.select("station", F.round(wx.wind_from(F.col("u"), F.col("v")), 4).alias("dir_from"), F.round(F.hypot("u", "v"), 6).alias("speed"))


def a24_category_probability(spark, d):
    """The share of members in each category; what can't be classed isn't counted."""
    o = obs(spark, d).withColumn("cat", wx.flight_category(F.col("ceiling_ft"), F.col("vis_m"))).where("cat is not null")
    n = o.groupBy("station").agg(F.count("*").alias("n"))
    return o.groupBy("station", "cat").agg(F.count("*").alias("k")).join(n, "station").select("station", "cat", F.round(100 * F.col("k") / F.col("n"), 6).alias("pct"))


def a25_exceedance(spark, d):
    """P(value >= threshold) over members, thresholds as a small relation."""
    t = F.explode(F.array(*(F.lit(x) for x in (-1.0, 0.0, 1.0)))).alias("threshold")
    return _members(spark, d).select("label", "value", t).groupBy("label", "threshold").agg(F.round(F.avg((F.col("value") >= F.col("threshold")).cast("double")), 6).alias("p"), F.count("*").alias("n"))


def a26_ensemble_percentiles(spark, d):
    m = _members(spark, d).groupBy("label")
    return m.agg(*(F.round(F.percentile(F.col("value").cast("double"), q / 100), 5).alias(f"p{q}") for q in (10, 50, 90)))


def a43_correlation(spark, d):
    """Correlation, null below three rows or without spread, and the least-squares slope."""
    x, y = F.col("temp_c").cast("double"), F.col("wind_speed").cast("double")
    g = obs(spark, d).groupBy("station").agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("s"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    ok = (F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0)
    return g.select("station", "n", F.when(ok, F.round("r", 6)).alias("r"), F.when(ok, F.round("s", 6)).alias("slope"))


def t11_verification(spark, d):
    """Three newest runs against truth of the same place and day of the month, mean and absolute error by rank.

    The tables' calendars don't meet, so a valid time is snapped to the day of the month (J24's rounding, by half a day).
    """
    c = latest.newest_k(cube(spark, d), ["loc_id"], "run", 3).withColumn("day", F.dayofmonth("valid_time"))
    snapped = F.dayofmonth(F.col("obs_time") + F.expr("interval 12 hours")).alias("day")
    truth = obs(spark, d).groupBy(F.col("station").alias("loc_id"), snapped).agg(F.avg("value").alias("truth"))
    return c.join(truth, ["loc_id", "day"]).groupBy("run_rank", "variable").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value") - F.col("truth")), 6).alias("bias"), F.round(F.avg(F.abs(F.col("value") - F.col("truth"))), 6).alias("mae"))


def t13_state_table(spark, d):
    """A state by time as a map of newest values, and the peak."""
    top = cube(spark, d).groupBy("loc_id", "variable").agg(F.max_by("value", F.struct("run", "value")).alias("v"), F.max("value").alias("peak"))
    return top.groupBy("loc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variable", "v")))).alias("m"), F.max("peak").alias("peak")).select("loc_id", F.try_element_at("m", F.lit("F")).alias("f"), F.try_element_at("m", F.lit("O")).alias("o"), "peak")


def t14_hazards(spark, d):
    """Icing and shear flags and whether two sources agree."""
    cold = F.col("temp_c").between(-16, 0)
    wet = F.col("vis_m") < 7000
    o = obs(spark, d).where("vis_m is not null")
    agree = F.when(cold & wet, "BOTH").when(~cold & ~wet, "none").otherwise("DISAGREE")
    return o.groupBy(agree.alias("icing"), (F.col("wind_speed") - F.col("temp_c") > 30).alias("shear")).agg(F.count("*").alias("n"))


def _sites(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 120 - 60).cast("double").alias("lat"), (F.col("s_suppkey") * 53 % 300 - 150).cast("double").alias("lon"))


#: How many sites are near, and within how many kilometres.
NEAREST, NEAR_KM = 3, 3000


def nearest_sites(s: DataFrame) -> DataFrame:
    """Sites (s_suppkey, lat, lon) to the nearest others of each, by rounded distance, then key; a join of places on cells of latitude and longitude, never on all pairs.

    Sites that share coordinates are as far from all others, so places meet, not sites: of a place only its first NEAREST + 1 keys can be among the
    nearest of any site, one of which may be the site itself. A cell is 30 degrees high (3000 km are 27), and as wide as 3000 km can reach at
    the latitude, all the way round near a pole.
    """
    s = s.where("s_suppkey is not null").groupBy("s_suppkey", "lat", "lon").agg(F.count("*").alias("n"))
    row = F.floor(F.col("lat") / 30).cast("long")
    a = s.select(F.col("lat").alias("la"), F.col("lon").alias("oa"), row.alias("row")).distinct().select("la", "oa", F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)).alias("cy"))
    # degrees of longitude that 3000 km span at most: asin(sin(r) / cos(latitude)), everything from 62 degrees on
    reach = F.when(F.abs("la") < 62, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(NEAR_KM / wx.EARTH_KM)) / F.cos(F.radians("la")))))).otherwise(180.0)
    a = a.withColumn("cx", F.explode(F.array_distinct(F.transform(F.sequence(F.floor((F.col("oa") - reach + 180) / 30).cast("long"), F.floor((F.col("oa") + reach + 180) / 30).cast("long")), lambda c: F.pmod(c, F.lit(12))))))
    first = s.withColumn("k", F.row_number().over(W.partitionBy("lat", "lon").orderBy("s_suppkey"))).where(F.col("k") <= NEAREST + 1)
    b = first.select(F.col("s_suppkey").alias("b"), F.col("n").alias("nb"), F.col("lat").alias("lb"), F.col("lon").alias("ob"), row.alias("cy"), F.pmod(F.floor((F.col("lon") + 180) / 30).cast("long"), F.lit(12)).alias("cx"))
    near = a.join(b, ["cy", "cx"]).withColumn("km", wx.distance_km(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob"))).where(F.col("km") <= NEAR_KM)
    k = F.row_number().over(W.partitionBy("la", "oa").orderBy(F.round("km", 6), "b"))
    near = near.withColumn("k", k).where(F.col("k") <= NEAREST + 1).withColumn("dir", wx.compass(F.round(wx.bearing(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")), 6)))
    own = s.select(F.col("s_suppkey").alias("a"), F.col("n").alias("na"), F.col("lat").alias("la"), F.col("lon").alias("oa"))
    # a key that is there more than once meets, and is met, as often
    met = own.join(near, ["la", "oa"]).where("a <> b").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(NEAREST).cast("long"), F.col("na") * F.col("nb")))))
    rk = F.row_number().over(W.partitionBy("a").orderBy(F.round("km", 6), "b"))
    return met.withColumn("rk", rk).where(F.col("rk") <= NEAREST).select("a", "rk", "b", F.round("km", 4).alias("km"), "dir")


def j31_nearest_sites(spark, d):
    """The three nearest sites within 3000 km; the adapter has 600 places at most, so that only the last step grows with the sites."""
    return nearest_sites(_sites(spark, d))


def t15_nearby_field(spark, d):
    """What each model says now at a site and its three nearest ones, with distance and direction, at the first valid time of the site's newest run.

    Places are met by their coordinates, never by name; of a place's runs for that time the newest speaks, and of its members the mean.
    """
    place = lambda c: [(F.col(c) * 37 % 120 - 60).alias("lat"), (F.col(c) * 53 % 300 - 150).alias("lon")]
    own = _sites(spark, d).select(F.col("s_suppkey").alias("site"), *place("s_suppkey"), F.lit(0.0).alias("km"), F.lit("--").alias("dir"))
    own = own.union(j31_nearest_sites(spark, d).select(F.col("a").alias("site"), *place("b"), "km", "dir"))
    c = cube(spark, d).where("variable = 'F'").select("loc_id", "model", "run", "valid_time", "value")
    newest = c.groupBy("loc_id", "model").agg(F.max(F.struct("run", (-F.unix_micros(F.col("valid_time").cast("timestamp"))).alias("k"), "valid_time")).alias("x")).select(F.col("loc_id").alias("site"), "model", F.col("x.valid_time").alias("valid_time"))
    field = c.groupBy("loc_id", "model", "valid_time", "run").agg(F.avg("value").alias("value")).groupBy("loc_id", "model", "valid_time").agg(F.max_by("value", "run").alias("value"))
    field = field.select(*place("loc_id"), "model", "valid_time", "value").groupBy("lat", "lon", "model", "valid_time").agg(F.avg("value").alias("value"))  # places that share coordinates are one
    rows = own.join(newest, "site").join(field, ["lat", "lon", "model", "valid_time"])
    return rows.groupBy("site", "model", "valid_time", "lat", "lon").agg(F.min(F.struct("km", "dir")).alias("x"), F.round(F.max("value"), 6).alias("value")).select("site", "model", "valid_time", "lat", "lon", "x.km", "x.dir", "value")


def t12_probabilities_by_time(spark, d):
    """By model and valid time, of the newest run for it: how many members there are, and how many of them reach each threshold, in percent."""
    c = cube(spark, d).where("value is not null")
    newest = c.groupBy("model", "valid_time").agg(F.max("run").alias("run"))
    share = lambda x: F.round(100 * F.avg((F.col("value") >= x).cast("double")), 6).alias(f"p_ge_{x}")
    return c.join(newest, ["model", "valid_time", "run"]).groupBy("model", "valid_time", "run").agg(F.count("*").alias("members"), *(share(x) for x in (10, 25, 40)))


def j33_own_coordinates(spark, d):
    """A field restricted to a site's own coordinates by value, not by name."""
    s = _sites(spark, d)
    c = cube(spark, d).withColumn("lat", (F.col("loc_id") * 37 % 120 - 60).cast("double")).withColumn("lon", (F.col("loc_id") * 53 % 300 - 150).cast("double"))
    return c.join(s.select("lat", "lon"), ["lat", "lon"], "left_semi").groupBy("loc_id").agg(F.count("*").alias("n"))


def x02_day_hour(spark, d):
    """A DDHH token against an anchor: an earlier day is next month, hour 24 the next day, no such day null."""
    o = obs(spark, d).select("event_id", "obs_time", (F.col("event_id") % 31 + 1).cast("int").alias("dd"), (F.col("event_id") % 25).cast("int").alias("hh"))
    month = F.date_trunc("month", F.when(F.col("dd") < F.dayofmonth("obs_time"), F.add_months(F.to_date("obs_time"), 1)).otherwise(F.to_date("obs_time"))).cast("date")
    day = F.when(F.col("dd") <= F.dayofmonth(F.last_day(month)), F.date_add(month, F.col("dd") - 1))
    return o.select("event_id", (day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hh"))).alias("t"))


def x05_cycles(spark, d):
    """X05, X06, ST02, ST03: the model cycle after a lag, floored to six hours, and the synoptic hour."""
    t = F.col("obs_time") - F.expr("interval 210 minutes")
    cyc = F.date_trunc("hour", t).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), (F.hour(t) % 6).cast("int"))
    return obs(spark, d).groupBy(cyc.alias("cycle"), F.when(F.hour("obs_time") < 12, 0).otherwise(12).alias("syn")).agg(F.count("*").alias("n"))


def x11_compass(spark, d):
    return obs(spark, d).groupBy(wx.compass(F.col("wind_dir")).alias("dir")).agg(F.count("*").alias("n"))


def x12_angles(spark, d):
    """Signed and unsigned differences."""
    o = obs(spark, d)
    return o.select("event_id", wx.turn(F.col("wind_dir"), F.col("event_id") % 360).alias("signed"), wx.apart(F.col("wind_dir"), F.col("event_id") % 360).alias("apart"))


def x15_units(spark, d):
    """Unit conversions, dewpoint and back, both kinds of rounding."""
    o = obs(spark, d).where("vis_m > 0")
    rh = (F.col("vis_m") / 100).cast("double")
    dew = wx.dewpoint(F.col("temp_c").cast("double"), rh)
    return o.select("event_id", F.round(wx.ms_to_kt(F.col("wind_speed")), 4).alias("kt"), F.round(wx.kelvin_to_c(F.col("temp_c") + 300.0), 4).alias("c"), F.round(dew, 5).alias("dew"), F.round(wx.humidity(F.col("temp_c").cast("double"), dew), 4).alias("rh"), F.bround(F.col("altimeter") / 4, 1).alias("half_even"))


def x20_ladder_inverse(spark, d):
    """A percentile out of cumulative exceedances, linear between the rungs."""
    m = _members(spark, d).groupBy("label").agg(*(F.avg((F.col("value") >= t).cast("double")).alias(f"e{i}") for i, t in enumerate((-1.0, 0.0, 1.0))))
    p = F.when(F.lit(0.5).between(F.col("e1"), F.col("e0")), -1 + F.try_divide(F.col("e0") - 0.5, F.col("e0") - F.col("e1"))).when(F.lit(0.5).between(F.col("e2"), F.col("e1")), F.try_divide(F.col("e1") - 0.5, F.col("e1") - F.col("e2")))
    return m.select("label", F.round(p, 6).alias("p50"))


def x22_categories(spark, d):
    """Band ladders, the worse of two letters, statuses of missing values."""
    o = obs(spark, d)
    status = F.when(F.col("ceiling_ft").isNull(), "unlimited").otherwise("numeric")
    return o.groupBy(wx.flight_category(F.col("ceiling_ft"), F.col("vis_m")).alias("cat"), status.alias("ceiling_status"), wx.altimeter_band(F.col("altimeter")).alias("band")).agg(F.count("*").alias("n"))


def x26_outlier_model(spark, d):
    """The model farthest from the mean of all, where they disagree."""
    p = cube(spark, d).groupBy("loc_id", "model").agg(F.avg("value").alias("v"))
    m = p.groupBy("loc_id").agg(F.avg("v").alias("mean_v"))
    far = F.struct(F.round(F.abs(F.col("v") - F.col("mean_v")), 9).alias("k"), F.col("model"))
    return p.join(m, "loc_id").groupBy("loc_id").agg(F.max(far).alias("w")).select("loc_id", F.when(F.col("w.k") > 1, F.col("w.model")).alias("outlier"))


_O, _C = f"WITH {OBS_SQL}", f"WITH {CUBE_SQL}"
_M = "WITH m AS (SELECT vec_id, label, unnest(embedding) AS value FROM embeddings)"
_L = f"coalesce({wx.ladder_sql('ceiling_ft', wx.CEILING_STEPS, 'E')}, 'E')"
_CAT = f"CASE WHEN vis_m IS NOT NULL THEN least({_L}, {wx.ladder_sql('vis_m', wx.VIS_STEPS, 'E')}) END"
_NAMES = "['" + "', '".join(wx.COMPASS) + "']"
_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))))"
_BR = "((degrees(atan2(sin(radians(y.lon - x.lon)) * cos(radians(y.lat)), cos(radians(x.lat)) * sin(radians(y.lat)) - sin(radians(x.lat)) * cos(radians(y.lat)) * cos(radians(y.lon - x.lon)))) + 360) % 360)"
_G = "(ln((vis_m / 100) / 100) + 17.625 * temp_c / (243.04 + temp_c))"
_DEW = f"(243.04 * {_G} / (17.625 - {_G}))"
QUERIES = {
    "a20_cross_model": (a20_cross_model, f"{_C}, p AS (SELECT loc_id, model, avg(value) AS v FROM cube_ GROUP BY ALL), g AS (SELECT loc_id, round(avg(v), 6) AS mean_v, round(max(v) - min(v), 6) AS spread, count(v) AS n FROM p GROUP BY 1) SELECT *, CASE WHEN spread < 2 THEN 'HIGH' WHEN spread < 4 THEN 'MED' ELSE 'LOW' END AS flag FROM g"),
    "a22_circular_spread": (a22_circular_spread, f"{_O}, g AS (SELECT station, list(DISTINCT wind_dir) AS d FROM obs GROUP BY 1), p AS (SELECT station, unnest(d) AS a, d FROM g), q AS (SELECT station, a, unnest(d) AS b FROM p) SELECT station, max(least((a - b + 360) % 360, 360 - (a - b + 360) % 360)) AS spread FROM q GROUP BY 1"),
    "a23_vector_wind": (a23_vector_wind, f"{_O}, m AS (SELECT station, avg(-wind_speed * sin(radians(wind_dir))) AS u, avg(-wind_speed * cos(radians(wind_dir))) AS v FROM obs GROUP BY 1) SELECT station, round((degrees(atan2(-u, -v)) + 360) % 360, 4) AS dir_from, round(sqrt(u * u + v * v), 6) AS speed FROM m"),
    "a24_category_probability": (a24_category_probability, f"{_O}, c AS (SELECT station, {_CAT} AS cat FROM obs), k AS (SELECT station, cat, count(*) AS k FROM c WHERE cat IS NOT NULL GROUP BY ALL) SELECT station, cat, round(100 * k / sum(k) OVER (PARTITION BY station), 6) AS pct FROM k"),
    "a25_exceedance": (a25_exceedance, f"{_M} SELECT label, t AS threshold, round(avg(CAST(value >= t AS DOUBLE)), 6) AS p, count(*) AS n FROM m, (VALUES (-1.0::DOUBLE), (0.0::DOUBLE), (1.0::DOUBLE)) x(t) GROUP BY ALL"),
    "a26_ensemble_percentiles": (a26_ensemble_percentiles, f"{_M} SELECT label, round(quantile_cont(CAST(value AS DOUBLE), 0.1), 5) AS p10, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 5) AS p50, round(quantile_cont(CAST(value AS DOUBLE), 0.9), 5) AS p90 FROM m GROUP BY 1"),
    "a43_correlation": (a43_correlation, f"{_O} SELECT station, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(temp_c) > 0 AND stddev_pop(wind_speed) > 0 THEN round(corr(temp_c, wind_speed), 6) END AS r, CASE WHEN count(*) >= 3 AND stddev_pop(temp_c) > 0 AND stddev_pop(wind_speed) > 0 THEN round(regr_slope(wind_speed, temp_c), 6) END AS slope FROM obs GROUP BY 1"),
    "t11_verification": (t11_verification, f"WITH {CUBE_SQL}, {OBS_SQL}, c AS (SELECT *, dense_rank() OVER (PARTITION BY loc_id ORDER BY run DESC) AS run_rank FROM cube_), t AS (SELECT station AS loc_id, day(obs_time + INTERVAL 12 HOUR) AS dy, avg(value) AS truth FROM obs GROUP BY ALL) SELECT CAST(run_rank AS INTEGER) AS run_rank, variable, count(*) AS n, round(avg(value - truth), 6) AS bias, round(avg(abs(value - truth)), 6) AS mae FROM c JOIN t ON c.loc_id = t.loc_id AND day(valid_time) = dy WHERE run_rank <= 3 GROUP BY ALL"),
    "t13_state_table": (t13_state_table, f"{_C}, t AS (SELECT loc_id, variable, list(value ORDER BY run DESC, value DESC)[1] AS v, max(value) AS peak FROM cube_ GROUP BY ALL) SELECT loc_id, max(v) FILTER (WHERE variable = 'F') AS f, max(v) FILTER (WHERE variable = 'O') AS o, max(peak) AS peak FROM t GROUP BY 1"),
    "t14_hazards": (t14_hazards, f"{_O} SELECT CASE WHEN temp_c BETWEEN -16 AND 0 AND vis_m < 7000 THEN 'BOTH' WHEN NOT (temp_c BETWEEN -16 AND 0) AND NOT vis_m < 7000 THEN 'none' ELSE 'DISAGREE' END AS icing, wind_speed - temp_c > 30 AS shear, count(*) AS n FROM obs WHERE vis_m IS NOT NULL GROUP BY ALL"),
    "j31_nearest_sites": (j31_nearest_sites, f"WITH s AS (SELECT s_suppkey, CAST(s_suppkey * 37 % 120 - 60 AS DOUBLE) AS lat, CAST(s_suppkey * 53 % 300 - 150 AS DOUBLE) AS lon FROM supplier), p AS (SELECT x.s_suppkey AS a, y.s_suppkey AS b, {_KM} AS km, {_BR} AS br FROM s x JOIN s y ON x.s_suppkey <> y.s_suppkey AND abs(x.lat - y.lat) < 60), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(km, 6), b) AS rk FROM p WHERE km <= 3000) SELECT a, CAST(rk AS INTEGER) AS rk, b, round(km, 4) AS km, {_NAMES}[CAST(floor(round(br, 6) / 22.5 + 0.5) AS INTEGER) % 16 + 1] AS dir FROM r WHERE rk <= 3"),
    "t15_nearby_field": (t15_nearby_field, f"""{_C}, s AS (SELECT s_suppkey, CAST(s_suppkey * 37 % 120 - 60 AS DOUBLE) AS lat, CAST(s_suppkey * 53 % 300 - 150 AS DOUBLE) AS lon FROM supplier), p AS (SELECT x.s_suppkey AS a, y.s_suppkey AS b, {_KM} AS km, {_BR} AS br FROM s x JOIN s y ON x.s_suppkey <> y.s_suppkey AND abs(x.lat - y.lat) < 60), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(km, 6), b) AS rk FROM p WHERE km <= 3000),
own AS (SELECT s_suppkey AS site, s_suppkey AS loc, 0.0::DOUBLE AS km, '--' AS dir FROM s UNION ALL SELECT a, b, round(km, 4), {_NAMES}[CAST(floor(round(br, 6) / 22.5 + 0.5) AS INTEGER) % 16 + 1] FROM r WHERE rk <= 3),
c AS (SELECT * FROM cube_ WHERE variable = 'F'), n AS (SELECT loc_id AS site, model, valid_time FROM c QUALIFY row_number() OVER (PARTITION BY loc_id, model ORDER BY run DESC, valid_time) = 1),
f AS (SELECT loc_id, model, valid_time, avg(value) AS value FROM c GROUP BY loc_id, model, valid_time, run QUALIFY row_number() OVER (PARTITION BY loc_id, model, valid_time ORDER BY run DESC) = 1),
g AS (SELECT loc_id * 37 % 120 - 60 AS lat, loc_id * 53 % 300 - 150 AS lon, model, valid_time, avg(value) AS value FROM f GROUP BY ALL)
SELECT site, model, valid_time, lat, lon, min((km, dir))[1] AS km, min((km, dir))[2] AS dir, round(max(value), 6) AS value FROM (SELECT site, loc * 37 % 120 - 60 AS lat, loc * 53 % 300 - 150 AS lon, km, dir FROM own) o JOIN n USING (site) JOIN g USING (lat, lon, model, valid_time) GROUP BY ALL"""),
    "t12_probabilities_by_time": (t12_probabilities_by_time, f"{_C}, n AS (SELECT model, valid_time, max(run) AS run FROM cube_ WHERE value IS NOT NULL GROUP BY ALL) SELECT model, valid_time, run, count(*) AS members, {', '.join(f'round(100 * avg(CAST(value >= {x} AS DOUBLE)), 6) AS p_ge_{x}' for x in (10, 25, 40))} FROM cube_ JOIN n USING (model, valid_time, run) WHERE value IS NOT NULL GROUP BY ALL"),
    "j33_own_coordinates": (j33_own_coordinates, f"{_C} SELECT loc_id, count(*) AS n FROM cube_ WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey * 37 % 120 = loc_id * 37 % 120 AND s_suppkey * 53 % 300 = loc_id * 53 % 300) GROUP BY 1"),
    "x02_day_hour": (x02_day_hour, f"{_O}, o AS (SELECT event_id, obs_time, event_id % 31 + 1 AS dd, event_id % 25 AS hh FROM obs), m AS (SELECT *, date_trunc('month', CASE WHEN dd < day(obs_time) THEN obs_time + INTERVAL 1 MONTH ELSE obs_time END) AS mo FROM o) SELECT event_id, CASE WHEN dd <= day(last_day(mo)) THEN mo + to_days(CAST(dd - 1 AS INTEGER)) + to_hours(hh) END AS t FROM m"),
    "x05_cycles": (x05_cycles, f"{_O}, x AS (SELECT obs_time, obs_time - INTERVAL 210 MINUTE AS t FROM obs) SELECT date_trunc('hour', t) - to_hours(hour(t) % 6) AS cycle, CASE WHEN hour(obs_time) < 12 THEN 0 ELSE 12 END AS syn, count(*) AS n FROM x GROUP BY ALL"),
    "x11_compass": (x11_compass, f"{_O} SELECT {_NAMES}[CAST(floor(wind_dir / 22.5 + 0.5) AS INTEGER) % 16 + 1] AS dir, count(*) AS n FROM obs GROUP BY 1"),
    "x12_angles": (x12_angles, f"{_O} SELECT event_id, (wind_dir - event_id % 360 + 540) % 360 - 180 AS signed, least((wind_dir - event_id % 360 + 360) % 360, 360 - (wind_dir - event_id % 360 + 360) % 360) AS apart FROM obs"),
    "x15_units": (x15_units, f"{_O} SELECT event_id, round(wind_speed * 1.943844::DOUBLE, 4) AS kt, round(temp_c + 300.0::DOUBLE - 273.15::DOUBLE, 4) AS c, round({_DEW}, 5) AS dew, round(vis_m / 100, 4) AS rh, round_even(altimeter / 4, 1) AS half_even FROM obs WHERE vis_m > 0"),
    "x20_ladder_inverse": (x20_ladder_inverse, f"{_M}, e AS (SELECT label, avg(CAST(value >= -1 AS DOUBLE)) AS e0, avg(CAST(value >= 0 AS DOUBLE)) AS e1, avg(CAST(value >= 1 AS DOUBLE)) AS e2 FROM m GROUP BY 1) SELECT label, round(CASE WHEN 0.5 BETWEEN e1 AND e0 THEN -1 + (e0 - 0.5) / nullif(e0 - e1, 0) WHEN 0.5 BETWEEN e2 AND e1 THEN (e1 - 0.5) / nullif(e1 - e2, 0) END, 6) AS p50 FROM e"),
    "x22_categories": (x22_categories, f"{_O} SELECT {_CAT} AS cat, CASE WHEN ceiling_ft IS NULL THEN 'unlimited' ELSE 'numeric' END AS ceiling_status, {wx.altimeter_band_sql('altimeter')} AS band, count(*) AS n FROM obs GROUP BY ALL"),
    "x26_outlier_model": (x26_outlier_model, f"{_C}, p AS (SELECT loc_id, model, avg(value) AS v FROM cube_ GROUP BY ALL), q AS (SELECT loc_id, model, round(abs(v - avg(v) OVER (PARTITION BY loc_id)), 9) AS k FROM p) SELECT loc_id, CASE WHEN k > 1 THEN model END AS outlier FROM q QUALIFY row_number() OVER (PARTITION BY loc_id ORDER BY k DESC, model DESC) = 1"),
}
