"""Grids of valid times by model and run, ladders, and slices of an archive (R10, R11, SK10, X20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wxspark.functions import times
from wxspark.operators.writes import copy_slice
from wxspark.sources.tables import CUBE_SQL, OBS_SQL, cube, obs, read

#: Fixed values of the adapter: hours between the times that a model has.
NATIVE_H = {"A": 1, "N": 1, "R": 3}
HOURS, STEP_H, SNAP_H = 48, 2, (3, 6)
LADDER = (200, 500, 1000, 2000, 3000, 5000)


def r10_snapped_grid(spark, d):
    """For each station's newest report, the times of three- and six-hourly models that cover the next 30 hours."""
    newest = obs(spark, d).groupBy("station").agg(F.max("obs_time").alias("anchor"))
    steps = newest.withColumn("step", F.explode(F.array(*map(F.lit, SNAP_H))))
    return steps.select("station", "step", F.explode(times.snapped_grid(F.col("anchor"), 30, F.col("step"))).alias("valid"))


def r11_run_grids(spark, d):
    """The ladder of each model's runs at two hours asked for, coarser where the model is: how many times, and the last."""
    native = F.create_map(*(F.lit(x) for pair in NATIVE_H.items() for x in pair))
    runs = cube(spark, d).select("model", "run").distinct()
    grid = runs.withColumn("grid", times.run_grid(F.col("run"), HOURS, F.lit(STEP_H), F.element_at(native, F.col("model"))))
    return grid.select("model", "run", F.size("grid").alias("n"), F.element_at("grid", 2).alias("second"), F.element_at("grid", -1).alias("last"))


def x20_ceiling_median(spark, d):
    """Each station's median ceiling from its ladder of shares below six heights; rungs that no report reaches aren't known."""
    shares = obs(spark, d).groupBy("station").agg(*(F.round(100 * F.avg(F.coalesce(F.col("ceiling_ft") < t, F.lit(False)).cast("double")), 6).alias(f"p{t}") for t in LADDER))
    return shares.select("station", F.round(times.ladder_percentile([(t, F.nullif(F.col(f"p{t}"), F.lit(0.0))) for t in LADDER], 50), 4).alias("median_ft"))


def sk10_archive_slice(spark, d):
    """SK10: the rows of an archive at some coordinates, of runs up to a cutoff."""
    sites = read(spark, d, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("loc_id"))
    return copy_slice(cube(spark, d), sites, ["loc_id"], "run", F.lit("1997-06-30").cast("timestamp_ntz")).drop("price")


QUERIES = {
    "r10_snapped_grid": (r10_snapped_grid, f"""WITH {OBS_SQL}, a AS (SELECT station, date_trunc('hour', max(obs_time)) AS a FROM obs GROUP BY 1), s AS (SELECT *, hour(a) % step AS over FROM a, (VALUES (3), (6)) v(step))
SELECT station, step, unnest(range(a - to_hours(over), a - to_hours(over) + to_hours(CAST(ceil((30 + over) / step) * step AS BIGINT)) + INTERVAL 1 MINUTE, to_hours(step))) AS valid FROM s"""),
    "r11_run_grids": (r11_run_grids, f"WITH {CUBE_SQL}, r AS (SELECT DISTINCT model, run, greatest({STEP_H}, CASE model WHEN 'R' THEN 3 ELSE 1 END) AS step FROM cube_) SELECT model, run, CAST({HOURS} // step + 1 AS INTEGER) AS n, date_trunc('hour', run) + to_hours(step) AS second, date_trunc('hour', run) + to_hours({HOURS} // step * step) AS last FROM r"),
    "x20_ceiling_median": (x20_ceiling_median, f"""WITH {OBS_SQL}, s AS (SELECT station, {', '.join(f'round(100 * avg(CAST(coalesce(ceiling_ft < {t}, false) AS DOUBLE)), 6) AS p{t}' for t in LADDER)} FROM obs GROUP BY 1),
u AS ({' UNION ALL '.join(f'SELECT station, {t}::DOUBLE AS t, nullif(p{t}, 0) AS p FROM s' for t in LADDER)}),
k AS (SELECT *, lag(t, 1, 0) OVER w AS t0, lag(p, 1, 0) OVER w AS p0 FROM u WHERE p IS NOT NULL WINDOW w AS (PARTITION BY station ORDER BY t)),
f AS (SELECT station, t0 + CASE WHEN p - p0 <= 0 THEN 0 ELSE (50 - p0) / (p - p0) END * (t - t0) AS m FROM k WHERE p >= 50 QUALIFY row_number() OVER (PARTITION BY station ORDER BY t) = 1) SELECT station, round(m, 4) AS median_ft FROM s LEFT JOIN f USING (station)"""),
    "sk10_archive_slice": (sk10_archive_slice, f"WITH {CUBE_SQL} SELECT * EXCLUDE (price) FROM cube_ WHERE run <= TIMESTAMP '1997-06-30' AND loc_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 0)"),
}
