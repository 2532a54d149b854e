"""Climatology: monthly and hourly statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wxspark.sources.tables import OBS_SQL, obs, read

OFFSET = "interval 6 hours"


def climo_hourly(spark, d):
    """Local-month by UTC-hour statistics with the modal sector and its share."""
    o = read(spark, d, "events").select(
        F.month(F.col("ts") - F.expr(OFFSET)).alias("mon"), F.hour("ts").alias("hr"), "value", "event_type",
        (F.pmod(F.floor(F.pmod(F.col("value") * 7, F.lit(360.0)) / 22.5 + 0.5), F.lit(16)) + 1).cast("int").alias("sector"),
    )
    base = o.groupBy("mon", "hr").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.percentile("value", 0.9), 6).alias("p90"),
        F.round(100 * F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)), 6).alias("pct_error"),
    )
    sectors = o.groupBy("mon", "hr", "sector").agg(F.count("*").alias("k"))
    top = sectors.groupBy("mon", "hr").agg(F.min(F.struct(-F.col("k"), "sector", "k")).alias("t")).select("mon", "hr", "t.sector", "t.k")
    joined = base.join(top, ["mon", "hr"], "left")
    return joined.select("mon", "hr", "n", "mean_value", "p90", "pct_error", F.col("sector").alias("modal_sector"), F.round(100 * F.col("k") / F.col("n"), 6).alias("modal_share"))


def climo_monthly(spark, d):
    """Daily extremes to monthly means, percentiles, records with their first day."""
    o = obs(spark, d).select("station", (F.col("obs_time") - F.expr(OFFSET)).alias("t"), "temp_c", "ceiling_ft", "vis_m")
    daily = o.groupBy("station", F.month("t").alias("mon"), F.to_date("t").alias("day")).agg(F.max("temp_c").alias("tx"), F.min("temp_c").alias("tn"))
    temps = daily.groupBy("station", "mon").agg(
        F.round(F.avg("tx"), 6).alias("mean_tx"), F.round(F.percentile("tx", 0.1), 6).alias("p10"), F.round(F.percentile("tx", 0.9), 6).alias("p90"),
        F.min(F.struct((-F.col("tx")).alias("k"), "day")).alias("rec"), F.count("*").alias("n_days"),
    )
    freq = o.groupBy("station", F.month("t").alias("mon")).agg(
        F.round(100 * F.avg(F.when((F.col("ceiling_ft") < 1000) | (F.col("vis_m") < 4800), 1.0).otherwise(0.0)), 6).alias("pct_low"),
        F.countDistinct(F.year("t")).alias("n_years"), F.count_if(F.col("ceiling_ft").isNull()).alias("n_unlimited"),
    )
    return temps.join(freq, ["station", "mon"]).select("station", "mon", "mean_tx", "p10", "p90", (-F.col("rec.k")).alias("record"), F.col("rec.day").alias("record_day"), "n_days", "pct_low", "n_years", "n_unlimited")


def climo_block_means(spark, d):
    """Hour blocks weighted by n (null counts 0, no reports counts 1), with the peak hour."""
    o = obs(spark, d)
    hourly = o.groupBy("station", F.hour("obs_time").alias("hr")).agg(F.count("*").alias("n"), (100 * F.avg(F.when(F.col("vis_m") < 1600, 1.0).otherwise(0.0))).alias("pct"))
    block = F.floor(F.col("hr") / 6).cast("int")
    return hourly.groupBy("station", block.alias("block")).agg(
        F.round(F.sum(F.coalesce("pct", F.lit(0.0)) * F.col("n")) / F.greatest(F.sum("n"), F.lit(1)), 6).alias("pct"),
        F.max_by("hr", F.struct(F.round("pct", 9), -F.col("hr"))).alias("peak_hr"),
    )


QUERIES = {
    "climo_hourly": (climo_hourly, """
WITH obs AS (
  SELECT CAST(month(ts - INTERVAL 6 HOUR) AS INTEGER) AS mon, CAST(hour(ts) AS INTEGER) AS hr, value, event_type,
    CAST(CAST(floor(((value * 7) % 360.0 + 360.0) % 360.0 / 22.5 + 0.5) AS INTEGER) % 16 + 1 AS INTEGER) AS sector FROM events),
base AS (SELECT mon, hr, count(*) AS n, round(avg(value), 6) AS mean_value, round(quantile_cont(value, 0.9), 6) AS p90,
  round(100 * avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS pct_error FROM obs GROUP BY mon, hr),
top AS (SELECT mon, hr, sector, k FROM (SELECT mon, hr, sector, count(*) AS k FROM obs GROUP BY mon, hr, sector) QUALIFY row_number() OVER (PARTITION BY mon, hr ORDER BY k DESC, sector) = 1)
SELECT mon, hr, n, mean_value, p90, pct_error, sector AS modal_sector, round(100 * k / n, 6) AS modal_share FROM base LEFT JOIN top USING (mon, hr)
"""),
    "climo_monthly": (climo_monthly, f"""
WITH {OBS_SQL}, o AS (SELECT station, obs_time - INTERVAL 6 HOUR AS t, temp_c, ceiling_ft, vis_m FROM obs),
daily AS (SELECT station, month(t) AS mon, CAST(t AS DATE) AS day, max(temp_c) AS tx FROM o GROUP BY ALL),
temps AS (SELECT station, mon, round(avg(tx), 6) AS mean_tx, round(quantile_cont(tx, 0.1), 6) AS p10, round(quantile_cont(tx, 0.9), 6) AS p90, count(*) AS n_days, list(tx ORDER BY tx DESC, day)[1] AS record, list(day ORDER BY tx DESC, day)[1] AS record_day FROM daily GROUP BY ALL),
freq AS (SELECT station, month(t) AS mon, round(100 * avg(CASE WHEN ceiling_ft < 1000 OR vis_m < 4800 THEN 1.0 ELSE 0.0 END), 6) AS pct_low, count(DISTINCT year(t)) AS n_years, count(*) FILTER (WHERE ceiling_ft IS NULL) AS n_unlimited FROM o GROUP BY ALL)
SELECT station, CAST(mon AS INTEGER) AS mon, mean_tx, p10, p90, record, record_day, n_days, pct_low, n_years, n_unlimited FROM temps JOIN freq USING (station, mon)
"""),
    "climo_block_means": (climo_block_means, f"""
WITH {OBS_SQL}, h AS (SELECT station, hour(obs_time) AS hr, count(*) AS n, 100 * avg(CASE WHEN vis_m < 1600 THEN 1.0 ELSE 0.0 END) AS pct FROM obs GROUP BY ALL)
SELECT station, CAST(hr // 6 AS INTEGER) AS block, round(sum(coalesce(pct, 0) * n) / greatest(sum(n), 1), 6) AS pct, CAST(list(hr ORDER BY round(pct, 9) DESC, hr)[1] AS INTEGER) AS peak_hr FROM h GROUP BY ALL
"""),
}
