"""Reports as text: the table's observations written as reports, and read back by the token grammar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.functions import metar, reports_text
from wxspark.operators import forecast_state
from wxspark.plans.documents import _CAND, _ELEM, HOURS, candidates_of, points
from wxspark.sources.documents import HOUR0, groups
from wxspark.sources.tables import OBS_SQL, obs


def texts(o: DataFrame) -> DataFrame:
    """event_id and raw: an observation as a report, with a trend and remarks that hold other values of the same kinds."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    signed = lambda c: F.when(c < 0, F.concat(F.lit("M"), pad(-c, 2))).otherwise(pad(c, 2))
    c = F.col
    wind = F.concat(pad(c("wind_dir"), 3), pad(c("wind_speed"), 2), F.coalesce(F.concat(F.lit("G"), pad(c("gust"), 2)), F.lit("")), F.lit("KT"))
    sky = F.coalesce(F.concat(F.lit("FEW001 BKN"), pad(F.floor(c("ceiling_ft") / 100), 3), F.lit(" OVC250")), F.lit("SKC"))
    parts = [
        c("report_type"), F.concat(F.lit("K"), pad(c("station") % 1000, 3)), F.concat(F.date_format("obs_time", "ddHHmm"), F.lit("Z")), F.when(c("corrected"), F.lit("COR")), wind, pad(c("vis_m"), 4), c("weather"), sky,
        F.concat(signed(c("temp_c")), F.lit("/"), signed(c("temp_c") - 3)), F.concat(F.lit("A"), c("altimeter")), F.when(c("event_id") % 2 == 0, F.lit("BECMG 27045G65KT 0100 +SHRA OVC001")), F.lit("RMK AO2 36030KT 9000 TSRA OVC002 M09/M09 A3111"),
    ]
    return o.select("event_id", F.concat_ws(" ", *parts).alias("raw"))


def x29_reports_read_back(spark, d):
    """What the grammar reads in the observations' reports; its SQL has the observations' own values."""
    rows = metar.parse_reports(texts(obs(spark, d)), "raw", ("event_id",))
    return rows.select(
        "event_id", "station", "day", "hhmm", "report_type", "corrected", "wind_dir_deg", "wind_speed", "wind_gust", "visibility", "vis_sm", "vis_m", "vis_flag", F.array_join("weather", " ").alias("weather"), "temp_c", "dewpoint_c",
        "altimeter_inhg", "altimeter_hpa", F.size("clouds").alias("n_layers"), "ceiling_ft", "remarks",
    )


def forecast_texts(g: DataFrame) -> DataFrame:
    """doc, station, valid_h and raw: a document's groups as one forecast text, in the order of their starts; one without a prevailing state is no document."""
    c = F.col
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    dh = lambda h: F.concat(pad(F.floor(h / 24) % 31 + 1, 2), pad(h % 24, 2))
    wind = F.when(c("wind_speed").isNotNull(), F.concat(pad(c("wind_dir"), 3), pad(c("wind_speed"), 2), F.coalesce(F.concat(F.lit("G"), pad(c("gust"), 2)), F.lit("")), F.lit("KT")))
    sky = F.when(c("ceiling_ft").isNotNull(), F.concat(F.lit("FEW001 BKN"), pad(F.floor(c("ceiling_ft") / 100), 3)))
    said = F.concat_ws(" ", wind, pad(c("vis_m"), 4), c("weather"), sky, F.concat(F.lit("QNH"), c("altimeter"), F.lit("INS")))
    head = F.when(c("kind") == "INITIAL", F.concat(F.lit("TAF K"), pad(c("station"), 3), F.lit(" "), dh(c("valid_h")), F.lit("00Z "), dh(c("valid_h")), F.lit("/"), dh(c("valid_h") + HOURS)))
    head = head.when(c("kind") == "FM", F.concat(F.lit("FM"), dh(c("start")), F.lit("00"))).otherwise(F.concat(c("kind"), F.lit(" "), dh(c("start")), F.lit("/"), dh(c("end"))))
    parts = F.array_sort(F.collect_list(F.struct("start", "grp", F.concat_ws(" ", head, said).alias("text"))))
    whole = g.groupBy("doc", "station", "valid_h").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("raw"), F.bool_or(c("kind") == "INITIAL").alias("whole"))
    return whole.where("whole").drop("whole")


def read_groups(texts: DataFrame) -> DataFrame:
    """Texts (doc, station, valid_h, raw) to groups as `operators.forecast_state` has them; hours come from the text's own tokens."""
    rows = reports_text.taf_groups(texts)
    anchor = F.timestamp_micros((F.col("valid_h") + HOUR0) * 3_600_000_000).cast("timestamp_ntz")
    rows = forecast_state.absolutise(forecast_state.absolutise(rows.withColumn("_anchor", anchor), "_anchor", "from_token", "_from"), "_anchor", "to_token", "_to")
    hour = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 3_600_000_000).cast("long") - HOUR0
    rows = rows.withColumn("_s", metar.group_sections(F.col("group_text"))).select("*", *(c.alias(k) for k, c in metar.group_tokens(F.col("_s")).items()))
    return rows.select("doc", "station", "kind", "valid_h", hour("_from").alias("start"), F.coalesce(hour("_to"), F.col("valid_h") + HOURS).alias("end"), *(v.alias(k) for k, v in metar.group_fields().items()))


def t19_scores_of_texts(spark, d):
    """Every document written as text, read back and scored, on the way that any emitted text takes; its SQL scores the groups themselves.

    A gust is told with its wind only, so one without wind is no part of a text.
    """
    read_back = read_groups(forecast_texts(groups(spark, d)))
    best = points(spark, d, candidates_of(read_back))
    earned = sum((F.coalesce(k, F.lit(0.0)) for k in list(_ELEM)[1:]), F.coalesce(list(_ELEM)[0], F.lit(0.0)))
    available = sum((F.when(F.col(k).isNotNull(), 1).otherwise(0) for k in list(_ELEM)[1:]), F.when(F.col(list(_ELEM)[0]).isNotNull(), 1).otherwise(0))
    total = best.groupBy("doc").agg(F.round(F.sum(earned), 6).alias("earned"), F.sum(available).alias("available"))
    return total.withColumn("pct", F.round(100 * F.try_divide("earned", "available"), 4))


_TABLE = ", ".join(f"({sm}::DOUBLE, {m})" for sm, m in metar.VIS_TABLE)
# a text can't tell of a gust without its wind
_GUST = "CASE WHEN l_suppkey % 3 = 0 THEN"
_TOLD = _CAND.replace(_GUST, "CASE WHEN l_suppkey % 3 = 0 AND (l_linenumber = 1 OR l_linenumber % 4 = 2 OR l_partkey % 2 = 0) THEN")
assert _TOLD != _CAND
_SUM = lambda x: " + ".join(x.format(k=k) for k in _ELEM)
QUERIES = {
    "t19_scores_of_texts": (t19_scores_of_texts, f"""{_TOLD}, e AS (SELECT doc, t, {', '.join(f'max({x}) AS {k}' for k, x in _ELEM.items())} FROM j GROUP BY ALL),
r AS (SELECT doc, round(sum({_SUM('coalesce({k}, 0)')}), 6) AS earned, CAST(sum({_SUM('CAST({k} IS NOT NULL AS BIGINT)')}) AS BIGINT) AS available FROM e GROUP BY doc) SELECT *, round(100 * earned / nullif(available, 0), 4) AS pct FROM r"""),
    "x29_reports_read_back": (x29_reports_read_back, f"""WITH {OBS_SQL}, v AS (SELECT vis_m, min((abs(m - vis_m), sm))[2] AS sm FROM (SELECT DISTINCT vis_m FROM obs WHERE vis_m IS NOT NULL), (VALUES {_TABLE}) t(sm, m) GROUP BY vis_m)
SELECT event_id, 'K' || lpad(CAST(station % 1000 AS VARCHAR), 3, '0') AS station, CAST(day(obs_time) AS INTEGER) AS day, strftime(obs_time, '%H%M') AS hhmm, report_type, corrected, CAST(wind_dir AS INTEGER) AS wind_dir_deg, CAST(wind_speed AS INTEGER) AS wind_speed,
  CAST(gust AS INTEGER) AS wind_gust, lpad(CAST(vis_m AS VARCHAR), 4, '0') AS visibility, sm AS vis_sm, CAST(vis_m AS INTEGER) AS vis_m, NULL::VARCHAR AS vis_flag, coalesce(weather, '') AS weather, CAST(temp_c AS INTEGER) AS temp_c, CAST(temp_c - 3 AS INTEGER) AS dewpoint_c,
  altimeter / 100 AS altimeter_inhg, round(altimeter / 100 * {metar.HPA_PER_INHG}::DOUBLE, 1) AS altimeter_hpa, CASE WHEN ceiling_ft IS NULL THEN 0 ELSE 3 END AS n_layers, CAST(ceiling_ft AS INTEGER) AS ceiling_ft,
  'AO2 36030KT 9000 TSRA OVC002 M09/M09 A3111' AS remarks FROM obs LEFT JOIN v USING (vis_m)"""),
}
