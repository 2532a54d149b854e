"""Report text into columns, with Spark's own string functions: METAR fields, TAF groups, remarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weather codes by class; freezing and thunder codes change the class.
WEATHER = r"(?:\+|-|VC)?(?:MI|PR|BC|DR|BL|SH|TS|FZ)?(?:DZ|RA|SN|SG|IC|PL|GR|GS|UP|BR|FG|FU|VA|DU|SA|HZ|PO|SQ|FC|SS|DS)+"


def _group(text: Column, pattern: str, n: int = 1) -> Column:
    out = F.regexp_extract(text, pattern, n)
    return F.when(out != "", out)


def body(text: Column) -> Column:
    """The report without its remarks."""
    return F.trim(F.regexp_replace(text, r"\s+RMK\b.*$", ""))


def metar_fields(text: Column) -> dict[str, Column]:
    """Station, day-hour-minute, wind, gust, visibility, lowest ceiling, temperatures, altimeter, weather, correction."""
    t = F.concat(F.lit(" "), body(text), F.lit(" "))
    signed = lambda c: F.when(c.startswith("M"), -F.substring(c, 2, 2).cast("int")).otherwise(c.cast("int"))
    sm_whole, sm_frac = _group(t, r"\s(?:P|M)?(\d{1,2})(?:\s\d/\d)?SM\s"), F.regexp_extract(t, r"\s(?:M)?(?:\d+\s)?(\d)/(\d{1,2})SM\s", 1)
    frac = F.when(sm_frac != "", sm_frac.cast("double") / F.regexp_extract(t, r"\s(?:M)?(?:\d+\s)?(\d)/(\d{1,2})SM\s", 2).cast("double"))
    mixed = F.regexp_extract(t, r"\s(\d)\s\d/\d{1,2}SM\s", 1)
    vis = F.when(mixed != "", mixed.cast("double") + frac).when(frac.isNotNull(), frac).otherwise(sm_whole.cast("double"))
    layers = F.transform(F.regexp_extract_all(t, F.lit(r"\s(?:BKN|OVC|VV)(\d{3})"), F.lit(1)), lambda x: x.cast("int") * 100)
    return {
        "station": _group(t, r"^\s(?:METAR |SPECI )?(?:COR )?([A-Z][A-Z0-9]{3})\s"),
        "day": _group(t, r"\s(\d{2})\d{4}Z\s").cast("int"), "hhmm": _group(t, r"\s\d{2}(\d{4})Z\s"),
        "wind_dir": F.when(~t.rlike(r"\sVRB\d"), _group(t, r"\s(\d{3})\d{2,3}(?:G\d{2,3})?KT\s").cast("int")),
        "wind_speed": _group(t, r"\s(?:\d{3}|VRB)(\d{2,3})(?:G\d{2,3})?KT\s").cast("int"), "gust": _group(t, r"\s(?:\d{3}|VRB)\d{2,3}G(\d{2,3})KT\s").cast("int"),
        "vis_sm": vis, "vis_flag": _group(t, r"\s([PM])\d{1,2}(?:/\d{1,2})?SM\s"), "vis_m": _group(t, r"\s(\d{4})\s").cast("int"), "cavok": t.contains(" CAVOK "),
        "ceiling_ft": F.array_min(layers), "temp_c": signed(_group(t, r"\s(M?\d{2})/M?\d{2}\s")), "dewpoint_c": signed(_group(t, r"\sM?\d{2}/(M?\d{2})\s")),
        "altimeter": _group(t, r"\sA(\d{4})\s").cast("int"), "weather": F.array_join(F.regexp_extract_all(t, F.lit(rf"\s({WEATHER})(?=\s)"), F.lit(1)), " "), "corrected": t.rlike(r"\bCOR\b"),
    }


def parse_metars(lines: DataFrame, column: str = "value") -> DataFrame:
    """Report lines to columns; blank lines and those that begin with # are left out (SC11)."""
    kept = lines.where(F.trim(F.col(column)) != "").where(~F.ltrim(F.col(column)).startswith("#"))
    return kept.select(F.col(column).alias("raw"), *(c.alias(k) for k, c in metar_fields(F.col(column)).items()))


def taf_groups(tafs: DataFrame, column: str = "raw") -> DataFrame:
    """A forecast text to one row a group: number, kind, validity tokens and text."""
    marked = F.regexp_replace(body(F.col(column)), r"\s+(?=(?:FM\d{6}|BECMG|TEMPO|PROB\d{2})\b)", "\u0001")
    # PROBnn TEMPO is one group
    marked = F.regexp_replace(marked, "(PROB\\d{2})\u0001TEMPO", "$1 TEMPO")
    rows = tafs.select("*", F.posexplode(F.split(marked, "\u0001")).alias("group_no", "group_text"))
    g = F.col("group_text")
    kind = F.when(F.col("group_no") == 0, "INITIAL").when(g.startswith("FM"), "FM").otherwise(F.regexp_extract(g, r"^(BECMG|TEMPO|PROB\d{2}(?: TEMPO)?)", 1))
    return rows.select("*", kind.alias("kind"), F.coalesce(_group(g, r"^FM(\d{6})"), _group(g, r"\b(\d{4})/\d{4}\b")).alias("from_token"), _group(g, r"\b\d{4}/(\d{4})\b").alias("to_token"))


def wind_override(text: Column) -> Column:
    """WND ddhhmm AFT remarks as an array of (wind, after)."""
    found = F.regexp_extract_all(text, F.lit(r"(WND \d{5}(?:G\d{2})?KT AFT \d{4,6})"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"WND (\S+)", 1).alias("wind"), F.regexp_extract(x, r"AFT (\d+)", 1).alias("after")))


def service_gap(text: Column) -> Column:
    """The tokens of LAST NO AMDS AFT ... NEXT ...; four and six digits are both read."""
    return F.struct(_group(text, r"LAST NO AMDS AFT (\d{4}(?:\d{2})?)\b").alias("after"), _group(text, r"NEXT (\d{4}(?:\d{2})?)\b").alias("next"))
