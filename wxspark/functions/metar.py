"""X29-X32, SC11: surface reports to 25 fields by one fold over a report's tokens, in Spark's own functions.

A token fills a field by what it looks like and by where it stands: sections come in a fixed order, and a token is taken for a section only if
no later one has begun (and, where a section holds one token, if it hasn't been filled). So remarks, trends and recent
weather fill nothing, and a second wind or pressure doesn't replace the first. Tokens that fit nowhere are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wxspark.functions.reports_text import WEATHER

#: Reportable visibilities, statute miles and metres; 9999 m is ten kilometres or more.
VIS_TABLE = [
    (0.0, 0), (0.0625, 100), (0.125, 200), (0.1875, 300), (0.25, 400), (0.3125, 500), (0.375, 600), (0.5, 800), (0.625, 1000), (0.75, 1200), (0.875, 1400), (1.0, 1600), (1.125, 1800), (1.25, 2000),
    (1.375, 2200), (1.5, 2400), (1.625, 2600), (1.75, 2800), (1.875, 3000), (2.0, 3200), (2.25, 3600), (2.5, 4000), (2.75, 4400), (3.0, 4800), (4.0, 6000), (5.0, 8000), (6.0, 9000),
]
#: Hectopascals in an inch of mercury; covers that are no layers; what ends the report's own observation.
HPA_PER_INHG, CLEAR, ENDS = 33.8638866667, r"CLR|SKC|NSC|NCD", r"RMK|BECMG|TEMPO|NOSIG|INTER|PROB\d\d|FM\d{4,6}"
#: The sections in order: name, pattern, whether it may hold several tokens.
SECTIONS = [
    ("type", r"METAR|SPECI", False), ("early", r"COR", True), ("station", r"[A-Z][A-Z0-9]{3}", False), ("time", r"\d{6}Z", False), ("modifier", r"AUTO|COR", True), ("wind", r"(?:\d{3}|VRB|///|[NSEW]{1,3})\d{2,3}(?:G\d{2,3})?(?:KT|MPS|KMH)", False),
    ("turning", r"\d{3}V\d{3}", False), ("visibility", r"CAVOK|[MP]?(?:\d{1,2}_\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}|\d{1,3})SM|[MP>]?\d{4}(?:NDV)?", False), ("runway", r"R\d{2}[LCR]?/\S+", True),
    ("weather", WEATHER + r"|(?:VC|[+-])?SH|VCTS|[+-]?TS", True), ("sky", rf"(?:FEW|SCT|BKN|OVC|VV)(?:\d{{3}}|///)(?:CB|TCU|///)?|{CLEAR}", True), ("temperature", r"M?\d{2}/(?:M?\d{2})?", False), ("pressure", r"[AQ]\d{4}", False),
]


def tokens(raw: Column) -> Column:
    """The tokens before remarks and trends; a whole number of miles and its fraction are one."""
    line = F.regexp_replace(F.trim(F.regexp_replace(F.trim(raw), "=$", "")), r"\s+", " ")
    return F.split(F.regexp_replace(line, r" (\d{1,2}) (\d{1,2}/\d{1,2}SM)", " $1_$2"), " ")


def sections(raw: Column, known: list[tuple[str, str, bool]] = SECTIONS, ends: str = ENDS) -> Column:
    """An array of struct(section, token) of the tokens that are taken, in order: one fold, whose state is the section reached."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<section:string,token:string>>").alias("taken"))

    names = F.array(*(F.lit(n) for n, _, _ in known))

    def step(state: Column, token: Column) -> Column:
        at, place = state["at"], F.lit(None).cast("int")
        # whether a section may still come is asked before its pattern, which costs more
        for k, (_, pattern, many) in reversed(list(enumerate(known, 1))):
            place = F.when((at <= k if many else at < k) & token.rlike(f"^(?:{pattern})$"), k).otherwise(place)
        place = F.when(at > len(known), None).when(token.rlike(f"^(?:{ends})$"), len(known) + 1).otherwise(place)
        put = lambda p: F.concat(state["taken"], F.array(F.struct(F.get(names, p - 1).alias("section"), token.alias("token"))))
        # a transform over an array of one finds the place once and names it thrice
        after = F.transform(F.array(place), lambda p: F.struct(F.coalesce(p, at).alias("at"), F.when(p <= len(known), put(p)).otherwise(state["taken"]).alias("taken")))
        return F.get(after, F.lit(0))

    return F.aggregate(tokens(raw), start, step, lambda s: s["taken"])


def _nearest(value: Column, key: str, out: str) -> Column:
    """The table's row nearest to a value; of two as near the lower visibility."""
    table = F.array(*(F.struct(F.lit(sm).alias("sm"), F.lit(float(m)).alias("m")) for sm, m in VIS_TABLE))
    # a transform over an array of one finds the value once, not for each row of the table
    least = lambda v: F.array_min(F.transform(table, lambda r: F.struct(F.abs(r[key] - v).alias("k"), r[out].alias("v"))))["v"]
    return F.when(value.isNotNull(), F.get(F.transform(F.array(value), least), F.lit(0)))


def visibility_sm(metres: Column) -> Column:
    """Statute miles of metres by the table, six at ten kilometres or more."""
    return F.when(metres >= 9999, 6.0).otherwise(_nearest(metres.cast("double"), "m", "sm"))


def visibility(token: Column) -> dict[str, Column]:
    """Statute miles, metres and flag of a token: M less, P more, or null."""
    part = lambda p, n=1: F.nullif(F.regexp_extract(token, p, n), F.lit(""))
    number = lambda c: F.expr("cast(null as double)") if c is None else c.cast("double")
    is_sm, sign = token.endswith("SM"), F.nullif(F.regexp_replace(F.regexp_extract(token, "^([MP>]?)", 1), ">", "P"), F.lit(""))
    whole = number(part(r"^[MP]?(\d{1,3})(?:_|SM)"))
    fraction = number(part(r"(\d{1,2})/\d{1,2}SM$")) / number(part(r"\d{1,2}/(\d{1,2})SM$"))
    miles = F.coalesce(whole + fraction, whole, fraction)
    metres = number(part(r"^[MP>]?(\d{4})"))
    far = metres >= 9999
    cavok = token == "CAVOK"
    return {
        "vis_sm": F.when(is_sm, miles).when(cavok | far, 6.0).otherwise(_nearest(metres, "m", "sm")),
        "vis_m": F.when(is_sm, F.when((miles > 6) | ((sign == "P") & (miles >= 6)), 9999.0).otherwise(_nearest(miles, "sm", "m"))).when(cavok | far, 9999.0).otherwise(metres).cast("int"),
        "vis_flag": F.when(cavok | (~is_sm & far), "P").otherwise(sign),
    }


def fields(raw: str = "raw") -> dict[str, Column]:
    """The fields of a report whose sections' tokens are in columns _t_ and the section's name."""
    all_ = lambda name: F.col(f"_t_{name}")
    one = lambda name: F.get(all_(name), F.lit(0))
    part = lambda name, p, n=1: F.nullif(F.regexp_extract(one(name), p, n), F.lit(""))
    signed = lambda c: F.regexp_replace(c, "^M", "-").cast("int")
    direction, pressure = part("wind", r"^(\d{3}|VRB|[NSEW]{1,3})"), part("pressure", r"(\d{4})").cast("double")
    inches = part("pressure", "^(A)").isNotNull()
    layer = lambda p, t: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    clouds = F.transform(F.filter(all_("sky"), lambda t: ~t.rlike(f"^(?:{CLEAR}|VV.*)$")), lambda t: F.struct(F.substring(t, 1, 3).alias("cover"), (layer(r"^...(\d{3})", t).cast("int") * 100).alias("height_ft"), layer("(CB|TCU)$", t).alias("type")))
    vertical = F.get(F.filter(all_("sky"), lambda t: t.startswith("VV")), F.lit(0))
    vertical = F.nullif(F.regexp_extract(vertical, r"^VV(\d{3})", 1), F.lit("")).cast("int") * 100
    bases = F.transform(F.filter(clouds, lambda c: c["cover"].isin("BKN", "OVC")), lambda c: c["height_ft"])
    vis, seen = visibility(one("visibility")), F.nullif(one("visibility"), F.lit("CAVOK"))
    return {
        "station": one("station"), "day": part("time", r"^(\d{2})").cast("int"), "hhmm": part("time", r"^\d{2}(\d{4})"), "report_type": one("type"),
        "auto": F.array_contains(all_("modifier"), "AUTO"), "corrected": F.array_contains(F.concat(all_("early"), all_("modifier")), "COR"), "cavok": F.coalesce(one("visibility") == "CAVOK", F.lit(False)),
        "wind_dir_deg": F.when(direction.rlike(r"^\d+$"), direction).cast("int"), "wind_dir_card": F.when(~direction.rlike(r"^\d+$"), direction), "wind_speed": part("wind", r"^(?:\d{3}|VRB|///|[NSEW]{1,3})(\d{2,3})").cast("int"),
        "wind_gust": part("wind", r"G(\d{2,3})").cast("int"), "wind_unit": part("wind", "(KT|MPS|KMH)$"), "visibility": F.regexp_replace(seen, "_", " "), **vis,
        "weather": all_("weather"), "temp_c": signed(part("temperature", r"^(M?\d{2})/")), "dewpoint_c": signed(part("temperature", r"/(M?\d{2})$")),
        "altimeter_inhg": F.when(inches, pressure / 100).otherwise(F.round(pressure / HPA_PER_INHG, 2)), "altimeter_hpa": F.when(inches, F.round(pressure / 100 * HPA_PER_INHG, 1)).otherwise(pressure),
        "clouds": clouds, "vertical_visibility_ft": vertical, "ceiling_ft": F.array_min(F.array_compact(F.concat(bases, F.array(vertical)))),
        "remarks": F.nullif(F.regexp_extract(raw, r"\sRMK\s+(.*?)=?\s*$", 1), F.lit("")),
    }


def _of(name: str):
    return lambda x: x["section"] == name


def parse_reports(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Report lines to their fields, beside the columns to keep and the raw line; blank lines and those that begin with # are left out."""
    text = F.trim(F.col(column))
    rows = lines.where((text != "") & ~text.startswith("#")).select(*keep, F.regexp_replace(text, r"\s*=\s*$", "").alias("raw"))
    held = {f"_t_{name}": F.transform(F.filter("_s", _of(name)), lambda x: x["token"]) for name, _, _ in SECTIONS}
    return rows.withColumn("_s", sections(F.col("raw"))).select("*", *(c.alias(k) for k, c in held.items())).select(*keep, *(c.alias(n) for n, c in fields().items()), "raw")


#: The sections of a forecast group, after its kind and times.
GROUP_SECTIONS = [
    ("head", r"TAF|AMD|COR|BECMG|TEMPO|PROB\d\d|FM\d{6}", True), ("station", r"[A-Z][A-Z0-9]{3}", False), ("issue", r"\d{6}Z", False), ("validity", r"\d{4}/\d{4}", False), *(x for x in SECTIONS if x[0] in ("wind", "visibility")),
    ("weather", SECTIONS[9][1] + "|NSW", True), ("sky", SECTIONS[10][1], True), ("altimeter", r"QNH\d{4}INS", False),
]


def group_sections(text: Column) -> Column:
    """The sections of a forecast group, to be held in a column of their own for `group_tokens`."""
    return sections(text, GROUP_SECTIONS, "RMK|LAST|LIMITED")


def group_tokens(s: Column) -> dict[str, Column]:
    """What `group_fields` reads of a group's sections; columns as well, as each is read several times."""
    all_ = lambda name: F.transform(F.filter(s, lambda x: x["section"] == name), lambda x: x["token"])
    return {"_wind": F.get(all_("wind"), F.lit(0)), "_visibility": F.get(all_("visibility"), F.lit(0)), "_weather": all_("weather"), "_sky": all_("sky"), "_altimeter": F.get(all_("altimeter"), F.lit(0))}


def group_fields() -> dict[str, Column]:
    """What a forecast group says by the columns of `group_tokens`, null where it says nothing: the fields of `operators.forecast_state`, altimeter in hundredths of an inch.

    A group that says its weather is NSW says there is none, as an empty text. Its ceiling is the lowest broken or overcast layer.
    """
    part = lambda name, p: F.nullif(F.regexp_extract(f"_{name}", p, 1), F.lit("")).cast("long")
    bases = F.transform(F.filter("_sky", lambda t: t.rlike(r"^(?:BKN|OVC|VV)\d{3}")), lambda t: F.regexp_extract(t, r"(\d{3})", 1).cast("long") * 100)
    weather = F.array_join(F.filter("_weather", lambda t: t != "NSW"), " ")
    return {
        "wind_dir": part("wind", r"^(\d{3})"), "wind_speed": part("wind", r"^(?:\d{3}|VRB)(\d{2,3})"), "gust": part("wind", r"G(\d{2,3})"), "vis_m": visibility(F.col("_visibility"))["vis_m"].cast("long"),
        "ceiling_ft": F.array_min(bases), "weather": F.when(F.size("_weather") > 0, weather), "altimeter": part("altimeter", r"(\d{4})"),
    }
