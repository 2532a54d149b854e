"""Column expressions of the domain: angles, distances, units, categories. No user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mean radius of the Earth, and the Magnus formula's two numbers.
EARTH_KM, MAGNUS_A, MAGNUS_B = 6371.0088, 17.625, 243.04
#: The compass by sector.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def compass(degrees: Column) -> Column:
    """X11: the 16-point name; sector edges belong to the next sector."""
    at = F.pmod(F.floor(F.pmod(degrees, F.lit(360)) / 22.5 + 0.5), F.lit(16)).cast("int") + 1
    return F.element_at(F.array(*map(F.lit, COMPASS)), at)


def turn(forecast: Column, observed: Column) -> Column:
    """Signed difference of directions in [-180, 180)."""
    return F.pmod(forecast - observed + 180, F.lit(360)) - 180


def apart(a: Column, b: Column) -> Column:
    """Unsigned difference of directions, 0 to 180."""
    d = F.pmod(a - b, F.lit(360))
    return F.least(d, 360 - d)


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def wind_from(u: Column, v: Column) -> Column:
    """The direction wind comes from, of its components."""
    return F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))


def circular_mean(degrees: Column, least: float = 1e-9) -> Column:
    """The mean direction; null where directions cancel out."""
    s, c = F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))
    return F.when(F.hypot(s, c) > least, F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)))


def kelvin_to_c(k: Column) -> Column:
    return k - 273.15


def ms_to_kt(v: Column) -> Column:
    return v * 1.943844


def dewpoint(temp_c: Column, rh: Column) -> Column:
    """Magnus dewpoint; null at a humidity that is not above 0."""
    g = F.ln(F.when(rh > 0, rh) / 100) + MAGNUS_A * temp_c / (MAGNUS_B + temp_c)
    return MAGNUS_B * g / (MAGNUS_A - g)


def humidity(temp_c: Column, dew_c: Column) -> Column:
    """X16 the other way: percent."""
    return 100 * F.exp(MAGNUS_A * dew_c / (MAGNUS_B + dew_c)) / F.exp(MAGNUS_A * temp_c / (MAGNUS_B + temp_c))


def ladder(value: Column, steps: list[tuple[float, str]], top: str) -> Column:
    """The name of the band [lo, hi) a value lies in; steps are (upper edge, name), ascending."""
    out = F.when(value < steps[0][0], F.lit(steps[0][1]))
    for edge, name in steps[1:]:
        out = out.when(value < edge, F.lit(name))
    return F.when(value.isNull(), None).otherwise(out.otherwise(F.lit(top)))


def ladder_sql(value: str, steps: list[tuple[float, str]], top: str) -> str:
    """X22 as SQL text for the twins."""
    return f"CASE {' '.join(f'WHEN {value} < {edge} THEN {name!r}' for edge, name in steps)} WHEN {value} IS NOT NULL THEN {top!r} END"


#: Category edges in feet and metres (X23, X24) at the landing minima of 200 ft and 800 m.
LANDING_FT, LANDING_M = 200, 800
CEILING_STEPS = [(200, "A"), (700, "B"), (1000, "C"), (2000, "D")]
VIS_STEPS = [(800, "A"), (3200, "B"), (4800, "D")]


def flight_category(ceiling_ft: Column, vis_m: Column, ceiling_known: Column | None = None) -> Column:
    """The worse of the ceiling's and the visibility's letter; a null ceiling is unlimited unless it isn't known, a null visibility unknown."""
    c = F.coalesce(ladder(ceiling_ft, CEILING_STEPS, "E"), F.lit("E"))
    known = vis_m.isNotNull() if ceiling_known is None else vis_m.isNotNull() & ceiling_known
    return F.when(known, F.least(c, ladder(vis_m, VIS_STEPS, "E")))


#: Altimeter bands in hundredths of an inch (X27); the upper edge belongs to HIGH, the lower one to NORMAL.
HIGH_FROM, LOW_BELOW = 3100, 2800


def altimeter_band(hundredths: Column) -> Column:
    """HIGH, LOW or NORMAL; null where the altimeter is."""
    return F.when(hundredths >= HIGH_FROM, "HIGH").when(hundredths < LOW_BELOW, "LOW").when(hundredths.isNotNull(), "NORMAL")


def altimeter_band_sql(hundredths: str) -> str:
    return f"CASE WHEN {hundredths} >= {HIGH_FROM} THEN 'HIGH' WHEN {hundredths} < {LOW_BELOW} THEN 'LOW' WHEN {hundredths} IS NOT NULL THEN 'NORMAL' END"


#: Codes by class.
CLASSES = {"other": "TS|SQ|FC|SS|DS|UP", "liquid": "RA|DZ", "frozen": "SN|SG|IC|PL|GR|GS", "obscuration": "FG|BR|HZ|FU|VA|DU|SA|PY|PO"}


def weather_classes(code: Column) -> Column:
    """The classes of a code, an array; rain and drizzle that freeze are freezing, thunder stands beside its rain."""
    named = [F.when(code.rlike(codes), F.when(code.contains("FZ"), "freezing").otherwise(name) if name == "liquid" else F.lit(name)) for name, codes in CLASSES.items()]
    return F.array_compact(F.array(*named))


#: Severities of precipitation, storms and ash, and what an obscuration adds to that of its visibility (X28); families by code.
SEVERITY = {"FC": 10.3, "DS": 10.2, "SS": 10.1, "TS": 9.3, "SQ": 9.2, "VA": 9.1, "GR": 7.0, "PL": 6.2, "GS": 6.1, "SN": 5.3, "SG": 5.2, "IC": 5.1, "RA": 3.0, "PO": 1.0}
OBSCURING = {"DU": 0.7, "SA": 0.6, "FU": 0.5, "FG": 0.4, "BR": 0.3, "HZ": 0.2, "PY": 0.1, "DZ": 0.0}
FAMILIES = {"rain": "DZ RA", "snow": "SN SG IC", "ice": "PL GR GS", "fog": "BR FG", "haze": "FU HZ PY VA", "dust": "DU SA PO DS SS"}
FREEZING_SEVERITY = {"RA": 8.2, "DZ": 8.1, "": 8.0}
#: Severity by statute miles below, and at five miles and beyond; of an unknown visibility.
VIS_SEVERITY, VIS_FIVE, VIS_BEYOND, VIS_UNKNOWN = [(0.5, 7.0), (1, 6.0), (3, 5.0)], 3.0, 1.0, 2.0


def _codes(group: Column) -> Column:
    """The two-letter codes of a weather group, in order, without its sign."""
    return F.regexp_extract_all(F.regexp_replace(group, r"^([+-]|VC)", ""), F.lit("(.{2})"), F.lit(1))


def _numbers(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def severity(group: Column, vis_sm: Column) -> Column:
    """The hazard of a weather group, 0 to 11: thunder, then freezing, then the worst fixed code, which its sign raises or lowers by one, or
    an obscuration by its visibility; half of it in the vicinity. Visibility may be null, not so the group."""
    codes, sign = _codes(group), F.regexp_extract(group, r"^([+-]|VC)", 1)
    worst = lambda values: F.array_max(F.transform(F.filter(codes, lambda c: c.isin(*values)), lambda c: F.element_at(_numbers(values), c)))
    bucket = F.when(vis_sm.isNull(), VIS_UNKNOWN)
    for edge, value in VIS_SEVERITY:
        bucket = bucket.when(vis_sm < edge, value)
    bucket = bucket.when(vis_sm <= 5, VIS_FIVE).otherwise(VIS_BEYOND)
    has = lambda c: F.array_contains(codes, c)
    freezing = F.when(has("RA"), FREEZING_SEVERITY["RA"]).when(has("DZ"), FREEZING_SEVERITY["DZ"]).otherwise(FREEZING_SEVERITY[""])
    fixed = worst(SEVERITY) + F.when(sign == "+", 1.0).when(sign == "-", -1.0).otherwise(0.0)
    base = F.when(has("TS"), SEVERITY["TS"]).when(has("FZ"), freezing).otherwise(F.coalesce(fixed, bucket + worst(OBSCURING), F.lit(0.0)))
    return F.round(F.when(sign == "VC", base * 0.5).otherwise(base), 2)


def family(group: Column) -> Column:
    """Thunder, freezing, or the family of the first code that has one, else other."""
    codes = _codes(group)
    known = {c: name for name, all_ in FAMILIES.items() for c in all_.split()}
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    first = F.get(F.filter(codes, lambda c: c.isin(*known)), F.lit(0))
    return F.when(F.array_contains(codes, "TS"), "thunder").when(F.array_contains(codes, "FZ"), "freezing").otherwise(F.coalesce(F.element_at(names, first), F.lit("other")))


def contingency(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Scores of a 2 x 2 table (hits, misses, false alarms, correct nulls); a zero denominator gives null."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    chance = ((a + b) * (a + c) + (c + d) * (b + d)) / F.nullif(a + b + c + d, F.lit(0.0))
    return {
        "pod": F.try_divide(a, a + b), "far": F.try_divide(c, a + c), "csi": F.try_divide(a, a + b + c),
        "bias": F.try_divide(a + c, a + b), "hss": F.try_divide(a + d - chance, a + b + c + d - chance),
    }
