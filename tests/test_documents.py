"""Severity, the audit, and states to groups, against plain Python and each other."""

import random

from pyspark.sql import functions as F

from wxspark.functions import weather as wx
from wxspark.operators import forecast_state
from wxspark.plans import documents

SF = "/root/testdata/sf0.001"


def plain_severity(group, sm):
    sign = next((s for s in ("+", "-", "VC") if group.startswith(s)), "")
    codes = [group[len(sign) :][i : i + 2] for i in range(0, len(group) - len(sign), 2)]
    bucket = 2.0 if sm is None else 7.0 if sm < 0.5 else 6.0 if sm < 1 else 5.0 if sm < 3 else 3.0 if sm <= 5 else 1.0
    if "TS" in codes:
        base = 9.3
    elif "FZ" in codes:
        base = 8.2 if "RA" in codes else 8.1 if "DZ" in codes else 8.0
    else:
        fixed, dim = [wx.SEVERITY[c] for c in codes if c in wx.SEVERITY], [wx.OBSCURING[c] for c in codes if c in wx.OBSCURING]
        base = max(fixed) + {"+": 1, "-": -1}.get(sign, 0) if fixed else bucket + max(dim) if dim else 0.0
    known = {c: n for n, x in wx.FAMILIES.items() for c in x.split()}
    name = "thunder" if "TS" in codes else "freezing" if "FZ" in codes else next((known[c] for c in codes if c in known), "other")
    return round(base * (0.5 if sign == "VC" else 1), 2), name


def test_severity_and_family(spark):
    r = random.Random(1)
    codes = [*wx.SEVERITY, *wx.OBSCURING, "FZ", "SH", "BL", "UP"]
    rows = [(r.choice(["", "", "+", "-", "VC"]) + "".join(r.choices(codes, k=r.randint(1, 3))), r.choice([None, 0.25, 0.5, 1.0, 2.9, 3.0, 5.0, 6.0])) for _ in range(400)] + [("+RA", 1.0), ("-SN", None), ("VCFG", 0.4), ("FG", 5.0)]
    got = spark.createDataFrame(rows, "g string, sm double").select("g", "sm", wx.severity(F.col("g"), F.col("sm")).alias("s"), wx.family(F.col("g")).alias("f")).collect()
    assert [(x.s, x.f) for x in got] == [plain_severity(*row) for row in rows]


def test_the_audit_reconciles_with_the_totals(spark):
    a = documents.audit(spark, SF).cache()
    totals = {x.element: (x.earned, x.available) for x in documents.t02_document_points(spark, SF).collect()}
    counted = {x.element: (round(x.e, 6), x.n) for x in a.where("counts and earned is not null").groupBy("element").agg(F.sum("earned").alias("e"), F.count("*").alias("n")).collect()}
    assert counted == {k: v for k, v in totals.items() if v[1]}
    # dense: each hour of each document has each element, and one row of it counts
    hours = documents.candidates(spark, SF).select("doc", "t").distinct().count()
    assert a.where("counts").count() == hours * 7 == a.select("doc", "t", "element").distinct().count()
    assert a.where("(earned is null) <> (reason is not null)").count() == 0
    a.unpersist()


def test_states_to_groups_and_back(spark):
    r = random.Random(2)
    rows, alternates = [], []
    for doc in range(40):
        s = None
        for t in range(100, 100 + r.choice([1, 5, 24])):
            if s is None or r.random() < 0.3:
                s = (r.choice([None, 10, 20]), r.choice([5, 8]), r.choice([None, 25]), r.choice([None, 800]), r.choice([None, 500]), r.choice([None, "RA"])) if s is None or r.random() < 0.4 else tuple(x if r.random() < 0.7 else y for x, y in zip(s, (20, 8, 25, 900, 600, "FG")))
            rows.append((doc, t, *s))
            for slot in range(2):
                if r.random() < 0.6:
                    alternates.append((doc, slot, t, *(x if r.random() < 0.6 else y for x, y in zip(s, (30, 9, 26, 700, 400, "SN")))))
    fields = "wind_dir long, wind_speed long, gust long, vis_m long, ceiling_ft long, weather string"
    states, alts = spark.createDataFrame(rows, f"doc long, t long, {fields}"), spark.createDataFrame(alternates, f"doc long, slot int, t long, {fields}")
    g = forecast_state.prevailing_groups(states, ["doc"]).cache()
    assert {x.kind for x in g.collect()} == {"INITIAL", "FM", "BECMG"}
    back = forecast_state.baseline(g, states.select("doc", "t"), ["doc"])
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    changes = sum(a[0] != b[0] or a[2:] != b[2:] for a, b in zip(rows, rows[1:])) + 1
    assert g.count() == changes
    tempo = forecast_state.temporary_groups(alts, states, ["doc"], "slot")
    said = forecast_state.overlays(tempo.withColumn("key", F.struct("doc", "slot")), alts.select(F.struct("doc", "slot").alias("key"), "t"), ["key"])
    names = [x.split()[0] for x in fields.split(", ")]
    base = states.select("doc", "t", F.struct(*names).alias("b"))
    got = said.select("key.doc", "key.slot", "t", F.struct(*names).alias("x")).join(base, ["doc", "t"]).select("doc", "slot", "t", *(F.coalesce(f"x.{c}", f"b.{c}").alias(c) for c in names))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(alternates, key=str)
    # the fewest: dynamic programming over all cuts of each slot's hours
    state = {(d, t): x for d, t, *x in rows}
    want = 0
    for key in {x[:2] for x in alternates}:
        own = sorted(x[2:] for x in alternates if x[:2] == key)

        def fits(some):
            return all(b[0] == a[0] + 1 for a, b in zip(some, some[1:])) and all(len({h[1 + i] for h in some}) == 1 or all(h[1 + i] == state[key[0], h[0]][i] for h in some) for i in range(6))

        best = [0]
        for j in range(1, len(own) + 1):
            best.append(min(best[i] + 1 for i in range(j) if fits(own[i:j])))
        want += best[-1]
    assert tempo.count() == want
    g.unpersist()


REPORTS = {
    "METAR KABC 100855Z AUTO 24008G18KT 200V280 1 1/2SM R12L/2400FT -RA BR BKN015 OVC030CB M02/M05 A2990 RMK AO2 27040G60KT 1/4SM FG OVC001 A3011": dict(
        station="KABC", day=10, hhmm="0855", report_type="METAR", auto=True, cavok=False, wind_dir_deg=240, wind_dir_card=None, wind_speed=8, wind_gust=18, wind_unit="KT", visibility="1 1/2SM", vis_sm=1.5, vis_m=2400, vis_flag=None,
        weather=["-RA", "BR"], temp_c=-2, dewpoint_c=-5, altimeter_inhg=29.9, ceiling_ft=1500, remarks="AO2 27040G60KT 1/4SM FG OVC001 A3011"),
    "SPECI COR KXYZ 101200Z VRB03KT P6SM VCSH SKC 24/12 A2992=": dict(report_type="SPECI", station="KXYZ", corrected=True),
    "SPECI KXYZ 101200Z COR VRB03KT P6SM VCSH SKC 24/12 A2992=": dict(station="KXYZ", corrected=True, wind_dir_deg=None, wind_dir_card="VRB", vis_sm=6.0, vis_m=9999, vis_flag="P", weather=["VCSH"], ceiling_ft=None, dewpoint_c=12, remarks=None),
    "EDDF 101220Z 01005MPS CAVOK 20/10 Q1013 BECMG 27020G40KT 0800 TSRA BKN002": dict(station="EDDF", report_type=None, cavok=True, visibility=None, vis_sm=6.0, vis_m=9999, vis_flag="P", weather=[], wind_speed=5, wind_unit="MPS", wind_gust=None, altimeter_hpa=1013.0, altimeter_inhg=29.91, ceiling_ft=None),
    "KAAA 101220Z 00000KT M1/4SM FG VV002 20/ A3001 RERA 35040KT": dict(vis_sm=0.25, vis_m=400, vis_flag="M", vertical_visibility_ft=200, ceiling_ft=200, temp_c=20, dewpoint_c=None, wind_speed=0, altimeter_hpa=1016.3),
    "LFPG 101230Z 24010KT 0450 FZFG SCT003TCU OVC///  M00/M01 Q0998 NOSIG": dict(vis_m=450, vis_sm=0.25, visibility="0450", weather=["FZFG"], temp_c=0, dewpoint_c=-1, ceiling_ft=None),
    "KBAD nonsense 27015KT": dict(station="KBAD", day=None, wind_speed=15, visibility=None, vis_m=None, weather=[], altimeter_inhg=None, remarks=None),
}


def test_reports_by_token_and_place(spark):
    from wxspark.functions import metar

    got = {x.raw: x for x in metar.parse_reports(spark.createDataFrame([(x,) for x in ["# note", " ", *REPORTS]], "value string")).collect()}
    assert len(got) == len(REPORTS)
    for raw, want in REPORTS.items():
        for name, value in want.items():
            assert got[raw.rstrip("=")][name] == value, (raw, name)
    layers = got[next(iter(REPORTS))].clouds
    assert [(c.cover, c.height_ft, c.type) for c in layers] == [("BKN", 1500, None), ("OVC", 3000, "CB")]
    assert len(metar.parse_reports(spark.createDataFrame([("x",)], "value string")).columns) == 26
