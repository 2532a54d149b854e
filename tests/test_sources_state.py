import datetime as dt
import gzip
import json
import math

import pytest

from wxspark.operators import forecast_state as fs
from wxspark.sources import files


def t(h, m=0, d=9):
    return dt.datetime(2026, 7, d, h, m)


def test_archive_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("station,valid,tmpf,p01i,metar\nKA,2026-07-09 12:00,70.0,T,KA 091200Z\nKA,2026-07-09 13:00,M,0.1,KA 091300Z\n")
    a, b = files.archive_csv(spark, str(tmp_path / "a.csv")).orderBy("obs_time").collect()
    assert (a.obs_time, a.tmpf, a.p01i, a.metar) == (t(12), 70.0, 0.0, "KA 091200Z") and b.tmpf is None


def test_forecast_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("forecasted_at,forecasted_time,lat,lon,tmp,gust\n2026-07-09T12:00:00Z,2026-07-09T13:00:00Z,1.5,2.5,NaN,7\n2026-07-09T12:00:00Z,2026-07-09T14:00:00Z,1.5,2.5,,inf\n")
    rows = {(r.valid_time, r.variable): r.value for r in files.forecast_csv(spark, str(tmp_path / "f.csv")).collect()}
    assert rows == {(t(13), "tmp"): None, (t(13), "gust"): 7.0, (t(14), "tmp"): None, (t(14), "gust"): None}


def test_report_json(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"icaoId": "KA", "obsTime": 1783598400, "rawOb": "KA x", "lat": 1.0, "lon": 2.0}]))
    (r,) = files.report_json(spark, str(tmp_path / "r.json")).collect()
    assert (r.station, r.obs_time) == ("KA", dt.datetime(2026, 7, 9, 12))


def test_sounding_and_bulletins(spark):
    html = "<pre>note\nPressure, Temp ,dewpoint\n1000,20,10\n,19,9\n850,x,5\n</pre> TAF KAAA 091200Z\n 0912/1012 X= TAF KAAA 091200Z 0912/1012 X="
    pages = spark.createDataFrame([(1, html), (2, "nothing"), (3, None)], "id int, html string")
    rows = files.sounding_html(pages, "id").orderBy("level").collect()
    assert [(r.pres, r.temp) for r in rows[:1]] == [(1000.0, 20.0)] and math.isnan(rows[1].temp) and len(rows) == 2 and math.isnan(rows[0].dir)
    assert [r.raw for r in files.bulletins(pages).collect()] == ["TAF KAAA 091200Z 0912/1012 X"]


def test_fixed_width_keeps_the_newest(spark):
    lines = spark.createDataFrame([("AB 2001 1.5",), ("AB 2010 2.5",), ("CD 1999    ",), ("           ",)], "value string")
    got = {r.id: (r.year, r.lat) for r in files.fixed_width(lines, {"id": (1, 2, "string"), "year": (4, 4, "int"), "lat": (9, 3, "double")}, ["id"], "year").collect()}
    assert got == {"AB": (2010, 2.5), "CD": (1999, None)}


def test_transcripts_and_blobs(spark, tmp_path):
    d = tmp_path / "m"
    d.mkdir()
    with gzip.open(d / "messages.json.gz", "wt") as f:
        json.dump([{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}], f)
    assert [(r.turn, r.role, r.content) for r in files.transcripts(spark, str(d)).orderBy("turn").collect()] == [(0, "user", "hi"), (1, "assistant", None)]
    b = files.blobs(spark, str(d))
    assert [r.kind for r in b.collect()] == ["gzip"]
    keys = b.select("sha256").union(spark.createDataFrame([("gone",)], "sha256 string"))
    assert [r.sha256 for r in files.missing_blobs(keys, b).collect()] == ["gone"]


GROUPS = "taf int, kind string, start timestamp_ntz, end timestamp_ntz, wind_dir int, wind_speed int, gust int, vis_m int, ceiling_ft int, weather string"


def groups(spark):
    n = None
    return spark.createDataFrame(
        [(1, "INITIAL", t(9), t(21), 240, 10, n, 9999, n, n), (1, "BECMG", t(12), t(14), 310, 20, 30, n, n, n), (1, "FM", t(18), t(21), 100, 5, n, 5000, n, n), (1, "TEMPO", t(15), t(17), n, n, n, 3000, n, "RA")], GROUPS)


@pytest.mark.parametrize("hour,want", [(8, (None, None, None)), (10, (240, 10, 9999)), (13, (240, 10, 9999)), (14, (310, 20, 9999)), (18, (100, 5, 5000))])
def test_baseline_folds_groups(spark, hour, want):
    times = spark.createDataFrame([(1, t(hour))], "taf int, t timestamp_ntz")
    (r,) = fs.baseline(groups(spark), times, ["taf"]).collect()
    assert (r.wind_dir, r.wind_speed, r.vis_m) == want


def test_overlays_and_wind_overrides(spark):
    times = spark.createDataFrame([(1, t(h)) for h in (14, 15, 16, 17)], "taf int, t timestamp_ntz")
    assert sorted(r.t.hour for r in fs.overlays(groups(spark), times, ["taf"]).collect()) == [15, 16]
    o = spark.createDataFrame([(1, t(15), 50, 7, None), (1, t(16), 60, 8, 18)], "taf int, after timestamp_ntz, o_dir int, o_speed int, o_gust int")
    got = {r.t.hour: (r.wind_dir, r.wind_speed, r.gust, r.vis_m) for r in fs.wind_overrides(fs.baseline(groups(spark), times, ["taf"]), o, ["taf"]).collect()}
    assert got == {14: (310, 20, 30, 9999), 15: (50, 7, None, 9999), 16: (60, 8, 18, 9999), 17: (60, 8, 18, 9999)}


def test_composite_and_absolute_times(spark):
    b = spark.createDataFrame([(1, 1, t(8), t(9), t(21)), (1, 2, t(15), t(15), t(21)), (1, 3, t(14), t(16), t(21))], "product int, bulletin int, issue timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz")
    assert sorted((r.bulletin, r.start, r.end) for r in fs.composite(b, ["product"]).collect()) == [(1, t(9), t(16)), (2, t(16), t(21))]
    a = spark.createDataFrame([(1, t(9), "0912"), (2, t(9), "0924"), (3, dt.datetime(2026, 12, 31, 9), "0106"), (4, t(9), "3212"), (5, t(9), None)], "i int, anchor timestamp_ntz, token string")
    got = {r.i: r.at for r in fs.absolutise(a, "anchor", "token", "at").collect()}
    assert got == {1: t(12), 2: t(0, d=10), 3: dt.datetime(2027, 1, 1, 6), 4: None, 5: None}
