import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from wxspark import catalog
from wxspark.functions import reports_text, weather as wx
from wxspark.operators import asof, intervals, matching, truth, writes
from wxspark.streaming import stream
from tests.oracle import same

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2026, 7, 9, 12)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


# --- as-of joins ---


def frames(spark, left, right):
    return spark.createDataFrame(left, "k int, t timestamp_ntz, id int"), spark.createDataFrame(right, "k int, u timestamp_ntz, v int")


def test_asof_is_strict_bounded_and_null_safe(spark):
    l, r = frames(spark, [(1, at(0), 1), (1, at(100), 2), (1, None, 3), (None, at(0), 4), (2, at(5), 5)], [(1, at(0), 10), (1, at(-10), 11), (1, at(9), 12), (None, at(-1), 13), (1, None, 14)])
    got = {x.id: x.r_v for x in asof.backward(l, r, ["k"], "t", "u", True, 90 * 60).collect()}
    assert got == {1: 11, 2: None, 3: None, 4: None, 5: None}
    assert {x.id: x.r_v for x in asof.backward(l, r, ["k"], "t", "u", False, 92 * 60).collect()} == {1: 10, 2: 12, 3: None, 4: None, 5: None}


def test_nearest_takes_the_later_of_equals(spark):
    l, r = frames(spark, [(1, at(0), 1), (1, at(60), 2), (1, at(500), 3)], [(1, at(-10), 10), (1, at(10), 11), (1, at(60), 12)])
    assert {x.id: x.r_v for x in asof.nearest(l, r, ["k"], "t", "u", 3600).collect()} == {1: 11, 2: 12, 3: None}


# --- intervals ---


def test_intervals_hold_ninety_minutes_then_gap(spark):
    f = spark.createDataFrame([("a", at(0)), ("a", at(60)), ("a", at(300))], "s string, t timestamp_ntz")
    rows = sorted((x.start, x.end, x.is_gap) for x in intervals.intervalise(f, ["s"], "t").collect())
    assert rows == [(at(0), at(60), False), (at(60), at(150), False), (at(150), at(300), True), (at(300), at(390), False)]


def test_overlap_join_matches_brute_force(spark):
    r = random.Random(1)
    a = [(r.randint(0, 2), i, at(s), at(s + r.randint(1, 300))) for i in range(40) for s in [r.randint(0, 600)]]
    b = [(r.randint(0, 2), i, at(s), at(s + r.randint(1, 300))) for i in range(40) for s in [r.randint(0, 600)]]
    fa, fb = (spark.createDataFrame(x, "k int, i int, start timestamp_ntz, end timestamp_ntz") for x in (a, b))
    got = sorted((x.l_i, x.r_i) for x in intervals.overlap_join(fa, fb, ["k"]).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3]))


def test_overlap_touching_edges_do_not_meet(spark):
    f = lambda s, e: spark.createDataFrame([(1, at(s), at(e))], "k int, start timestamp_ntz, end timestamp_ntz")
    assert intervals.overlap_join(f(0, 60), f(60, 90), ["k"]).count() == 0


def _obs(spark, rows):
    cols = "station string, obs_time timestamp_ntz, event_id int, ceiling_ft int, vis_m int, altimeter int, gust int, wind_speed int, wind_dir int, weather string"
    full = [("K", at(m), i, c, v, 2992, None, w, d, None) for i, (m, c, v, w, d) in enumerate(rows)]
    return truth.state_hours(spark.createDataFrame(full, cols), ["station"], ["event_id"])


def test_truth_views(spark):
    h = _obs(spark, [(-5, 1500, 9999, 10, 240), (65, 900, 1600, 20, 100), (70, 900, None, 20, 200)])
    cons = {x.hour: x for x in truth.conservative(h, ["station"]).collect()}
    assert cons[T0].cons_ceiling == 1500 and cons[at(60)].cons_ceiling == 900 and cons[at(60)].cons_vis == 1600
    assert (cons[at(60)].cons_speed, cons[at(60)].cons_dir) == (20, 100)
    pred = {x.hour: x for x in truth.predominant(_obs(spark, [(0, 1000, 1, 1, 1), (40, 500, 1, 1, 1), (60, 1, 1, 1, 1)]), ["station"], "ceiling_ft").collect()}
    assert pred[T0].pred_ceiling_ft == 1000 and pred[T0].n_temporary == 1


# --- columns ---


def one(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def test_angles_and_distances(spark):
    f = lambda x: F.lit(float(x))
    assert one(spark, wx.turn(F.lit(350), F.lit(10)), wx.apart(F.lit(350), F.lit(10)), wx.compass(F.lit(349)), wx.compass(F.lit(11.25))) == (-20, 20, "N", "NNE")
    km, b = one(spark, wx.distance_km(f(0), f(0), f(0), f(1)), wx.bearing(f(0), f(0), f(0), f(1)))
    assert abs(km - 111.195) < 0.01 and abs(b - 90) < 1e-9
    assert one(spark, wx.flight_category(F.lit(None).cast("int"), F.lit(9999)), wx.flight_category(F.lit(100), F.lit(9999)), wx.flight_category(F.lit(100), F.lit(None).cast("int"))) == ("E", "A", None)


def test_contingency(spark):
    got = one(spark, *wx.contingency(*map(F.lit, (3, 1, 2, 4))).values())
    assert [round(x, 6) for x in got] == [0.75, 0.4, 0.5, 1.25, 0.4]
    assert one(spark, *wx.contingency(*map(F.lit, (0, 0, 0, 5))).values()) == (None,) * 5


# --- write policies ---


def test_write_policies(spark):
    s = "k int, corrected boolean, v string, seq int"
    old = spark.createDataFrame([(1, False, "old", 0), (2, True, "cor", 0)], s)
    new = spark.createDataFrame([(1, False, "again", 1), (1, True, "fix", 2), (1, True, "fix2", 3), (2, True, "late", 1), (3, None, "new", 1), (3, False, "new2", 2)], s)
    vs = lambda f: {x.k: x.v for x in f.collect()}
    first = writes.keep_first(old, new, ["k"], "seq")
    assert vs(first) == {1: "old", 2: "cor", 3: "new"} and vs(writes.keep_first(first, new, ["k"], "seq")) == vs(first)
    fixed = writes.correct(old, new, ["k"], "corrected", "seq")
    assert vs(fixed) == {1: "fix", 2: "cor", 3: "new"} and vs(writes.correct(fixed, new, ["k"], "corrected", "seq")) == vs(fixed)
    assert sorted((x.k, x.v) for x in writes.replace(old, new.where("k = 1"), ["k"]).collect()) == [(1, "again"), (1, "fix"), (1, "fix2"), (2, "cor")]


def test_rebuild_partitions(spark, tmp_path):
    p = str(tmp_path / "t")
    f = lambda rows: spark.createDataFrame(rows, "station string, v int")
    writes.rebuild_partitions(f([("a", 1), ("b", 2)]), p, ["station"])
    writes.rebuild_partitions(f([("b", 3)]), p, ["station"])
    assert sorted((x.station, x.v) for x in spark.read.parquet(p).collect()) == [("a", 1), ("b", 3)]


# --- episode matching ---


def test_matching_is_best(spark):
    assert matching.match_in_order([1, 4], [0, 2], 3) == [(0, 0), (1, 1)]
    assert matching.match_in_order([0], [5], 3) == []
    r = random.Random(3)
    for _ in range(200):
        f, o = (sorted(r.sample(range(12), r.randint(0, 4))) for _ in range(2))
        got = matching.match_in_order(f, o, 3)
        best = (0, 0)
        for k in range(min(len(f), len(o)) + 1):
            for a in itertools.combinations(range(len(f)), k):
                for b in itertools.permutations(range(len(o)), k):
                    if all(abs(f[i] - o[j]) <= 3 for i, j in zip(a, b)):
                        best = min(best, (-k, sum(abs(f[i] - o[j]) for i, j in zip(a, b))))
        assert (-len(got), sum(abs(f[i] - o[j]) for i, j in got)) == best


def test_matching_visits_only_cells_within_the_window():
    onsets = [10 * i for i in range(20_000)]
    assert matching.match_in_order(onsets, [x + 1 for x in onsets], 3) == [(i, i) for i in range(20_000)]


def test_matching_deals_episodes_out_at_gaps(spark):
    rows = [("K", side, float(10 * i + shift)) for i in range(300) for side, shift in (("F", 0), ("O", 2))] + [("K", "F", 5000.0), ("K", "O", None)]
    df = spark.createDataFrame(rows, "station string, side string, onset_h double")
    sizes = matching.close_groups(df, ["station"], 3).groupBy("station", "close").count()
    assert sizes.count() == 302 and sizes.agg(F.max("count")).first()[0] == 2
    assert {x.outcome: x["count"] for x in matching.match_episodes(df, ["station"]).groupBy("outcome").count().collect()} == {"match": 300, "false_alarm": 1, "missed": 1}


# --- report text ---


def test_metar_fields(spark):
    raw = ["METAR KABC 100855Z 24008G18KT 1 1/2SM -RA BR BKN015 OVC030 M02/M05 A2990 RMK AO2", "# note", " ", "SPECI COR KXYZ 101200Z VRB03KT P6SM SKC 24/12 A2992", "EDDF 101220Z 01005KT 9999 FEW020 20/10 Q1013", "KAAA 101220Z 01005KT 1/4SM FG VV002 20/20 A3001"]
    got = {x.station: x for x in reports_text.parse_metars(spark.createDataFrame([(x,) for x in raw], "value string")).collect()}
    a = got["KABC"]
    assert (a.day, a.hhmm, a.wind_dir, a.wind_speed, a.gust, a.vis_sm, a.ceiling_ft, a.temp_c, a.dewpoint_c, a.altimeter, a.weather) == (10, "0855", 240, 8, 18, 1.5, 1500, -2, -5, 2990, "-RA BR")
    assert (got["KXYZ"].wind_dir, got["KXYZ"].wind_speed, got["KXYZ"].vis_sm, got["KXYZ"].vis_flag, got["KXYZ"].corrected, got["KXYZ"].ceiling_ft) == (None, 3, 6.0, "P", True, None)
    assert got["EDDF"].vis_m == 9999 and got["KAAA"].vis_sm == 0.25 and got["KAAA"].ceiling_ft == 200 and len(got) == 4


def test_taf_groups_and_remarks(spark):
    raw = "TAF KXXX 090900Z 0909/1015 24010KT 9999 SKC QNH2992INS BECMG 0912/0914 31020G30KT TEMPO 0915/0918 3SM RA FM092000 VRB05KT P6SM PROB30 TEMPO 1000/1004 1SM FG RMK LAST NO AMDS AFT 1621 NEXT 1711"
    f = spark.createDataFrame([(1, raw)], "taf_id int, raw string")
    got = [(x.kind, x.from_token, x.to_token) for x in reports_text.taf_groups(f).orderBy("group_no").collect()]
    assert got == [("INITIAL", "0909", "1015"), ("BECMG", "0912", "0914"), ("TEMPO", "0915", "0918"), ("FM", "092000", None), ("PROB30 TEMPO", "1000", "1004")]
    assert tuple(f.select(reports_text.service_gap(F.col("raw")).alias("x")).first().x) == ("1621", "1711")
    assert one(spark, reports_text.wind_override(F.lit("RMK WND 24010G20KT AFT 0912")))[0][0].wind == "24010G20KT"


# --- streaming ---


def test_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [(1, False, "a", 0, at(0)), (1, True, "b", 1, at(1)), (2, False, "c", 0, at(2)), (2, False, "d", 1, at(3))]
    schema = "k int, corrected boolean, v string, seq int, t timestamp_ntz"
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(src)
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = read.writeStream.foreachBatch(stream.upsert_sink(out, ["k"], "corrected", "seq")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((x.k, x.v) for x in stream.current(spark, out).collect()) in ([(1, "b"), (2, "c")], [(1, "b"), (2, "d")])
    # a batch that runs again changes nothing
    again = spark.createDataFrame([rows[-1]], schema)
    before = sorted(map(tuple, stream.current(spark, out).select("k", "v").collect()))
    stream.upsert_sink(out, ["k"], "corrected", "seq")(again, 3)
    assert sorted(map(tuple, stream.current(spark, out).select("k", "v").collect())) == before


def test_stream_drops_repeats(spark, tmp_path):
    src = str(tmp_path / "src")
    f = spark.createDataFrame([(1, "x", dt.datetime(2026, 1, 1)), (1, "x", dt.datetime(2026, 1, 1)), (2, "y", dt.datetime(2026, 1, 1))], "k int, v string, t timestamp")
    f.write.parquet(src)
    q = stream.idempotent(spark.readStream.schema(f.schema).parquet(src), "t", "k", "v").writeStream.format("memory").queryName("seen_once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select * from seen_once").count() == 2


def test_bands_at_their_edges(spark):
    steps = [(None, "E"), (199, "A"), (200, "B"), (699, "B"), (700, "C"), (999, "C"), (1000, "D"), (1999, "D"), (2000, "E")]
    f = spark.createDataFrame([(c, 9999, want) for c, want in steps] + [(None, v, w) for v, w in [(799, "A"), (800, "B"), (3199, "B"), (3200, "D"), (4799, "D"), (4800, "E"), (None, None)]], "c int, v int, want string")
    assert f.where(~wx.flight_category(F.col("c"), F.col("v")).eqNullSafe(F.col("want"))).count() == 0
    assert one(spark, *(wx.altimeter_band(F.lit(x)) for x in (3100, 3099, 2800, 2799, None))) == ("HIGH", "NORMAL", "NORMAL", "LOW", None)
