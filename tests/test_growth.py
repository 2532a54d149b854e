"""Steps that grew faster than their input: the same results as brute force, without pairs of all rows or a task call a group."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from wxspark.functions import metar
from wxspark.functions import weather as wx
from wxspark.operators import forecast_state, matching
from wxspark.plans import amendments, documents, forecasts, revisions
from wxspark.plans import reports as score_plans
from wxspark.sources import documents as sources
from wxspark.sources import tables
from wxspark.sources.documents import FIELDS


def test_sites_of_shared_places_meet_by_place(spark):
    rng = random.Random(3)
    sites = [(k, float(rng.choice([-60, -10, 0, 15, 59])), float(rng.choice([-150, -149, 0, 20, 149]))) for k in range(70)] + [(5, 0.0, 20.0), (5, 0.0, 20.0), (None, 0.0, 0.0)]
    df = spark.createDataFrame(sites, "s_suppkey long, lat double, lon double")
    got = Counter((r.a, r.rk, r.b) for r in forecasts.nearest_sites(df).collect())
    pairs = df.selectExpr("s_suppkey a", "lat la", "lon oa").crossJoin(df.selectExpr("s_suppkey b", "lat lb", "lon ob")).where("a <> b").withColumn("km", wx.distance_km(*(F.col(c) for c in ("la", "oa", "lb", "ob")))).where("km <= 3000")
    by = {}
    for r in pairs.collect():
        by.setdefault(r.a, []).append((round(r.km, 6), r.b))
    assert got == Counter((a, i, b) for a, found in by.items() for i, (_, b) in enumerate(sorted(found)[:3], 1))


def test_many_sites_of_few_places(spark):
    # 40,000 sites of one place are 1.6 billion pairs, where the first four of the place suffice
    df = spark.range(40000).selectExpr("id AS s_suppkey", "10.0D AS lat", "20.0D AS lon")
    rows = forecasts.nearest_sites(df)
    assert rows.count() == 120000
    assert [r.b for r in rows.where("a = 1").orderBy("rk").collect()] == [0, 2, 3] and [r.b for r in rows.where("a = 39999").orderBy("rk").collect()] == [0, 1, 2]


def test_episode_groups_are_matched_without_a_call_each(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(12)]), rng.choice("FO"), rng.choice([None, *map(float, range(60))])) for _ in range(500)]
    df = spark.createDataFrame(rows, "station long, side string, onset_h double")
    found = matching.match_episodes(df, ["station"])
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    want = Counter()
    for key in {r[0] for r in rows}:
        times = lambda s: sorted(x for k, side, x in rows if k == key and side == s and x is not None)
        f, o = times("F"), times("O")
        pairs = matching.match_in_order(f, o, 3)
        want[key, "match"] += len(pairs)
        want[key, "false_alarm"] += sum(1 for k, s, _ in rows if k == key and s == "F") - len(pairs)
        want[key, "missed"] += sum(1 for k, s, _ in rows if k == key and s == "O") - len(pairs)
    got = Counter((r.station, r.outcome) for r in found.collect())
    assert got == +want
    assert found.where("outcome = 'match' and (fcst_h is null or obs_h is null or abs(fcst_h - obs_h) > 3)").count() == 0


def test_spoken_hours_are_those_of_baseline_and_overlays(spark):
    rng = random.Random(5)
    maybe = lambda x: x if rng.random() < 0.6 else None
    rows = []
    for doc in range(60):
        v = rng.randrange(5)
        for k in range(rng.randrange(1, 7)):
            start = None if rng.random() < 0.05 else v + rng.randrange(-3, 26)
            end = None if start is None or rng.random() < 0.05 else start + rng.randrange(0, 6)
            kind = "INITIAL" if k == 0 and doc % 9 else rng.choice(["FM", "BECMG", "TEMPO", "PROB30"])
            rows.append((doc, 1, kind, v, v if kind == "INITIAL" else start, end, *(maybe(rng.randrange(9)) for _ in range(5)), maybe(rng.choice(["RA", ""])), maybe(7)))
    g = spark.createDataFrame(rows, "doc long, station long, kind string, valid_h long, start long, end long, wind_dir long, wind_speed long, gust long, vis_m long, ceiling_ft long, weather string, altimeter long")
    times = g.where("kind = 'INITIAL'").selectExpr("doc", "station", f"explode(sequence(valid_h, valid_h + {documents.HOURS - 1})) AS t")
    c = forecast_state.spoken(g, documents.HOURS, FIELDS, ("altimeter",)).select("doc", "station", "t", *FIELDS, "alternate")
    assert Counter(map(tuple, c.collect())) == Counter(map(tuple, documents.candidates_of(g, times).collect())) and c.count() > 1000
    # one grouping by document is all that is dealt out
    assert c.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_a_token_is_placed_once_and_late_ones_ask_no_pattern(spark):
    df = spark.createDataFrame([("METAR KABC 010000Z 27010KT 3200 RA BKN010 10/08 A2990 RMK A3000",)], "raw string")
    got = df.select(metar.sections(F.col("raw")).alias("s"))
    assert [x["section"] for x in got.first().s] == ["type", "station", "time", "wind", "visibility", "weather", "sky", "temperature", "pressure"]
    # each pattern stands once in the fold, where it stood four times
    assert got._jdf.queryExecution().analyzed().toString().count("RLIKE(") <= 2 * (len(metar.SECTIONS) + 1)


def test_events_of_documents_are_bits_and_each_pattern_is_matched_once(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.doc, documents.EVENTS[r.event][0], side, r.h + k) for r in documents.event_patterns(spark, sf).collect() for side, bits in (("f", r.f), ("o", r.o)) for k in range(documents.HOURS) if bits >> k & 1}
    want = set()
    c = documents.candidates(spark, sf).join(documents._truth(spark, sf), ["station", "t"], "left")
    for i, (n, x) in enumerate(documents.EVENTS):
        said, seen = F.expr(x.format(p="")), F.col("o_wind_speed").isNotNull() & F.expr(x.format(p="o_"))
        want |= {(r.doc, n, "f", r.t) for r in c.where(said).select("doc", "t").collect()} | {(r.doc, n, "o", r.t) for r in c.where(seen).select("doc", "t").collect()}
    assert got == want and len(got) > 1000
    assert documents.t05_document_episodes(spark, sf).count() > 0


def test_rules_read_one_folding_of_the_documents(spark):
    q = amendments.t03g_headline(spark, "/root/testdata/sf0.001")
    plan = re.sub(r"#\d+L?", "", q._jdf.queryExecution().optimizedPlan().toString())
    folds = [line.strip(" :+-") for line in plan.splitlines() if "Filter" in line and "i.station" in line]
    # what one reader filters must not go below the exchange, or each has its own
    assert len(folds) > 4 and len(set(folds)) == 1


def test_parts_grow_with_the_table(spark):
    lines = spark.range(1000, numPartitions=50)
    assert sources.parts(spark, lines) == 50 * sources.PER_SPLIT > sources.parts(spark, spark.range(10, numPartitions=1))


def test_groups_of_states_come_from_stretches_not_hours(spark):
    # hours of a document were dealt out and met again by joins; stretches need neither
    plan = documents.x48_states_to_groups(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan


def test_scores_find_the_reports_of_a_station_and_validity_once(spark):
    plan = revisions._scores(spark, "/root/testdata/sf0.001", tables.obs(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 2


def test_subjects_read_one_folding_and_products_their_last_bulletins(spark):
    sf = "/root/testdata/sf0.001"
    plan = re.sub(r"#\d+L?", "", documents.t08_subjects(spark, sf)._jdf.queryExecution().optimizedPlan().toString())
    # the composite was a second folding, whose hours met their product's in a shuffled join
    assert sum("Filter" in line and "i.station" in line for line in plan.splitlines()) == 1
    rng = random.Random(6)
    rows = [(rng.randrange(3), 6 * rng.randrange(2), rng.randrange(400), "INITIAL") for _ in range(300)]
    g = spark.createDataFrame(rows + rows[:20], "station long, valid_h long, doc long, kind string")
    few, all_ = (forecast_state.composite(b, ["station", "valid_h"]).select("station", "valid_h", "bulletin", "start", "end") for b in (documents.latest_bulletins(g), documents.bulletins(g)))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, all_.collect())) and 24 < few.count() < 80 and documents.latest_bulletins(g).count() <= 72


def test_altimeters_of_an_hour_are_one_row_that_is_broadcast(spark):
    plan = amendments.skill_errors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 2


def test_scores_are_summed_before_they_meet_their_order(spark, tmp_path):
    rng = random.Random(7)
    lines = [(rng.choice([None, *range(40)]), rng.choice("ANR"), "F", rng.choice([None, 1.0, 7.0, 33.0]), rng.choice([None, 0.0, 0.05, 0.1]), 0.0) for _ in range(400)]
    orders = [(k, 1, "1-URGENT", 0) for k in [None, *range(5, 45), 7, 7, 9]]
    spark.createDataFrame(lines, "l_orderkey long, l_returnflag string, l_linestatus string, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate int").write.parquet(f"{tmp_path}/orders.parquet")
    want = score_plans.scored(spark, str(tmp_path)).groupBy("evaluation", "subject").agg(F.sum("earned").alias("e"), F.sum("available").alias("a"))
    got = score_plans.scored_sums(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.count() > 60
    # lines and orders are dealt out once each, and not again for their sums
    assert score_plans.a38_headline(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
