"""Late truth against a full run, versions of scores, and ascents in batch and as a stream."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from wxspark.operators import revisions, truth
from wxspark.streaming import ascents

T0 = dt.datetime(2026, 7, 9)
REPORT = "station int, obs_time timestamp_ntz, event_id long, ceiling_ft long, vis_m long, altimeter long, gust long, wind_speed long, wind_dir long, weather string"


def reports(seed, n=160):
    r = random.Random(seed)
    return [(r.randrange(3), T0 + dt.timedelta(minutes=r.choice([10, 15, 30]) * r.randrange(90)), i, r.choice([None, 500, 2500]), r.choice([None, 800, 9000]), 2990, r.choice([None, 30]), r.randrange(30), r.randrange(360), r.choice([None, "RA", "TSRA"])) for i in range(n)]


@pytest.mark.parametrize("seed,share", [(1, 0.1), (2, 0.6), (3, 0.02)])
@pytest.mark.parametrize("view", ["conservative", "predominant"])
def test_truth_after_late_reports_equals_a_full_run(spark, seed, share, view):
    rows, r = reports(seed), random.Random(seed)
    late = {x[2] for x in rows if r.random() < share}
    o = spark.createDataFrame(rows, REPORT)

    def made(frame):
        hours = truth.state_hours(frame, ["station"], ["event_id"])
        return truth.conservative(hours, ["station"]) if view == "conservative" else truth.predominant_states(hours, ["station"])

    is_late = F.col("event_id").isin(sorted(late))
    got = revisions.refresh(made(o.where(~is_late)), o, o.where(is_late), ["station"], made)
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)
    assert rows(got) == rows(made(o))


def test_late_reports_touch_ninety_minutes(spark):
    f = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=30)), (2, T0 + dt.timedelta(minutes=31)), (3, None)], "station int, obs_time timestamp_ntz")
    got = {}
    for x in revisions.touched_hours(f, ["station"]).collect():
        got.setdefault(x.station, set()).add(int((x.hour - T0).total_seconds() // 3600))
    assert got == {1: {0, 1}, 2: {0, 1, 2}}


SCORED = "evaluation int, scorer string, subject string, scorer_version string, policy_hash string, truth_hash string, complete boolean, earned int"


def test_versions_are_only_added(spark):
    f = lambda rows: spark.createDataFrame(rows, SCORED)
    one = f([(1, "t", "s", "1", "p", "a", False, 3), (2, "t", "s", "1", "p", "b", True, 4)])
    first = revisions.append_versions(one.withColumn("version", F.lit(0)).limit(0), one)
    assert sorted((x.evaluation, x.version) for x in first.collect()) == [(1, 1), (2, 1)]
    assert sorted(map(tuple, revisions.append_versions(first, one.union(one)).collect())) == sorted(map(tuple, first.collect()))
    # a wider window with other truth, the same truth under a new scorer, and what is known already
    two = f([(1, "t", "s", "1", "p", "c", True, 5), (2, "t", "s", "1", "p", "b", True, 4), (2, "t", "s", "2", "p", "b", False, 9)])
    second = revisions.append_versions(first, two)
    assert sorted((x.evaluation, x.version, x.truth_hash, x.scorer_version) for x in second.collect()) == [(1, 1, "a", "1"), (1, 2, "c", "1"), (2, 1, "b", "1"), (2, 2, "b", "2")]
    assert sorted((x.evaluation, x.version, x.earned) for x in revisions.newest_complete(second).collect()) == [(1, 2, 5), (2, 1, 4)]
    # old truth again is no news
    assert revisions.append_versions(second, one).count() == 4


def test_what_is_due(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    evaluations = spark.createDataFrame([(1, "pending", at(1)), (2, "pending", at(9)), (3, "scored", at(1)), (4, "scored", at(1)), (5, "partial", at(1)), (6, "failed", at(1))], "evaluation int, status string, valid_to timestamp_ntz")
    have = [(e, s, j, v) for e, v in ((3, "2"), (4, "2"), (5, "1")) for s in ("t", "a") for j in ("subject", "climo")]
    have.remove((4, "a", "climo", "2"))
    results = spark.createDataFrame(have, "evaluation int, scorer string, subject string, scorer_version string")
    targets = spark.createDataFrame([("t", "2"), ("a", "2")], "scorer string, scorer_version string")
    due = lambda subjects: sorted(x.evaluation for x in revisions.due(evaluations, results, targets, subjects, F.lit(at(2))).collect())
    assert due(["subject", "climo", "human"]) == [1, 4, 5] and due(["subject"]) == [1, 5]


# --- ascents ---

SIGHTING = "site string, launched timestamp, seen_at timestamp, top_hpa double, digest string"


def sightings(seed, keys=40):
    r, rows = random.Random(seed), []
    for k in range(keys):
        launched = T0 + dt.timedelta(hours=12 * (k % 5))
        for _ in range(r.randint(0, 4)):
            rows.append((f"s{k}", launched, launched + dt.timedelta(minutes=r.choice([30, 90, 239, 240, 300])), r.choice([None, 100.0, 95.0, 400.0]), r.choice("abc")))
    return sorted(rows, key=lambda x: (x[2], x[4]))


def plain(rows):
    out = {}
    for key in {x[:2] for x in rows}:
        own = [x for x in rows if x[:2] == key]
        early = [x for x in own if x[2] - x[1] < dt.timedelta(hours=4)]
        done = [x for x in early if x[3] is not None and x[3] <= 95]
        out[key] = ("complete", done[0][2]) if done else ("four hours old", early[-1][2]) if early else ("seen late", own[0][2])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_final_ascents_in_batch_and_as_a_replayed_stream(spark, tmp_path, seed):
    rows = sightings(seed)
    got = {(x.site, x.launched): (x.why, x.seen_at) for x in revisions.final_ascents(spark.createDataFrame(rows, SIGHTING)).collect()}
    assert got == plain(rows)
    # files in order of seen_at, some of them read twice; the last one moves the watermark beyond all four hours
    src, step = str(tmp_path / "src"), max(1, len(rows) // 6)
    cuts = [rows[i : i + step] for i in range(0, len(rows), step)]
    for part in [*cuts[:2], cuts[1], *cuts[2:], cuts[-1], [("end", T0 + dt.timedelta(days=9), T0 + dt.timedelta(days=9), 1.0, "z")], [("end", T0 + dt.timedelta(days=9), T0 + dt.timedelta(days=9), 1.0, "z")]]:
        spark.createDataFrame(part, SIGHTING).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    stream = spark.readStream.schema(SIGHTING).option("maxFilesPerTrigger", 1).parquet(src)
    q = ascents.final_ascents(stream, "1 hour").writeStream.format("memory").queryName(f"final_{seed}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    found = [((x.site, x.launched), (x.why, x.seen_at)) for x in spark.sql(f"select * from final_{seed}").collect() if x.site != "end"]
    assert len(found) == len({k for k, _ in found}) and dict(found) == got


def test_a_timer_ends_an_ascent_without_another_sighting(spark, tmp_path):
    now = dt.datetime.fromtimestamp(int(time.time()), dt.timezone.utc).replace(tzinfo=None)
    rows = [("old", now - dt.timedelta(hours=4) + dt.timedelta(seconds=8), now - dt.timedelta(hours=3), 100.0, "a"), ("young", now - dt.timedelta(hours=1), now, 100.0, "b"), ("whole", now - dt.timedelta(hours=1), now, 9.0, "c")]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, SIGHTING).coalesce(1).write.parquet(src)
    q = ascents.final_ascents(spark.readStream.schema(SIGHTING).parquet(src)).writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while time.time() < end and q.exception() is None and spark.sql("select * from timed").count() < 2:
            time.sleep(1)
        assert q.exception() is None
        assert sorted((x.site, x.why, x.digest) for x in spark.sql("select * from timed").collect()) == [("old", "four hours old", "a"), ("whole", "complete", "c")]
    finally:
        q.stop()
