"""Grids, ladders and slices against plain Python."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from wxspark.functions import times
from wxspark.operators import writes


def test_snapped_and_run_grids(spark):
    r = random.Random(1)
    rows = [(dt.datetime(2026, 7, 1) + dt.timedelta(minutes=r.randrange(5000)), r.choice([1, 2, 3, 6]), r.choice([None, 1, 3])) for _ in range(60)]
    f = spark.createDataFrame(rows, "a timestamp_ntz, step int, native int")
    for x in f.select("*", times.snapped_grid(F.col("a"), 30, F.col("step")).alias("s"), times.run_grid(F.col("a"), 48, F.col("step"), F.col("native")).alias("g")).collect():
        a = x.a.replace(minute=0, second=0)
        start = a.replace(hour=a.hour // x.step * x.step)
        span = math.ceil((30 + a.hour - start.hour) / x.step) * x.step
        assert x.s == [start + dt.timedelta(hours=h) for h in range(0, span + 1, x.step)] and x.s[-1] >= a + dt.timedelta(hours=30)
        step = max(x.step, x.native or x.step)
        assert x.g == [a + dt.timedelta(hours=h) for h in range(0, 49, step)]


def test_ladder_skips_unknown_rungs(spark):
    f = spark.createDataFrame([(10.0, 60.0, 90.0), (None, 60.0, None), (60.0, None, 80.0), (10.0, None, 40.0), (None, None, None), (0.0, 0.0, 50.0)], "a double, b double, c double")
    got = [x.v for x in f.select(times.ladder_percentile([(200, F.col("a")), (500, F.col("b")), (1000, F.col("c"))], 50).alias("v")).collect()]
    want = [200 + 40 / 50 * 300, 500 * 50 / 60, 200 * 50 / 60, None, None, 1000.0]
    assert all(g == w or abs(g - w) < 1e-9 for g, w in zip(got, want))


def test_slices_of_another_archive(spark, tmp_path):
    s = "loc int, run int, v string"
    spark.createDataFrame([(1, 1, "a"), (1, 9, "b"), (2, 1, "c"), (3, 1, "d"), (3, 1, "d")], s).write.parquet(str(tmp_path / "other"))
    here, places = spark.createDataFrame([(1, 1, "mine")], s), spark.createDataFrame([(1,), (3,), (3,)], "loc int")
    take = lambda name: writes.copy_slice(writes.archive(spark, str(tmp_path / name)), places, ["loc"], "run", F.lit(5))
    assert sorted(map(tuple, take("other").collect())) == [(1, 1, "a"), (3, 1, "d"), (3, 1, "d")] and take("missing") is None
    both = writes.append_slice(here, take("other"), ["loc", "run"])
    assert sorted(map(tuple, both.collect())) == [(1, 1, "mine"), (3, 1, "d")]
    assert writes.append_slice(both, take("other"), ["loc", "run"]).count() == 2 and writes.append_slice(here, take("missing"), ["loc"]).count() == 1
