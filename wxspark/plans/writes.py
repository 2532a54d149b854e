"""Write policies, ids, kept-first archives and late corrections, as tables after a batch (SK01-SK04, SK06, SK07, SK09, X42, J37, J38, ST01)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wxspark.operators import writes
from wxspark.operators.asof import latest_at_key
from wxspark.sources.tables import OBS_SQL, TAFS_SQL, obs, read, tafs

CUT = "2024-01-20 00:00:00"


def _halves(spark, d):
    o = obs(spark, d).select("station", F.hour("obs_time").alias("hr"), "obs_time", "event_id", "corrected", "value")
    cut = F.lit(CUT).cast("timestamp_ntz")
    return o.where(F.col("obs_time") < cut), o.where(F.col("obs_time") >= cut)


def sk01_keep_first(spark, d):
    """SK01, SK03: the stored half, keyed, then a batch that changes nothing that is there."""
    a, b = _halves(spark, d)
    stored = writes.keep_first(a.limit(0), a, ["station", "hr"], "event_id")
    return writes.keep_first(stored, b, ["station", "hr"], "event_id")


def sk02_corrections(spark, d):
    """SK02, ST06: a correction replaces what isn't one."""
    a, b = _halves(spark, d)
    stored = writes.keep_first(a.limit(0), a, ["station", "hr"], "event_id")
    return writes.correct(stored, b, ["station", "hr"], "corrected", "event_id")


def sk04_replace(spark, d):
    a, b = _halves(spark, d)
    return writes.replace(a.select("station", "event_id"), b.where("corrected").select("station", "event_id"), ["station"])


def sk06_status_flip(spark, d):
    t = tafs(spark, d)
    return t.select("taf_id", F.when((F.col("status") == "O") & (F.col("issue") < F.lit("1999-01-01").cast("timestamp_ntz")), "S").otherwise(F.col("status")).alias("status"))


def sk07_content_ids(spark, d):
    """SK07, X42: append-only by content id; of a second batch that overlaps the first only what is new is added."""
    n = read(spark, d, "nation")
    said = lambda rows: rows.select(writes.content_id("n_nationkey", "n_name", "n_regionkey").alias("id"), "n_name")
    first, second = said(n.where("n_nationkey < 15")), said(n.where("n_nationkey >= 10"))
    return writes.append_new(first, second, "id")


def sk09_slice(spark, d):
    """SK09, ST07: a slice before a cutoff and not older than a day, new keys only."""
    cut = F.lit(CUT).cast("timestamp_ntz")
    o = obs(spark, d)
    return o.where((F.col("obs_time") < cut) & (F.col("obs_time") >= cut - F.expr("interval 24 hours"))).select("station", "obs_time", "event_id")


def j37_entitlement(spark, d):
    """Station by product through region dims, deduplicated by kind and identity."""
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    products = spark.createDataFrame([("radar", 0, 3), ("sat", 2, 4), ("sat", 0, 4)], "kind string, lo int, hi int")
    j = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    plan = j.join(F.broadcast(products), F.col("r_regionkey").between(F.col("lo"), F.col("hi")))
    return plan.select("kind", F.when(F.col("kind") == "sat", F.col("r_name")).otherwise(F.col("n_name")).alias("identity")).distinct()


def j38_fallback(spark, d):
    """The first ranked source that has a document before a time, and its two newest."""
    t = tafs(spark, d).where(F.col("issue") < F.lit("2000-01-01").cast("timestamp_ntz")).withColumn("src", F.expr("case kind when 'TAF' then 1 when 'AMD' then 2 else 3 end"))
    best = t.groupBy("station").agg(F.min("src").alias("src"))
    rk = F.row_number().over(W.partitionBy("station").orderBy(F.desc("issue"), F.desc("taf_id")))
    return t.join(best, ["station", "src"]).withColumn("rk", rk).where("rk <= 2").select("station", "src", "rk", "taf_id")


def st01_idempotent_poll(spark, d):
    """ST01: polls that overlap, one document a content id."""
    t = tafs(spark, d).select("station", "issue", "kind", "value")
    polls = t.where("station % 2 = 0").unionByName(t)
    ids = polls.withColumn("id", writes.content_id("station", "kind", F.date_format("issue", "yyyy-MM-dd")))
    return latest_at_key(ids.select("id", "station", "kind", "value"), ["id"], [F.col("value")])


_O = f"WITH {OBS_SQL}, o AS (SELECT station, CAST(hour(obs_time) AS INTEGER) AS hr, obs_time, event_id, corrected, value FROM obs)"
_T = f"WITH {TAFS_SQL}"
QUERIES = {
    "sk01_keep_first": (sk01_keep_first, f"{_O} SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY station, hr ORDER BY obs_time >= TIMESTAMP '{CUT}', event_id) = 1"),
    "sk02_corrections": (sk02_corrections, f"{_O}, a AS (SELECT *, 0 AS nw FROM o WHERE obs_time < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY station, hr ORDER BY event_id) = 1), u AS (SELECT * FROM a UNION ALL SELECT *, 1 FROM o WHERE obs_time >= TIMESTAMP '{CUT}') SELECT station, hr, obs_time, event_id, corrected, value FROM u QUALIFY row_number() OVER (PARTITION BY station, hr ORDER BY NOT corrected, nw, event_id) = 1"),
    "sk04_replace": (sk04_replace, f"{_O}, b AS (SELECT station, event_id FROM o WHERE obs_time >= TIMESTAMP '{CUT}' AND corrected) SELECT station, event_id FROM o WHERE obs_time < TIMESTAMP '{CUT}' AND station NOT IN (SELECT station FROM b) UNION ALL SELECT * FROM b"),
    "sk06_status_flip": (sk06_status_flip, f"{_T} SELECT taf_id, CASE WHEN status = 'O' AND issue < TIMESTAMP '1999-01-01' THEN 'S' ELSE status END AS status FROM tafs"),
    "sk07_content_ids": (sk07_content_ids, "SELECT substr(sha256(n_nationkey || '|' || n_name || '|' || n_regionkey), 1, 12) AS id, n_name FROM nation"),
    "sk09_slice": (sk09_slice, f"{_O} SELECT station, obs_time, event_id FROM o WHERE obs_time < TIMESTAMP '{CUT}' AND obs_time >= TIMESTAMP '{CUT}' - INTERVAL 24 HOUR"),
    "j37_entitlement": (j37_entitlement, "SELECT DISTINCT kind, CASE WHEN kind = 'sat' THEN r_name ELSE n_name END AS identity FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES ('radar', 0, 3), ('sat', 2, 4), ('sat', 0, 4)) p(kind, lo, hi) ON r_regionkey BETWEEN lo AND hi"),
    "j38_fallback": (j38_fallback, f"{_T}, t AS (SELECT station, taf_id, issue, CASE kind WHEN 'TAF' THEN 1 WHEN 'AMD' THEN 2 ELSE 3 END AS src FROM tafs WHERE issue < TIMESTAMP '2000-01-01'), b AS (SELECT * FROM t QUALIFY src = min(src) OVER (PARTITION BY station)), r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY issue DESC, taf_id DESC) AS rk FROM b) SELECT station, CAST(src AS INTEGER) AS src, CAST(rk AS INTEGER) AS rk, taf_id FROM r WHERE rk <= 2"),
    "st01_idempotent_poll": (st01_idempotent_poll, f"{_T} SELECT substr(sha256(station || '|' || kind || '|' || strftime(issue, '%Y-%m-%d')), 1, 12) AS id, station, kind, max(value) AS value FROM tafs GROUP BY ALL"),
}
