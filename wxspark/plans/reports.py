"""Pooled reports: never averages of percentages, empty pools are null."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wxspark.sources.documents import parts
from wxspark.sources.tables import read

#: An evaluation is an order, a subject a return flag, an element a line status; discount x quantity is earned.


def scored(spark, d):
    """Tall scores of evaluations: points earned of those available, by subject and element."""
    l, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("evaluation"), F.col("o_custkey").alias("station"), F.col("l_returnflag").alias("subject"), F.col("l_linestatus").alias("element"),
        F.round(F.col("l_quantity") * F.col("l_discount") * 10).cast("long").alias("earned"), F.col("l_quantity").cast("long").alias("available"), F.col("l_tax").alias("err"), F.col("o_orderpriority").alias("cell"), F.col("o_orderdate").alias("day"),
    )


SCORED_SQL = ("scored AS (SELECT o_orderkey AS evaluation, o_custkey AS station, l_returnflag AS subject, l_linestatus AS element, CAST(round(l_quantity * l_discount * 10) AS BIGINT) AS earned, CAST(l_quantity AS BIGINT) AS available, "
              "l_tax AS err, o_orderpriority AS cell, o_orderdate AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")


def scored_sums(spark, d):
    """evaluation, subject, e, a: sums of `scored`. Lines are summed before they meet their order, in parts that grow with the table, so a task's hash table doesn't."""
    lines = read(spark, d, "lineitem").where("l_orderkey is not null").select("l_orderkey", "l_returnflag", "l_quantity", "l_discount")
    n = parts(spark, lines)
    earned = F.round(F.col("l_quantity") * F.col("l_discount") * 10).cast("long")
    per = lines.repartition(n, "l_orderkey").groupBy("l_orderkey", "l_returnflag").agg(F.sum(earned).alias("e"), F.sum(F.col("l_quantity").cast("long")).alias("a"))
    # an order that stands twice doubles its lines
    orders = read(spark, d, "orders").where("o_orderkey is not null").select("o_orderkey").repartition(n, "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("times"))
    return per.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("evaluation"), F.col("l_returnflag").alias("subject"), (F.col("e") * F.col("times")).alias("e"), (F.col("a") * F.col("times")).alias("a"))


def a38_headline(spark, d):
    """Pooled percentage, mean of percentages and its error."""
    per = scored_sums(spark, d)
    pct = 100 * F.try_divide(F.col("e"), F.col("a"))
    g = per.groupBy("subject").agg(F.sum("e").alias("e"), F.sum("a").alias("a"), F.avg(pct).alias("m"), F.stddev_samp(pct).alias("s"), F.count("*").alias("n"))
    return g.select("subject", "n", F.round(100 * F.try_divide(F.col("e"), F.col("a")), 6).alias("pooled"), F.round("m", 6).alias("mean_pct"), F.round(F.col("s") / F.sqrt("n"), 6).alias("se"))


def a40_element_winner(spark, d):
    """Elements by subject side by side, and the best subject."""
    g = scored(spark, d).groupBy("element", "subject").agg(F.round(100 * F.try_divide(F.sum("earned"), F.sum("available")), 6).alias("pct"))
    side = g.groupBy("element").pivot("subject", ["A", "N", "R"]).agg(F.first("pct"))
    best = g.groupBy("element").agg(F.max_by("subject", F.struct("pct", "subject")).alias("winner"))
    return side.join(best, "element")


def a41_station_difficulty(spark, d):
    """Stations by pooled score, hardest first, nulls last: a range-partitioned sort, no rank over one partition."""
    g = scored(spark, d).where("subject <> 'N'").groupBy("station").agg(F.round(100 * F.try_divide(F.sum("earned"), F.sum("available")), 6).alias("pct"))
    return g.orderBy(F.col("pct").asc_nulls_last(), "station")


def a44_contrast(spark, d):
    """Outcome by cell, with and without a key of a JSON map."""
    e = read(spark, d, "events").withColumn("m", F.from_json("props", "map<string,double>"))
    k = F.try_element_at("m", F.lit("k"))
    return e.groupBy("event_type", (k > 50).alias("with_k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def a45_lead_decay(spark, d):
    """Score by bin, last minus first, and the first bin where one subject beats another."""
    b = F.least(F.floor((F.month("day") - 1) / 3), F.lit(3)).cast("int")
    g = scored(spark, d).groupBy("subject", b.alias("bin")).agg((100 * F.try_divide(F.sum("earned"), F.sum("available"))).alias("pct"))
    per = g.groupBy("subject").agg(F.round(F.max_by("pct", "bin") - F.min_by("pct", "bin"), 6).alias("decay"))
    a, r = (g.where(F.col("subject") == s).select("bin", F.col("pct").alias(s)) for s in "AR")
    cross = a.join(r, "bin").agg(F.min(F.when(F.col("A") > F.col("R"), F.col("bin"))).alias("crossover"))
    return per.join(F.broadcast(cross), how="left")


def a46_weighted_means(spark, d):
    """Means pooled by n, not averaged."""
    g = scored(spark, d).groupBy("cell", "subject").agg(F.avg("err").alias("m"), F.count("*").alias("n"))
    return g.groupBy("subject").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("mae"), F.sum("n").alias("n"))


def a47_aliasing(spark, d):
    """Distinct hours behind a cell and the largest one's share."""
    e = read(spark, d, "events").groupBy("event_type", F.hour("ts").alias("hr")).agg(F.count("*").alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n_hours"), F.round(F.max("k") / F.sum("k"), 6).alias("largest"))


def a49_spend(spark, d):
    """Spend by model through a price map, usable runs and cost per usable run."""
    price = spark.createDataFrame([("A", 0.5), ("N", 1.0), ("R", 2.0)], "subject string, usd double")
    s = scored(spark, d).join(F.broadcast(price), "subject").withColumn("cost", F.col("available") * F.col("usd") / 1000)
    clean = F.count_if(F.col("err") < 0.05)
    g = s.groupBy("subject").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("usd"), clean.alias("clean"))
    return g.select("subject", "n", "usd", "clean", F.round(F.try_divide(F.col("usd"), F.col("clean")), 8).alias("usd_per_clean"))


def j29_paired_subset(spark, d):
    """Pools over evaluations that both subjects have."""
    s = scored(spark, d)
    both = s.where("subject = 'A'").select("evaluation").intersect(s.where("subject = 'R'").select("evaluation"))
    return s.join(both, "evaluation", "left_semi").groupBy("subject").agg(F.count("*").alias("n"), F.round(100 * F.try_divide(F.sum("earned"), F.sum("available")), 6).alias("pct"))


def a55_cycle_gap(spark, d):
    """The smallest circular gap between the distinct hours of issue."""
    h = read(spark, d, "events").select("user_id", F.hour("ts").alias("h")).distinct()
    w = W.partitionBy("user_id").orderBy("h")
    top = F.first("h").over(w) + 24
    gap = F.coalesce(F.lead("h").over(w), top) - F.col("h")
    return h.withColumn("gap", gap).groupBy("user_id").agg(F.min("gap").alias("gap"), F.count("*").alias("n"))


def a56_per_year(spark, d):
    return read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("yr"), "o_orderstatus").agg(F.count("*").alias("n"))


def a60_served_models(spark, d):
    """The distinct labels of each window, and whether there is more than one."""
    g = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.countDistinct("role").alias("k"))
    return g.groupBy("roles", (F.col("k") > 1).alias("mixed")).agg(F.count("*").alias("n"))


def a61_zero_counts_kept(spark, d):
    """Reports per roster station, zeros kept, against the rate it should file at."""
    e = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("k"))
    roster = read(spark, d, "customer").select(F.col("c_custkey").alias("station"), (F.col("c_custkey") % 5).alias("rate"))
    j = roster.join(e, F.col("station") == F.col("user_id"), "left").select("station", F.coalesce("k", F.lit(0)).alias("n"), "rate")
    return j.withColumn("silent", F.col("n") < F.col("rate"))


_S = f"WITH {SCORED_SQL}"
QUERIES = {
    "a38_headline": (a38_headline, f"{_S}, p AS (SELECT evaluation, subject, sum(earned) AS e, sum(available) AS a FROM scored GROUP BY ALL) SELECT subject, count(*) AS n, round(100 * sum(e) / nullif(sum(a), 0), 6) AS pooled, round(avg(100 * e / nullif(a, 0)), 6) AS mean_pct, round(stddev_samp(100 * e / nullif(a, 0)) / sqrt(count(*)), 6) AS se FROM p GROUP BY 1"),
    "a40_element_winner": (a40_element_winner, f"{_S}, g AS (SELECT element, subject, round(100 * sum(earned) / nullif(sum(available), 0), 6) AS pct FROM scored GROUP BY ALL) SELECT element, max(pct) FILTER (WHERE subject = 'A') AS \"A\", max(pct) FILTER (WHERE subject = 'N') AS \"N\", max(pct) FILTER (WHERE subject = 'R') AS \"R\", list(subject ORDER BY pct DESC, subject DESC)[1] AS winner FROM g GROUP BY 1"),
    "a41_station_difficulty": (a41_station_difficulty, f"{_S}, g AS (SELECT station, round(100 * sum(earned) / nullif(sum(available), 0), 6) AS pct FROM scored WHERE subject <> 'N' GROUP BY 1) SELECT station, pct FROM g ORDER BY pct NULLS LAST, station"),
    "a44_contrast": (a44_contrast, "SELECT event_type, CAST(props->>'$.k' AS DOUBLE) > 50 AS with_k, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL"),
    "a45_lead_decay": (a45_lead_decay, f"{_S}, g AS (SELECT subject, CAST(least((month(day) - 1) // 3, 3) AS INTEGER) AS bin, 100 * sum(earned) / nullif(sum(available), 0) AS pct FROM scored GROUP BY ALL), x AS (SELECT min(a.bin) FILTER (WHERE a.pct > r.pct) AS crossover FROM g a JOIN g r ON a.bin = r.bin AND a.subject = 'A' AND r.subject = 'R') SELECT subject, round(list(pct ORDER BY bin DESC)[1] - list(pct ORDER BY bin)[1], 6) AS decay, any_value(crossover) AS crossover FROM g, x GROUP BY 1"),
    "a46_weighted_means": (a46_weighted_means, f"{_S} SELECT subject, round(avg(err), 6) AS mae, count(*) AS n FROM scored GROUP BY 1"),
    "a47_aliasing": (a47_aliasing, "WITH e AS (SELECT event_type, hour(ts) AS hr, count(*) AS k FROM events GROUP BY ALL) SELECT event_type, count(*) AS n_hours, round(max(k) / sum(k), 6) AS largest FROM e GROUP BY 1"),
    "a49_spend": (a49_spend, f"{_S}, p AS (SELECT * FROM (VALUES ('A', 0.5::DOUBLE), ('N', 1.0::DOUBLE), ('R', 2.0::DOUBLE)) v(subject, u)), g AS (SELECT subject, count(*) AS n, round(sum(available * u / 1000), 4) AS usd, count(*) FILTER (WHERE err < 0.05) AS clean FROM scored JOIN p USING (subject) GROUP BY 1) SELECT *, round(usd / nullif(clean, 0), 8) AS usd_per_clean FROM g"),
    "j29_paired_subset": (j29_paired_subset, f"{_S} SELECT subject, count(*) AS n, round(100 * sum(earned) / nullif(sum(available), 0), 6) AS pct FROM scored WHERE evaluation IN (SELECT evaluation FROM scored WHERE subject = 'A') AND evaluation IN (SELECT evaluation FROM scored WHERE subject = 'R') GROUP BY 1"),
    "a55_cycle_gap": (a55_cycle_gap, "WITH h AS (SELECT DISTINCT user_id, hour(ts) AS h FROM events), g AS (SELECT user_id, coalesce(lead(h) OVER w, min(h) OVER (PARTITION BY user_id) + 24) - h AS gap FROM h WINDOW w AS (PARTITION BY user_id ORDER BY h)) SELECT user_id, CAST(min(gap) AS INTEGER) AS gap, count(*) AS n FROM g GROUP BY 1"),
    "a56_per_year": (a56_per_year, "SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL"),
    "a60_served_models": (a60_served_models, "WITH g AS (SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(DISTINCT role) AS k FROM conversations GROUP BY 1) SELECT roles, k > 1 AS mixed, count(*) AS n FROM g GROUP BY ALL"),
    "a61_zero_counts_kept": (a61_zero_counts_kept, "SELECT c_custkey AS station, count(user_id) AS n, c_custkey % 5 AS rate, count(user_id) < c_custkey % 5 AS silent FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey"),
}
