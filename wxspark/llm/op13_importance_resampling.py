"""Target-distribution importance resampling: hashed n-gram features, counted by DuckDB in each task, weighed and drawn by Spark.

1. A task hands its batches of texts to a DuckDB of its own: SQL unnests the words, windows them to n-grams, numbers
   each one's bucket by a registered zlib CRC function and counts (text, bucket). Spark writes these counts as Parquet
   in the shared folder, a list of buckets and one of counts a row.
2. Spark sums the counts of a bucket over all documents and over all target texts. The gain of a bucket is the logarithm of how
   much likelier the target makes it, smoothed by one and in whole thousandths.
3. A second pass over the Parquet adds up each document's gains, reading the table of gains (`buckets` numbers, a parameter,
   whatever the data). Gumbel noise, fixed by the doc_id, is added; the highest scores are the draw.
4. Ranks come from a sort by ranges: a row's rank is its number within its range and the sizes of the ranges before.

Texts longer than PIECE bytes go to SQL in pieces that end between two words; each n-gram belongs to the piece in which it
starts, so pieces change nothing.

Defined cases: null texts are empty ones; a text without words has no features, weight 0 and is never drawn; repeated
rows are documents each, with ranks of their own; a row without a doc_id takes part, its noise is that of an empty
name, and it comes last among equal scores; equal scores go by doc_id; without target texts gains compare with an even spread;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import tempfile
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wxspark.llm.common import drop, list_array, small_batches, written

#: n-grams of up to ORDER words; BUCKETS; the seed of the noise; percent drawn of documents of at least LEAST_WORDS words.
ORDER, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Bytes of text in one SQL call, and of one piece of a text.
STEP, PIECE = 4 << 20, 1 << 20
#: Megabytes of memory of a task's DuckDB, beyond which it goes to the task's own temporary folder.
MEMORY_MB = 400

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTS = "n_words long, n_features long, bucket array<int>, times array<int>"


def pieces(text: str, order: int, most: int = PIECE) -> list[tuple[str, str]]:
    """The text cut between words into pieces of about `most` bytes, each with the order - 1 words that follow it."""
    raw = text.encode()
    if len(raw) <= most:
        return [(text, "")]
    cuts, at = [0], most
    while at < len(raw) and (m := _BREAK.search(raw, at)):
        cuts.append(m.end())
        at = m.end() + most
    out = []
    for lo, hi in zip(cuts, [*cuts[1:], len(raw)]):
        tail, at = [], hi
        while len(tail) < order - 1 and (m := _WORD.search(raw, at)):
            tail.append(m[0])
            at = m.end()
        out.append((raw[lo:hi].decode(), b" ".join(tail).decode()))
    return out


def count_sql(order: int, buckets: int) -> str:
    """(row, n_words, n_features, buckets, counts) of the pieces in `texts` (row, own, tail)."""
    words = f"regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '{WORD}')"
    grams = " UNION ALL ".join(
        "SELECT row, w AS gram FROM words WHERE i <= own" if n == 1 else
        f"SELECT row, gram FROM (SELECT row, i, own, string_agg(w, ' ') OVER s AS gram, count(*) OVER s AS n FROM words WINDOW s AS (PARTITION BY row, piece ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) WHERE i <= own AND n = {n}"
        for n in range(1, order + 1)
    )
    return f"""
    WITH lists AS (SELECT row, piece, {words.format('own')} AS a, {words.format('tail')} AS b FROM texts),
    words AS (SELECT row, piece, len(a) AS own, unnest(a || b) AS w, generate_subscripts(a || b, 1) AS i FROM lists),
    grams AS (SELECT row, gram, count(*) AS n FROM ({grams}) GROUP BY row, gram),
    numbered AS (SELECT gram, crc(gram) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM grams)),
    counts AS (SELECT row, bucket, sum(n)::BIGINT AS n FROM grams JOIN numbered USING (gram) GROUP BY row, bucket),
    listed AS (SELECT row, sum(n)::BIGINT AS n_features, list(bucket::INTEGER ORDER BY bucket) AS bucket, list(n::INTEGER ORDER BY bucket) AS times FROM counts GROUP BY row),
    n AS (SELECT row, sum(len(a))::BIGINT AS n_words FROM lists GROUP BY row)
    SELECT n.row, n_words, coalesce(n_features, 0) AS n_features, coalesce(bucket, []::INTEGER[]) AS bucket, coalesce(times, []::INTEGER[]) AS times
    FROM n LEFT JOIN listed USING (row) ORDER BY n.row
    """


def features(texts: DataFrame, keys: list[str], order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """keys, number of words and features, and the counts by bucket of each row's text; a row for every row."""
    sql = count_sql(order, buckets)
    kept = texts.select(*keys, F.col("text").cast("string").alias("text"))

    def run(batches):
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": spill}) as db:
            crc = lambda grams: pa.array([zlib.crc32(g.encode()) for g in grams.to_pylist()], pa.int64())
            db.create_function("crc", crc, ["VARCHAR"], "BIGINT", type="arrow")

            def counted(rows: pa.RecordBatch, cut: list[tuple[int, int, str, str]]) -> pa.RecordBatch:
                r, p, own, tail = zip(*cut)
                db.register("texts", pa.table({"row": pa.array(r, pa.int64()), "piece": pa.array(p, pa.int64()), "own": pa.array(own, pa.string()), "tail": pa.array(tail, pa.string())}))
                got = db.sql(sql).to_arrow_table().combine_chunks()
                db.unregister("texts")
                lists = [list_array([np.asarray(x, np.int32) for x in got[c].to_pylist()], np.int32) for c in ("bucket", "times")]
                return pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keys))), *(got[c].combine_chunks() for c in ("n_words", "n_features")), *lists], names=[*keys, "n_words", "n_features", "bucket", "times"])

            for batch in batches:
                begin, size, cut = 0, 0, []
                for i, text in enumerate(batch.column(len(keys))):
                    own = pieces(text.as_py() or "", order)
                    cut += [(i - begin, k, *x) for k, x in enumerate(own)]
                    size += sum(len(x[0]) for x in own)
                    if size >= STEP:
                        yield counted(batch.slice(begin, i + 1 - begin), cut)
                        begin, size, cut = i + 1, 0, []
                if cut:
                    yield counted(batch.slice(begin), cut)

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), COUNTS]))


def bucket_sums(counts: DataFrame, name: str) -> DataFrame:
    """bucket and the number of features in it; summed within tasks first, so at most `buckets` rows leave each."""
    each = counts.select(F.explode(F.arrays_zip("bucket", "times")).alias("x"))
    return each.groupBy(F.col("x.bucket").alias("bucket")).agg(F.sum(F.col("x.times").cast("long")).alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in whole thousandths; `buckets` numbers are all that comes to the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in bucket_sums(source, "s").join(bucket_sums(target, "t"), "bucket", "full_outer").collect():
        s[row.bucket], t[row.bucket] = row.s or 0, row.t or 0
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """counts with weight, the sum of the gains of all features, instead of the lists."""
    keys = [c for c in counts.columns if c not in ("bucket", "times")]

    def run(batches):
        for batch in batches:
            b, n = (batch.column(batch.schema.get_field_index(c)) for c in ("bucket", "times"))
            each = gain[b.flatten().to_numpy(zero_copy_only=False)] * n.flatten().to_numpy(zero_copy_only=False)
            total = np.concatenate([[0], np.cumsum(each)])
            at = np.concatenate([[0], np.cumsum(b.value_lengths().to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keys), pa.array(total[at[1:]] - total[at[:-1]], pa.int64())], names=[*keys, "weight"])

    kinds = dict(counts.dtypes)
    return counts.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "weight long"]))


def ranked(rows: DataFrame, order: list, most: int) -> DataFrame:
    """rows with their rank in the order if it is at most `most`, else null; no task holds more than a range of the sort."""
    dealt = written(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(sizes), "_range").withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("_range", "_before")


def resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1 in the draw, null if not drawn): a row for every document."""
    small_batches(docs.sparkSession)
    counts = written(features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], order, buckets))
    wanted = written(features(target.select("text"), [], order, buckets))
    gain = gains(counts, wanted, buckets)
    drop(wanted)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weigh(counts, gain).withColumn("score", F.col("weight") + gumbel)
    n = counts.where(F.col("n_words") >= least_words).count()
    drawn = ranked(scored.where(F.col("n_words") >= least_words), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], percent * n // 100)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = written(drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank"))
    drop(counts)
    return out


#: The contract's query; CRC-32 is folded over the bytes of each distinct word, with a table made by its rule.
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS g FROM d), bw AS (SELECT unnest(w) AS g FROM b),
steps AS (SELECT list(list_reduce(list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
grams AS (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM dw UNION SELECT g FROM bw)),
crc AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT)), lambda c, v: xor(c // 256, t[xor(c % 256, v) + 1])), 4294967295) % 10000 AS bucket FROM grams, steps),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (g) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (g) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN crc USING (g) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weights USING (doc_id)),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN places USING (doc_id)
"""
