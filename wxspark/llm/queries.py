"""One registered query for each corpus operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wxspark.llm import op1_best_fit_packing as op1
from wxspark.llm import op2_minhash_near_dedup as op2
from wxspark.llm import op3_license_scan as op3
from wxspark.llm import op4_substring_dedup as op4
from wxspark.llm import op5_chat_formatting as op5
from wxspark.llm import op6_toxicity as op6
from wxspark.llm import op7_quality_rules as op7
from wxspark.llm import op8_pii as op8
from wxspark.llm import op9_line_dedup as op9
from wxspark.llm import op10_benchmark_decontamination as op10
from wxspark.llm import op11_simhash_near_dedup as op11
from wxspark.llm import op12_hard_negatives as op12
from wxspark.llm import op13_importance_resampling as op13


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.pack(_docs(spark, sf_dir))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.near_duplicates(_docs(spark, sf_dir), *op2.CONTRACT)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.scan(_docs(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.dedup(_docs(spark, sf_dir))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.digests(op5.examples(op5.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.judge(_docs(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.find(_docs(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.judge(_docs(spark, sf_dir))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.hits(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.near_duplicates(_docs(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM reach r JOIN ways e ON e.x = r.b)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
least AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
marks AS (SELECT doc_id, i FROM windows JOIN least USING (g) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
told AS (SELECT doc_id, i, word, max(marks.i IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY words.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM words LEFT JOIN marks USING (doc_id, i)),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM told GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


_QUERIES = (
    op1_best_fit_packing, op2_minhash_near_dedup, op3_license_scan, op4_substring_dedup, op5_chat_formatting,
    op6_toxicity, op7_quality_rules, op8_pii, op9_line_dedup, op10_benchmark_decontamination,
    op11_simhash_near_dedup, op12_hard_negatives, op13_importance_resampling,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    return {"op2_minhash_near_dedup": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op5_chat_formatting": op5.SQL, "op7_quality_rules": op7.SQL, "op12_hard_negatives": op12.SQL, "op13_importance_resampling": op13.SQL}
