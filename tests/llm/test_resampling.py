import collections
import hashlib
import math
import re
import zlib

import pytest

from tests.llm import helpers
from tests.oracle import same
from wxspark.llm import op13_importance_resampling as op13

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, bucket string, rank string, row string, weight string"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "b", "r", "w", "x") for d, t in docs], SCHEMA).repartition(3)


def brute(docs, target, order, buckets, percent=10, least=20):
    def grams(text):
        w = WORD.findall(helpers.lower(text))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    number = lambda g: zlib.crc32(g.encode()) % buckets
    own = [(d, *grams(t)) for d, t in docs]
    s, t = collections.Counter(), collections.Counter()
    for _, _, g in own:
        s.update(map(number, g))
    for x in target:
        t.update(map(number, grams(x)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    rows = []
    for d, n, g in own:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[number(x)] for x in g)
        rows.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("seed,order,buckets,percent", [(1, 1, 10_000, 10), (2, 2, 50, 35), (3, 3, 1000, 100)])
def test_draw_matches_brute_force(spark, seed, order, buckets, percent):
    docs = helpers.corpus(seed) + [(7, "Ünï-cödé 1a2 \x00 b_c " * 9), (7, "Ünï-cödé 1a2 \x00 b_c " * 9), (8, None), (None, "a b " * 30), (None, None)]
    target = [t for _, t in helpers.corpus(seed + 10, 20)] + [None, ""]
    got = op13.resample(frame(spark, docs), frame(spark, [(0, t) for t in target]), order, buckets, percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, target, order, buckets, percent)


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    assert same(op13.resample(docs, target), op13.SQL, sf) == 1000


def test_nothing_in_and_nothing_to_aim_at(spark):
    assert op13.resample(frame(spark, []).limit(0), frame(spark, [(1, "a b")])).collect() == []
    docs = [(d, t) for d, t in helpers.corpus(5)]
    got = op13.resample(frame(spark, docs), frame(spark, []).limit(0)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, [], 1, 10_000)


@pytest.mark.parametrize("order", [1, 3])
def test_pieces_change_nothing(spark, order):
    text = "".join(f"w{i % 977}{'-' if i % 3 else ' , '}é{i % 13} " for i in range(150_000)) + "z" * 3_000_000 + " end of it"
    own = op13.pieces(text, order)
    assert len(own) > 2 and "".join(x for x, _ in own) == text
    row = op13.features(frame(spark, [(1, text)]), ["doc_id"], order).first()
    words = WORD.findall(text)
    want = collections.Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, order + 1) for i in range(len(words) - n + 1))
    assert row.n_words == len(words) and dict(zip(row.bucket, row.times)) == want
