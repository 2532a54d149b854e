import random

import numpy as np
import pytest
import xxhash

from tests.llm import helpers
from wxspark.llm import op11_simhash_near_dedup as op11

SCHEMA = "doc_id long, text string, f long, signature string, component_id string, _gone int"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, "s", "c", i) for i, (d, t) in enumerate(docs)], SCHEMA).repartition(3)


def fingerprint(text, words=4):
    w = helpers.SPACE.findall(helpers.lower(text))
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints, distance):
    """The component of each fingerprint, by brute force."""
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and bin(a ^ b).count("1") <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in prints}


def brute(docs, words=4, distance=4):
    prints = [fingerprint(t, words) for _, t in docs]
    part = grouped(set(prints), distance)
    least = {}
    for (d, _), f in zip(docs, prints):
        if d is not None:
            least[part[f]] = min(d, least.get(part[f], d))
    return sorted(((d, f"{f:016x}", least.get(part[f])) for (d, _), f in zip(docs, prints)), key=str)


@pytest.mark.parametrize("seed,words,distance,cell", [(1, 4, 4, 8192), (2, 1, 7, 8192), (3, 1, 12, 4), (4, 2, 8, 3)])
def test_components_match_brute_force(spark, seed, words, distance, cell):
    docs = helpers.corpus(seed) + [(3, "one other text of this name"), (3, "a third, then"), (None, "one other text of this name"), (None, "nobody else says so"), (5000, None), (5001, " \t\n"), (5002, "É é")]
    got = op11.near_duplicates(frame(spark, docs), words, distance, cell).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, words, distance)


def clouds(seed, n=900):
    """Fingerprints in clouds of some bits about a few centres, with chains between them."""
    r = random.Random(seed)
    out = set()
    for _ in range(6):
        c = r.getrandbits(64)
        for _ in range(n // 8):
            out.add(c ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 7))}))
        for _ in range(20):
            for b in r.sample(range(64), r.randint(1, 5)):
                c ^= 1 << b
            out.add(c)
    return out | {r.getrandbits(64) for _ in range(n // 8)} | {0, (1 << 64) - 1}


@pytest.mark.parametrize("distance,cell", [(4, 8192), (4, 40), (4, 7), (3, 10), (1, 5), (6, 16)])
def test_no_link_is_lost_in_any_cell(spark, distance, cell):
    prints = clouds(distance)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(f),) for f in prints], "f long").repartition(4)
    pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in op11.links(op11.signatures(rows, distance, cell), distance).distinct().collect()]
    assert all(bin(a ^ b).count("1") <= distance and a != b for a, b in pairs)
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    want = grouped(prints, distance)
    assert {frozenset(f for f in prints if find(f) == x) for x in map(find, prints)} == {frozenset(f for f in prints if want[f] == x) for x in set(want.values())}


def test_a_dense_group_gives_a_forest():
    f = np.array(sorted({1 << i ^ 1 << j for i in range(64) for j in range(i)} | {0}), np.uint64)
    none = np.zeros(0, np.uint64)
    assert len(list(op11.forest(f, none, 4))) == len(f) - 1
    assert len(list(op11.forest(f[:900], f[900:], 4))) == len(f) - 1
    assert list(op11.forest(f[:1], none, 4)) == [] and list(op11.forest(none, none, 4)) == []


def test_edges(spark):
    assert op11.near_duplicates(frame(spark, []).limit(0)).collect() == []
    docs = [(2, "a b c d e"), (1, "A  B\tC d e"), (1, "a b c d e"), (3, None), (4, ""), (None, ""), (9, "w " * 300_000)]
    assert sorted((tuple(r) for r in op11.near_duplicates(frame(spark, docs)).collect()), key=str) == brute(docs)
    assert sorted(x["_gone"] for x in op11.dedup(frame(spark, docs)).collect()) == [1, 2, 3, 5, 6]
