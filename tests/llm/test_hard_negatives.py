import math
import random

import numpy as np
import pytest

from tests.oracle import same
from wxspark.llm import op12_hard_negatives as op12

SCHEMA = "vec_id long, embedding array<double>, label int, score long, shard int, v string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "v") for r in rows], SCHEMA).repartition(4)


def brute(rows):
    able = []
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        able.append((i, [math.floor(256 * c) for c in x], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for at, (anchor, q, label) in enumerate(able):
        if anchor % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x)), i, l) for k, (i, x, l) in enumerate(able) if k != at)
        for p, pid, _ in [r for r in scored if r[2] == label][:5]:
            held = [r for r in scored if r[2] != label and 30 * -p <= 100 * -r[0] <= 90 * -p]
            out += [(anchor, pid, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(held[:10])]
    return sorted(out)


def vectors(seed, n, dims, labels=4):
    """Clusters, a vector that a third of the rows share, zeros, repeated rows, and what takes no part."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        kind = r.random()
        c = r.choice(centres)
        x = centres[0] if kind < 0.33 else [a + r.gauss(0, 0.3) for a in c] if kind < 0.9 else [0.0] * dims
        x = x[: r.randint(0, dims)] if kind > 0.97 else x
        rows.append((i * 5, x, r.randrange(labels)))
    rows += [r.choice(rows) for _ in range(n // 20)] + [rows[0], rows[0], (0, centres[1], 1), (100, centres[1], 1), (100, centres[1], 1)]
    return rows + [(None, centres[0], 1), (3, None, 1), (4, centres[0], None), (5, [1.0, None], 1), (6, [math.nan], 1), (7, [math.inf], 1), (8, [], 1)]


@pytest.mark.parametrize("seed,dims,scale,sizes", [(1, 3, 1.0, None), (2, 6, 1.0, (16, 3, 8, 3)), (3, 16, 1e4, (40, 4, 16, 2))])
def test_negatives_match_brute_force(spark, monkeypatch, seed, dims, scale, sizes):
    for name, value in zip(("SHARD", "DEPTH", "CHUNK", "QUERIES"), sizes or ()):
        monkeypatch.setattr(op12, name, value)
    rows = [(i, x and [c if c is None else c * scale for c in x], label) for i, x, label in vectors(seed, 400, dims)]
    got = sorted(tuple(r) for r in op12.mine(frame(spark, rows)).collect())
    assert got == brute(rows) and len(got) > 100


def test_scores_beyond_exact_doubles(spark):
    r = random.Random(5)
    rows = [(i * 10, [r.gauss(0, 1) * 2.0**20 for _ in range(5)], r.randrange(2)) for i in range(150)] + [(1, [1e300], 1), (2, [-1e300, 0.0], 0)]
    got = sorted(tuple(x) for x in op12.mine(frame(spark, rows)).collect())
    assert got == brute(rows[:150]) and max(x[4] for x in got) > op12.EXACT


def test_bounds_of_a_tree_hold():
    r = np.random.default_rng(1)
    m = np.floor(r.normal(0, 60, (700, 5)))
    space = op12.Space(5, int((m * m).sum(axis=1).max()))
    tree = op12.Tree(space, m, 16, 64)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(700)) and max(map(len, tree.leaves)) <= 16
    for q in m[::50]:
        near, far = tree.ranges(q)
        d = np.sqrt(np.maximum((q * q).sum() + space.longest - 2 * (m @ q), 0))
        assert all(near[i] <= d[leaf].min() + space.slack and far[i] >= d[leaf].max() - space.slack for i, leaf in enumerate(tree.leaves))
    leaf, path = tree.place(m)
    assert all(i in tree.leaves[k] for i, k in enumerate(leaf)) and all(len(p) == len(tree.above[k]) for p, k in zip(path, leaf))


def test_query_matches_sql_and_edges(spark):
    sf = "/root/testdata/sf0.01"
    assert same(op12.mine(spark.read.parquet(f"{sf}/embeddings.parquet")), op12.SQL, sf) > 0
    assert op12.mine(frame(spark, []).limit(0)).collect() == []
    assert op12.mine(frame(spark, [(100, [1.0], 1), (200, None, 2)])).collect() == []
