"""Episode matching by overlap against all matchings, and on long chains."""

import random
import time

import numpy as np
import pytest

from wxspark.operators import assignment


def best(forecast, observed, window=3):
    found = [None, None]

    def shared(f, o):
        return max(0, min(f[1], o[1]) - max(f[0], o[0]) + 1)

    def go(k, used, pairs):
        if k == len(observed):
            cost = sum(abs(forecast[f][0] - observed[o][0]) - 100 * shared(forecast[f], observed[o]) for f, o in pairs)
            key = (-len(pairs), cost, [observed[o][0] for _, o in pairs], [forecast[f][0] for f, _ in pairs])
            if found[0] is None or key < found[0]:
                found[:] = key, pairs
            return
        go(k + 1, used, pairs)
        for i, f in enumerate(forecast):
            if i not in used and (shared(f, observed[k]) or abs(f[0] - observed[k][0]) <= window):
                go(k + 1, used | {i}, [*pairs, (i, k)])

    go(0, frozenset(), [])
    return found[0]


def episodes(r, most, gap, span):
    """Up to `most` episodes of one side, at least `gap` hours apart (0: one may begin in the hour after another)."""
    at, out = r.randint(0, 4), []
    for _ in range(r.randint(0, most)):
        end = at + r.choice([0, 0, 1, 2, span])
        out.append((at, end))
        at = end + 1 + gap + r.choice([0, 0, 1, 3])
    return out


@pytest.mark.parametrize("gap,span,rounds", [(1, 4, 250), (0, 3, 250), (0, 9, 150)])
def test_assignment_equals_all_matchings(gap, span, rounds):
    r = random.Random(gap * 10 + span)
    crossed = 0
    for _ in range(rounds):
        f, o = episodes(r, 7, gap, span), episodes(r, 7 if span < 9 else 5, gap, span)
        pairs = sorted(assignment.assign(np.array(f).reshape(-1, 2), np.array(o).reshape(-1, 2)), key=lambda p: p[1])
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        cost = sum(abs(f[i][0] - o[j][0]) - 100 * max(0, min(f[i][1], o[j][1]) - max(f[i][0], o[j][0]) + 1) for i, j in pairs)
        assert (-len(pairs), cost, [o[j][0] for _, j in pairs], [f[i][0] for i, _ in pairs]) == (best(f, o) or (0, 0, [], []))
        crossed += any(a[0] > b[0] for a, b in zip(pairs, pairs[1:]))
    assert crossed or gap or span == 9


def test_matchings_may_cross_where_episodes_touch():
    f, o = np.array([(0, 0), (1, 1)]), np.array([(1, 1), (2, 2)])
    assert sorted(assignment.assign(f, o)) == [(0, 1), (1, 0)]


def test_a_chain_of_a_hundred_thousand_episodes_ends(spark):
    n = 100_000
    began = time.time()
    f, o = np.array([(3 * i, 3 * i + 1) for i in range(n)]), np.array([(3 * i + 1, 3 * i + 1) for i in range(n)])
    assert sorted(assignment.assign(f, o)) == [(i, i) for i in range(n)]
    assert time.time() - began < 60


def test_match_by_key(spark):
    r = random.Random(4)
    rows, want = [], {}
    for key in range(60):
        f, o = episodes(r, 5, 1, 4), episodes(r, 5, 1, 4)
        rows += [(key, "x", "F", *e) for e in f] + [(key, "x", "O", *e) for e in o]
        want[key] = best(f, o), len(f), len(o)
    rows += [(99, None, "F", None, None), (100, None, "O", 1, 2)]
    got = {}
    for x in assignment.match(spark.createDataFrame(rows, "key int, name string, side string, onset long, end long").repartition(3), ["key", "name"]).collect():
        got.setdefault(x.key, []).append(x)
    assert [(x.outcome, x.o_onset, x.o_end, x.f_onset) for x in got.pop(100)] == [("missed", 1, 2, None)] and 99 not in got
    for key, (found, n, m) in want.items():
        own = got.get(key, [])
        pairs = sorted((x.o_onset, x.f_onset) for x in own if x.outcome == "matched")
        assert ([o for o, _ in pairs], [f for _, f in pairs]) == (found[2], found[3]) if found else not pairs
        assert sum(x.outcome == "false_alarm" for x in own) == n - len(pairs) and sum(x.outcome == "missed" for x in own) == m - len(pairs)
