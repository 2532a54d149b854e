"""One-to-one matching of forecast and observed episodes by overlap, then onset: most pairs, least cost, earliest.

An episode is hours [onset, end], both included. Two may be matched if they share an hour or their onsets lie within the window. Of the matchings
with most pairs the one of least cost counts, a pair's cost being the hours between its onsets less 100 for each hour shared; of equals the one whose
matched observed onsets, then forecast onsets, come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hours between onsets up to which episodes without a shared hour may match; the worth of a shared hour.
WINDOW_H, SHARED = 3, 100


def components(episodes: DataFrame, by: list[str], window_h: int = WINDOW_H) -> DataFrame:
    """Episodes with the number of their component: a new one starts where no episode before reaches, by its end or by the window."""
    w = W.partitionBy(*by).orderBy("onset", "end", "side")
    reach = F.max(F.greatest("end", F.col("onset") + window_h)).over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = episodes.withColumn("_fresh", F.coalesce(F.col("onset") > reach, F.lit(True)).cast("long"))
    return fresh.withColumn("component", F.sum("_fresh").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_fresh")


class _Chosen:
    """Pairs chosen so far, newest last: a list that states share."""

    __slots__ = ("pair", "before", "n")

    def __init__(self, pair: tuple[int, int], before: _Chosen | None):
        self.pair, self.before, self.n = pair, before, 1 + (before.n if before else 0)


def _unlike(a: _Chosen | None, b: _Chosen | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """What two lists of one length have behind what they share, by observed episode."""
    x, y = [], []
    while a is not b:
        x.append(a.pair)
        y.append(b.pair)
        a, b = a.before, b.before
    return sorted(x), sorted(y)


def assign(forecast: np.ndarray, observed: np.ndarray, window_h: int = WINDOW_H) -> Iterator[tuple[int, int]]:
    """Matched (forecast, observed) places of one component; both are rows (onset, end) by onset.

    A sweep over the onsets. What may still match is what has not and reaches beyond the sweep; the best choice so far is
    kept for each set of these, and as the episodes of a side don't overlap, there are few. Where one choice is left, its
    pairs are final and let go, so a long chain is cut without loss.
    """
    rows = sorted([(int(a), int(b), 0, i) for i, (a, b) in enumerate(forecast)] + [(int(a), int(b), 1, i) for i, (a, b) in enumerate(observed)])
    states: dict[frozenset, tuple[int, int, _Chosen | None]] = {frozenset(): (0, 0, None)}
    for onset, end, side, i in rows:
        me = (max(end, onset + window_h), side, i, onset, end)
        after: dict[frozenset, tuple[int, int, _Chosen | None]] = {}
        for open_, (pairs, cost, chosen) in states.items():
            still = frozenset(x for x in open_ if x[0] >= onset)
            ways = [(still | {me}, (pairs, cost, chosen))]
            for other in still:
                if other[1] != side:
                    shared = max(0, min(end, other[4]) - onset + 1)
                    if shared or onset - other[3] <= window_h:
                        pair = (i, other[2]) if side else (other[2], i)
                        ways.append((still - {other}, (pairs - 1, cost + onset - other[3] - SHARED * shared, _Chosen(pair, chosen))))
            for key, value in ways:
                best = after.get(key)
                if best is None or value[:2] < best[:2] or value[:2] == best[:2] and _earlier(value[2], best[2], forecast, observed):
                    after[key] = value
        if len(after) == 1:
            (key, (_, _, chosen)), = after.items()
            yield from _final(chosen)
            after = {key: (0, 0, None)}
        states = after
    best = None
    for value in states.values():
        if best is None or value[:2] < best[:2] or value[:2] == best[:2] and _earlier(value[2], best[2], forecast, observed):
            best = value
    yield from _final(best[2])


def _earlier(a: _Chosen | None, b: _Chosen | None, forecast: np.ndarray, observed: np.ndarray) -> bool:
    """Of two choices with as many pairs: whether the first one's observed onsets, then its forecast onsets, come first."""
    x, y = _unlike(a, b)
    key = lambda z: ([int(observed[o][0]) for o, _ in z], [int(forecast[f][0]) for _, f in z])
    return key(x) < key(y)


def _final(chosen: _Chosen | None) -> Iterator[tuple[int, int]]:
    while chosen is not None:
        yield chosen.pair[::-1]
        chosen = chosen.before


def match(episodes: DataFrame, by: list[str], window_h: int = WINDOW_H) -> DataFrame:
    """Episodes (by, side 'F' or 'O', onset, end: whole hours) to by, outcome, f_onset, f_end, o_onset, o_end: matched, missed or false_alarm.

    The episodes of a side don't overlap, as runs of hours don't; a task gets sorted components, one after the other. Episodes without
    an onset go.
    """
    kinds = dict(episodes.dtypes)
    out = ["f_onset", "f_end", "o_onset", "o_end"]

    def matched(frame: pd.DataFrame) -> pd.DataFrame:
        """The outcomes of whole components that lie one after the other, each by onset."""
        group, is_f, times = frame[["_group", "component"]].to_numpy(np.int64), frame["side"].to_numpy() == "F", frame[["onset", "end"]].to_numpy(np.int64)
        begin = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1)))
        rows, at = [], []
        for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(frame)]):
            own = times[a:z]
            f, o = own[is_f[a:z]], own[~is_f[a:z]]
            pairs = list(assign(f, o, window_h))
            hits, seen = {i for i, _ in pairs}, {j for _, j in pairs}
            found = [("matched", *f[i], *o[j]) for i, j in pairs] + [("false_alarm", *x, None, None) for i, x in enumerate(f) if i not in hits] + [("missed", None, None, *x) for j, x in enumerate(o) if j not in seen]
            rows += found
            at += [a] * len(found)
        got = pd.DataFrame(rows, columns=["outcome", *out]).astype({c: "Int64" for c in out})
        return pd.concat([frame[by].iloc[at].reset_index(drop=True), got], axis=1)

    def run(frames):
        kept = None
        for frame in frames:
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            group = frame[["_group", "component"]].to_numpy(np.int64)
            last = int(np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1)))[-1]) if len(frame) else 0
            kept = frame.iloc[last:].reset_index(drop=True)  # the last component may go on
            if last:
                yield matched(frame.iloc[:last])
        if kept is not None and len(kept):
            yield matched(kept)

    each = W.partitionBy(*by, "component")
    dealt = components(episodes.where("onset is not null").select(*by, "side", F.col("onset").cast("long"), F.col("end").cast("long")), by, window_h)
    dealt = dealt.withColumn("n_f", F.count_if(F.col("side") == "F").over(each)).withColumn("n_o", F.count_if(F.col("side") == "O").over(each))
    # one of each side meet, or they would be two components; a side alone has nothing to match: no task is needed
    own = lambda s, c: F.when(F.col("side") == s, F.col(c))
    alone = dealt.where("n_f = 0 or n_o = 0").select(*by, F.when(F.col("side") == "F", "false_alarm").otherwise("missed").alias("outcome"), own("F", "onset").alias("f_onset"), own("F", "end").alias("f_end"), own("O", "onset").alias("o_onset"), own("O", "end").alias("o_end"))
    two = dealt.where("n_f = 1 and n_o = 1").groupBy(*by, "component").agg(*(F.max(own(s.upper(), c)).alias(f"{s}_{c}") for s in "fo" for c in ("onset", "end")))
    rest = dealt.where("n_f > 0 and n_o > 0 and n_f + n_o > 2").withColumn("_group", F.xxhash64(*by)).drop("n_f", "n_o")
    dealt_out = rest.repartition(*by, "component").sortWithinPartitions("_group", "component", "onset", "end")
    rest = dealt_out.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "outcome string", *(f"{c} long" for c in out)]))
    return alone.union(two.select(*by, F.lit("matched").alias("outcome"), *out)).union(rest)
