"""One-to-one matching of episodes, most pairs first, then least cost, then earliest.

Matches never cross a gap beyond the window, so a group holds a key's episodes between two such gaps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def match_in_order(forecast: np.ndarray, observed: np.ndarray, window: float) -> list[tuple[int, int]]:
    """Onsets ascend, so some best matching never crosses: dynamic programming over the cells within the window.

    Row i holds places lo[i] .. hi[i] of observed; places before lo[i] equal lo[i], and at hi[i] row i equals row i + 1.
    Two rows of values are kept, and a byte a cell for the way back.
    """
    f, o = [float(x) for x in forecast], [float(x) for x in observed]
    n, m = len(f), len(o)
    lo, hi, a, b = [], [], 0, 0
    for x in f:
        while a < m and o[a] < x and x - o[a] > window:
            a += 1
        b = max(a, b)
        while b < m and abs(x - o[b]) <= window:
            b += 1
        lo.append(a)
        hi.append(b)
    below, start, took = [(0, 0.0)], m, [b""] * n
    for i in range(n - 1, -1, -1):
        row, way = [below[max(hi[i], start) - start]], bytearray(hi[i] - lo[i])
        for j in range(hi[i] - 1, lo[i] - 1, -1):
            pairs, cost = below[max(j + 1, start) - start]
            value, step = min([((pairs - 1, cost + abs(f[i] - o[j])), 0), (below[max(j, start) - start], 1), (row[-1], 2)])
            row.append(value)
            way[j - lo[i]] = step
        below, start, took[i] = row[::-1], lo[i], bytes(way)
    out, i, j = [], 0, 0
    while i < n and j < m:
        j = max(j, lo[i])
        step = took[i][j - lo[i]] if j < hi[i] else 1
        if step == 0:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif step == 1:
            i += 1
        else:
            j += 1
    return out


def close_groups(episodes: DataFrame, by: list[str], window_h: float) -> DataFrame:
    """Episodes with the number of their group, and whether they begin it; a new one starts wherever the gap to the onset before exceeds the window."""
    w = W.partitionBy(*by).orderBy("onset_h")
    far = episodes.withColumn("far", F.coalesce((F.col("onset_h") - F.lag("onset_h").over(w) > window_h), F.lit(True)).cast("long"))
    return far.withColumn("close", F.sum("far").over(w.rowsBetween(W.unboundedPreceding, 0)))


def match_episodes(episodes: DataFrame, by: list[str], window_h: float = 3) -> DataFrame:
    """Episodes (by, side 'F' or 'O', onset_h) matched within a key; the unmatched are misses and false alarms.

    A group of one side has nothing to match and a group of two sides and two episodes is a match: these never leave Spark's own
    operators. Of the others a task gets whole groups, one after the other.
    """
    kinds = dict(episodes.dtypes)
    out = {"outcome": "string", "fcst_h": "double", "obs_h": "double"}

    def matched(frame: pd.DataFrame) -> pd.DataFrame:
        """The outcomes of whole groups, each by onset."""
        is_f, onset, begin = frame["side"].to_numpy() == "F", frame["onset_h"].to_numpy(float), np.flatnonzero(frame["far"].to_numpy() == 1).tolist()
        rows, at = [], []
        for a, z in zip(begin, [*begin[1:], len(frame)]):
            f, o = onset[a:z][is_f[a:z]].tolist(), onset[a:z][~is_f[a:z]].tolist()
            pairs = match_in_order(f, o, window_h)
            hits, seen = {i for i, _ in pairs}, {j for _, j in pairs}
            found = [("match", f[i], o[j]) for i, j in pairs] + [("false_alarm", x, None) for i, x in enumerate(f) if i not in hits] + [("missed", None, x) for j, x in enumerate(o) if j not in seen]
            rows += found
            at += [a] * len(found)
        got = pd.DataFrame(rows, columns=list(out)).astype({"fcst_h": float, "obs_h": float})
        return pd.concat([frame[by].iloc[at].reset_index(drop=True), got], axis=1)

    def run(frames):
        kept = None
        for frame in frames:
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            begin = np.flatnonzero(frame["far"].to_numpy() == 1)
            last = int(begin[-1]) if len(begin) else 0
            kept = frame.iloc[last:].reset_index(drop=True)  # the last group may go on
            if last:
                yield matched(frame.iloc[:last])
        if kept is not None and len(kept):
            yield matched(kept)

    each = W.partitionBy(*by, "close")
    dealt = close_groups(episodes, by, window_h).withColumn("n_f", F.count_if(F.col("side") == "F").over(each)).withColumn("n_o", F.count_if(F.col("side") == "O").over(each))
    own = lambda s: F.when(F.col("side") == s, F.col("onset_h").cast("double"))
    alone = dealt.where("n_f = 0 or n_o = 0").select(*by, F.when(F.col("side") == "F", "false_alarm").otherwise("missed").alias("outcome"), own("F").alias("fcst_h"), own("O").alias("obs_h"))
    two = dealt.where("n_f = 1 and n_o = 1").groupBy(*by, "close").agg(F.max(own("F")).alias("fcst_h"), F.max(own("O")).alias("obs_h")).select(*by, F.lit("match").alias("outcome"), "fcst_h", "obs_h")
    rest = dealt.where("n_f > 0 and n_o > 0 and n_f + n_o > 2").drop("n_f", "n_o").repartition(*by, "close").sortWithinPartitions(*by, "close", F.desc("far"), "onset_h")
    return alone.union(two).union(rest.mapInPandas(run, ", ".join(f"`{c}` {k}" for c, k in ({c: kinds[c] for c in by} | out).items())))
