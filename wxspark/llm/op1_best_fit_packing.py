"""Best-fit packing: a configuration linear program over the histogram of piece lengths.

Multiplicative weights solve the program; a knapsack dynamic program prices the configurations; the
solution is rounded down and what is left over is packed best-fit decreasing, on counts. The driver sees
the histogram alone (at most `capacity` rows). Spark numbers the pieces of each length and each number
falls into one slot of the plan, so nothing is packed piece by piece on the driver.

Defined cases: a null text is an empty one and gives one piece holding only the end id; repeated rows are
packed as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wxspark.llm.common import small_batches, written

CAPACITY, END_ID, ROUNDS, RANK_GROUP = 1024, 2, 150, 1000
#: The share of the fractional solution that is rounded down; the rest absorbs its error.
SCALE = 0.9
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str):
    """The vocabulary of byte_bpe_50k.json as ranks: the same ids as the tokenizers file, four times as fast."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


@lru_cache(maxsize=2)
def _reference(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def encode(text: str, ranks_path: str, pattern: str, json_path: str) -> list[int]:
    """Token ids; very long runs of white space, which the fast encoder refuses, go to the slow one."""
    try:
        return _encoder(ranks_path, pattern).encode(text, allowed_special="all", disallowed_special=())
    except ValueError:
        return _reference(json_path).encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the remainder first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every document's token pieces with the checksum of their ids."""
    import public_tokenizers as P

    files = P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("byte_bpe_50k.json")

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(np.array(encode(text or "", *files), "<u4"), np.uint32(END_ID)).astype("<u4")
                rows.extend((doc, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cut(len(ids), capacity)))
            a = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(a[1], pa.int32()), *(pa.array(x, pa.int64()) for x in a[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession, 500)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def _knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable multiset of sizes within capacity, by dynamic programming over the capacity."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes[0]), capacity + 1):
        fit = int(np.searchsorted(sizes, c, "right"))
        gain = best[c - sizes[:fit]] + value[:fit]
        k = int(gain.argmax())
        best[c], took[c] = gain[k], k
        if best[c - 1] > best[c]:
            best[c], took[c] = best[c - 1], -1
    out: dict[int, int] = defaultdict(int)
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            out[int(took[c])] += 1
            c -= int(sizes[took[c]])
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Configurations {length: times} and how many sequences use each; together they hold the histogram exactly."""
    plan: list[tuple[dict[int, int], int]] = []
    left = {l: n for l, n in histogram.items() if n}
    if full := left.pop(capacity, 0):
        plan.append(({capacity: 1}, full))
    if left:
        sizes = np.array(sorted(left))
        need = np.array([left[int(l)] for l in sizes], float)
        bound = sizes @ need / capacity
        covered, used = np.zeros(len(sizes)), defaultdict(float)
        rate = max(2.0, np.log(len(sizes) + 1)) * 4
        for _ in range(rounds):
            share = covered / need
            weight = np.exp(-rate * (share - share.min()))
            config = _knapsack(sizes, weight / need * need.mean() + 1e-9 * sizes, capacity)
            step = bound / rounds
            for k, times in config.items():
                covered[k] += step * times
            used[tuple(sorted(config.items()))] += step
        remaining = need.astype(np.int64)
        scale = SCALE
        for config, x in sorted(used.items(), key=lambda item: (-item[1], item[0])):
            times = min(int(scale * x), *(int(remaining[k]) // n for k, n in config))
            if times > 0:
                for k, n in config:
                    remaining[k] -= times * n
                plan.append(({int(sizes[k]): n for k, n in config}, times))
        plan += _best_fit({int(l): int(n) for l, n in zip(sizes, remaining) if n}, capacity)
    return plan


def _best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: equal partly filled sequences are one entry."""
    open_: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                per = capacity // length
                if n >= per:
                    open_[capacity - per * length][((length, per),)] += n // per
                if n % per:
                    open_[capacity - n % per * length][((length, n % per),)] += 1
                break
            config, count = next(iter(open_[room].items()))
            per = min(room // length, n)
            take = min(count, n // per)
            n -= take * per
            open_[room][config] -= take
            if not open_[room][config]:
                del open_[room][config]
            if not open_[room]:
                del open_[room]
            open_[room - per * length][(*config, (length, per))] += take
    return [(dict(config), n) for group in open_.values() for config, n in group.items()]


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first number, first sequence, times in a sequence, place of the first), by first number."""
    out, taken, sequence = defaultdict(list), defaultdict(int), 0
    for config, count in plan:
        place = 0
        for length in sorted(config, reverse=True):
            times = config[length]
            out[length].append((taken[length], sequence, times, place))
            taken[length] += count * times
            place += length * times
        sequence += count
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def assign(found: DataFrame, plan: list[tuple[dict[int, int], int]], counts: dict[int, int]) -> DataFrame:
    """Each piece in its slot: pieces of a length are numbered in salted groups, so a hot length is many groups."""
    spark, where = found.sparkSession, slots(plan)
    groups = spark.createDataFrame([(l, -(-n // RANK_GROUP)) for l, n in counts.items()], "length long, groups long")
    salted = found.join(F.broadcast(groups), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start"), "groups"))
    sums = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sums.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("row", F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")))
    numbered = ranked.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row") - 1).alias("number"))

    def place(frames):
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            lengths, numbers = frame["length"].to_numpy(), frame["number"].to_numpy()
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                rows = where[int(length)]
                at = rows[np.searchsorted(rows[:, 0], numbers[own], "right") - 1]
                k = numbers[own] - at[:, 0]
                sequence[own], offset[own] = at[:, 1] + k // at[:, 2], at[:, 3] + k % at[:, 2] * length
            yield pd.DataFrame({**{c: frame[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": sequence, "offset": offset})

    return numbered.mapInPandas(place, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Packs documents (doc_id, text) into sequences of at most `capacity` tokens; one row a piece."""
    found = written(pieces(docs, capacity))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    return assign(found, solve(counts, capacity, rounds), counts)
