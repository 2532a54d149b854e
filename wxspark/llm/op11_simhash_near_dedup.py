"""SimHash near-dedup: deletion-variant signatures of few segments, equality join, verification.

1. A scan hashes the word shingles of each whole text, repeats included, by XXH64; a bit of the fingerprint is set if
   it is set in over half of the hashes.
2. Links are between fingerprints, so documents with one fingerprint are a class from the start and only distinct fingerprints go on.
3. Fingerprints are cut into distance // 2 + 1 segments (three for four bits). If all of them differed by two bits or more, the
   whole would differ by more than the distance; so a pair that links has a segment that differs by one bit at most.
   Each segment is indexed once for each of its bits, that bit deleted: 64 signatures a fingerprint, and two segments meet in
   one if, and only if, they differ by one bit at most.
4. Equal signatures are brought together by a shuffle and a sort. A task reads its sorted signatures in batches and
   verifies each group by exclusive-or and bit counts. It lets out a spanning forest of the links it finds, never
   all pairs, so a group of n fingerprints gives fewer than n rows.
5. A group of over CELL fingerprints is named by counts of exact segments, before signatures are made. Its members get signatures of a
   second level instead, made in the same way of the bits outside of the segment, which hold what is left of the distance. A
   group that is still larger than CELL is dealt to cells, a home block and a guest block each, so that every pair meets in
   one of them and no task holds more than two blocks.
6. Connected components of the forests name the groups.

Defined cases: null texts, empty texts and texts without words have the fingerprint zero, which links like any other;
repeated rows of a doc_id are documents each, and each has its own fingerprint; a row without a doc_id takes part, but names no
component (one without any doc_id in reach has none); ties don't arise; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wxspark.llm.common import WHITE, Words, components, drop, small_batches, text_steps, written

#: Words of a shingle, and bits by which linked fingerprints may differ.
WORDS, DISTANCE = 4, 4
#: The seed of XXH64 that the contract names.
SEED = 42
#: Fingerprints of one signature that one task verifies together; those of a group that is verified beside others.
CELL, SMALL = 8192, 48
#: Rows of a verified block; signatures read at once; shingles whose bits are counted at once.
BLOCK, GATHERED, COUNTED = 512, 1 << 16, 1 << 15


# --- fingerprints ----------------------------------------------------------------------------


def _joined(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space behind each, and where each begins and ends."""
    size = w.ends - w.starts
    end = np.cumsum(size + 1) - 1
    start = end - size
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.starts] += 1
    inside[w.ends] -= 1
    place = np.ones(len(out), bool)
    place[end] = False
    out[place] = w.data[np.cumsum(inside[:-1]).astype(bool)] if len(end) else 0
    return out.tobytes(), start, end


def _fingerprint(raw: bytes, start: np.ndarray, end: np.ndarray, words: int) -> int:
    """The majority, bit by bit, of the hashes of the shingles of one text's words."""
    n = len(start)
    if not n:
        return 0
    first, last = (start[: n - words + 1], end[words - 1 :]) if n >= words else (start[:1], end[-1:])
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(first), COUNTED):
        h = np.array([xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in zip(first[lo : lo + COUNTED].tolist(), last[lo : lo + COUNTED].tolist())], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and the fingerprint as a signed number, for every row."""

    def run(batches):
        for rows, data, offsets in text_steps(batches):
            w = Words(data, offsets, WHITE, lower=True)
            raw, start, end = _joined(w)
            f = [_fingerprint(raw, start[a:b], end[a:b], words) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.array(f, np.uint64).view(np.int64))], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, f long")


# --- signatures ------------------------------------------------------------------------------


def segments(bits: list[int], distance: int) -> list[list[int]]:
    """bits cut into as many parts as make one differ by at most one bit when all differ by at most `distance`."""
    n = min(distance // 2 + 1, len(bits))
    edge = [len(bits) * k // n for k in range(n + 1)]
    return [bits[a:b] for a, b in zip(edge, edge[1:])]


def _mask(bits: list[int]) -> int:
    """The bits as a signed 64-bit number."""
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def _variants(f: Column, parts: list[tuple[str, list[int]]], salt: Column | None = None) -> Column:
    """An array of struct(signature, part): each part once for each of its bits, that bit deleted."""
    one = lambda name, part, b: F.xxhash64(*([] if salt is None else [salt]), F.lit(f"{name}-{b}"), f.bitwiseAND(F.lit(_mask([x for x in part if x != b])).cast("long")))
    return F.array(*(F.struct(one(name, part, b).alias("signature"), F.lit(name).alias("part")) for name, part in parts for b in part))


def signatures(distinct: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """signature, home, guest, visits, f: what is to be held against each other; written where groups are large.

    Signatures are 64-bit hashes of what they stand for; one that two things share brings together more, and loses nothing.
    """
    parts = [(str(k), part) for k, part in enumerate(segments(list(range(64)), distance))]
    exact = F.explode(F.array(*(F.struct(F.lit(name).alias("part"), F.col("f").bitwiseAND(F.lit(_mask(bits)).cast("long")).alias("value")) for name, bits in parts))).alias("x")
    # a signature gathers two exact segments, so that one of them holds half of a large group
    heavy = written(distinct.select(exact).groupBy("x.part", "x.value").count().where(2 * F.col("count") > cell).select("part", "value"))
    first = distinct.select("f", F.explode(_variants(F.col("f"), parts)).alias("x")).select(F.col("x.signature").alias("signature"), F.col("x.part").alias("part"), "f")
    plain = lambda rows: rows.select("signature", F.lit(0).alias("home"), F.lit(0).alias("guest"), F.lit(False).alias("visits"), "f")
    if not heavy.take(1):
        return plain(first)
    hot = None
    for name, bits in parts:  # the signatures of the heavy segments
        own = heavy.where(F.col("part") == name).select(F.explode(_variants(F.col("value"), [(name, bits)])).alias("x")).select(F.col("x.signature").alias("signature"))
        hot = own if hot is None else hot.union(own)
    hot = written(hot.distinct())
    crowd, light = first.join(hot, "signature", "left_semi"), first.join(hot, "signature", "left_anti")
    second = None
    for name, bits in parts:
        rest = [(f"{name}.{k}", part) for k, part in enumerate(segments([b for b in range(64) if b not in bits], distance))]
        own = crowd.where(F.col("part") == name).select("f", F.explode(_variants(F.col("f"), rest, F.col("signature"))).alias("x")).select(F.col("x.signature").alias("signature"), "f")
        second = own if second is None else second.union(own)
    second = written(second)
    sizes = written(second.groupBy("signature").count().where(F.col("count") > cell).select("signature", F.ceil(F.col("count") / cell).cast("int").alias("blocks")))
    dealt = second.join(sizes, "signature", "left")
    block = F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")
    large = dealt.where("blocks is not null").withColumn("block", block)
    others = lambda lo, hi: F.explode(F.sequence(lo, hi))
    home = large.withColumn("other", others(F.col("block"), F.col("blocks") - 1)).select("signature", F.col("block").alias("home"), F.col("other").alias("guest"), F.lit(False).alias("visits"), "f")
    guest = large.where("block > 0").withColumn("other", others(F.lit(0), F.col("block") - 1)).select("signature", F.col("other").alias("home"), F.col("block").alias("guest"), F.lit(True).alias("visits"), "f")
    return plain(light).union(plain(dealt.where("blocks is null"))).union(home).union(guest)


# --- verification ----------------------------------------------------------------------------


def forest(home: np.ndarray, guest: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links between home and guest (or within home, if there is no guest) that join two of their components.

    Breadth first: what a fingerprint reaches leaves those that are still to be reached, so a dense group is done in few steps.
    """
    within = not len(guest)
    free = [home, home if within else guest]
    left = [np.ones(len(x), bool) for x in free]
    for seed in range(len(home)):
        if not left[0][seed]:
            continue
        left[0][seed] = False
        queue, side = np.array([seed]), 0
        while len(queue):
            other = 0 if within else 1 - side
            reached = []
            for lo in range(0, len(queue), BLOCK):
                at = np.flatnonzero(left[other])
                if not len(at):
                    break
                some = queue[lo : lo + BLOCK]
                near = np.bitwise_count(free[side][some][:, None] ^ free[other][at][None, :]) <= distance
                hit = np.flatnonzero(near.any(axis=0))
                by = some[near[:, hit].argmax(axis=0)]
                left[other][at[hit]] = False
                reached.append(at[hit])
                yield from zip(free[side][by].tolist(), free[other][at[hit]].tolist())
            queue, side = (np.concatenate(reached) if reached else np.zeros(0, int)), other


def links(signed: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Verified links (a, b) of fingerprints, a spanning forest of each group of equal signatures."""
    cell = ["signature", "home", "guest"]

    def verified(f: np.ndarray, visits: np.ndarray, same: np.ndarray) -> list[tuple[int, int]]:
        """Links of groups that lie one after the other: same says that a row has the group of the row before it."""
        begin = np.flatnonzero(~same)
        size = np.diff(np.append(begin, len(f)))
        # most groups are small: rows one, two ... places apart are held against each other in all of them at once
        step, found = 1, []
        small = np.repeat(np.where(size <= SMALL, size, 0), size)
        place = np.arange(len(f)) - np.repeat(begin, size)
        at = np.flatnonzero(place + step < small)
        while len(at):
            near = at[(np.bitwise_count(f[at] ^ f[at + step]) <= distance) & ~(visits[at] & visits[at + step])]
            near = near[(visits[near] != visits[near + step]) | ~crossed[np.searchsorted(begin, near, "right") - 1]] if (crossed := np.bitwise_or.reduceat(visits, begin)).any() else near
            found.append(np.stack([near, near + step]))
            step += 1
            at = at[place[at] + step < small[at]]
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
        group = np.searchsorted(begin, a, "right") - 1
        dense = np.bincount(group, minlength=len(begin)) >= size
        a, b = a[~dense[group]], b[~dense[group]]
        pairs = list(zip(f[a].tolist(), f[b].tolist()))
        for g in np.flatnonzero((size > SMALL) | dense).tolist():
            own = slice(begin[g], begin[g] + size[g])
            pairs += forest(f[own][~visits[own]], f[own][visits[own]], distance)
        return pairs

    def run(batches):
        kept: list[np.ndarray] = []
        for rows in gathered(batches):
            rows = [np.concatenate(x) for x in zip(kept, rows)] if kept else rows
            same = np.append(False, np.logical_and.reduce([k[1:] == k[:-1] for k in rows[:3]]))
            last = int(np.flatnonzero(~same)[-1])  # the last group may go on
            kept = [x[last:] for x in rows]
            if last:
                yield out(verified(rows[4][:last].view(np.uint64), rows[3][:last], same[:last]))
        if kept:
            f = kept[4].view(np.uint64)
            yield out(verified(f, kept[3], np.arange(len(f)) > 0))

    def gathered(batches):
        """Columns of about GATHERED rows at a time."""
        some, n = [], 0
        for batch in batches:
            if batch.num_rows:
                some.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                n += batch.num_rows
            if n >= GATHERED:
                yield [np.concatenate(x) for x in zip(*some)]
                some, n = [], 0
        if some:
            yield [np.concatenate(x) for x in zip(*some)]

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = (np.array(x, np.uint64).view(np.int64) for x in (zip(*pairs) if pairs else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return signed.select(*cell, "visits", "f").repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that links reach."""
    small_batches(docs.sparkSession)
    base = written(fingerprints(docs, words))
    least = written(base.groupBy("f").agg(F.min("doc_id").alias("least")))
    found = written(links(signatures(least.select("f"), distance, cell), distance).distinct())
    label = components(found)
    named = least.join(label, F.col("f") == F.col("node"), "left").select("f", "least", "component")
    # a fingerprint that links with none is a component of its own
    least_of = named.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least_of, "component", "left").select("f", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = written(base.join(named, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"))
    drop(base, least, found)
    return out


def dedup(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The documents less all but one (the smallest doc_id) of each component; rows without a doc_id stay, and so does a doc_id
    with several texts if one of them is the first of its component."""
    said = near_duplicates(docs, words, distance).groupBy("doc_id").agg(F.max("component_id").alias("most"))
    return docs.join(said.where("most < doc_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
