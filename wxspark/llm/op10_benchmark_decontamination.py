"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, verified by banded alignment.

Texts are compared by their letters and digits: ASCII letters in lower case, all other ASCII characters left out. A
benchmark item is cut into overlapping regions of REGION bytes (the whole item if it is shorter). A region of m
bytes with at most e = floor(EDIT_SHARE * m) edits shares at least m - Q + 1 - Q * e q-grams with the text, all
of them within e diagonals. So for each (document, item) the shared q-grams are counted in bands of diagonals
that overlap by half; a region whose count reaches the bound is aligned within its band, and the document is
hit if the alignment needs no more than e edits.

The benchmark is taken in blocks of at most BLOCK_BYTES, each handed to the tasks as a table of its q-grams; documents
are never joined or shuffled.

Q is short enough for the bound to be positive at every length of a region. The document is hit by the first band and
region that the alignment confirms: bands in order of their diagonals, regions from the item's begin.

Defined cases: null texts and items are empty; items with fewer than Q letters and digits are no passages and match
nothing; repeated rows are each judged, and a repeated item_id gives a row for each of its texts that is held; a row without a doc_id
is judged like others (a hit's doc_id is null then) and leaves `decontaminate` if it is hit; very long texts are searched
whole; empty tables give no hits; other columns are ignored by `hits` and kept by `decontaminate`, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.llm.common import LOWER, column_bytes, mix, small_batches, text_steps

Q, REGION, STRIDE, EDIT_SHARE, BLOCK_BYTES = 10, 64, 16, 0.05, 4 << 20
HITS = "doc_id long, item_id long, begin long, end long, n_shared long, edits long"
_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BITS = 22


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that count, where each stood, and the rows' offsets among them."""
    at = np.flatnonzero(_KEEP[data])
    return LOWER[data[at]], at, np.searchsorted(at, offsets)


def qgrams(data: np.ndarray) -> np.ndarray:
    """A 64-bit value of every run of Q = 10 bytes: distinct but for chance."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint64) | data[1:].astype(np.uint64) << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    return eight[:-2] * np.uint64(0x9E3779B97F4A7C15) + two[8:] * np.uint64(0xC2B2AE3D27D4EB4F)


def edits_within(pattern: bytes, text: bytes, most: int) -> int | None:
    """Fewest edits that turn the pattern into some substring of text; None if more than `most`."""
    if pattern in text:
        return 0
    p, row = np.frombuffer(pattern, np.uint8), np.zeros(len(text) + 1, np.int32)
    t, steps = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    for i, c in enumerate(p):
        nxt = np.empty_like(row)
        nxt[0] = i + 1
        nxt[1:] = np.minimum(row[:-1] + (t != c), row[1:] + 1)
        row = np.minimum.accumulate(nxt - steps) + steps
        if row.min() > most:
            return None
    return int(row.min()) if row.min() <= most else None


class Index:
    """A block of benchmark items by their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.texts, grams, owner, place = [], [], [], [], []
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            data, _, _ = letters(raw, np.array([0, len(raw)]))
            g = qgrams(data)
            if len(g):
                grams.append(g)
                owner.append(np.full(len(g), len(self.ids)))
                place.append(np.arange(len(g)))
                self.ids.append(item)
                self.texts.append(data.tobytes())
        grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams = grams[order]
        self.owner = (np.concatenate(owner) if owner else grams)[order].astype(np.int32)
        self.place = (np.concatenate(place) if place else grams)[order].astype(np.int32)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.slot(self.grams)] = True

    @staticmethod
    def slot(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)

    def shared(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every shared q-gram as (place in the text, item, place in the item)."""
        at = np.flatnonzero(self.maybe[self.slot(grams)])
        lo, hi = np.searchsorted(self.grams, grams[at], "left"), np.searchsorted(self.grams, grams[at], "right")
        n = hi - lo
        rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.owner[rows], self.place[rows].astype(np.int64)


def bound(m: int) -> int:
    """Q-grams that a region of m bytes shares with a text at least, if its edits are within EDIT_SHARE; 1 or more for m >= Q."""
    return m - Q + 1 - Q * int(EDIT_SHARE * m)


def _regions(n: int) -> list[tuple[int, int]]:
    if n <= REGION:
        return [(0, n)]
    return [(s, s + REGION) for s in [*range(0, n - REGION, STRIDE), n - REGION]]


def _hit(text: np.ndarray, item: bytes, t: np.ndarray, p: np.ndarray) -> tuple[int, int, int, int] | None:
    """The first region of an item that some band of one document confirms: (begin, end) in the text, count, edits."""
    best = None
    widest = int(EDIT_SHARE * min(REGION, len(item)))
    width = 2 * max(1, widest) + 2
    diagonal = t - p
    bands = defaultdict(list)
    for shift in (0, width // 2):
        band = (diagonal + shift) // width
        for b in np.unique(band).tolist():
            bands[b, shift] = np.flatnonzero(band == b)
    for own in bands.values():
        if best:
            break
        places = np.sort(p[own])
        for s, e in _regions(len(item)):
            m, most = e - s, int(EDIT_SHARE * (e - s))
            count = int(np.searchsorted(places, e - Q, "right") - np.searchsorted(places, s, "left"))
            if count < bound(m):
                continue
            d = diagonal[own]
            lo, hi = max(0, s + int(d.min()) - most), min(len(text), e + int(d.max()) + most)
            cost = edits_within(item[s:e], text[lo:hi].tobytes(), most)
            if cost is not None:
                best = (int(t[own].min()), int(t[own].max()) + Q, len(own), cost)
                break
    return best


def _blocks(docs: DataFrame, benchmark: DataFrame):
    """The benchmark in blocks of bounded size, each as an index."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(-(-size // BLOCK_BYTES)) or 1
    for block in range(blocks):
        taken = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield Index([(r[0], r[1]) for r in taken.collect()])


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it holds: place in the text (code points), shared q-grams, edits."""
    rows, found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), None

    def search(index):
        def run(batches):
            for part, data, offsets in text_steps(batches):
                ids = part.column(0).to_pylist()
                cols = list(zip(*((ids[row], *rest) for row, *rest in _found(index, data, offsets)))) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in HITS.split(", ")])

        return run

    for index in _blocks(docs, benchmark):
        part = rows.mapInArrow(search(index), HITS)
        found = part if found is None else found.union(part)
    return found


def _found(index: Index, data: np.ndarray, offsets: np.ndarray):
    """(row, item_id, begin, end, shared, edits) of the hits in some texts."""
    text, at, edges = letters(data, offsets)
    t, owner, p = index.shared(qgrams(text))
    row_of = np.searchsorted(edges, t, "right") - 1
    inside = t + Q <= edges[row_of + 1]
    t, owner, p, row_of = t[inside], owner[inside], p[inside], row_of[inside]
    order = np.lexsort((t, owner, row_of))
    t, owner, p, row_of = t[order], owner[order], p[order], row_of[order]
    cuts = np.flatnonzero((np.diff(row_of) != 0) | (np.diff(owner) != 0)) + 1
    starts = np.append(0, cuts) if len(t) else cuts
    for a, b in zip(starts.tolist(), [*cuts.tolist(), len(t)]):
        row, item = int(row_of[a]), index.texts[owner[a]]
        if b - a < bound(min(REGION, len(item))):
            continue
        lo, hi = int(edges[row]), int(edges[row + 1])
        if hit := _hit(text[lo:hi], item, t[a:b] - lo, p[a:b]):
            begin, end = at[lo + hit[0]], at[lo + hit[1] - 1] + 1
            raw = data[offsets[row] : offsets[row + 1]]
            points = np.cumsum((raw & 0xC0) != 0x80)
            yield row, index.ids[owner[a]], int(points[begin - offsets[row]]) - 1, int(points[end - 1 - offsets[row]]), hit[2], hit[3]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; texts are searched in place, so nothing is joined."""

    def clean(index):
        def run(batches):
            for batch in batches:
                keep, done = np.ones(len(batch), bool), 0
                column = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("text"))], names=["text"])
                for part, data, offsets in text_steps([column]):
                    keep[[done + row for row, *_ in _found(index, data, offsets)]] = False
                    done += len(part)
                yield batch.filter(pa.array(keep))

        return run

    for index in _blocks(docs, benchmark):
        docs = docs.mapInArrow(clean(index), docs.schema)
    return docs
