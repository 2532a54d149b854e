"""Substring dedup: suffix trees of words, partitioned by prefixes of variable length into groups sized for memory.

A suffix is a place in a text with at least `window` words behind it, read to that depth. Suffixes of one text that
lie side by side share their words, so they travel together as a stretch:

1. Every suffix has an anchor: the run of ANCHOR words with the smallest hash among the runs that begin in its first part
   (the leftmost on ties). Equal suffixes have equal anchors at equal places. The words from the anchor on are the
   prefix that suffixes are dealt by; the suffixes of one anchor are a stretch of at most 2 * window words.
2. Prefixes of ANCHOR words are counted. One that a single document has holds no node of two documents and is pruned.
   One with over HOT stretches is lengthened, in LEVELS steps, as far as every suffix still holds it whole.
3. Prefixes are dealt by hash to groups of about GROUP stretches. In each group the suffixes are sorted (ranks of
   1, 2, 4 ... words) on words compared as words, and the longest common prefixes of neighbours give the tree's deep
   internal nodes: runs of neighbours that share `window` words or more. A node keeps its smallest doc_id.
4. A prefix that is over HOT at its greatest length is lengthened to the whole window: then each group is one node, told by
   128 bits, and Spark's partial aggregation finds its smallest doc_id without gathering it.
5. Suffixes below a node, other than those of its smallest document, mark the words they cover. Runs of marks side by
   side are the maximal repeats.

Documents with the same word sequence are classes first (128 bits); only a class's smallest doc_id enters the trees, the
others are wholly covered when they hold a window at all.

Defined cases: null texts have no words; texts shorter than the window lose nothing; each row is answered once, rows that
repeat a doc_id, with one text or several, have no smaller doc_id among themselves; a row without a doc_id neither loses
words nor takes them from others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.llm.common import SEEDS, WHITE, Words, column_bytes, drop, hash_runs, identity, list_array, small_batches, text_steps, written

#: Words of a window and of an anchor; stretches (about 70 words each) of a group; stretches of a prefix from which it is lengthened.
WINDOW, ANCHOR, GROUP, HOT, LEVELS = 50, 9, 2048, 512, 2


def span_of(window: int, anchor: int) -> int:
    """Among how many first runs a suffix's anchor is chosen: what lies behind is at least two fifths of the window."""
    return max(1, min(window - anchor + 1, 3 * window // 5))


def anchor_of_suffixes(grams: np.ndarray, n: int, span: int) -> np.ndarray:
    """For each of the first n places the place of the smallest of the next `span` runs, by doubling; ties go to the leftmost."""
    best, size = np.arange(len(grams)), 1
    while size < span:
        step = min(size, span - size)
        left, right = best[: len(best) - step], best[step:]
        best, size = np.where(grams[right] < grams[left], right, left), size + step
    return best[:n]


def _anchored(w: Words, window: int, anchor: int):
    """Of each row: first word, its runs of `anchor` words, and its suffixes' anchors."""
    grams = hash_runs(w.hash, anchor)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        own = grams[a : b - anchor + 1] if b - a >= window else grams[:0]
        yield a, own, anchor_of_suffixes(own, max(0, b - a - window + 1), span_of(window, anchor)) if len(own) else np.zeros(0, np.int64)


def anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, row, n_words, 128 bits of the word sequence, the distinct anchors."""

    def run(batches):
        for rows, data, offsets in text_steps(batches):
            w = Words(data, offsets)
            found = [np.unique(own[np.unique(at)]) for _, own, at in _anchored(w, window, anchor)]
            c1, c2 = zip(*(identity(w.hash[a:b], w.hashed(SEEDS[1])[a:b]) for a, b in zip(w.first[:-1], w.first[1:])))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(w.first)), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), list_array(found, np.uint64)], names=["doc_id", "row", "n_words", "c1", "c2", "anchors"])

    return docs.mapInArrow(run, "doc_id long, row long, n_words long, c1 long, c2 long, anchors array<long>")


def _lengths(window: int, anchor: int) -> list[int]:
    """Lengths of the prefixes: ANCHOR words first, at most what every suffix holds from its anchor on."""
    most = window - span_of(window, anchor) + 1
    return [anchor + (most - anchor) * i // LEVELS for i in range(LEVELS + 1)]


def _squeezed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """White space in a row counts once, so that a stretch is no longer than its words."""
    keep = np.ones(len(data), bool)
    keep[1:] = ~(WHITE[data[1:]] & WHITE[data[:-1]])
    return (data, offsets) if keep.all() else (data[keep], np.append(0, np.cumsum(keep))[offsets])


def _stretches(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """The stretches of shared anchors: prefix hashes (longer ones where the prefix is hot), document, first suffix, suffixes, words."""
    lengths = _lengths(window, anchor)

    def run(batches):
        for rows, data, offsets in text_steps(batches):
            data, offsets = _squeezed(data, offsets)
            w, raw = Words(data, offsets), data.tobytes()
            longer = [hash_runs(w.hash, n) for n in lengths[1:]]
            live, hot = rows.column(3), rows.column(4)
            doc, row, prefix, more, first, size, text = [], [], [], [[] for _ in longer], [], [], []
            for r, (a, own, at) in enumerate(_anchored(w, window, anchor)):
                if not len(at):
                    continue
                begin = np.flatnonzero(np.append(True, np.diff(at) != 0))
                n, key = np.diff(np.append(begin, len(at))), own[at[begin]]
                some = np.flatnonzero(np.isin(key, np.asarray(live[r].values).view(np.uint64)))
                begin, n, key, at = begin[some], n[some], key[some], at[begin[some]]
                warm = np.isin(key, np.asarray(hot[r].values).view(np.uint64)) if len(hot[r].values) else np.zeros(len(key), bool)
                doc.append(np.full(len(key), rows.column(0)[r].as_py()))
                row.append(np.full(len(key), rows.column(1)[r].as_py()))
                prefix.append(key)
                for out, runs in zip(more, longer):
                    out.append(pa.array(runs[a + at].view(np.int64), mask=~warm))
                first.append(begin)
                size.append(n)
                text += [raw[s:e] for s, e in zip(w.starts[a + begin].tolist(), w.ends[a + begin + n + window - 2].tolist())]
            if text:
                longs = [pa.array(np.concatenate(x).astype(np.int64)) for x in (doc, row)]
                columns = [*longs, pa.array(np.concatenate(prefix).view(np.int64)), *(pa.concat_arrays(x) for x in more), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (first, size)), pa.array(text, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "p0", *(f"p{i + 1}" for i in range(LEVELS)), "first", "size", "words"])

    return texts.mapInArrow(run, "doc_id long, row long, p0 long, " + "".join(f"p{i + 1} long, " for i in range(LEVELS)) + "first int, size int, words binary")


def suffix_array(codes: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at some places, read to a depth, and each one's longest common prefix with the one before.

    Every suffix has `depth` words behind its place. Ranks of 2, 4, 8 ... words are made of those of half the length.
    """
    ranks = [codes.astype(np.int64)]
    while 2 << len(ranks) - 1 <= depth:
        step, low = 1 << len(ranks) - 1, ranks[-1]
        ranks.append(np.unique(low[:-step] * (int(low.max()) + 1) + low[step:], return_inverse=True)[1])
    widest = 1 << len(ranks) - 1
    order = np.lexsort((ranks[-1][place + depth - widest], ranks[-1][place]))
    x, y = place[order[:-1]], place[order[1:]]
    common = np.zeros(len(x), np.int64)
    for k in reversed(range(len(ranks))):
        fits = common + (1 << k) <= depth
        near = np.where(fits, common, 0)
        common += (fits & (ranks[k][x + near] == ranks[k][y + near])).astype(np.int64) << k
    return order, np.append(0, common)[: len(place)]


def _tree(window: int):
    """The marks of a group: doc_id, row, first of some neighbouring suffixes, how many."""

    def run(table: pa.Table) -> pa.Table:
        doc, row, first, size = (table.column(c).to_numpy() for c in ("doc_id", "row", "first", "size"))
        data, offsets = column_bytes(table.column("words").cast(pa.string()))
        w = Words(data, offsets)
        ends = np.append(0, np.cumsum(w.ends - w.starts))
        packed = np.ascontiguousarray(data[~WHITE[data]])
        words = pa.Array.from_buffers(pa.large_binary(), len(w.starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)])
        codes = words.dictionary_encode().indices.to_numpy()
        of = np.repeat(np.arange(len(size)), size)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        order, common = suffix_array(codes, w.first[of] + nth, window)
        node = np.cumsum(common < window) - 1  # neighbours with `window` words in common hang below one deep node
        docs = doc[of][order]
        least = np.minimum.reduceat(docs, np.flatnonzero(common < window))
        gone = np.zeros(len(of), bool)
        gone[order] = docs > least[node]
        begin = gone & (np.append(True, ~gone[:-1]) | (nth == 0))
        end = gone & (np.append(~gone[1:], True) | (np.append(nth[1:], 0) == 0))
        at, to = np.flatnonzero(begin), np.flatnonzero(end)
        return pa.table({"doc_id": doc[of[at]], "row": row[of[at]], "first": (first[of[at]] + nth[at]).astype(np.int32), "n": (to - at + 1).astype(np.int32)})

    return run


def _windows(stretches: DataFrame, window: int) -> DataFrame:
    """Suffixes, one by one, by 128 bits of their whole window."""

    def run(batches):
        for rows, data, offsets in text_steps(batches, "words"):
            w = Words(data, offsets)
            size = np.asarray(rows.column(3))
            of = np.repeat(np.arange(len(size)), size)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            h = [hash_runs(w.hashed(seed), window)[w.first[of] + nth] for seed in SEEDS]
            doc, row, first = (np.asarray(rows.column(i)) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array(doc[of]), pa.array(row[of]), pa.array((first[of] + nth).astype(np.int32))], names=["h1", "h2", "doc_id", "row", "first"])

    texts = stretches.select("doc_id", "row", "first", "size", F.col("words").cast("string").alias("words"))
    return texts.mapInArrow(run, "h1 long, h2 long, doc_id long, row long, first int")


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, row, whole (all words go), marks (first suffix and number of neighbouring ones that an earlier document holds); only rows that lose words."""
    base = written(anchors(docs.where("doc_id is not null"), window, anchor))
    classes = base.groupBy("c1", "c2", "n_words").agg(F.min("doc_id").alias("rep"))
    reps = base.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "row"])
    level = reps.select("doc_id", "row", F.explode("anchors").alias("anchor"))
    shared = level.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    live = level.join(shared, "anchor").groupBy("doc_id", "row").agg(F.collect_list("anchor").alias("live"), F.collect_list(F.when(F.col("n") > HOT, F.col("anchor"))).alias("hot"))
    stretches = written(_stretches(docs.dropDuplicates(["doc_id", "row"]).join(live, ["doc_id", "row"]).select("doc_id", "row", "text", "live", "hot"), window, anchor))
    over = [written(stretches.where(f"p{i} is not null").groupBy(f"p{i}").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(f"p{i}", F.lit(True).alias(f"over{i}"))) for i in range(1, LEVELS + 1)]
    warm = stretches.where("p1 is not null")
    for i in range(1, LEVELS + 1):
        warm = warm.join(over[i - 1], f"p{i}", "left")
    longest = F.coalesce(*(F.when(F.col(f"over{i}").isNull(), F.xxhash64(F.lit(i), f"p{i}")) for i in range(1, LEVELS + 1)))
    warm = written(warm.select("doc_id", "row", "first", "size", "words", longest.alias("prefix")))
    told = stretches.where("p1 is null").select("doc_id", "row", "first", "size", "words", F.xxhash64(F.lit(0), "p0").alias("prefix")).union(warm.where("prefix is not null"))
    groups = max(1, -(-told.count() // GROUP))
    marks = told.withColumn("group", F.pmod(F.xxhash64("prefix"), F.lit(groups))).groupBy("group").applyInArrow(_tree(window), "doc_id long, row long, first int, n int")
    # of prefixes that no length makes small: each window is a node. Written, so that Spark may split a hot one in the join
    single = written(_windows(warm.where("prefix is null"), window))
    nodes = written(single.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h1", "h2", "least"))
    marks = marks.union(single.join(nodes, ["h1", "h2"]).where("doc_id > least").select("doc_id", "row", "first", F.lit(1).alias("n")))
    marks = marks.groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "n")).alias("marks"))
    whole = base.where(F.col("n_words") >= window).select("doc_id", "row", "n_words", "c1", "c2").join(classes, ["c1", "c2", "n_words"]).where("doc_id > rep").select("doc_id", "row", F.lit(True).alias("whole")).distinct()
    out = written(whole.join(marks, ["doc_id", "row"], "full_outer"))
    drop(base, stretches, *over, warm, single, nodes)
    return out


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, on demand, the kept words joined by spaces as text."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = docs.join(repeats(docs, window, anchor), ["doc_id", "row"], "left").select("doc_id", "text", "whole", "marks")

    def run(batches):
        for rows, data, offsets in text_steps(batches):
            w = Words(data, offsets)
            raw, removed, digests, texts = data.tobytes(), [], [], []
            for a, b, whole, marks in zip(w.first[:-1], w.first[1:], rows.column(2).to_pylist(), rows.column(3)):
                gone = np.zeros(b - a, bool)
                if whole:
                    gone[:] = True
                elif marks.is_valid and len(marks.values):
                    first, n = (np.asarray(marks.values.field(c)) for c in ("first", "n"))
                    edge = np.zeros(b - a + 1, np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + n + window - 1, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                left = np.flatnonzero(~gone) + a
                text = b" ".join(raw[s:e] for s, e in zip(w.starts[left].tolist(), w.ends[left].tolist()))
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(text).hexdigest())
                texts.append(text.decode() if with_text else None)
            out = [rows.column(0), pa.array(np.diff(w.first)), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
