"""What the corpus operators share: shared-folder tables, Arrow text blocks, word hashes, components."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer row is a step of its own.
STEP_BYTES = 1 << 20
#: Bytes of text under one prefix sum of word hashing.
BLOCK = 1 << 18
#: Bytes of a row group that a writer holds back.
ROW_GROUP = 32 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


# --- tables in the shared folder -------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a folder of its own only where none is set and Spark is one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="wxspark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wxspark/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables of `written` that nothing reads any more; others and None are left alone."""
    for df in tables:
        if df is not None and (path := _PATHS.pop(df, None)):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def semi(rows: DataFrame, ids: DataFrame, on: str, most: int = 2_000_000) -> DataFrame:
    """rows whose id is among ids (distinct, written): ids are sent to the tasks if they are at most `most`, else joined."""
    few = ids.limit(most + 1).count() <= most
    return rows.join(F.broadcast(ids) if few else ids, on, "left_semi")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows, and so the bytes, of one Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


# --- text columns as bytes -------------------------------------------------------------------


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its rows' n+1 offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def steps(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most STEP_BYTES each, single rows if they are longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP_BYTES, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes than this are hashed one by one, in C.
LONG = 128
SEEDS = (0, 0x6A09E667F3BCC909)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span: eight bytes at a time are mixed in, so no structure of the bytes cancels out.

    Equal bytes give equal hashes in every process; spans of up to eight bytes and one length never collide.
    """
    out, raw = np.empty(len(starts), np.uint64), np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", raw, strides=(1,))  # the eight bytes from any place on
    for lo in range(0, len(starts), BLOCK):
        at, size = starts[lo : lo + BLOCK], (ends - starts)[lo : lo + BLOCK]
        h = mix(size.astype(np.uint64) + np.uint64(seed ^ 0x9E3779B97F4A7C15))
        h = mix(h ^ (eight[at] & _LOW[np.minimum(size, 8)]))
        rest, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(rest):
            h[rest] = mix(h[rest] ^ (eight[at[rest] + done] & _LOW[np.minimum(size[rest] - done, 8)]))
            done += 8
            rest = rest[size[rest] > done]
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i] + size[i]].data, seed)
        out[lo : lo + BLOCK] = h
    return out


class Words:
    """The words of some rows: byte spans in data, hashes, and first[r]:first[r+1] as the words of row r."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE, lower: bool = False):
        self.data = LOWER[data] if lower else np.ascontiguousarray(data)
        word = ~separator[self.data]
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        start[inner] = word[inner]
        end[inner - 1] = word[inner - 1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._hash: dict[int, np.ndarray] = {}

    def hashed(self, seed: int = 0) -> np.ndarray:
        if seed not in self._hash:
            self._hash[seed] = hash_spans(self.data, self.starts, self.ends, seed)
        return self._hash[seed]

    @property
    def hash(self) -> np.ndarray:
        return self.hashed()


def _after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two runs, one after the other; not linear, so that runs of alternating words don't cancel out."""
    return mix(a ^ mix(b + np.uint64(0x3C6EF372FE94F82B)))


def hash_runs(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` consecutive word hashes, put together from runs of 1, 2, 4 ...; empty if there are fewer."""
    size = int(size)
    if len(words) < size or size < 1:
        return np.zeros(0, np.uint64)
    out = np.empty(len(words) - size + 1, np.uint64)
    for lo in range(0, len(out), BLOCK):
        power, step, at, n, got = words[lo : lo + BLOCK + size - 1], 1, 0, min(BLOCK, len(out) - lo), None
        for bit in range(size.bit_length()):
            if bit:
                power, step = _after(power[:-step], power[step:]), 2 * step
            if size >> bit & 1:
                got = power[at : at + n] if got is None else _after(got, power[at : at + n])
                at += step
        out[lo : lo + n] = mix(got)
    return out


def identity(*parts: np.ndarray) -> tuple[int, int]:
    """128 bits, as two signed numbers, of some hashes in their order."""
    raw = xxhash.xxh3_128_digest(b"".join(p.tobytes() for p in parts))
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def text_steps(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Arrow batches cut into steps of bounded bytes: (rows, bytes, offsets)."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in steps(offsets):
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def list_array(parts: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    """A list column from one numpy array a row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind, copy=False) if values.dtype != np.uint64 else values.view(np.int64)))


# --- connected components --------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node.

    Alternating large-star and small-star rounds; every round is a pre-aggregated groupBy and a join,
    written to the shared folder, so no node's neighbours are gathered in one place.
    """
    pairs = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        spent, pairs = pairs, written(
            small.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")
            .union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
        )
        drop(spent)
        now = pairs.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    own = pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return own.union(pairs.select(F.col("a").alias("node"), F.col("a").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
