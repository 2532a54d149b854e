"""Toxicity: noisy-channel deobfuscation by Viterbi decoding under a character language model, then a scorer.

1. A scan of the whole corpus counts letter trigrams inside words: the character language model.
2. Tokens that look disguised (digits or symbols among letters, spaced single letters, letters three times in a
   row) become lattices of letters: each sign stands for the letters it may replace or for none. The best path
   under the model, found by the Viterbi algorithm, replaces the token.
3. Restored texts are scored by the hashed words and word beginnings whose share of toxic documents is beyond
   chance, weighed by their log odds on a bounded sample of labelled rows (TRAIN_ROWS, a parameter); a logistic curve
   over a text's strongest weight, summed weights and summed weights a word gives the score.

Labels are taken only from rows whose crc32(doc_id) mod 5 is not 0. Scores see texts alone.

Defined cases: a null text is empty and gets the curve's value at no evidence; without a toxic label all scores
are 0; labels that are null are skipped; a doc_id labelled twice counts as toxic if one label says so; repeated
rows get equal scores; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.llm.common import LOWER, Words, column_bytes, hash_spans, small_batches, text_steps
from wxspark.llm.op3_license_scan import SEPARATOR

TRAIN_ROWS, FOLDS, BITS, PREFIXES = 20_000, 5, 20, (4, 5, 6)
#: A feature counts from this many standard deviations above chance on; PRIOR labelled rows pull it to the base rate.
#: SHORT words are added to a text's length where weights are taken a word, so that one word isn't a text's whole share.
BEYOND, PRIOR, SHORT = 8.0, 1.0, 20
#: What a sign may stand for.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
_SIGNS = "".join(re.escape(c) for c in STANDS_FOR)
#: Tokens of any length; a token is looked at from its begin only and never given back, so the scan stays linear.
_LEET = re.compile(rf"(?<![a-z0-9{_SIGNS}])(?=[0-9{_SIGNS}]*+[a-z])(?=[a-z269]*+[{_SIGNS}])[a-z0-9{_SIGNS}]{{3,}}+")
_SPACED = re.compile(rf"(?<!\S)(?:[a-z{_SIGNS}][ .*_-]){{2,}}[a-z{_SIGNS}](?![^\s.,;:!?])")
_LONG = re.compile(r"(?<![a-z])(?=[a-z]*?([a-z])\1\1)[a-z]++")
_RUN, _ENDS = re.compile(r"(.)\1\1++"), re.compile(r"^[!|@$+]{2,}+|(?<![!|@$+])[!|@$+]{2,}+$")
#: Tokens up to this length are remembered; after so many letters the part that all paths share is put aside.
REMEMBER, SHARED = 64, 256
_LETTER, _SIGN, _GAP, _OTHER = (np.zeros(256, bool) for _ in range(4))
_LETTER[97:123] = True
_SIGN[[ord(c) for c in STANDS_FOR]] = True
_GAP[[ord(c) for c in " .*_-"]] = True
_OTHER[[ord(c) for c in "269"]] = True


# --- the character language model ------------------------------------------------------------


def trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams (27 x 27 x 27; 0 is no letter) over all texts; at most 19,683 rows reach the driver."""

    def run(batches):
        total = np.zeros(27**3, np.int64)
        for _, data, offsets in text_steps(batches):
            c = LOWER[data]
            c = np.where(_LETTER[c], c - 96, 0).astype(np.int32)
            total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3) if len(c) > 2 else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(27**3)
    for r in rows:
        out[r["code"]] = r["n"]
    return out.reshape(27, 27, 27)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), smoothed."""
    smooth = counts + 0.05
    return np.log(smooth / smooth.sum(axis=2, keepdims=True)).astype(np.float32)


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest plain word behind a disguised token: Viterbi over its letter lattice."""
    paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    last, done = "", []
    for k, c in enumerate(token):
        if "a" <= c <= "z":
            options = [(c, 0.0)] if c != last else [(c, -0.7), ("", 0.0)]
        elif c in STANDS_FOR:
            options = [(x, -0.3) for x in STANDS_FOR[c]] + ([("", -1.0)] if k in (0, len(token) - 1) else [("", -4.0)])
        else:
            options = [("", 0.0)]
        nxt: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, said) in paths.items():
            for x, cost in options:
                if x:
                    i = ord(x) - 96
                    state, value = (b, i), score + cost + float(model[a, b, i])
                    if state not in nxt or value > nxt[state][0]:
                        nxt[state] = (value, said + x)
                elif (a, b) not in nxt or score + cost > nxt[a, b][0]:
                    nxt[a, b] = (score + cost, said)
        paths, last = nxt, c
        if k % SHARED == SHARED - 1:
            same = commonprefix([said for _, said in paths.values()])
            done.append(same)
            paths = {state: (score, said[len(same) :]) for state, (score, said) in paths.items()}
    return "".join(done) + max((score + float(model[a, b, 0]), said) for (a, b), (score, said) in paths.items())[1]


def suspicious(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold something disguised: a cheap test that misses none of the three patterns."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    c = LOWER[data]
    letter, sign, gap = _LETTER[c], _SIGN[c], _GAP[c]
    other = letter | _OTHER[c]
    hit = (other[:-1] & sign[1:]) | (sign[:-1] & other[1:])
    hit[:-1] |= letter[:-2] & (c[:-2] == c[1:-1]) & (c[1:-1] == c[2:])
    if len(c) > 4:
        one = letter | sign
        hit[: len(c) - 4] |= one[:-4] & gap[1:-3] & one[2:-2] & gap[3:-1] & one[4:]
    return np.unique(np.searchsorted(offsets, np.flatnonzero(hit), "right") - 1)


def restore(text: str, model: np.ndarray, memo) -> str:
    """A text, its ASCII letters in lower case, with disguised tokens decoded; runs count as two of a kind, runs of signs at an end not at all."""

    def plain(token: str) -> str:
        return memo(token) if len(token) <= REMEMBER else decode(token, model)

    text = _SPACED.sub(lambda m: plain(m[0]), text)
    text = _LEET.sub(lambda m: plain(_RUN.sub(r"\1\1", _ENDS.sub("", m[0]))), text)
    return _LONG.sub(lambda m: plain(_RUN.sub(r"\1\1", m[0])), text)


# --- features and the scorer -----------------------------------------------------------------


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every word and word beginning, and the words of each row."""
    w = Words(data, offsets, SEPARATOR, lower=True)
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    rows, hashes, size = [row], [w.hash], w.ends - w.starts
    for n in PREFIXES:
        own = np.flatnonzero(size > n)
        rows.append(row[own])
        hashes.append(hash_spans(w.data, w.starts[own], w.starts[own] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
    return np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64), np.diff(w.first)


def _restored_steps(batches, model: np.ndarray):
    """(rows, bytes, offsets) of texts whose disguised tokens are decoded."""
    memo = lru_cache(maxsize=100_000)(lambda token: decode(token, model))
    for rows, data, offsets in text_steps(batches):
        odd = suspicious(data, offsets)
        if len(odd):
            raw, parts, done = data.tobytes(), [], 0
            size = np.diff(offsets)
            for r in odd.tolist():
                parts.append(raw[offsets[done] : offsets[r]])
                text = restore(raw[offsets[r] : offsets[r + 1]].lower().decode(), model, memo).encode()  # bytes: ASCII alone is lowered
                parts.append(text)
                size[r] = len(text)
                done = r + 1
            parts.append(raw[offsets[done] :])
            data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum(size))
        yield rows, data, offsets


class Scorer:
    """Weights by bucket and the logistic curve over the evidence."""

    def __init__(self, weights: np.ndarray, curve: np.ndarray | None):
        self.weights, self.curve = weights, curve

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row each: its largest weight, the log of its weights' sum and of their share in its words."""
        n = len(offsets) - 1
        row, bucket, words = features(data, offsets)
        value = self.weights[bucket]
        strong = value > 0
        row, value = row[strong], value[strong]
        most = np.zeros(n, np.float32)
        np.maximum.at(most, row, value)
        total = np.bincount(row, value, minlength=n)
        return np.stack([most, np.log1p(total), np.log1p(100 * total / (words + SHORT))], axis=1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + evidence @ self.curve[1:], -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * len(a) ** 0 * np.eye(len(w))
        w = w + np.linalg.solve(h, a.T @ (y - p) - ridge * w)
    return w


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[Scorer, np.ndarray]:
    """The scorer and the language model."""
    small_batches(docs.sparkSession)
    model = log_model(trigrams(docs))
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")  # at most train_rows rows

    def count(batches):
        for part, data, offsets in _restored_steps(batches, model):
            toxic = np.asarray(part.column(2)) == 1
            row, bucket, _ = features(data, offsets)
            pair = np.unique(row * (1 << BITS) + bucket)
            row, bucket = pair >> BITS, pair & ((1 << BITS) - 1)
            at, of = np.unique(bucket, return_inverse=True)
            bad = np.bincount(of, toxic[row]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bad), pa.array(np.bincount(of).astype(np.int64))], names=["bucket", "bad", "n"])

    p, n = sample.agg(F.sum("toxic"), F.count("*")).first()
    weights = np.zeros(1 << BITS, np.float32)
    if not p:
        return Scorer(weights, None), model
    base = min(p / n, 1 - 1 / (n + 1))
    told = rows.mapInArrow(count, "bucket int, bad long, n long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    beyond = (F.col("bad") - base * F.col("n")) / F.sqrt(F.col("n") * (base * (1 - base) + 1e-9))
    for r in told.where(beyond >= BEYOND).collect():  # at most 2 ** BITS rows
        weights[r["bucket"]] = np.log((r["bad"] + PRIOR * base) / (r["n"] - r["bad"] + PRIOR * (1 - base)) / (base / (1 - base)))
    scorer = Scorer(weights, None)

    def see(batches):
        for part, data, offsets in _restored_steps(batches, model):
            e = scorer.evidence(data, offsets)
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(float)) for x in e.T), part.column(2).cast(pa.int32())], names=["most", "total", "share", "toxic"])

    seen = np.array([tuple(r) for r in rows.mapInArrow(see, "most double, total double, share double, toxic int").collect()])  # the sample's rows
    if len(seen):
        seen = seen[np.lexsort(seen.T)]
        scorer = Scorer(weights, fit_curve(seen[:, :-1], seen[:, -1]))
    return scorer, model


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scorer, model = train(docs, labels, train_rows)

    def run(batches):
        for rows, data, offsets in _restored_steps(batches, model):
            s = scorer.score(scorer.evidence(data, offsets))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that are not predicted toxic; the text is scored in place, so nothing is joined."""
    scorer, model = train(docs, labels, train_rows)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            part = pa.RecordBatch.from_arrays([column], names=["text"])
            keep = [scorer.score(scorer.evidence(data, offsets)) < 0.5 for _, data, offsets in _restored_steps([part], model)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
