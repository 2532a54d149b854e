"""PII: plain patterns as seeds, then bootstrapped contextual extraction on a pattern-instance graph.

1. A scan finds e-mail, IP, card and phone spans (base) and keys: runs of KEY characters or more with letters and digits. These
   are the seed entities. It also lists candidates: other tokens with a digit, mixed case or an underscore inside. What stands
   before a seed or candidate is its lexical pattern: the word before it, or its label, the beginning of its own token up to
   the first = or : (secret=...). Brackets and quotes before it are skipped.
2. A second scan counts how often each word and each label stands anywhere; tasks add up their own counts first. After
   that texts aren't read again: all rounds are joins on the graph of patterns and instances.
3. Known instances, at first the seeds, induce patterns: those that stand before MIN_SEEDS different ones. Spark scores the
   graph: a pattern's confidence is the score of its instances, each as often as it stands there, over all its occurrences, so that copies
   weigh alike on both sides; an instance's score is 1 for a seed, else its best trusted (CONFIDENCE) pattern's confidence.
4. Instances that a trusted pattern has discovered induce new patterns like seeds, until nothing changes. Scores are whole
   STEPS-ths, rounded down, and never fall, so that this end is always reached, however long the chain of discoveries.
5. Keys, and candidates after a trusted pattern, become spans of kind id.

Defined cases: a null text is empty; rows are told apart by doc_id and text, so rows without a doc_id and rows that repeat one
have their own spans; equal rows are judged alike; tokens and words of any length take part whole; overlapping base
spans of different kinds all stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.llm.common import Words, drop, hash_spans, small_batches, text_steps, written

KINDS = ("email", "ip", "card", "phone", "id")
MIN_SEEDS, CONFIDENCE, STEPS, KEY, ID = 3, 0.3, 64, 24, 4
#: Different words whose counts a task holds at once.
HELD_WORDS = 1_000_000
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS, _PHONE = re.compile(r"[0-9]+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPACES = " \t\n\x0b\x0c\r"
_EDGE, _SPACE = re.compile(r"^[^\w]+|[^\w]+$"), re.compile(f"[{_SPACES}]")
_MARK = re.compile(r"[=:]")
_ODD, _KEY = re.compile(r"[0-9]|[a-z][A-Z]|[A-Za-z]_[A-Za-z]"), re.compile(r"[A-Za-z0-9+/_-]{%d,}+" % KEY)
FOUND = "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base array<struct<start:int,kind:int,end:int>>, seen array<struct<pattern:long,instance:long,seed:boolean,start:int,kind:int,end:int,whole:boolean>>"
_SEEN = ("pattern", "instance", "seed", "start", "kind", "end", "whole")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; every step is linear in the text."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    runs = [m.span() for m in _DIGITS.finditer(text)]
    k = 0
    while k + 3 < len(runs):
        four = runs[k : k + 4]
        if all(b[0] - a[1] == 1 and text[a[1]] == "." for a, b in zip(four, four[1:])):
            if all(e - s <= 3 or not text[s:e].lstrip("0")[3:] for s, e in four) and all(int(text[s:e].lstrip("0")[:4] or 0) <= 255 for s, e in four):
                out.append((four[0][0], 1, four[3][1]))
            k += 4
        else:
            k += 1
    k = 0
    while k < len(runs):
        j, n = k, runs[k][1] - runs[k][0]
        while j + 1 < len(runs) and runs[j + 1][0] - runs[j][1] == 1 and text[runs[j][1]] in " -":
            j += 1
            n += runs[j][1] - runs[j][0]
        if 14 <= n <= 19 and luhn("".join(text[s:e] for s, e in runs[k : j + 1])):
            out.append((runs[k][0], 2, runs[j][1]))
        k = j + 1
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(e - s for s, e in ((x.start(), x.end()) for x in _DIGITS.finditer(m[0]))) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)])).view(np.int64)[0]) if len(raw) else 0


def _before(text: str, start: int, least: int) -> tuple[int, int]:
    """The word before a place, or what of it lies behind `least`; empty at the text's begin."""
    end = start
    while end > least and text[end - 1] in _SPACES:
        end -= 1
    begin = end
    while begin > least and text[begin - 1] not in _SPACES:
        begin -= 1
    return begin, end


def _label(token: str) -> int:
    """Where a token's label ends, 0 if it has none: up to the first = or :, from a letter on, with something behind it."""
    m = _MARK.search(token, 1)
    return m.end() if m and m.end() < len(token) and (token[0].isalpha() and token[0].isascii() or token[0] >= "\x80") else 0


def _ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def keys(text: str) -> list[tuple[int, int, int]]:
    """Runs of KEY characters or more that hold four letters and four digits at least: secrets by their shape."""
    out = []
    for m in _KEY.finditer(text):
        digits, letters = sum("0" <= c <= "9" for c in m[0]), sum(c.isalpha() for c in m[0])
        if digits >= 4 and letters >= 4:
            out.append((m.start(), ID, m.end()))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(pattern, instance, seed, start, kind, end, whole) of seeds and of other tokens with something odd in them.

    whole: the pattern is a word of its own there, or its token's label, and this is the first span behind it, so it is one of its
    occurrences. A pattern is looked for behind the span before only, so that the work is linear in the text.
    """
    free, covered = [], 0
    ends = sorted(base)
    for k in keys(text):
        while covered < len(ends) and ends[covered][2] <= k[0]:
            covered += 1
        if covered == len(ends) or ends[covered][0] >= k[2]:
            free.append(k)
    spans = [(s, kind, e, True) for s, kind, e in sorted(base + free)]
    last, k, reach = 0, 0, 0
    tokens = []
    for m in _ODD.finditer(text):
        if m.start() < last:
            continue
        begin = m.start()
        while begin > last and text[begin - 1] not in _SPACES:
            begin -= 1
        end = _SPACE.search(text, m.end())
        last = end.start() if end else len(text)
        while k < len(spans) and spans[k][2] <= begin:
            k += 1
        if k < len(spans) and spans[k][0] < last:
            continue
        cut = _label(text[begin:last])
        if cut and _ODD.search(text, begin + cut, last):
            begin += cut
        inner = _EDGE.sub("", text[begin:last])
        if inner:
            begin += text[begin:last].find(inner)
            tokens.append((begin, ID, begin + len(inner), False))
    out = []
    for start, kind, end, seed in sorted(spans + tokens):
        least = min(reach, start)
        begin, place = _before(text, start, least)
        if begin < place == start and not re.search(r"\w", text[begin:place]):
            begin, place = _before(text, begin, least)  # brackets and quotes
        word = text[begin:place]
        first = bool(word) and begin >= reach and (not begin or text[begin - 1] in _SPACES)
        if place < start and text[place] in _SPACES:
            whole = first
        else:
            whole = first and begin + _label(text[begin : start + 1]) == place
        out.append((_hash(_ascii_lower(word)) if word else None, _hash(text[start:end]), seed, start, kind, end, whole))
        reach = max(reach, end)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and pattern occurrences of every document."""

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        seen = pa.list_(pa.struct([("pattern", pa.int64()), ("instance", pa.int64()), ("seed", pa.bool_()), ("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("whole", pa.bool_())]))
        for batch in batches:
            n, bases, told = [], [], []
            for text in batch.column(2).to_pylist():
                base = base_spans(text)
                n.append([sum(x[1] == kind for x in base) for kind in range(ID)])
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                told.append([dict(zip(_SEEN, c)) for c in candidates(text, base)])
            counts = [pa.array(c, pa.int64()) for c in zip(*n)] if n else [pa.array([], pa.int64())] * ID
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts, pa.array(bases, span), pa.array(told, seen)], names=["doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base", "seen"])

    return docs.mapInArrow(run, FOUND)


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def occurrences(docs: DataFrame) -> DataFrame:
    """How often each word and each label (as hashes) stands in all texts; a task adds up its own before it lets them out."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        word, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        return word, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    def run(batches):
        held, size = [], 0
        for _, data, offsets in text_steps(batches):
            w = Words(data, offsets, lower=True)
            if not len(w.starts):
                continue
            mark = np.append(np.flatnonzero((w.data == 58) | (w.data == 61)) + 1, len(w.data) + 1)
            end = mark[np.searchsorted(mark, w.starts + 2)]
            some = (end < w.ends) & _LETTER[w.data[w.starts]]
            held.append(np.unique(np.concatenate([w.hash, hash_spans(w.data, w.starts[some], end[some])]), return_counts=True))
            size += len(held[-1][0])
            if size > HELD_WORDS:
                held = [merged(held)]
                size = len(held[0][0])
                if size > HELD_WORDS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["pattern", "n"])
                    held, size = [], 0
        if held:
            word, n = merged(held)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["pattern", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def trusted(found: DataFrame, docs: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE, rounds: int | None = None) -> DataFrame:
    """Patterns whose confidence reaches the bound once nothing changes, or after so many rounds; written."""
    seen = found.select(F.explode("seen").alias("x")).where("x.pattern is not null")
    all_edges = written(seen.groupBy("x.pattern", "x.instance").agg(F.max("x.seed").alias("seed"), F.count_if("x.whole").alias("times")))
    # a pattern with fewer instances than MIN_SEEDS of any kind is never induced, one that is nowhere whole never trusted
    able = all_edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("times").alias("n")).where((F.col("instances") >= min_seeds) & (F.col("n") > 0)).select("pattern")
    counts = written(occurrences(docs).join(able, "pattern", "left_semi"))
    edges = written(all_edges.join(counts, "pattern"))
    scores = written(edges.where("seed").select("instance", F.lit(STEPS).alias("score")).distinct())
    good, total, turn = None, -1, 0
    while rounds is None or turn < rounds:
        ranked = edges.join(scores, "instance").groupBy("pattern").agg(F.count("*").alias("known"), (F.sum(F.col("score") * F.col("times")) / F.max("n") / STEPS).alias("confidence"))
        before, good = good, written(ranked.where((F.col("known") >= min_seeds) & (F.col("confidence") >= confidence)).select("pattern", F.least(F.lit(STEPS), F.floor(F.col("confidence") * STEPS)).cast("int").alias("level")))
        # nothing falls from round to round, so equal sums are equal trust
        now = tuple(good.agg(F.count("*"), F.sum("level")).first())
        drop(before)
        if now == total:
            break
        total, turn = now, turn + 1
        spent = scores
        scores = written(edges.join(good, "pattern", "left").groupBy("instance").agg(F.max(F.when(F.col("seed"), STEPS).otherwise(F.col("level"))).alias("score")).where("score is not null"))
        drop(spent)
    drop(all_edges, counts, edges, scores)
    return good.select("pattern")


def find(docs: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE, rounds: int | None = None) -> DataFrame:
    """One row a document: counts and digest of base spans, and all spans as kind:start:end."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("row"), text.alias("text"))
    found = written(scan(docs))
    good = trusted(found, docs, min_seeds, confidence, rounds)
    more = found.select("doc_id", "row", F.explode("seen").alias("x")).where(F.col("x.kind") == ID).select("doc_id", "row", "x.seed", "x.pattern", F.struct("x.start", "x.kind", "x.end").alias("span"))
    more = more.where("seed").union(more.where("not seed").join(good, "pattern", "left_semi").select(*more.columns))
    more = more.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_set("span").alias("more"))
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    told = lambda spans: F.expr(f"array_join(transform({spans}, s -> concat_ws(':', element_at({kinds}, s.kind + 1), s.start, s.end)), ',')")
    all_ = "array_sort(concat(base, coalesce(more, cast(array() as array<struct<start:int,kind:int,end:int>>))))"
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))
    return found.drop("seen").join(more, same, "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(told("base").cast("binary"), 256).alias("base_sha256"), told(all_).alias("spans"))
