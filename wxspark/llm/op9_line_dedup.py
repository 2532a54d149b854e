"""Line dedup: an edit-distance join of lines by segment partitions, in DataFrame and SQL operations only.

Lines are those between line feeds. Equal lines are one class, told apart by 104 hash bits. In the join a line goes by
40 hash bits and counts of frequent letters, which bound the edits between two lines from below; there the
text itself tells lines of one identity apart. A line of at least MIN_CHARS code points is cut into EDITS + 1 segments. Two lines within EDITS
edits share a whole segment, at a place that their lengths bound, so the segments (index) are joined with those
substrings of equally long or longer lines that may meet them (probes). Pairs that meet within the letters' bound
are verified by a bit-parallel edit distance in a band of 2 * EDITS + 1 diagonals: one number holds a column of the band,
and a SQL fold over the characters of one line moves it along. A line's links are the other texts
within EDITS edits. The rule is one of both numbers: lines of fewer than MIN_CHARS code points, where EDITS edits may be another
line altogether, are linked with equal lines only.

A line goes if an equal or linked line stands earlier, by (doc_id, line_no), in the input. Lines without a word
always stay.

Defined cases: a null text has no lines, an empty one has one empty line; rows that repeat a doc_id hold the same
places, none of which is earlier than the other; rows without a doc_id have no place and keep their lines;
very long lines take part whole; an empty table gives no rows; other columns, whatever their names, stay as they are in
`dedup` and are ignored in `judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wxspark.llm.common import written

EDITS, MIN_CHARS = 2, 32
#: Letters whose counts modulo 8 are the low bits of a line's identity.
COUNTED = "aehinort"
_COUNT_BITS = 3 * len(COUNTED)


def lines(docs: DataFrame) -> DataFrame:
    """Each line's place and identity; line_no counts from 1."""
    at = docs.select(F.col("doc_id").cast("long"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))
    return at.select("doc_id", (F.col("line_no") + 1).cast("long").alias("line_no"), F.shiftright(F.xxhash64("line"), _COUNT_BITS).alias("h1"), F.xxhash64("line", F.lit(17)).alias("h2"), "line")


def _with_counts() -> Column:
    """h1 above, letter counts below: still a function of the line."""
    out = F.shiftleft(F.col("h1"), _COUNT_BITS)
    for i, c in enumerate(COUNTED):
        n = (F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(c), F.lit("")))).cast("long")
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(7)), 3 * i))
    return out


def _within_counts(a: str, b: str, edits: int) -> Column:
    """An edit adds one letter at most and takes one away at most, so neither sum over the letters exceeds the edits.

    All counts are taken apart at once: three bits each, the top one of which keeps a borrow inside its own. A difference of four or more is taken for the
    nearer of both signs, and of neither is it within three edits.
    """
    if edits > 3:  # counts are known modulo 8
        return F.lit(True)
    ones = sum(1 << 3 * i for i in range(len(COUNTED)))
    low, mid, top, all_ = f"{ones}L", f"{2 * ones}L", f"{4 * ones}L", f"{7 * ones}L"
    d = f"((({a} & {all_} | {top}) - ({b} & {3 * ones}L)) ^ (({a} ^ ~{b}) & {top}))"
    less = f"(shiftright({d} & {top}, 1) | shiftright({d} & {top}, 2))"
    gains = f"bit_count({d} & {low} & ~{less}) + 2 * bit_count({d} & {mid} & ~{less})"
    losses = f"bit_count(~{d} & {low} & {less}) + 2 * bit_count(~{d} & {mid} & {less}) + bit_count({d} & {top})"
    return F.expr(f"{gains} <= {edits} and {losses} <= {edits}")


def texts(docs: DataFrame) -> DataFrame:
    """One row a distinct line (id, line, n). All uses of it have this very plan, so Spark shuffles the texts once."""
    found = lines(docs).select(_with_counts().alias("id"), "line").groupBy("id").agg(F.collect_set("line").alias("same"))
    return found.select("id", F.explode("same").alias("line")).select("id", "line", F.char_length("line").alias("n"))


def places(docs: DataFrame) -> DataFrame:
    """How often each distinct line stands, and where first; null if only in rows without a doc_id."""
    return lines(docs).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "line_no"))).alias("first"))


def _segment(i: int | str, k: int, n: str) -> tuple[str, str]:
    """Start (from 1) and length of the i-th of k segments of a line of n code points: even, longer ones last."""
    short, base = f"({k} - {n} % {k})", f"({n} div {k})"
    return f"(({i} - 1) * {base} + greatest(0, {i} - 1 - {short}) + 1)", f"({base} + if({i} > {short}, 1, 0))"


def _begin(i: int | str, k: int, edits: int) -> str:
    """A place at or before all that the i-th segment's substrings may begin at."""
    return f"greatest(1, ({i} - 1) * ((n - {edits}) div {k}) + 1 - {edits})"


def _parts(found: DataFrame, edits: int) -> DataFrame:
    """The stretch of a line that each segment's substrings lie in: they are cut from it and not from the whole line."""
    k = edits + 1
    return found.select("id", "n", *(F.expr(f"substring(line, {_begin(i, k, edits)}, n div {k} + {3 * k + 3 * edits + 4})").alias(f"part{i}") for i in range(1, k + 1)))


def _cut(i: int, k: int, edits: int, start: str, size: str) -> str:
    return f"substring(part{i}, {start} - {_begin(i, k, edits)} + 1, {size})"


def _index_keys(edits: int) -> str:
    k, out = edits + 1, []
    for i in range(1, k + 1):
        start, size = _segment(i, k, "n")
        out.append(f"xxhash64(n, {i}, {_cut(i, k, edits, start, size)})")
    return f"array({', '.join(out)})"


def _probe_places(edits: int) -> list[tuple[int, int, int]]:
    """(less, i, move): the substrings that may meet the i-th segment of a line shorter by `less` code points begin `move` behind its start."""
    k = edits + 1
    return [(less, i, move) for less in range(edits + 1) for i in range(1, k + 1) for move in range(max(1 - i, less - (k - i)), min(i - 1, less + k - i) + 1)]


def _probes(parts: DataFrame, edits: int) -> DataFrame:
    """key, b, even (the lines are of one length): a row for each substring that may meet a segment of a line shorter by 0 .. edits code points.

    The places are dealt out before their keys are cut, so that the code of a key stands once: a dozen keys in one method are more than the JVM compiles.
    """
    k = edits + 1
    places = ", ".join(f"named_struct('less', {less}, 'i', {i}, 'move', {move})" for less, i, move in _probe_places(edits))
    start, size = _segment("i", k, "(n - less)")
    dealt = parts.select("*", F.expr(f"inline(array({places}))")).select("*", F.expr(f"{start} + move").alias("at"), F.expr(size).alias("size"))
    part = "case i " + " ".join(f"when {i} then part{i}" for i in range(1, k + 1)) + " end"
    key = f"xxhash64(n - less, i, substring({part}, at - {_begin('i', k, edits)} + 1, size))"
    return dealt.where("at between 1 and n - size + 1").select(F.expr(key).alias("key"), F.col("id").alias("b"), (F.col("less") == 0).alias("even"))


def within_edits(a: str, b: str, edits: int) -> Column:
    """Whether two lines are within some edits, 20 at most: Myers' bit vectors, kept to the band of diagonals that such a pair can use.

    Bit i of a column stands for the row i - edits below the diagonal. up and down say where the distance grows or falls by one from
    the row above; low is the distance in the band's lowest row. Behind the last column, the steps from the end of a down to that row
    are taken back. Columns, with the band's rows, are numbered along b; rows before or behind a match nothing. The characters are
    bound to a lambda's variable, as an expression under a lambda is evaluated anew for each element.
    """
    width = 2 * edits + 1
    band, top = (1 << width) - 1, width - 1
    same = " + ".join(f"if(get(p.a, j - {edits - i}) = p.b[j], {1 << i}L, 0L)" for i in range(width))
    match = f"transform(sequence(0, size(p.b) - 1), j -> {same})"
    # d: where the distance stays along the diagonal; across and back: where it grows or falls along the row
    d = f"(((((m & s.up) + s.up) ^ s.up) | m | s.down) & {band}L)"
    across, back = f"((s.down | ~(d | s.up)) & {band}L)", "(d & s.up)"
    moved = f"named_struct('up', ({back} | ~(shiftright(d, 1) | {across})) & {band}L, 'down', shiftright(d, 1) & {across}, 'low', s.low + 1L - shiftright(d, {top}))"
    start = f"named_struct('up', {band - (1 << edits) + 1}L, 'down', 0L, 'low', {edits}L)"
    # the rows have moved on by one behind the last column, so the top bit is below the lowest row
    behind = f"shiftleft({band}L, size(p.a) - size(p.b) + {edits}) & {band >> 1}L"
    end = f"x.low - bit_count(x.up & ({behind})) + bit_count(x.down & ({behind}))"
    fold = f"aggregate({match}, {start}, (s, m) -> element_at(transform(array({d}), d -> {moved}), 1), x -> {end})"
    told = f"case when abs(size(p.a) - size(p.b)) > {edits} then false when size(p.a) = 0 or size(p.b) = 0 then true else {fold} <= {edits} end"
    return F.expr(f"exists(array(named_struct('a', split({a}, ''), 'b', split({b}, ''))), p -> {told})")


def links(found: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Linked lines, both ways: (h1, h2) and its partner (o1, o2)."""
    parts = _parts(found.where(F.col("n") >= min_chars), edits)
    index = parts.select(F.explode(F.expr(_index_keys(edits))).alias("key"), F.col("id").alias("a"))
    probe = _probes(parts, edits)
    ordered = F.when(F.col("even"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    pairs = index.join(probe, "key").where(ordered & _within_counts("a", "b", edits)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a, b = (found.select(F.col("id").alias(x), F.col("line").alias(f"{x}_line"), F.col("n").alias(f"{x}_n")) for x in "ab")
    near = pairs.join(a, "a").join(b, "b").where((F.col("a_n") >= min_chars) & (F.col("b_n") >= min_chars) & (F.col("a_line") != F.col("b_line")))
    near = near.where(within_edits("a_line", "b_line", edits))
    name = lambda x, h1, h2: (F.shiftright(x, _COUNT_BITS).alias(h1), F.xxhash64(f"{x}_line", F.lit(17)).alias(h2))
    return near.select(F.explode(F.array(F.struct(*name("a", "h1", "h2"), *name("b", "o1", "o2")), F.struct(*name("b", "h1", "h2"), *name("a", "o1", "o2")))).alias("x")).select("x.*")


def judge(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row a line: doc_id, line_no, its class (first place of the same text), n_links (other texts linked), kept."""
    first = places(docs)
    other = first.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("first").alias("other"))
    linked = links(texts(docs), edits, min_chars).join(other, ["o1", "o2"]).groupBy("h1", "h2").agg(F.count("*").alias("n_links"), F.min("other").alias("other"))
    # only of lines that stand twice or are linked; written, so that Spark may split a very common line in the join
    told = written(first.join(linked, ["h1", "h2"], "left").where("n > 1 or n_links > 0").drop("n"))
    place = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "line_no"))
    out = lines(docs).select("doc_id", "line_no", "h1", "h2", F.col("line").rlike(r"[^ \t\n\x0B\f\r]").alias("has_word")).join(told, ["h1", "h2"], "left").withColumn("first", F.coalesce("first", place))
    gone = F.col("has_word") & F.coalesce((F.col("first") < place) | (F.coalesce("other", "first") < place), F.lit(False))
    return out.select("doc_id", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (~gone).alias("kept"))


def dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without the lines that go; n_chars, where there is such a column, counts the new text."""
    gone = judge(docs, edits, min_chars).where("not kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*docs.columns).alias("own")).join(gone, "doc_id", "left")
    text = F.when(F.col("gone").isNull(), F.col("own.text")).otherwise(F.expr("element_at(transform(array(split(own.text, '\\n')), l -> array_join(transform(array_except(sequence(1L, cast(size(l) as bigint)), gone), i -> element_at(l, cast(i as int))), '\\n')), 1)"))
    out = {c: F.col(f"own.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("gone").isNull(), F.col("own.n_chars")).otherwise(F.char_length(text).cast("long"))
    return joined.select(*(x.alias(c) for c, x in out.items()))
