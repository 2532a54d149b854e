"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Each rule is (name, measure, lowest, highest, from how many words it holds). Measures are Spark SQL over the
words, lines and counts of a text. A document is kept if the base rules and all rules of the table hold.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are judged alike; an
empty table gives no rows; other columns are ignored, also by name. A missing measure (0 / 0) passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it was for on with as are be by at from or an he this "
    "le la les de des du et en un une que qui est pour dans par sur pas au aux avec ce il ne se "
    "der die das und zu den von mit ist im ein eine nicht auf sich des dem für als auch "
    "el los las que y del se por con para una su lo no como al es"
).split()
#: name, measure, lowest, highest, from how many words on
RULES = (
    ("word_length", "word_chars / n_words", 1.5, 15.0, 10),
    ("symbol_ratio", "n_symbols / n_words", None, 0.25, 10),
    ("stop_ratio", "n_stop / n_words", 0.01, None, 100),
    ("dup_line_ratio", "n_dup_lines / n_lines", None, 0.5, 10),
)

_SPACE = r"[ \\t\\n\\x0B\\f\\r]"
_WORDS = f"filter(split(coalesce(_text, ''), '{_SPACE}+'), w -> w <> '')"
_LINES = rf"filter(split(coalesce(_text, ''), '\\n'), l -> l rlike '[^ \\t\\n\\x0B\\f\\r]')"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(words: str, size: int = REPEAT_WINDOW) -> str:
    """Words covered by windows that stand twice or more: windows are sorted by hash only where some repeat."""
    window = "xxhash64(" + ", ".join(f"h[i + {k}]" for k in range(size)) + ")"
    windows = _let(f"transform({words}, w -> xxhash64(w))", "h", f"transform(sequence(0, size(h) - {size}), i -> {window})")
    places = "array_sort(transform(filter(transform(s, (x, k) -> named_struct('i', x.i, 'twice', (k > 0 and s[greatest(k - 1, 0)].g = x.g) or (k + 1 < size(s) and s[least(k + 1, size(s) - 1)].g = x.g))), y -> y.twice), y -> y.i))"
    covered = f"aggregate({places}, named_struct('n', 0L, 'end', 0), (a, i) -> named_struct('n', a.n + least({size}, i + {size} - a.end), 'end', i + {size}), a -> a.n)"
    ordered = _let("array_sort(transform(g, (x, k) -> named_struct('g', x, 'i', k)))", "s", covered)
    return f"case when size({words}) < {size} then 0L else {_let(windows, 'g', f'case when size(array_distinct(g)) = size(g) then 0L else {ordered} end')} end"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules are written in."""
    split = docs.select("doc_id", F.col("text").cast("string").alias("_text")).select(
        "doc_id",
        F.expr(_let(_WORDS, "w", "named_struct("
            "'n_words', cast(size(w) as bigint), "
            "'word_chars', aggregate(w, 0L, (a, x) -> a + char_length(x)), "
            f"'n_stop', cast(size(filter(w, x -> lower(x) in ({_STOP}))) as bigint), "
            f"'n_repeat_words', {_repeat_words('w')})")).alias("_w"),
        F.expr(_let(_LINES, "l", "named_struct('n_lines', cast(size(l) as bigint), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint))")).alias("_l"),
        F.expr("cast(coalesce(regexp_count(_text, '[#*$%&|<>]'), 0) as bigint)").alias("n_symbols"),
    )
    return split.select("doc_id", "_w.*", "n_symbols", "_l.*")


def rule(measure: str, lowest: float | None, highest: float | None, words: int) -> Column:
    value = F.expr(measure.replace(" / ", " / nullif(") + ", 0)")
    bad = F.lit(False)
    if lowest is not None:
        bad = bad | (value < lowest)
    if highest is not None:
        bad = bad | (value > highest)
    return F.coalesce((F.col("n_words") < words) | ~bad, F.lit(True))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the counts, base_failed and kept."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    kept = ~base_failed
    for _, measure, lowest, highest, words in rules:
        kept = kept & rule(measure, lowest, highest, words)
    return measures(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), kept.alias("kept"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
marks AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i FROM d),
told AS (SELECT doc_id, max(marks.i IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY words.i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS twice FROM words LEFT JOIN marks USING (doc_id, i)),
repeated AS (SELECT doc_id, count(*) FILTER (WHERE twice) AS n FROM told GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN (""" + _STOP + r"""))) AS n_stop FROM d LEFT JOIN repeated USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)""" + "".join(
    f"\n  AND (n_words < {words} OR coalesce({measure.replace(' / ', ' / nullif(')}, 0) " + (f">= {low}" if low is not None else f"<= {high}") + (f" AND {measure.replace(' / ', ' / nullif(')}, 0) <= {high}" if low is not None and high is not None else "") + ", true))"
    for _, measure, low, high, words in RULES
) + " AS kept FROM m"
