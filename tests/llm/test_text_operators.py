import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import helpers
from tests.oracle import same
from wxspark.llm import op2_minhash_near_dedup as op2
from wxspark.llm import op3_license_scan as op3
from wxspark.llm import op5_chat_formatting as op5
from wxspark.llm import op6_toxicity as op6
from wxspark.llm import op7_quality_rules as op7
from wxspark.llm import op8_pii as op8
from wxspark.llm import op9_line_dedup as op9
from wxspark.llm import op10_benchmark_decontamination as op10
from wxspark.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, line string, key string, pattern string"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "l", "k", "p") for d, t in docs], SCHEMA).repartition(4)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    assert same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) > 0


# --- license scans ---


def test_license_base_matches_brute_force(spark):
    r = random.Random(1)
    words = ["cc", "by", "General", "public", "LICENSE", "all", "rights", "reserved", "x", "é", "cc-by"]
    docs = [(i, "".join(r.choice(words) + r.choice([" ", "-", "\n", ", ", "\x00"]) for _ in range(r.randint(0, 60)))) for i in range(150)] + [(900, None), (901, "")]
    got = {x.doc_id: (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in op3.scan(frame(spark, docs)).collect()}
    for d, text in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", helpers.lower(text))
        at = [(i, label) for phrase, label in op3.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        assert got[d] == (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))), d


def test_license_templates(spark):
    docs = [
        (1, "Licensed under the Apache License, Version 2.0."), (2, "licensed under the Apache License 2.0"), (3, "licensed under the apache licence 2.0"),
        (4, "Released under the terms of the MIT License."), (5, "Licensed under CC BY-NC 4.0."), (6, "Copyright (c) 2020 by Some Body Else. All rights reserved."),
        (7, "This work is licensed under the GNU General Public License, version 3."), (8, "mit der license"),
    ]
    got = {x.doc_id: (x.labels, x.score) for x in op3.scan(frame(spark, docs)).collect()}
    assert got == {1: ("apache-2.0", 1.0), 2: ("apache-2.0", 1.0), 3: ("", 0.0), 4: ("mit", 1.0), 5: ("cc-by,cc-by-nc-4.0", 1.0), 6: ("copyright,reserved", 1.0), 7: ("gpl,gpl-3.0", 1.0), 8: ("", 0.0)}


def test_automaton_optional_and_replaceable():
    a, w = op3.Automaton("a [[b [[c]]]] {2} d"), lambda s: [op3.word_hash(x) for x in s.split()]
    assert [s for s in ("a d", "a b d", "a b c d", "a c d", "a x y d", "a b x y d", "a x y z d", "b d", "a") if a.accepts(w(s), 0)] == ["a d", "a b d", "a b c d", "a c d", "a x y d", "a b x y d"]


def pattern(template):
    """A template as a regular expression over words with a space behind each."""
    out = ""
    for token in re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", template):
        out += {"[[": "(?:", "]]": ")?"}.get(token, f"(?:[^ ]+ ){{0,{token[1:-1]}}}" if token[0] == "{" else f"{token} ")
    return re.compile(f"(?<![^ ]){out}")


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_match_brute_force(spark, seed):
    r = random.Random(seed)
    templates = [("x", "a b [[c {2} d]] e"), ("y", "b {1} [[a]] c"), ("z", "e [[e [[d]]]] {3} a b"), ("w", "d d")]
    docs = [(i, " ".join(r.choice("abcde") for _ in range(r.randint(0, 14)))) for i in range(250)]
    got = {x.doc_id: x.labels for x in op3.scan(frame(spark, docs), templates=templates).collect()}
    want = {d: ",".join(label for label, t in sorted(templates) if pattern(t).search(text + " ")) for d, text in docs}
    assert got == want and len(set(want.values())) > 6


def spell(template, r):
    """A text that a template accepts: options taken or not, regions filled with other words."""
    while m := re.search(r"\[\[([^\[\]]*)\]\]", template):
        template = template[: m.start()] + (m[1] if r.random() < 0.5 else "") + template[m.end() :]
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(r.choice(["Foo", "bar", "2024"]) for _ in range(r.randint(0, int(m[1])))), template)


def test_whole_licences_are_found_and_changed_ones_not(spark):
    r, docs, want = random.Random(3), [], {}
    for k, (label, template) in enumerate(op3.TEMPLATES):
        for copy in range(3):
            text = spell(template, r)
            docs.append((10 * k + copy, f"Some words; {text}, and more"))
            want[10 * k + copy] = label
        must = [x for x in re.sub(r"\[\[.*\]\]|\{\d+\}", " ", template).split()]
        docs.append((10 * k + 9, " ".join(x if i != len(must) // 2 else "else" for i, x in enumerate(must))))
    got = {x.doc_id: x.labels.split(",") for x in op3.scan(frame(spark, docs)).collect()}
    assert all(label in got[d] for d, label in want.items())
    assert not any(label in got[10 * k + 9] for k, (label, t) in enumerate(op3.TEMPLATES) if label.endswith(("-text", "-notice")))


def test_a_hash_alone_matches_nothing():
    data = np.frombuffer(b"cc by xx", np.uint8)
    w = op3.Words(data, np.array([0, 8]), op3.SEPARATOR, lower=True)
    s = op3.Spelling(["cc", "by"])
    assert s.of(w).tolist() == [op3.word_hash("cc"), op3.word_hash("by"), 0]
    w._hash[0] = np.array([op3.word_hash("by"), op3.word_hash("by"), op3.word_hash("cc")], np.uint64)  # as if words collided
    assert s.of(w).tolist() == [0, op3.word_hash("by"), 0]


def test_licenses_of_repeated_rows_and_of_none(spark):
    rows = op3.scan(frame(spark, [(1, "all rights reserved")] * 3 + [(None, "cc by")])).collect()
    assert sorted((x.doc_id or 0, x.labels) for x in rows) == [(0, "cc-by"), (1, "reserved"), (1, "reserved"), (1, "reserved")]
    assert op3.scan(frame(spark, []).limit(0)).collect() == []


# --- chat formatting ---


def test_chat_round_trip(spark):
    r = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "\n", "<\\|", "ok", "é", "<|", "", "\\n"]
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "a\n<|b"]), r.choice([None, "".join(r.choice(bits) for _ in range(r.randint(0, 8)))])) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(7, 2, "assistant", "twice"), (7, 2, "assistant", "twice"), (None, None, "user", "x"), (50, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {x.conv_id: x for x in op5.digests(op5.examples(df)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x[4] for x in turns if x[2] == "assistant")
        whole = "".join(f"{x[2]}\n{x[4]}\n" for x in turns)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_examples_have_one_target_each(spark):
    df = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", "a1"), (1, 2, "user", "v"), (1, 3, "assistant", "a2"), (2, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    rows = op5.examples(df).orderBy("conv_id", "example").collect()
    assert [(x.conv_id, x.n_turns, x.text[x.loss_start : x.loss_end] if x.loss_start is not None else None) for x in rows] == [(1, 2, "a1"), (1, 4, "a2"), (2, 1, None)]
    assert rows[1].text.startswith(rows[0].text)
    assert op5.digests(op5.examples(df.limit(0))).collect() == []


# --- toxicity ---


def test_viterbi_restores_disguises(spark):
    docs = frame(spark, [(i, "the stupid moron said pathetic things and worthless trash about a clown with kindness " * 3) for i in range(20)])
    model = op6.log_model(op6.trigrams(docs))
    memo = lambda t: op6.decode(t, model)
    for bad in ("stup1d", "st00pid", "5tup!d", "s t u p i d", "stuuuupid", "s.t.u.p.i.d", "m0r0n", "p@thet1c", "tr4$h"):
        data = np.frombuffer(f"you {bad} one".encode(), np.uint8)
        assert op6.suspicious(data, np.array([0, len(data)])).tolist() == [0], bad
    assert [op6.restore(f"you {x} one", model, memo) for x in ("stup1d", "5tup!d", "s t u p i d", "stuuuupid", "s.t.u.p.i.d", "m0r0n", "p@thet1c", "tr4$h")] == [f"you {x} one" for x in ("stupid", "stupid", "stupid", "stupid", "stupid", "moron", "pathetic", "trash")]


def test_disguises_of_any_length_are_restored(spark):
    docs = frame(spark, [(i, "the stupid idiot moron said pathetic things and worthless trash about a clown with kindness " * 3) for i in range(20)])
    model = op6.log_model(op6.trigrams(docs))
    memo = lambda t: op6.decode(t, model)
    long = {"1d10t" + "!" * 30: "idiot", "!" * 40 + "1d10t": "idiot", "st" + "u" * 90 + "pid": "stupid", "m" + "o" * 60 + "r0n": "moron", "1" + "d" * 40 + "i" * 40 + "0t": "idiot", "m0r0n" + "|" * 500: "moron"}
    for bad, want in long.items():
        data = np.frombuffer(f"you {bad} one".encode(), np.uint8)
        assert op6.suspicious(data, np.array([0, len(data)])).tolist() == [0], bad
        assert op6.restore(f"you {bad} one", model, memo) == f"you {want} one", bad
    assert op6.suspicious(np.frombuffer(b"d2!", np.uint8), np.array([0, 3])).tolist() == [0]
    # the parts put aside change nothing: long tokens decode as their words do
    assert op6.decode("stup1d" * 2000, model).count("stupid") >= 1990


def test_decoder_is_the_best_of_all_paths(spark):
    model = op6.log_model(op6.trigrams(frame(spark, [(i, "stupid moron idiot trash clown pathetic " * 3) for i in range(5)])))

    def all_paths(token):
        last, paths = "", [("", 0.0)]
        for k, c in enumerate(token):
            if "a" <= c <= "z":
                options = [(c, 0.0)] if c != last else [(c, -0.7), ("", 0.0)]
            elif c in op6.STANDS_FOR:
                options = [(x, -0.3) for x in op6.STANDS_FOR[c]] + [("", -1.0 if k in (0, len(token) - 1) else -4.0)]
            else:
                options = [("", 0.0)]
            last, paths = c, [(said + x, score + cost) for said, score in paths for x, cost in options]
        code = lambda c: ord(c) - 96 if c else 0
        score = lambda s: sum(float(model[code(a), code(b), code(c)]) for a, b, c in zip(["", "", *s], ["", *s], [*s, ""]))
        return [(value + score(said), said) for said, value in paths]

    r = random.Random(4)
    for _ in range(300):
        token = "".join(r.choice("stupidmoraa015$!| .2") for _ in range(r.randint(1, 9)))
        paths = all_paths(token)
        got = op6.decode(token, model)
        assert max(x for x, said in paths if said == got) >= max(paths)[0] - 1e-4, token
    # only ASCII letters are lowered, in rows with disguises as in others
    assert op6.restore("É stup1d".encode().lower().decode(), model, lambda t: op6.decode(t, model)) == "É stupid"


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    told = op6.score(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    bad = [x for x in told if x.toxic == 1]
    assert len(bad) > 30 and sum(x.predicted for x in bad) >= 0.9 * len(bad)
    assert sum(x.predicted for x in told if x.toxic == 0) <= 0.02 * len(told)
    assert all(0 <= x.score <= 1 for x in told)


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, None), (2, ""), (3, "x"), (3, "x")])
    assert {(x.doc_id, x.score, x.predicted) for x in op6.score(docs, none).collect()} == {(1, 0.0, 0), (2, 0.0, 0), (3, 0.0, 0)}
    assert op6.score(docs.limit(0), none).collect() == [] and op6.reject(docs, none).count() == 4


# --- quality rules ---


def test_quality_matches_brute_force(spark):
    docs = [*helpers.corpus(8), (500, "a b c d e " * 3), (501, "# $ %\n\nx y\nx y\n \n"), (502, "w " * 4), (503, "é x " * 12)]
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in op7.judge(frame(spark, docs)).collect()}
    assert got == {d: helpers.quality(t) for d, t in docs}
    assert op7.judge(frame(spark, []).limit(0)).collect() == []


# --- PII ---


def test_pii_base_matches_brute_force(spark):
    r = random.Random(3)
    bits = ["a@b.c", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "12", " ", "-", "9" * 15, "0", "q.", "%", "(", "é", "+12345678901234567", "\n", "0001.2.3.004"]
    docs = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 14)))) for i in range(400)] + [(900, None), (901, "")]
    got = {x.doc_id: x for x in op8.find(frame(spark, docs)).collect()}
    for d, text in docs:
        want = helpers.base_spans(text)
        told = ",".join(f"{op8.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert [got[d][f"n_{k}"] for k in op8.KINDS[:4]] == [sum(x[1] == k for x in want) for k in range(4)], (text, want)
        assert got[d].base_sha256 == hashlib.sha256(told.encode()).hexdigest(), text
        assert set(told.split(",")) - {""} <= set(got[d].spans.split(","))


def test_pii_bootstraps_unseen_identifiers(spark):
    seeds = [(i, f"some words then phone: +1 (555) 123-45{i:02d} and more of the text") for i in range(30)]
    docs = seeds + [(50, "this one says phone: 0912-3456-78 here"), (51, "plain number 1234567 stays"), (None, "phone: 12345678")]
    got = {x.doc_id: x.spans for x in op8.find(frame(spark, docs)).collect()}
    assert got[50] == "id:21:33" and got[51] == "" and got[None] == "id:7:15"
    assert op8.find(frame(spark, []).limit(0)).collect() == []


def test_pii_discoveries_induce_new_patterns(spark):
    seeds = [(i, f"then phone: +1 (555) 123-45{i:02d} and more") for i in range(30)]
    found = [(100 + i, f"or phone: 0912-34-{i:02d} stays") for i in range(5)]  # behind a trusted pattern
    again = [(200 + i, f"ring mobil= 0912-34-{i:02d} today") for i in range(5)]  # the same behind another word
    last = (300, "ring mobil= aBc_dEf today")  # no digit, and no seed behind that word
    got = {x.doc_id: x.spans for x in op8.find(frame(spark, [*seeds, *found, *again, last, (301, "ring phone aBc_dEf")])).collect()}
    assert got[100] == "id:10:20" and got[200] == "id:12:22" and got[300] == "id:12:19" and got[301] == ""
    one = {x.doc_id: x.spans for x in op8.find(frame(spark, [*seeds, *found, *again, last]), rounds=1).collect()}
    assert one[100] == "id:10:20" and one[300] == ""


def test_pii_rows_and_tokens_of_any_length(spark):
    seeds = [(i, f"some words then {'p' * 90}: +1 (555) 123-45{i:02d} and more of the text") for i in range(30)]
    long = "ab12" * 2000
    rows = [(50, f"this {'p' * 90}: x7 here"), (50, "x"), (50, None), (51, f"{'p' * 90}: {'9:' * 400}"), (52, f"see {long} there"), (53, "secret = 0123456789abcdef0123456789abcdef")]
    got = sorted((x.doc_id, x.spans) for x in op8.find(frame(spark, seeds + rows)).collect() if x.doc_id >= 50)
    assert got == [(50, ""), (50, ""), (50, "id:97:99"), (51, f"id:92:{92 + 799}"), (52, f"id:4:{4 + len(long)}"), (53, "id:9:41")]


def test_pii_confidence_does_not_fall_with_copies(spark):
    seeds = [(i, f"some words then phone: +1 (555) 123-45{i:02d} and more of the text") for i in range(30)]
    docs = seeds + [(50, "this one says phone: 0912-3456-78 here"), (51, "plain number 1234567 stays")]
    one = frame(spark, docs)
    many = one.crossJoin(spark.range(1000).withColumnRenamed("id", "copy")).selectExpr("doc_id + 1000 * copy AS doc_id", "text")
    told = lambda rows: {(x.doc_id % 1000, x.spans) for x in op8.find(rows).select("doc_id", "spans").collect()}
    assert told(many) == told(one) and (50, "id:21:33") in told(one)
    # copies of a single document
    assert (50, "id:21:33") in told(many.where("doc_id < 1000 or doc_id % 1000 = 7"))


# --- line dedup ---


@pytest.mark.parametrize("edits,min_chars", [(2, 6), (1, 8), (3, 10)])
def test_line_dedup_matches_brute_force(spark, edits, min_chars):
    r = random.Random(edits)
    base = ["".join(r.choice("abé ") for _ in range(r.randint(0, 24))) for _ in range(25)]

    def vary(s):
        s = list(s)
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(s))
            s[k : k + r.randint(0, 1)] = r.choice(["", "a", "x", "é"])
        return "".join(s)

    docs = [(i, "\n".join(vary(r.choice(base)) for _ in range(r.randint(0, 5)))) for i in range(70)] + [(900, None), (901, ""), (902, "\n \n")]
    got = {(x.doc_id, x.line_no): (x.class_doc_id, x.class_line_no, x.n_links, x.kept) for x in op9.judge(frame(spark, docs), edits, min_chars).collect()}
    want = helpers.line_dedup(docs, edits, min_chars)
    assert got == want
    texts = {x.doc_id: x.text for x in op9.dedup(frame(spark, docs), edits, min_chars).collect()}
    for d, t in docs:
        assert texts[d] == (None if t is None else "\n".join(l for i, l in enumerate(t.split("\n")) if want[d, i + 1][3]))


def test_bit_parallel_band_matches_the_edit_distance(spark):
    r, rows = random.Random(9), []
    for _ in range(3000):
        a = "".join(r.choice("abé") for _ in range(r.randint(1, 10)))
        b = list(a)
        for _ in range(r.randint(0, 5)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 1)] = r.choice(["", "a", "x", "é"])
        b = b or ["a"]
        rows.append((a, "".join(b), helpers.edit_distance(a, "".join(b))))
    told = spark.createDataFrame(rows, "a string, b string, far int").select("far", *(op9.within_edits("a", "b", k).alias(f"e{k}") for k in range(5)))
    assert all(x[f"e{k}"] == (x.far <= k) for x in told.collect() for k in range(5))


def test_line_dedup_keeps_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some line\nx", 1, 2, "a", 3), (2, "some line\ny", 4, 5, "b", 6)], "doc_id int, text string, gone long, _gone long, own string, n_chars int")
    rows = op9.dedup(docs)
    assert rows.columns == docs.columns and sorted(map(tuple, rows.collect())) == [(1, "some line\nx", 1, 2, "a", 3), (2, "y", 4, 5, "b", 1)]


def test_line_dedup_edges(spark):
    assert op9.judge(frame(spark, []).limit(0)).collect() == []
    same_row = frame(spark, [(1, "one\ntwo"), (1, "one\ntwo"), (None, "one")])
    assert sorted((x.text for x in op9.dedup(same_row).collect())) == ["one", "one\ntwo", "one\ntwo"]


# --- decontamination ---


def test_decontamination_finds_planted_passages(spark):
    r = random.Random(5)
    say = lambda k: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(k))
    items = [(i, say(r.randint(12, 50)).capitalize() + ".") for i in range(12)] + [(90, None), (91, "short")]
    docs, dirty = [(900, None), (901, ""), (902, "short")], set()
    for i in range(200):
        text = say(r.randint(5, 200))
        if i % 4 == 0:
            k, item = r.choice(items[:12])
            chars = list(item)
            for _ in range(int(len(item) * 0.02) if i % 8 else 0):
                chars[r.randrange(len(chars))] = r.choice("etaoin")
            text, _ = f"{say(20)} é {''.join(chars).upper() if i % 3 else ''.join(chars)}\n{text}", dirty.add((i, k))
        docs.append((i, text))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = op10.hits(frame(spark, docs), bench).collect()
    assert {(x.doc_id, x.item_id) for x in rows} == dirty
    text = dict(docs)
    for x in rows:
        if x.edits == 0 and x.doc_id % 8 == 0:
            clean = lambda s: re.sub("[^a-z0-9]", "", s.lower())
            assert clean(text[x.doc_id][x.begin : x.end]) == clean(dict(items)[x.item_id])
    assert {x.doc_id for x in op10.decontaminate(frame(spark, docs), bench).collect()} == {d for d, _ in docs} - {d for d, _ in dirty}


def brute_hits(docs, items):
    """Every region of every item against every whole text."""
    clean = lambda s: re.sub("[^a-z0-9]", "", (s or "").lower())
    out = set()
    for d, text in docs:
        t = clean(text)
        for i, item in items:
            p = clean(item)
            for lo, hi in op10._regions(len(p)) if len(p) >= op10.Q else []:
                most, row = int(op10.EDIT_SHARE * (hi - lo)), [0] * (len(t) + 1)
                for k, c in enumerate(p[lo:hi]):
                    new = [k + 1]
                    for j, x in enumerate(t):
                        new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
                    row = new
                if min(row) <= most:
                    out.add((d, i))
                    break
    return out


def test_decontamination_matches_brute_force(spark):
    r = random.Random(11)
    say = lambda k: "".join(r.choice("abcd ") for _ in range(k))
    items = [(i, say(n)) for i, n in enumerate((8, 12, 14, 21, 22, 24, 25, 27, 30, 48, 60, 70, 90, 120))]
    docs = [(900, None), (901, "")]
    for k in range(90):
        part = list(r.choice(items)[1])
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(part))
            part[at : at + r.randint(0, 1)] = r.choice(["", "a", "x", "b"])
        docs.append((k, say(r.randint(0, 60)) + "".join(part) + say(r.randint(0, 60))))
    docs.append((None, items[12][1]))
    rows = op10.hits(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in rows} == brute_hits(docs, items)
    clean = op10.decontaminate(frame(spark, docs).withColumn("_gone", op2.F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    dirty = {x.doc_id for x in rows}
    assert {x.doc_id for x in clean.collect()} == {d for d, _ in docs} - dirty and None in dirty


def test_decontamination_finds_a_short_item_with_an_edit_in_its_middle(spark):
    item = "qwertyuiopasdfghjklzx"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = op10.hits(frame(spark, [(5, "abc " * 100_000 + item[:10] + "9" + item[11:])]), bench).collect()
    assert [(x.doc_id, x.item_id, x.edits) for x in rows] == [(5, 1, 1)]


def test_decontamination_blocks_and_nothing(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, op10.hits(docs, bench).collect()))
    monkeypatch.setattr(op10, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, op10.hits(docs, bench).collect())) == whole != []
    assert op10.hits(docs, bench.limit(0)).collect() == [] and op10.hits(docs.limit(0), bench).collect() == []


def test_edits_within_is_semi_global():
    r = random.Random(6)
    for _ in range(100):
        p, t = ("".join(r.choice("ab") for _ in range(r.randint(1, n))).encode() for n in (8, 20))
        best = min(helpers.edit_distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert op10.edits_within(p, t, 3) == (best if best <= 3 else None)


# --- the pipeline ---


def test_pipeline_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, ("tox", "line", "near", "bench", "pack")):
        out = op2.written(stage(spark, kept, SF))
        before = {x.doc_id: x.text for x in kept.collect()}
        if want == "pack":
            assert {x.doc_id for x in out.collect()} == set(before)
            break
        assert out.columns == docs.columns
        after = {x.doc_id: x.text for x in out.collect()}
        if want == "line":
            told = helpers.line_dedup(before.items(), op9.EDITS, op9.MIN_CHARS)
            assert after == {d: "\n".join(l for i, l in enumerate(t.split("\n")) if told[d, i + 1][3]) for d, t in before.items()}
            assert all(x.n_chars == len(x.text) for x in out.collect())
        elif want == "near":
            assert set(after) == {d for d, x in helpers.near_duplicates(before.items(), *op2.STAGE).items() if x[2]}
        else:
            assert set(after) <= set(before) and len(after) >= 0.7 * len(before)
        kept = out
    assert corpus_pipeline.run(spark, SF).count() == out.count()


def test_pii_labels_inside_tokens(spark):
    seeds = [(i, f"some mail=bob{i}@example.com words") for i in range(30)]
    rows = [(50, "and mail=x9_y9 too"), (51, "but male=x9 not"), (52, "(mail=z8) there"), (53, "mail= w7 and 9:x9"), (54, "MAIL=Q5")]
    got = {x.doc_id: x.spans for x in op8.find(frame(spark, seeds + rows)).collect()}
    assert [got[k] for k in range(50, 55)] == ["id:9:14", "", "", "id:6:8", "id:5:7"]


def test_pii_counts_are_those_of_words_and_labels(spark):
    text = "Key= key=a key=b:c :x =y k:: a:b= 9:z é=1 key=a\nKEY= " + "w " * 50
    got = {x.pattern: x.n for x in op8.occurrences(frame(spark, [(1, text), (2, text), (3, None)])).collect()}
    words = [op8._ascii_lower(w) for w in text.split()] * 2
    want = collections.Counter(words) + collections.Counter(w[: op8._label(w)] for w in words if op8._label(w))
    assert {op8._hash(w): n for w, n in want.items()} == got


def test_pii_a_pattern_that_only_stands_inside_tokens_ends_by_itself(spark):
    docs = [(i, f"see x/y=bob{i}@example.com (at{i}@example.org) a-b-c+1 (555) 123-45{i:02d} now") for i in range(40)]
    got = op8.find(frame(spark, docs)).collect()
    assert len(got) == 40 and all(x.n_email == 2 for x in got)


def test_pii_a_long_chain_of_discoveries_is_found_whole(spark):
    word = [f"word{x}" for x in "abcdefghijklmno"]
    docs = [(i, f"by {word[0]} bob{i}@example.com now " * 20) for i in range(3)]
    for k in range(14):
        # word k discovers three instances that only word k + 1 has, too
        docs += [(1000 * (k + 1) + i, f"by {word[k]} aa_{k}x{i} now") for i in range(3)]
        docs += [(1000 * (k + 1) + 100 + i, f"by {word[k + 1]} aa_{k}x{i} now " * 20) for i in range(3)]
    docs += [(99, f"by {word[14]} zz_9 now"), (98, "by nobody zz_9x now")]
    got = {x.doc_id: x.spans for x in op8.find(frame(spark, docs), confidence=0.1).collect()}
    assert got.pop(98) == "" and all(got.values())
    few = {x.doc_id: x.spans for x in op8.find(frame(spark, docs), confidence=0.1, rounds=2).collect()}
    assert few[1000] and not few[99]


def test_op9_joins_by_code_that_the_jvm_compiles(spark):
    found = op9.texts(spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog\nthe quick brown fox jumped over a lazy dog")], "doc_id long, text string"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(op9.links(found)._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # methods of over 8000 bytes stay interpreted; a dozen keys in one array were 19,915, the letters' bound 8,509
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert len(sizes) > 5 and max(sizes) < 8000
    # a place for each of the substrings, of which some are beyond the line's end
    assert len(op9._probe_places(2)) == 12 and 2 * 8 < op9._probes(op9._parts(found, 2), 2).count() <= 2 * 12


def test_op9_letters_bound_is_that_of_each_letter(spark):
    rng = random.Random(8)
    lines = ["".join(rng.choice(op9.COUNTED + "xyz") for _ in range(rng.randrange(40))) for _ in range(60)]
    lines += [x[:i] + rng.choice("aeh") + x[i + rng.randrange(2) :] for x in lines if x for i in [rng.randrange(len(x))]]
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("h1", F.xxhash64("line")).select("line", op9._with_counts().alias("id"))
    pairs = df.selectExpr("line x", "id a").crossJoin(df.selectExpr("line y", "id b"))
    for edits in (1, 2, 3):
        seen = collections.Counter()
        for r in pairs.select("x", "y", op9._within_counts("a", "b", edits).alias("ok")).collect():
            # modulo 8, of which four is too many on both sides
            d = [(r.x.count(c) - r.y.count(c)) % 8 for c in op9.COUNTED]
            want = sum(n for n in d if n <= 4) <= edits and sum(8 - n for n in d if n >= 4) <= edits
            assert r.ok == want
            seen[want] += 1
        assert min(seen[True], seen[False]) > 60
