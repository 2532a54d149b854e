import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tests.llm import helpers
from wxspark.llm import op1_best_fit_packing as op1
from wxspark.llm import op2_minhash_near_dedup as op2
from wxspark.llm import op4_substring_dedup as op4

SCHEMA = "doc_id long, text string, rep string, key string, component string"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "r", "k", "c") for d, t in docs], SCHEMA).repartition(5)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing_is_exact_and_tight(spark, capacity):
    docs = helpers.corpus(3) + [(9000, "x<|endoftext|>y " * 50), (9001, "word " * 5000), (9001, "word " * 5000), (9002, " " * 3000), (9003, "a" * 3000), (9004, " " * 1_000_000 + "x")]
    rows = op1.pack(frame(spark, docs), capacity).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want += [(d, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())) for k, (at, n) in enumerate(op1.cut(len(ids), capacity))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= capacity
    total = sum(r.length for r in rows)
    assert len(places) <= 1.06 * -(-total // capacity) + 1


def test_solver_is_near_the_bound():
    r = np.random.default_rng(0)
    lengths = np.minimum(1023, np.exp(r.normal(5, 1, 200_000)).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = op1.solve(counts)
    held = {}
    for config, n in plan:
        assert sum(l * k for l, k in config.items()) <= 1024
        for l, k in config.items():
            held[l] = held.get(l, 0) + k * n
    assert held == counts
    assert sum(n for _, n in plan) <= 1.002 * lengths.sum() / 1024 + 1


def test_packing_of_nothing(spark):
    assert op1.pack(frame(spark, []).limit(0)).collect() == []


@pytest.mark.parametrize("seed,words,percent", [(1, 3, 85), (2, 5, 80), (4, 3, 85)])
def test_near_duplicates_match_brute_force(spark, seed, words, percent):
    docs = helpers.corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op2.near_duplicates(frame(spark, docs), words, percent).collect()}
    assert got == helpers.near_duplicates(docs, words, percent)


def test_rest_blocks_find_what_star_rounds_leave(spark, monkeypatch):
    docs = helpers.corpus(5)
    small = frame(spark, docs)
    base = op2.written(op2.sketches(small, 3)).where("n_shingles > 0")
    reps = base.groupBy("c1", "c2", "n_shingles").agg(op2.F.min("doc_id").alias("doc_id")).join(base.select("doc_id", "sketch"), "doc_id")
    monkeypatch.setattr(op2, "ALL_PAIRS", 1)
    monkeypatch.setattr(op2, "LIST_BLOCK", 4)
    label = {r.node: r.component for r in op2.links(reps, small, 3, 85, rounds=1).collect()}
    want = helpers.near_duplicates([d for d in docs if d[0] in {r.doc_id for r in reps.collect()}], 3, 85)
    assert all(label.get(d, d) == w[1] for d, w in want.items())
    # without star rounds all of it is left to the cells
    label = {r.node: r.component for r in op2.links(reps, small, 3, 85, rounds=0).where("node is not null").collect()}
    lists = [d for d in want if d in label]
    assert len(lists) > 10 and all(label[d] == want[d][1] for d in lists)


def test_sketches_keep_pairs_at_the_threshold(spark):
    # 96 of 120 words: a similarity of exactly 0.80, with sketches that reach into the upper half of the hashes
    words, pairs = [[f"w{i}x{k}" for k in range(120)] for i in range(10_000)], range(10_000)
    base = op2.sketches(frame(spark, [(2 * i, " ".join(words[i])) for i in pairs] + [(2 * i + 1, " ".join(words[i][:96])) for i in pairs]), 1).selectExpr("doc_id", "n_shingles", "sketch")
    base = op2.written(base)
    assert base.where("sketch <> array_sort(sketch)").count() == 0
    a, b = (base.where(f"doc_id % 2 = {r}").selectExpr("doc_id div 2 AS i", f"n_shingles AS n{x}", f"sketch AS k{x}") for r, x in enumerate("ab"))
    lost = a.join(b, "i").where(~op2._may_link(80, op2.K, op2.least_shared(op2.K, 80)))
    assert lost.count() == 0


def test_cells_of_a_list_of_loose_members_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(op2, "LIST_BLOCK", 20)
    size = {i: 40 + i % 60 for i in range(400)}  # each member a component of its own
    cells = op2._cells(spark.createDataFrame([(7, 400, i, n, i) for i, n in size.items()], "key long, n long, doc_id long, n_shingles long, label long"), 80).collect()
    held = {}
    for x in cells:
        held.setdefault(tuple(x.cell), ([], []))[x.visits].append(x.doc_id)
    assert max(len(a) + len(b) for a, b in held.values()) <= 4 * 20
    met = {(a, b) for home, guests in held.values() for a in home for b in guests}
    assert all((a, b) in met or (b, a) in met for a in size for b in size if a != b and 100 * min(size[a], size[b]) >= 80 * max(size[a], size[b]))


def test_near_duplicates_edges(spark):
    assert op2.near_duplicates(frame(spark, []).limit(0)).collect() == []
    rows = op2.near_duplicates(frame(spark, [(1, None), (2, ""), (3, "a b"), (4, "A  B"), (4, "A  B"), (5, "a")]), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False), (5, 1, 5, True)]


@pytest.mark.parametrize("order", [1, -1])
def test_near_duplicates_of_a_doc_id_with_two_texts(spark, order):
    base, other = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = [(5, base), (5, other), (7, base + " more"), (9, other + " more")][::order]
    assert {(r.doc_id, r.component_id) for r in op2.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), 3, 85).collect()} == {(5, 5), (7, 5), (9, 5)}
    assert [r.doc_id for r in op2.dedup(frame(spark, docs), 3, 85).collect()] == [5, 5]


@pytest.mark.parametrize("seed", [8, 9])
def test_near_duplicates_with_repeated_doc_ids(spark, seed):
    docs = [(d % 50, t) for d, t in helpers.corpus(seed)]
    got = op2.near_duplicates(frame(spark, docs), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == helpers.repeated_near_duplicates(docs, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def alternating(n):
    """The Thue-Morse word and its complement: a hash that is linear modulo a power of two can't tell them apart."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_in_linear_hashes_are_told_apart(spark):
    one, two = alternating(1024)
    words = [" ".join(x) for x in alternating(2048)]
    docs = [(1, f"x {one} y"), (2, f"x {two} y"), (3, one), (4, two), (5, words[0]), (6, words[1])]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op2.near_duplicates(frame(spark, docs), 3, 85).collect()}
    assert got == helpers.near_duplicates(docs, 3, 85)
    tail = " ".join(f"w{i}" for i in range(49))
    docs += [(10, f"{one} {tail}"), (11, f"{two} {tail}")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op4.dedup(frame(spark, docs)).collect()}
    assert got == helpers.substring_dedup(docs, 50)


def test_near_dedup_keeps_rows_without_a_doc_id_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", 0), (2, "a b c d e f", 1), (None, "a b c d e f", 2), (None, None, 3), (1, "a b c d e f", 4)]
    docs = spark.createDataFrame([(d, t, g, g, g, g) for d, t, g in rows], "doc_id long, text string, _gone long, sketch long, label long, n long")
    kept = op2.dedup(docs)
    assert kept.columns == docs.columns and sorted(x["_gone"] for x in kept.collect()) == [0, 2, 3, 4]


@pytest.mark.parametrize("seed,window", [(1, 50), (2, 50), (6, 12)])
def test_substring_dedup_matches_brute_force(spark, seed, window):
    docs = helpers.corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op4.dedup(frame(spark, docs), window).collect()}
    assert got == helpers.substring_dedup(docs, window)


@pytest.mark.parametrize("hot", [1, 3])
def test_substring_dedup_lengthens_hot_prefixes(spark, monkeypatch, hot):
    monkeypatch.setattr(op4, "HOT", hot)
    monkeypatch.setattr(op4, "GROUP", 16)
    docs = helpers.corpus(7, 60)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op4.dedup(frame(spark, docs)).collect()}
    assert got == helpers.substring_dedup(docs, 50)


def test_suffix_array_is_sorted_and_knows_common_prefixes():
    r = np.random.default_rng(1)
    for depth in (3, 8, 13):
        codes = r.integers(0, 3, 200)
        place = r.permutation(200 - depth)
        order, common = op4.suffix_array(codes, place, depth)
        said = [tuple(codes[p : p + depth]) for p in place[order]]
        assert said == sorted(said)
        assert common[0] == 0 and all(n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), depth) for a, b, n in zip(said, said[1:], common[1:]))


def test_substring_dedup_edges(spark):
    assert op4.dedup(frame(spark, []).limit(0)).collect() == []
    long = " ".join(f"w{i}" for i in range(60))
    rows = op4.dedup(frame(spark, [(1, long), (1, long), (2, long), (3, long + " " + long)]), with_text=True).collect()
    assert sorted((r.doc_id, r.n_removed, len(r.text)) for r in rows) == [(1, 0, len(long)), (1, 0, len(long)), (2, 60, 0), (3, 120, 0)]
    # rows without a doc_id, and a doc_id with two texts: each row has its answer
    other = " ".join(f"v{i}" for i in range(55))
    rows = op4.dedup(frame(spark, [(None, long), (None, None), (2, long), (2, other), (3, other + "  \n " * 1000 + long), (1, "x")]), with_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rows) == [(0, 0, 0), (0, 60, 0), (1, 1, 0), (2, 55, 0), (2, 60, 0), (3, 115, 115)]
