"""MinHash near-dedup: bottom-k sketches from one hash function, inverted lists, union-sketch filter, exact Jaccard.

1. A scan turns each text into its set of hashed word shingles and keeps the k smallest: the sketch. Texts
   with one and the same set, told by 128 bits, are a class, named by the first 64 of them (two classes have one name with a chance of
   n^2 / 2^65 for n classes). Links are between classes, so texts that share a doc_id are told apart until the end.
2. Inverted lists are kept of two retained values that follow each other among a sketch's first KEYED. For sets of at most KEYED
   shingles above the threshold such a list always exists. For larger ones: walk the union's sketch upwards; each of its values is in both sets with a
   chance of at least p (the threshold), and two neighbours that both sets hold make a list. No such neighbours among KEYED values
   have a chance of 8e-10 for p = 0.8 and 7e-12 for 0.85.
3. Lists give candidate pairs. Short ones are paired at once. In long ones star rounds hold all members against
   one; lists whose members are in one component are done. What stays is dealt to cells of bounded size, with its full sets: each
   cell finds its candidates by their sketches, verifies them, and lets out only pairs that join two components, so no
   candidate pair is ever a row. Documents of long lists know how many of their shingles no other document of long lists has;
   this gives an exact upper bound of a pair's similarity, which spares the loose members of a family.
4. Pairs whose union sketch says that they may reach the threshold are verified on the full shingle sets, by a
   second hash of the words, so that a link rests on 128 bits.

5. A doc_id with several texts is a document that has the links of all of them: its classes are joined, and all of its rows have
   one component.

Defined cases: a null text is an empty one; an empty set is linked with nothing; rows that repeat a doc_id, with one text or several,
are one document and share its component, whatever their order, each with the size of its own set; a row without a doc_id can't be named: it has no component, links
nothing but through its class, and stays in `dedup`; ties don't arise, as components are named by doc_id; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from math import comb, log
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.llm.common import SEEDS, Words, components, drop, hash_runs, identity, list_array, semi, small_batches, text_steps, written

#: Sketch size, and how many of its values make lists; star rounds; lists of up to ALL_PAIRS members are paired at
#: once, longer ones after the rounds in cells of LIST_BLOCK members or CELL_SHINGLES shingles; chance that the union sketch misses a pair.
K, KEYED, ROUNDS, ALL_PAIRS, LIST_BLOCK, CELL_SHINGLES, MISS = 64, 32, 2, 8, 1000, 500_000, 1e-9
#: (shingle words, percent) of the contract's query and of stages without a contract.
CONTRACT, STAGE = (3, 85), (5, 80)
#: Sketches are stored as signed numbers; with this bit turned their order is that of the unsigned hashes.
TOP = np.uint64(1 << 63)
SKETCH = "doc_id long, n_shingles long, c1 long, c2 long, sketch array<long>"


def _runs(w: Words, words: int, seed: int) -> list[np.ndarray]:
    """The hashes of each row's shingles, in order."""
    h = w.hashed(seed)
    runs, out = hash_runs(h, words), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        out.append(runs[a : b - words + 1] if b - a >= words else hash_runs(h[a:b], b - a))
    return out


def _class(first: np.ndarray, second: np.ndarray) -> tuple[int, int, np.ndarray]:
    """128 bits that tell a text's set, and the set by its first hashes."""
    own, at = np.unique(first, return_index=True)
    return *identity(own, second[at]), own


def sketches(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """doc_id, set size, the set's 128-bit identity, its k smallest values."""

    def run(batches):
        for rows, data, offsets in text_steps(batches):
            w, out = Words(data, offsets, lower=True), []
            for first, second in zip(_runs(w, words, SEEDS[0]), _runs(w, words, SEEDS[1])):
                c1, c2, own = _class(first, second)
                out.append((len(own), c1, c2, own[:k] ^ TOP))
            n, c1, c2, kept = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x, pa.int64()) for x in (n, c1, c2)), list_array(list(kept), np.uint64)], names=["doc_id", "n_shingles", "c1", "c2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def least_shared(k: int, percent: int, miss: float = MISS) -> int:
    """Shared values among the k of a union sketch that a pair above the threshold has, but for a chance of `miss`."""
    p, total = percent / 100, 0.0
    for x in range(k + 1):
        total += comb(k, x) * p**x * (1 - p) ** (k - x)
        if total > miss:
            return x
    return k


def _may_link(percent: int, k: int, least: int):
    """The shared part of the union sketch suffices (exact where both sketches hold whole sets)."""
    union = F.slice(F.array_sort(F.array_union("ka", "kb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("ka", "kb"), union))
    whole = 100 * F.size(F.array_intersect("ka", "kb")) >= percent * F.size(F.array_union("ka", "kb"))
    return F.when(F.greatest("na", "nb") <= k, whole).otherwise(shared >= least)


def _fits(na: str, ca: str, nb: str, cb: str, percent: int):
    """Exact upper bound: n shingles, c of them not private. The intersection is at most the smaller c; the union holds both
    private parts and the larger c."""
    return 100 * F.least(ca, cb) >= percent * (F.col(na) - F.col(ca) + F.col(nb) - F.col(cb) + F.greatest(ca, cb))


class Classes(NamedTuple):
    """Documents whose texts go by the names of their classes; names: doc_id (a class) and name (a doc_id with a text of it)."""

    docs: DataFrame
    names: DataFrame


def _sets(docs: DataFrame | Classes, ids: DataFrame, words: int) -> DataFrame:
    """doc_id and full shingle set, ascending, of the documents or classes named; hashed by the second seed.

    Texts of other classes that share a wanted doc_id come along.
    """
    named = isinstance(docs, Classes)

    def run(batches):
        for rows, data, offsets in text_steps(batches):
            w = Words(data, offsets, lower=True)
            second = _runs(w, words, SEEDS[1])
            sets = [np.unique(x.view(np.int64)) for x in second]
            yield pa.RecordBatch.from_arrays([pa.array([_class(x, y)[0] for x, y in zip(_runs(w, words, SEEDS[0]), second)], pa.int64()) if named else rows.column(0), list_array(sets)], names=["doc_id", "set"])

    if named:
        ids = written(ids.join(docs.names, "doc_id").select(F.col("name").alias("doc_id")).distinct())
        docs = docs.docs
    texts = semi(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), ids, "doc_id")
    return texts.mapInArrow(run, "doc_id long, set array<long>")


def _private(docs: DataFrame, crowd: DataFrame, words: int) -> DataFrame:
    """How many shingles each document of a crowd has that no other one of it has."""
    seen = _sets(docs, crowd, words).select("doc_id", F.explode("set").alias("shingle"))
    alone = seen.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("most")).where("doc_id = most")
    return crowd.join(alone.groupBy("doc_id").agg(F.count("*").alias("private")), "doc_id", "left").select("doc_id", F.coalesce("private", F.lit(0)).alias("private"))


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold, written."""
    wanted = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    sets = written(_sets(docs, wanted, words).dropDuplicates(["doc_id"]))
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    out = written(pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"))
    drop(wanted, sets)
    return out


def links(reps: DataFrame, docs: DataFrame, words: int, percent: int, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """Component of each representative that is linked with another: rows (node, component)."""
    least = least_shared(k, percent)
    keys = reps.where("n_shingles > 1").select("doc_id", F.explode(F.expr(f"transform(sequence(0, least(size(sketch), {KEYED}) - 2), i -> xxhash64(sketch[i], sketch[i + 1]))")).alias("key"))
    # written, so that Spark may split a very common list in the join
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    found = written(keys.join(shared, "key"))
    crowd = written(found.where(F.col("n") > ALL_PAIRS).select("doc_id").distinct())
    listed = written(found.select("doc_id").distinct())
    known = semi(reps, listed, "doc_id").join(_private(docs, crowd, words), "doc_id", "left")
    light = written(known.select("doc_id", "n_shingles", (F.col("n_shingles") - F.coalesce("private", F.lit(0))).alias("common"), F.col("private").isNotNull().alias("crowd"), "sketch"))
    lists = written(found.join(light.drop("sketch"), "doc_id"))
    drop(shared, found, crowd, listed)
    label, edges = None, None

    def labelled(members: DataFrame) -> DataFrame:
        if label is None:
            return members.withColumn("label", F.col("doc_id"))
        return members.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")

    def joined(more: DataFrame) -> None:
        nonlocal edges, label
        if more.take(1):
            spent, edges = edges, written(more if edges is None else edges.union(more))
            drop(spent)
            label = components(edges)

    long = lists.where(F.col("n") > ALL_PAIRS)
    for turn in range(rounds):
        members = labelled(long)
        # the leader: first the member with the fewest private shingles, later any
        rank = F.col("n_shingles") - F.col("common") if turn == 0 else F.lit(0)
        order = F.struct(rank, F.xxhash64("doc_id", F.lit(turn)), F.col("doc_id").alias("leader"), F.col("label").alias("leader_label"), F.col("n_shingles").alias("leader_n"), F.col("common").alias("leader_common"))
        mixed = members.groupBy("key").agg(F.min(order).alias("lead"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "lead.leader", "lead.leader_label", "lead.leader_n", "lead.leader_common")
        star = members.join(mixed, "key").where((F.col("label") != F.col("leader_label")) & _fits("n_shingles", "common", "leader_n", "leader_common", percent))
        pairs = star.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b"))
        if turn == 0:
            pairs = pairs.union(_meet(labelled(lists.where(F.col("n") <= ALL_PAIRS)), percent))
        met = written(pairs.distinct())
        a, b = (light.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"k{x}")) for x in "ab")
        likely = written(met.join(a, "a").join(b, "b").where(_may_link(percent, k, least)).select("a", "b"))
        more = _verified(likely, docs, words, percent)
        joined(more)
        drop(met, likely, more)
    # a member whose shingles are for the most part its own is above the threshold with nobody
    members = labelled(long.where(100 * F.col("common") >= percent * F.col("n_shingles")))
    mixed = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    rest = written(members.join(mixed, "key").select("key", "n", "doc_id", "n_shingles", "common", "label"))
    more = _rest(rest, docs, words, percent, k, least)
    joined(more)
    drop(lists, light, rest, more)
    return label if label is not None else reps.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component")).limit(0)


def _meet(members: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) within short lists whose labels differ and whose bound allows a link."""
    x, y = (members.select("key", F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("common").alias(f"c{c}"), F.col("crowd").alias(f"w{c}"), F.col("label").alias(f"l{c}")) for c in "ab")
    # what is private in the crowd may be shared with a document outside of it
    bound = F.when(F.col("wa") & F.col("wb"), _fits("na", "ca", "nb", "cb", percent)).otherwise(_fits("na", "na", "nb", "nb", percent))
    return x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & bound).select("a", "b")


def _cells(members: DataFrame, percent: int) -> DataFrame:
    """Members of mixed lists dealt to cells: key, cell, doc_id, label, visits.

    A cell holds about LIST_BLOCK members of a list at home, or CELL_SHINGLES shingles, and as many guests, members outside the list's
    largest component; each pair with different labels meets in one of them. Lists of over LIST_BLOCK members are cut in
    bands of size first: two sets above the threshold are in one band or in neighbouring ones.
    """
    width = max(log(100 / percent), 0.01) * (1 + 1e-9)
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "label")).alias("x")).select("key", F.col("x.label").alias("main"))
    band = F.when(F.col("n") > LIST_BLOCK, F.floor(F.log("n_shingles") / width)).otherwise(0).cast("int")
    rows = written(members.join(main, "key").select("key", "doc_id", "n_shingles", "label", band.alias("band"), (F.col("label") != F.col("main")).alias("loose")))
    blocks = lambda which: F.greatest(F.ceil(F.count(which) / LIST_BLOCK), F.ceil(F.coalesce(F.sum(which), F.lit(0)) / CELL_SHINGLES)).cast("int")
    bands = written(rows.groupBy("key", "band").agg(blocks(F.col("n_shingles")).alias("homes"), blocks(F.when(F.col("loose"), F.col("n_shingles"))).alias("guests")))
    block = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), n).cast("int")
    other = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))
    own = rows.join(bands, ["key", "band"])
    theirs = lambda c: bands.where(F.col(c) > 0).select("key", F.col("band").alias("to"), F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias("at"))
    home = own.withColumn("to", other).join(theirs("guests"), ["key", "to"]).select("key", F.struct(F.col("band").alias("h"), block(F.col("homes"), 0).alias("i"), F.col("to").alias("g"), F.col("at").alias("j")).alias("cell"), "doc_id", "label", F.lit(False).alias("visits"))
    visits = own.where("loose").withColumn("to", other).join(theirs("homes"), ["key", "to"]).select("key", F.struct(F.col("to").alias("h"), F.col("at").alias("i"), F.col("band").alias("g"), block(F.col("guests"), 1).alias("j")).alias("cell"), "doc_id", "label", F.lit(True).alias("visits"))
    return home.union(visits)


def _forest(home: pd.DataFrame, guests: pd.DataFrame, key: int, percent: int, k: int, least: int) -> list[tuple[int, int]]:
    """Verified links of a cell that join two components: fewer than it has labels.

    Two documents that share several mixed lists are held against each other in the one with the smallest key.
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            x = up
        return x

    def padded(lists, width):
        out = np.full((len(lists), width), np.iinfo(np.int64).max)
        for row, values in zip(out, lists):
            row[: min(len(values), width)] = values[:width]
        return out

    labels, ids, sizes, common = (home[c].to_numpy() for c in ("label", "doc_id", "n_shingles", "common"))
    sets = home["set"].tolist()
    keys, sketch = padded(home["keys"], KEYED), padded(sets, k)  # the least of the set are a sketch by its own hash
    links = []
    for doc, label, n, c, gk, gs in guests[["doc_id", "label", "n_shingles", "common", "keys", "set"]].itertuples(index=False):
        at = np.flatnonzero((labels != label) & (100 * np.minimum(common, c) >= percent * (sizes - common + n - c + np.maximum(common, c))))
        if len(at):
            at = at[~(np.isin(keys[at], gk[gk < key])).any(axis=1)]
        if len(at):
            shared = np.isin(sketch[at], gs[:k]).sum(axis=1)
            at = at[np.where(np.maximum(sizes[at], n) <= k, 100 * shared >= percent * (sizes[at] + n - shared), shared >= least)]
        mine = find(label)
        at = at[[find(x) != mine for x in labels[at].tolist()]] if len(at) else at
        for lo in range(0, len(at), 64):
            some = at[lo : lo + 64]
            values = np.concatenate([sets[i] for i in some])
            place = np.minimum(np.searchsorted(gs, values), len(gs) - 1)
            begin = np.cumsum(sizes[some]) - sizes[some]
            both = np.add.reduceat((gs[place] == values).astype(np.int64), begin)
            for i in some[100 * both >= percent * (sizes[some] + n - both)].tolist():
                x, y = find(int(labels[i])), find(label)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((min(doc, int(ids[i])), max(doc, int(ids[i]))))
    return links


def _rest(members: DataFrame, docs: DataFrame, words: int, percent: int, k: int, least: int) -> DataFrame:
    """Verified links (a, b) in long lists that still hold several components, found cell by cell; written."""
    own = members.groupBy("doc_id").agg(F.array_sort(F.collect_list("key")).alias("keys"), F.first("n_shingles").alias("n_shingles"), F.first("common").alias("common"))  # at most KEYED - 1 keys
    wanted = written(members.select("doc_id").distinct())
    full = written(own.join(_sets(docs, wanted, words).dropDuplicates(["doc_id"]), "doc_id"))

    def run(frame):
        links = _forest(frame[~frame["visits"]], frame[frame["visits"]], frame["key"].iloc[0], percent, k, least)
        return pd.DataFrame(links, columns=["a", "b"]).astype(np.int64)

    out = written(_cells(members, percent).join(full, "doc_id").groupBy("key", "cell").applyInPandas(run, "a long, b long"))
    drop(wanted, full)
    return out


def near_duplicates(docs: DataFrame, words: int = STAGE[0], percent: int = STAGE[1], k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id)."""
    small_batches(docs.sparkSession)
    base = written(sketches(docs, words, k))
    full = base.where("n_shingles > 0")
    classes = written(full.groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    key = ["c1", "c2", "n_shingles"]
    reps = full.join(classes.where("rep is not null").select(*key, F.col("rep").alias("doc_id")), [*key, "doc_id"], "left_semi").dropDuplicates(["c1"]).select(F.col("c1").alias("doc_id"), "n_shingles", "sketch")
    label = links(reps, Classes(docs, classes.where("rep is not null").select(F.col("c1").alias("doc_id"), F.col("rep").alias("name"))), words, percent, k)
    found = written(classes.join(label, F.col("c1") == F.col("node"), "left").select(*key, "rep", F.coalesce("component", "c1").alias("group")))
    # documents with several sets join the groups of their classes
    rows = base.select("doc_id", *key)
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi")).where("lo <> hi").select("doc_id")
    held = written(rows.join(several, "doc_id", "left_semi").join(found, key, "left").select("doc_id", "group").distinct())
    more = written(held.join(held.groupBy("doc_id").agg(F.min("group").alias("least")), "doc_id").where("group <> least").select(F.col("group").alias("a"), F.col("least").alias("b")))
    if more.take(1):
        spent, joined = found, components(more)
        found = written(found.join(joined, F.col("group") == F.col("node"), "left").select(*key, "rep", F.coalesce("component", "group").alias("group")))
        drop(spent)
    least = found.groupBy("group").agg(F.min("rep").alias("component_id"))
    named = rows.join(found.join(least, "group").select(*key, "component_id"), key, "left")
    # an empty text of a document that has others has their component
    whole = named.join(held.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("of_all"))
    own = F.coalesce("of_all", "component_id", "doc_id")
    return named.join(whole, "doc_id", "left").select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept"))


def dedup(docs: DataFrame, words: int = STAGE[0], percent: int = STAGE[1]) -> DataFrame:
    """The documents less all but one (the smallest doc_id) of each group of near-duplicates; rows without a doc_id stay."""
    gone = near_duplicates(docs, words, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
