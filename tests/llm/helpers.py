"""Brute-force twins of the contracts, on plain Python data."""

import hashlib
import random
import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def repeated_near_duplicates(docs, words, percent):
    """Sorted (doc_id, set size, component) of every row, where a doc_id with several texts has the links of all of them."""
    alone = near_duplicates([(i, t) for i, (_, t) in enumerate(docs)], words, percent)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, (d, _) in enumerate(docs):
        root[find(("row", alone[i][1]))] = find(("doc", d))
    least = {}
    for d, _ in docs:
        least[find(("doc", d))] = min(d, least.get(find(("doc", d)), d))
    return sorted((d, alone[i][0], least[find(("doc", d))]) for i, (d, _) in enumerate(docs))


def near_duplicates(docs, words, percent):
    sets = {}
    for doc, text in docs:
        w = SPACE.findall(lower(text))
        sets[doc] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def substring_dedup(docs, window):
    words = {d: SPACE.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed, n=120):
    """Texts with copies, near copies, shared passages, empty and null ones, odd spaces."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(300)]
    say = lambda k: [r.choice(vocab) for _ in range(k)]
    shared, docs = [say(70) for _ in range(3)], []
    for i in range(n):
        kind = r.random()
        if kind < 0.1 or not docs:
            text = " ".join(say(r.randint(1, 400)))
        elif kind < 0.3:
            text = r.choice(docs)[1]
        elif kind < 0.7:
            w = (r.choice(docs)[1] or "x").split(" ")
            for _ in range(r.randint(1, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = r.choice(vocab)
            text = " ".join(w)
        elif kind < 0.9:
            p = r.choice(shared)
            lo = r.randint(0, 15)
            text = " ".join(say(r.randint(0, 40)) + p[lo : lo + r.randint(40, 70)] + say(r.randint(0, 60)))
        else:
            text = r.choice(["", None, " \t\n", "one", "Two words", "A b\x0bc\x0cd\r\ne " * 30, "   x" * 40])
        docs.append((i * 7 % n, text))
    return docs


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def line_dedup(docs, edits, min_chars):
    rows = sorted({(d, i + 1, l) for d, t in docs if t is not None for i, l in enumerate(t.split("\n"))})
    first = {}
    for d, i, l in rows:
        first.setdefault(l, (d, i))
    long_ = [l for l in first if len(l) >= min_chars]
    near = {l: [m for m in long_ if m != l and abs(len(l) - len(m)) <= edits and edit_distance(l, m) <= edits] for l in long_}
    out = {}
    for d, i, l in rows:
        others = near.get(l, [])
        early = min([first[l], *(first[m] for m in others)])
        out[d, i] = (*first[l], len(others), not (SPACE.search(l) and early < (d, i)))
    return out


def base_spans(text):
    """The contract's patterns, as they stand."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def quality(text):
    w = SPACE.findall(text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    again = {g for g in windows if windows.count(g) > 1} if len(windows) < 400 else {g for g, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {j for i, g in enumerate(windows) if g in again for j in range(i, i + 5)}
    lines = [l for l in (text or "").split("\n") if SPACE.search(l)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))
