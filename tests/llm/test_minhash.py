import random
from collections import Counter

import numpy as np

from lectern.llm import minhash as M


def shingles(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def plain(a, b):
    both = set(a) | set(b)
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in both) for d in a if d in b)


def classes(pairs):
    ids = [i for i, _ in pairs]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = {i: shingles(t) for i, t in pairs}
    for k, (a, ta) in enumerate(pairs):
        for b, tb in pairs[k + 1 :]:
            if ta is not None and tb is not None and (ta == tb or plain(s[a], s[b]) >= 0.8):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def texts(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 7, 60, 200]))]
        for _ in range(r.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    repeated = " ".join(["same old line of five words"] * 30)
    return [*out, repeated, repeated + " end", "", "", None, None, "one", "one", "one two"]


def test_same_as_brute_force(docs_of):
    pairs = list(enumerate(texts()))
    want = classes(pairs)
    got = {r.doc_id: r.class_id for r in M.near_duplicates(docs_of(pairs)).collect()}
    assert got == want


def test_similarity_is_exact():
    r = random.Random(1)
    for _ in range(40):
        a = Counter(r.choices(range(12), k=r.randint(1, 30)))
        b = Counter(r.choices(range(12), k=r.randint(1, 30)))
        arrays = [(np.array(sorted(c), np.uint64), np.array([float(c[k]) for k in sorted(c)])) for c in (a, b)]
        assert abs(M.probability_jaccard(*arrays) - plain(a, b)) < 1e-9


def test_signatures_estimate_it():
    a = Counter({i: 1 + i % 4 for i in range(80)})
    b = Counter({i: 1 + i % 3 for i in range(10, 95)})
    doc = np.array([0] * len(a) + [1] * len(b))
    e = np.array([*a, *b], np.uint64)
    with np.errstate(over="ignore"):
        s = M.probminhash(doc, M.mix(e + np.uint64(77)), np.array([*a.values(), *b.values()], float), 2, 4096)
    assert abs((s[0] == s[1]).mean() - plain(a, b)) < 0.04


def test_blocks_find_what_hubs_miss(docs_of, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 2)
    monkeypatch.setattr(M, "HUB_GROUP", 2)
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    base = [word() for _ in range(150)]
    chain = [list(base)]
    for _ in range(12):  # every text is near the next, the ends are far apart
        nxt = list(chain[-1])
        nxt[r.randrange(150)] = word()
        nxt[r.randrange(150)] = word()
        chain.append(nxt)
    pairs = [(i, " ".join(c)) for i, c in enumerate(chain)]
    want = classes(pairs)
    assert {r.doc_id: r.class_id for r in M.near_duplicates(docs_of(pairs)).collect()} == want


def test_drop_and_edges(docs_of):
    df = docs_of([(2, "a b c d e f"), (1, "a b c d e f"), (5, None), (5, None), (None, "a b c d e f"), (7, "other text here now ok"), (7, "other text here now ok")])
    kept = M.drop_near_duplicates(df)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 5), (False, 7), (True, 0)]
    assert kept.columns == df.columns
    assert M.near_duplicates(df.limit(0)).count() == 0 and M.drop_near_duplicates(df.limit(0)).count() == 0


def test_ids_with_several_texts(docs_of):
    a, b, c, near = "one two three four five six", "red green blue black white grey", "sun moon star sky sea land", " ".join(f"w{i}" for i in range(80))
    df = docs_of([(7, a), (7, b), (7, None), (7, b), (3, a), (9, b), (9, c), (8, near), (8, near + " end"), (7, near + " stop")])
    classes = {(r.doc_id, r.class_id) for r in M.near_duplicates(df).collect()}
    assert classes == {(7, 3), (7, 7), (3, 3), (9, 7), (9, 9), (8, 7)}
    kept = sorted(((r.doc_id, r.text) for r in M.drop_near_duplicates(df).collect()), key=str)
    assert kept == sorted([(3, a), (7, b), (7, None), (9, c), (7, near + " stop")], key=str)
    again = docs_of([(8, near), (8, near + " end")])
    assert M.drop_near_duplicates(again).count() == 1


def test_recall_on_the_table(spark, sf_dir):
    """All pairs at or above the threshold, found by an index of shingles, against the classes: none is missed, none made up."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()]
    bags = {i: shingles(t) for i, t in rows if t is not None}
    index, pairs = {}, set()
    for i, bag in bags.items():
        for s in bag:
            pairs |= {(j, i) for j in index.get(s, ())}
            index.setdefault(s, []).append(i)
    size = {i: sum(b.values()) for i, b in bags.items()}
    near = set()
    for a, b in pairs:
        x, y = bags[a], bags[b]
        # shared weight bounds the similarity from above
        if sum(min(x[e] / size[a], y[e] / size[b]) for e in x.keys() & y.keys()) >= 0.8 and plain(x, y) >= 0.8:
            near.add((a, b))
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.doc_id: r.class_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i, _ in rows} and len(near) > 50
