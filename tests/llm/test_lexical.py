"""Ranked lexical search against a plain score of every document."""

import re
from collections import Counter

import numpy as np
import pytest
from compare import assert_same

from lectern.llm import lexical_search as ls
from lectern.llm import queries

ITEMS = "item_id long, text string, score double, rank int"


def plain(pairs, items, top=50):
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(i, c, sum(c.values())) for i, t in pairs if (c := Counter(terms(t)))]
    total = sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = set()
    for item, text in items:
        rows = []
        for i, c, n in docs:
            m = 100 - 50 + 50 * n * len(docs) // total
            score = sum(ls.weight(len(docs), df[t]) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score:
                rows.append((-score, i))
        out |= {(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(rows)[:top])}
    return out


def run(spark, docs, items, **args):
    table = spark.createDataFrame([(i, t, 1.0, 7) for i, t in items], ITEMS)
    return {tuple(r) for r in ls.search(docs, table, **args).collect()}


def test_terms():
    assert ls.split_terms("Äb-C_d\tE9 École\x7f日本、x".encode()) == [t.encode() for t in ("Äb", "c", "d", "e9", "École", "日本、x")]


@pytest.mark.parametrize("shard", [1, 40, 10**6])
def test_same_as_plain(spark, docs_of, monkeypatch, shard):
    monkeypatch.setattr(ls, "SHARD_POSTINGS", shard)
    r = np.random.default_rng(4)
    words = [f"w{int(k)}" for k in r.zipf(1.3, 4000) % 60]
    pairs = [(i, " ".join(words[17 * i % 3900 :][: int(r.integers(0, 60))])) for i in range(300)]
    pairs += [(400 + i, "W1 w2, w3") for i in range(70)] + [(900, None), (901, ""), (902, "w5 " * 40_000), (903, "...")]
    items = [(0, "w1 w2 w3 w50"), (1, "W7 w7 w9"), (2, "nowhere"), (3, None), (4, ""), (5, " ".join(f"w{k}" for k in range(60)))]
    assert run(spark, docs_of(pairs).repartition(5), items) == plain(pairs, items)
    assert run(spark, docs_of(pairs), items, top=3, block_bytes=20) == plain(pairs, items, 3)


def test_ties_repeats_and_nulls(spark, docs_of):
    docs = docs_of([(5, "a b"), (3, "a b"), (3, "a b"), (None, "a b"), (1, "c")])
    assert [(r.rank, r.doc_id) for r in ls.search(docs, spark.createDataFrame([(1, "a"), (1, "a")], "item_id int, text string")).orderBy("rank").collect()] == [(1, 3), (2, 3), (3, 5), (4, None)]
    several = ls.search(docs, spark.createDataFrame([(1, "a"), (1, "c")], "item_id int, text string")).orderBy("rank").collect()
    assert [r.rank for r in several] == [1, 2, 3, 4, 5]


def test_empty(spark, docs_of):
    assert not run(spark, docs_of([]), [(1, "a")])
    assert not run(spark, docs_of([(1, "a")]), [])
    assert not run(spark, docs_of([(1, None), (2, "")]), [(1, "a")])


def test_lists_are_left_early():
    """Only a part of long lists is read where few documents stand out, and ties with the last place keep the search going."""
    n = 50_000
    impact = np.ones(2 * n, np.int64) * 10
    impact[np.arange(0, 400, 2)] = 1000 + np.arange(200)
    shard = ls.Shard(np.arange(n), np.zeros(n, np.int64), np.repeat(np.arange(n), 2), np.tile([0, 1], n), impact)
    member = np.ones(2, bool)
    best, read = shard.search(np.array([0, 1]), member, np.zeros((0, 3), np.int64), 50)
    assert best[:, 2].tolist() == list(range(199, 149, -1)) and read < 2000
    best, read = shard.search(np.array([0, 1]), member, np.zeros((0, 3), np.int64), 250)
    assert best[:, 2].tolist() == [*range(199, -1, -1), *range(200, 250)] and read == 2 * n


def test_same_as_sql(spark, sf_dir, duck):
    assert_same(queries.op11_lexical_search(spark, sf_dir), duck.sql(queries.ORACLE_SQL["op11_lexical_search"]))
