"""Overlap joins of word sets against a loop over all pairs, and that frequent words make no candidates."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import overlap
from lectern.operators.overlap import overlap_pairs


def sets(spark, name, rows):
    return spark.createDataFrame([(i, g, w, "x") for i, (g, w) in enumerate(rows)], f"{name} int, g string, words array<string>, size string")


def made(seed, n, most):
    r = random.Random(seed)
    words = [f"w{min(int(r.paretovariate(0.5)), 60)}" for _ in range(400)]
    return [(r.choice([None, "a", "b"]), sorted(set(r.sample(words, r.randint(0, most))))) for _ in range(n)]


@pytest.mark.parametrize(("need", "least"), [(lambda s: 1, 1), (lambda s: 2, 2), (lambda s: max(2, -(-6 * s // 10)), 2), (lambda s: s, 1), (lambda s: s // 2 + 1, 1)])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_same_as_all_pairs(spark, need, least, by):
    left, right = made(1, 80, 14), made(2, 60, 7)
    sizes = {s: need(s) for s in range(20)}
    column = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("size"))
    got = {tuple(r) for r in overlap_pairs(sets(spark, "left_id", left), sets(spark, "right_id", right), column, by, least).collect()}
    want = {(i, j, n) for i, (g, a) in enumerate(left) for j, (h, b) in enumerate(right) if (not by or g == h) and (n := len(set(a) & set(b))) >= max(need(len(b)), least)}
    assert got == want


def test_empty(spark):
    some = [("a", ["x"])]
    for left, right in (([], some), (some, []), ([("a", [])], some), (some, [("a", None)])):
        assert overlap_pairs(sets(spark, "left_id", left), sets(spark, "right_id", right), F.lit(1)).count() == 0


def test_frequent_words_are_not_met(spark, monkeypatch):
    """All sets share two words; only those that share a rare one too are ever compared."""
    left = [("a", ["the", "of", f"l{i}"]) for i in range(300)]
    right = [("a", ["the", "of", f"l{i}", f"l{i + 1}"]) for i in range(0, 300, 3)]
    written = []
    keep = overlap.persist_shared
    monkeypatch.setattr(overlap, "persist_shared", lambda df, label: written.append(label) or keep(df, label))
    pairs = overlap_pairs(sets(spark, "left_id", left), sets(spark, "right_id", right), F.lit(3), least=3)
    assert pairs.count() == 200 and written == ["right-sets", "left-words", "word-weights", "left-sets", "right-sets"]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoopJoin" not in plan
