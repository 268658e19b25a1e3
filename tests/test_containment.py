"""Containment joins against plain loops over all pairs."""

import random

import pytest

from lectern.operators import containment as C
from lectern.operators import matching


def column(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def words(seed, n, letters="ab ", longest=12):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(n)]


def plain(texts, names):
    return sorted({(t, n) for t in texts if t is not None for n in names if n and n in t})


@pytest.mark.parametrize("block", [1, 30, 10**6])
def test_names_held(spark, block):
    texts, names = [*words(1, 80, longest=30), None, "", "éa b"], [*words(2, 60, longest=5), None, "", "éa", "a", "a"]
    got = C.names_held(column(spark, "text", set(texts)), "text", column(spark, "name", names), ["text"], block)
    assert sorted(tuple(r) for r in got.collect()) == plain(set(texts), names)


def test_rows_keep_their_columns(spark):
    rows = spark.createDataFrame([(1, "xay", [1]), (1, "xay", [1]), (2, None, None), (3, "b", [])], "name int, t string, more array<int>")
    got = C.names_held(rows.withColumnRenamed("name", "id"), "t", column(spark, "name", ["a", "y"]), ["id", "more"])
    assert sorted(map(tuple, got.collect())) == [(1, [1], "a"), (1, [1], "a"), (1, [1], "y"), (1, [1], "y")]


@pytest.mark.parametrize("gram", [1, 3, 4])
def test_names_that_hold(spark, gram):
    names, texts = [*words(3, 90), None, "", "日本語の本"], [*words(4, 70, longest=6), None, "", "日本", "本", "nowhere"]
    got = C.names_that_hold(column(spark, "name", names), column(spark, "text", texts), gram)
    assert sorted(tuple(r) for r in got.collect()) == sorted((t, n) for n, t in plain(names, texts))


def test_nothing(spark):
    none, some = column(spark, "text", []), column(spark, "name", ["a"])
    assert C.names_held(none, "text", some, ["text"]).count() == 0 and C.names_held(column(spark, "text", ["a"]), "text", column(spark, "name", []), ["text"]).count() == 0
    assert C.names_that_hold(some, none).count() == 0


@pytest.mark.parametrize("limit", [10, 10**6])
def test_tree_lookup(spark, limit):
    rows = spark.createDataFrame([(1, "Root / SES / Droit"), (2, "root / management"), (3, "x"), (4, None), (5, "")], "id int, tree string")
    keys = spark.createDataFrame([("LAW", "Droit", 1), ("SES", "Management", 2), ("X", None, 3), (None, "management", 0)], "key string, name string, priority int")
    got = dict(matching.tree_lookup(rows, "tree", keys.where("key is not null"), limit=limit).select("id", "tree_key").collect())
    assert got == {1: "LAW", 2: "SES", 3: "X", 4: None, 5: None}


def test_match_names(spark):
    r = random.Random(5)
    level = lambda: r.choice([None, "B", "M"])
    ects = lambda: r.choice([None, 90.0, 120.0])
    wanted = [(i, w.upper() + " ", level(), ects()) for i, w in enumerate(words(6, 60, longest=7))] + [(900, None, "B", 90.0)]
    known = [(i, [a, None, b], level(), ects()) for i, (a, b) in enumerate(zip(words(7, 60, longest=7), words(8, 60, longest=4)))]
    got = matching.match_names(spark.createDataFrame(wanted, "id int, name string, level string, ects double"), spark.createDataFrame(known, "program_id int, names array<string>, level string, ects double"))
    want = set()
    for i, w, lv, e in wanted:
        w = (w or "").lower().strip(" ")
        if not w or lv is None:
            continue
        same = [(k, {x.lower().strip(" ") for x in n if x} - {""}) for k, n, kl, ke in known if kl == lv and ke == e]
        exact = {(i, k, "exact") for k, n in same if w in n}
        want |= exact or {(i, k, "contains") for k, n in same if any(x in w or w in x for x in n)}
    assert {tuple(x) for x in got.collect()} == want
