"""The similarity join of names against the plain double loop, loose JSON and deep traversals."""

import difflib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators import html as H
from lectern.operators import similarity as S
from lectern.plans import catalogue
from lectern.sources import readers


def plain(left, right, least):
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    return {(a, b, round(r, 9)) for a in set(left) - {None} for b in set(right) - {None} if (r := ratio(a, b)) >= least}


def table(spark, names):
    return spark.createDataFrame([(n, "x") for n in names], "name string, words string")


@pytest.mark.parametrize("least", [0.6, 0.8, 0.9, 1.0])
def test_same_as_all_pairs(spark, least):
    r = random.Random(1)
    words = ["".join(r.choice("abcde é") for _ in range(r.randint(0, 14))) for _ in range(50)]

    def near(w):
        w = list(w)
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(w))
            w[k : k + r.randint(0, 1)] = r.choice(["", "z", "a"])
        return "".join(w)

    left, right = [*words, None, "", "a"], [near(w) for w in words + words] + [None, "", "aa"]
    got = {(x.a, x.b, round(x.ratio, 9)) for x in S.similar_names(table(spark, left), table(spark, right), least).collect()}
    assert got == plain(left, right, least)


def test_bound():
    assert S.least_shared(10, 0.8) == 3 and S.least_shared(20, 0.9) >= 10 and S.least_shared(3, 0.8) == 0


def test_parts(spark, sf_dir):
    names = [r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws(" ", "p_name", F.lower("p_type"))).distinct().collect()]
    got = {(x.a, x.b, x.ratio) for x in catalogue.QUERIES["similar_part_names"](spark, sf_dir).collect()}
    assert got == {(a, b, round(r, 6)) for a, b, r in plain(names, names, 0.85) if a < b}


def test_broken_objects_are_skipped_whole(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1, "b": {"a": 9}}, {"a": {"a": 2}, oops {"a": 3}}, {"a": 4}] {"a": 5, "b": "}{"\n{"a": "open\n{"a": 6}\n' + "{" * 20_000)
    assert [r.a for r in readers.json_loose(spark, str(tmp_path / "x.json"), StructType.fromDDL("a int")).collect()] == [1, 4, 6]


def test_traversal_of_twenty_levels(spark):
    links = [(f"p{i}", f"p{i + s}") for i in range(60) for s in (1, 2, -3)]
    want = {"p0": 0}
    for depth in range(1, 21):
        want = {b: depth for a, b in links if a in want} | want
    edges = spark.createDataFrame([*links, ("p0", None)], "source string, target string")
    assert {r.url: r.depth for r in H.reachable(spark.createDataFrame([("p0",), (None,)], "url string"), edges, 20).collect()} == want and max(want.values()) == 20
    assert H.reachable(spark.createDataFrame([], "url string"), edges, 20).count() == 0
