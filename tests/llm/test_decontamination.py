from compare import assert_same

from lectern.llm import decontamination as C


def words(n, tag="w"):
    return [f"{tag}{i}" for i in range(n)]


def test_same_as_sql(spark, sf_dir, duck):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert_same(C.contaminated(docs, bench), duck.sql(C.ORACLE_SQL))


def test_substitutions_and_edges(spark, docs_of):
    item = words(30)
    sub = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(item))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "short text here"), (3, None), (4, " ?! "), (None, "x y z"), (5, " ".join(words(10, "t")))], "item_id long, text string")
    cases = {
        1: ("lead in " + sub() + " tail", {1}), 2: (sub(5, 9).upper(), {1}), 3: (sub(*range(0, 30, 3)), set()), 4: (" ".join(item[3:16]), {1}), 5: (" ".join(item[3:13]), set()),
        6: ("a short, text: here!", {2}), 7: ("a short texts here", set()), 8: (None, set()), 9: ("", set()), 10: (sub(*range(2, 30, 6)), {1}), 11: (" ".join(words(10, "t")[:4] + ["z"] + words(10, "t")[5:]), {5}),
        12: ("t0 " * 5000, set()),
    }
    df = docs_of([(k, t) for k, (t, _) in cases.items()] + [(None, sub()), (1, "clean row of the same id")])
    for blocks in (C.BLOCK_SEEDS, 20):
        found = C.overlaps(df, bench, blocks).collect()
        assert {(r.doc_id, r.item_id) for r in found} == {(k, i) for k, (_, s) in cases.items() for i in s} | {(None, 1)}
    rows = C.contaminated(df, bench).collect()
    assert len(rows) == 14 and sorted(r.contaminated for r in rows if r.doc_id == 1) == [False, True]
    kept = C.drop_contaminated(df, C.overlaps(df, bench))
    assert kept.columns == df.columns and kept.count() == 14 - sum(r.contaminated for r in rows)
    assert C.contaminated(df.limit(0), bench).count() == 0 and C.overlaps(df, bench.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, docs_of):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = C.contaminated(docs_of([(1, "a")]), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_very_long_text_and_equal_items(spark, docs_of):
    item = words(30)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item).upper()), (3, " ".join(words(20, "v"))), (9, " ".join(item))], "item_id long, text string")
    filler = [f"f{i % 977}" for i in range(400_000)]
    text = " ".join([*filler[:200_000], *item, *filler[200_000:], *item[5:20]] + item * 500)
    rows = C.contaminated(docs_of([(1, text), (2, " ".join(filler)), (3, " ".join(item)), (3, " ".join(item))]), bench).collect()
    assert sorted((r.doc_id, r.items) for r in rows) == [(1, "1,2,9"), (2, ""), (3, "1,2,9"), (3, "1,2,9")]
