"""Copies of rows: matched once as classes, with the same rows as if each copy were matched by itself."""

from collections import Counter

from lectern.operators import matching
from lectern.operators.grouped import alike


def test_alike(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "a"), (4, "a", "b"), (4, "c", None), (5, "c", None), (5, "a", "b"), (5, "a", "b")], "id int, x string, y string")
    classes, members = alike(df, "id")
    of = {r.id: r["class"] for r in members.collect()}
    assert of[1] == of[2] != of[3] and of[4] == of[5] and len(set(of.values())) == 3
    assert Counter((r.id, r.x, r.y) for r in classes.collect()) == Counter({(of[1], "a", None): 1, (of[3], None, "a"): 1, (of[4], "a", "b"): 1, (of[4], "c", None): 1})


def test_documents_are_scored_as_classes(spark, monkeypatch):
    p = [("Large Ring", "F1", 90), ("Hot Bolt", "F1", 120), ("Large Bolt", None, 90)]
    d = [("plan large ring", "F1", [90]), ("hot bolt", None, []), ("bolt large", "F1", [120, 90])]
    names = "document_index int, text string, label string, faculty string, level string, ects_values array<int>, urls array<string>"

    def run(copies):
        programmes = spark.createDataFrame([(i * 10 + k, [n], f, "B", e, []) for i in range(copies) for k, (n, f, e) in enumerate(p)], "programme_index int, names array<string>, faculty string, level string, ects int, urls array<string>")
        documents = spark.createDataFrame([(i * 10 + k, t, "plan", f, "B", e, []) for i in range(copies) for k, (t, f, e) in enumerate(d)], names)
        return matching.match_documents(programmes, documents), matching.select_matches(matching.score_pairs(programmes, documents, strong=True))

    rows = lambda df: Counter((r.document_index, r.programme_index, r.score, tuple(r.reasons)) for r in df.select("document_index", "programme_index", "score", "reasons").collect())
    got, plain = run(4)
    assert rows(got) == rows(plain) and len(rows(got)) == 16 * len(rows(run(1)[0])) > 0
    scored = []
    plainly = matching.score_pairs
    monkeypatch.setattr(matching, "score_pairs", lambda *a, **k: scored.append(plainly(*a, **k)) or scored[-1])
    run(4)[0].count()
    one = scored[0].count()
    run(1)[0].count()
    assert one == scored[2].count()  # copies add no pair


def test_copies_of_names_add_no_link(spark):
    def sides(copies):
        wanted = spark.createDataFrame([(i * 10 + k, n, "M", 90.0) for i in range(copies) for k, n in enumerate(["Law", "Law and more", "Art", ""])], "id int, name string, level string, ects double")
        known = spark.createDataFrame([(i * 10 + k, n, "M", 90.0) for i in range(copies) for k, n in enumerate([["Law", "Recht"], ["Law and more", "law"], ["Music"], None])], "program_id int, names array<string>, level string, ects double")
        return wanted, known

    links = [matching.name_links(*sides(n))[0].count() for n in (1, 5)]
    assert links[0] == links[1] > 0
    pairs = matching.match_names(*sides(5)).collect()
    assert len({(r.id, r.program_id) for r in pairs}) == len(pairs) == 25 * links[0]
    want = {(i, n, min(r.how for r in pairs if r.id == i)) for i, n in Counter(r.id for r in pairs).items()}
    assert {tuple(r) for r in matching.count_names(*sides(5)).collect()} == want
