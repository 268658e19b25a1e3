"""Queries over whole tables against brute force."""


from collections import defaultdict

from lectern.operators import etl
from lectern.plans import catalogue, endpoints
from lectern.plans.derived import tables


def test_equivalence_components(spark, tmp_path):
    # far keys, small quantities and keys that a modulus of 2,000 would merge
    lines = [(1, 5, 1.0), (2001, 5, 50.0), (2001, 7, 2.0), (5, 2005, 50.0), (4001, 2007, 3.0), (7, 9, 1.0), (None, 9, 1.0), *[(10_000 + i, 20_000 + i // 3, 1.0) for i in range(3000)]]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, _ in lines:
        if a is not None:
            x, y = sorted((find(a), find(-b - 1)))
            root[y] = x
    got = {r.id: r.component for r in catalogue.QUERIES["equivalence_components"](spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in root} and len(got) > 4000 and got[1] == got[2001] != got[5] != got[4001]


def test_token_jaccard(spark, sf_dir):
    parts = {r.p_partkey: (r.p_brand, frozenset(r.p_name.lower().split(" "))) for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, (p, x) in parts.items() for b, (q, y) in parts.items() if a < b and p == q and x & y}
    rows = catalogue.QUERIES["token_jaccard"](spark, sf_dir).collect()
    of = defaultdict(list)
    for r in rows:
        if r.kind == "member":
            of[r.a].append(r.b)
    whole = lambda c: [c, *of[c]]
    got = {(a, b): 1.0 for c in list(of) for a in whole(c) for b in whole(c) if a < b}
    for r in rows:
        if r.kind == "classes":
            got |= {(min(a, b), max(a, b)): r.similarity for a in whole(r.a) for b in whole(r.b)}
    assert got == want and len(want) > 100


def test_document_matching(spark, tmp_path):
    names = ["large ring", "large bolt", "hot ring", "hot gear", "blue plate", "steel"]
    parts = [(k, names[k % 6], f"Brand#{k % 2}", ("LARGE", "SMALL", "ECONOMY")[k % 3], (1, 7, 10, 11, 30, 50)[k * 5 % 7 % 6]) for k in range(1, 40)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for dk, dn, db, _, ds in parts:
        ok = []
        for k, n, b, t, s in parts:
            ratio, overlap = max((len(x & set(dn.split())) / len(x), len(x & set(dn.split()))) for x in (set(n.split()), {*n.split(), t.lower()}))
            name = 8 if ratio >= 0.95 and overlap else 6 if ratio >= 0.6 and overlap > 1 else 4 if overlap > 1 else 2 if overlap else 0
            score = 3 + (5 if s == ds else -4) + name
            if b == db and overlap and score >= 9 and name > 2 and (s == ds or ratio >= 0.95):
                ok.append((k, score, s == ds))
        agreeing = [x for x in ok if x[2]]
        best = max((x[1] for x in agreeing), default=0)
        want |= {(dk * 10, k, score) for k, score, _ in agreeing if score >= best - 2}
    got = {(r.document_index, r.programme_index, r.score) for r in catalogue.QUERIES["document_matching"](spark, str(tmp_path)).collect()}
    assert got == want and {x[0] // 10 for x in got} == {p[0] for p in parts}


def test_timetables_of_all_courses(spark, tmp_path):
    orders = [(k, k % 3, ("F", "O", "P")[k % 7 % 3], 100.0 * k, "1-URGENT") for k in range(1, 200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda q: catalogue.QUERIES[q](spark, str(tmp_path)).collect()
    start, end = lambda k: (8 + k % 9) * 60 + 15, lambda k: (10 + k % 9) * 60
    want = {(p, str(a), str(b)) for a, p, *_ in orders for b, q, *_ in orders if p == q and str(a) < str(b) and a % 5 == b % 5 and start(a) < end(b) and start(b) < end(a)}
    assert {tuple(r) for r in run("schedule_conflicts")} == want
    assert {(r.plan, r.code) for r in run("timetable_lanes")} == {(p, str(k)) for k, p, *_ in orders}
    clashing = {(p, c) for p, a, b in want for c in (a, b)}
    assert {(r.plan, c) for r in run("conflict_groups") for c in r.codes.split(",")} == clashing


def test_staged_links_have_their_types(spark, sf_dir):
    staged = tables(spark, sf_dir)["programcoursestaging"].collect()
    want = {(r.program_id, r.extracted_code.strip()): r.inferred_type or "Mandatory" for r in staged if r.reference_type == "course" and r.extracted_code and not r.extracted_code.endswith("X ")}
    df = catalogue.QUERIES["staging_to_final"](spark, sf_dir)
    got = {(r.program_id, r.code): r.course_type for r in df.collect()}
    assert got == {k: want[k] for k in got} and len(got) > 1000 and set(got.values()) == {"Mandatory", "Elective"}
    assert "RLIKE" in df._jdf.queryExecution().optimizedPlan().toString()  # words of the untyped ones are read


def test_staged_types_by_sql(spark, duck):
    texts = ["Wahlübung", "options; nicht\u00a0obligatorisch", "option, obligatoire", "Wahl_1", "Wahlfächer", "pas\nobligatoire", "not mandatory, freie  Wahl", "core", "Übung à choix", "Wahl\ufefffrei pflicht nicht\ufeffobligatorisch", "", None]
    rows = [(i, 7, None, None, x, "t", f"EC.{i}", title, "course", None, kind) for i, (x, title, kind) in enumerate((x, y, k) for x in texts for y in (None, "required", "au choix") for k in (None, "Elective", "?"))]
    staging = spark.createDataFrame(rows, "staging_id int, program_id int, source_doc_id int, page_no int, section string, raw_text string, extracted_code string, extracted_title string, reference_type string, fetched_at timestamp, inferred_type string")
    courses = spark.createDataFrame([(r[6], None, "Micro") for r in rows], "code string, alternative_code string, name string")
    got = {r.code: r.course_type for r in etl.staging_to_final(staging, courses).collect()}
    l = staging.toPandas()  # noqa: E741, F841
    assert got == dict(duck.sql(f"SELECT extracted_code, {endpoints._SAID} FROM l").fetchall()) and set(got.values()) == {"Mandatory", "Elective"} and len(got) == len(rows)
