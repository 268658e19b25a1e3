import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import documents as D
from lectern.operators import etl, matching, planning, quality
from lectern.operators import html as H
from lectern.operators import relational as R
from lectern.operators import retrieval as S
from lectern.operators.graph import connected_components
from lectern.sources import readers, sinks
from lectern.streaming import sessions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("value", "operator", "expected"), [(">=6", None, ("gte", 6.0)), ("< 3", "gt", ("lt", 3.0)), ("=90", None, ("eq", 90.0)), ("abc", None, None), ("6", "lte", ("lte", 6.0)), (None, None, None)])
def test_numeric_filter(value, operator, expected):
    assert R.numeric_filter(value, operator) == expected


def test_arguments():
    assert R.id_list(["1, 2", "2,x", "3.0"]) == [1, 2, 3]
    assert R.tri_state("TRUE") is True and R.tri_state("maybe") is None


def test_program_type(spark):
    df = spark.createDataFrame([(None, "Master"), (60.0, "Master"), (90.0, "Master"), (120.0, "Master"), (100.0, "Master"), (120.0, "Bachelor"), (180.0, "Bachelor"), (240.0, "Bachelor")], "e double, l string")
    assert [r[0] for r in df.select(R.program_type(F.col("e"), F.col("l"))).collect()] == [None, "minor", "major", "mono", None, "major", "mono", None]


def test_upserts(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, None, 2), (None, "x", 3), (None, "y", 4)], "k int, v string, s int")
    assert etl.upsert_last(df, ["k"], "s").count() == 2
    assert etl.upsert_last(df, ["k"], "s", nulls_merge=False).count() == 3
    kept = etl.upsert_keep(df.where("k = 1"), ["k"], "s")
    assert rows(kept) == [(1, "a", 2)]
    again = etl.upsert_last(etl.upsert_last(df, ["k"], "s"), ["k"], "s")
    assert again.count() == 2
    new = spark.createDataFrame([(1, "z", 5), (2, "n", 6), (2, "m", 7)], "k int, v string, s int")
    assert rows(etl.insert_ignore(df.where("k = 1 and s = 1"), new, ["k"], "s")) == [(1, "a", 1), (2, "n", 6)]


def test_surrogate_keys(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("abcd2",), ("abcd1",)], "v string")
    first = etl.surrogate_keys(df, "v", "k")
    assert rows(first) == [("a", 1), ("abcd1", 2), ("abcd2", 3), ("b", 4)]
    more = etl.surrogate_keys(spark.createDataFrame([("c",), ("a",)], "v string"), "v", "k", first)
    assert dict(rows(more))["c"] == 5


def test_quarantine_and_changes(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "k int, v int")
    good, bad = etl.quarantine(df, {"positive": F.col("v") > 0})
    assert rows(good) == [(1, 5)] and bad.count() == 2
    changed = etl.update_changed(df, spark.createDataFrame([(1, 5), (2, 7)], "k int, v int"), "k", ["v"])
    assert {(r.k, r.v, r.changed) for r in changed.collect()} == {(1, 5, False), (2, 7, True), (3, None, False)}


def test_staging(spark):
    staging = spark.createDataFrame(
        [(1, 7, 3, 1, "Wahlpflicht", "t", " EC.001 ", "Old", "course", None), (2, 7, 3, 2, "Pflicht", "t", "EC.001", "New", "course", None), (3, 7, 3, 1, "x", "t", "ALT.9", None, "course", None), (4, 7, 3, 1, "x", "t", "EC.002", "m", "module", None)],
        "staging_id int, program_id int, source_doc_id int, page_no int, section string, raw_text string, extracted_code string, extracted_title string, reference_type string, fetched_at timestamp",
    )
    courses = spark.createDataFrame([("EC.001", None, "Micro"), ("EC.003", "ALT.9", "Macro")], "code string, alternative_code string, name string")
    out = {r.code: r for r in etl.staging_to_final(staging, courses).collect()}
    assert out["EC.001"].course_name == "New" and out["EC.001"].course_type == "Mandatory"
    assert out["EC.003"].course_name == "Macro" and set(out) == {"EC.001", "EC.003"}


def test_staged_types_come_before_words(spark):
    staged = [("Elective", "Pflicht"), (" Mandatory ", "Wahl"), (None, "Wahl"), ("", "Pflicht"), ("elective", "x"), (None, None)]
    staging = spark.createDataFrame(
        [(i, 7, None, None, section, "t", f"EC.{i}", None, "course", None, kind) for i, (kind, section) in enumerate(staged)],
        "staging_id int, program_id int, source_doc_id int, page_no int, section string, raw_text string, extracted_code string, extracted_title string, reference_type string, fetched_at timestamp, inferred_type string",
    )
    courses = spark.createDataFrame([(f"EC.{i}", None, "Micro") for i in range(6)], "code string, alternative_code string, name string")
    got = [r.course_type for r in etl.staging_to_final(staging, courses).orderBy("code").collect()]
    assert got == ["Elective", "Mandatory", "Elective", "Mandatory", "Mandatory", "Mandatory"]


def test_day_time_info(spark):
    df = spark.createDataFrame(
        [("Weekly", "x", None, None, [("16.09.2025", "08:15 - 10:00", "Lecture"), ("23.09.2025", "08:15 - 10:00", "Lecture")]), ("Weekly", "Montag 13:15 - 15:00", None, None, None), ("Block", None, "Seminar", "28 h", None), ("Block", "x irrégulier", None, None, None)],
        "t string, times string, s string, c string, d array<struct<date:string,time:string,unit_type:string>>",
    )
    got = [r[0] for r in df.select(etl.day_time_info(F.col("t"), F.col("times"), F.col("s"), F.col("c"), F.col("d"))).collect()]
    assert got == ["Tuesday 08:15 - 10:00 (Lecture)", "Monday 13:15 - 15:00", "Seminar, 28 hours total", "Irregular schedule"]


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (8, 8), (None, 1)], "a long, b long")
    assert rows(connected_components(links)) == [(3, 3), (4, 3), (5, 3), (8, 8), (9, 8)]
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overlaps(spark):
    df = spark.createDataFrame([(1, "u", 0.0, 10.0), (2, "u", 10.0, 20.0), (3, "u", 5.0, 15.0), (4, "v", 5.0, 15.0)], "i int, k string, s double, e double")
    assert rows(R.binned_overlaps(df, "i", ["k"], "s", "e", 4.0).select("a", "b")) == [(1, 3), (2, 3)]
    assert rows(planning.overlap_depth(df, ["k"], "s", "e")) == [("u", 2), ("v", 1)]


def test_conflict_groups(spark):
    b = spark.createDataFrame([(1, "A", "Monday", 0, 60), (1, "B", "Monday", 30, 90), (1, "C", "Monday", 60, 120), (1, "D", "Tuesday", 0, 60)], "plan long, code string, day string, start int, end int")
    assert {r.codes for r in planning.conflict_groups(b).collect()} == {"A,B", "B,C"}
    assert {(r.code, r.lane) for r in planning.lanes(b).collect()} == {("A", 0), ("B", 1), ("C", 0), ("D", 0)}


def test_suggest(spark):
    block = "array<struct<day:string,start:int,end:int>>"
    c = spark.createDataFrame([(1, "A", 20.0, True, False, [("Monday", 0, 60)]), (1, "B", 10.0, False, False, [("Monday", 30, 90)]), (1, "C", 10.0, False, False, []), (1, "Z", 0.0, False, False, [])], f"plan long, code string, ects double, mandatory boolean, required boolean, blocks {block}")
    assert {r.code for r in planning.suggest_courses(c).collect()} == {"A", "C", "Z"}


def test_plan(spark):
    kinds = "array<string>"
    c = spark.createDataFrame(
        [(1, 1, "A1", "Statistik I", 6.0, "Mandatory", "1. Jahr", ["Autumn"], ["Deutsch"], 1, None), (1, 2, "A1F", "Statistique I", 6.0, "Mandatory", "1. Jahr", ["Autumn"], ["Français"], 1, None), (1, 3, "A2", "Statistik II", 6.0, "Mandatory", "1. Jahr", [], ["Deutsch"], 1, None)],
        f"plan long, row_no long, code string, name string, ects double, course_type string, section string, semester_types {kinds}, languages {kinds}, suggested_year int, day_time_info string",
    )
    groups = planning.roll_up(planning.equivalence_groups(c))
    found = {tuple(r.codes): r for r in groups.collect()}
    assert set(found) == {("A1", "A1F"), ("A2",)} and found["A1", "A1F"].requires_choice
    slots = {r.group_no: r.semester_number for r in planning.plan_semesters(groups, 4, 24.0).collect()}
    assert slots[1] == 1 and slots[3] > slots[1]


def test_mentions(spark):
    q = spark.createDataFrame([(1, "Is micro economics in EC.001?"), (2, "nothing")], "id int, text string")
    c = spark.createDataFrame([("EC.001", "Mikroökonomie / Micro Economics"), ("EC.002", "Law")], "code string, name string")
    assert rows(planning.mentioned(q, c)) == [(1, "EC.001")]


def test_matching(spark):
    p = spark.createDataFrame([(0, ["Informatik", "Computer Science"], "SCIMED", "M", 90, []), (1, ["Computer Science"], "SCIMED", "M", 30, []), (2, ["Law"], "LAW", "M", 90, [])], "programme_index int, names array<string>, faculty string, level string, ects int, urls array<string>")
    d = spark.createDataFrame([(0, "Studienplan Computer Science 90 ECTS", "plan", "SCIMED", "M", [90], []), (1, "Computer Science", "plan", "SCIMED", "M", [], []), (2, "Computer Science", "plan", "LAW", "M", [90], [])], "document_index int, text string, label string, faculty string, level string, ects_values array<int>, urls array<string>")
    got = rows(matching.select_matches(matching.score_pairs(p, d)).select("document_index", "programme_index", "score"))
    assert got == [(0, 0, 18), (1, 0, 13)]
    names = matching.match_names(spark.createDataFrame([(1, "Law", "M", 90.0), (2, "Law and more", "M", 90.0)], "id int, name string, level string, ects double"), spark.createDataFrame([(7, ["LAW "], "M", 90.0)], "program_id int, names array<string>, level string, ects double"))
    assert rows(names) == [(1, 7, "exact"), (2, 7, "contains")]


def test_documents(spark):
    text = '---METADATA_JSON---\n{"doc_key": "k"}\n---/METADATA_JSON---\n---PAGE 1---\n# One\n\nAlpha\n\n---PAGE 2---\nBeta'
    df = spark.createDataFrame([(1, text), (2, "bare"), (3, "---METADATA_JSON---{bad---/METADATA_JSON---x")], "i int, t string")
    got = {r.i: r.h for r in df.select("i", D.split_header(F.col("t")).alias("h")).collect()}
    assert json.loads(got[1].header) == {"doc_key": "k"} and got[2].body == "bare" and got[3].header == "{}"
    pages = D.pages(df.select("i", D.split_header(F.col("t"))["body"].alias("b")), "i", "b")
    assert rows(pages) == [(1, 1, "# One\n\nAlpha"), (1, 2, "Beta"), (2, 1, "bare"), (3, 1, "x")]


def test_chunkers(spark):
    table = "| a | |\n|---|---|\n| 1 | 2 | 3 |"
    assert D.table_records(table).startswith("Table rows:\n- a: 1; column_2: 2; column_3: 3")
    chunks = D.semantic_chunks(f"# Top\n\nfirst\n\n{table}\n\nlast", 50, 300, 5)
    assert [c["table"] for c in chunks] == [False, True, False] and chunks[2]["text"].startswith("Previous context: ")
    for size in (1799, 1800, 1801, 5000):
        whole = "x" * size
        assert "".join(D.windows(whole, 1800, 0)) == whole
    assert D.semantic_chunks("") == [] and D.section_chunks("") == []
    kids = D.parent_child_chunks("Intro:\n\n" + "\n\n".join(["word " * 100] * 5))
    assert all(len(k["text"]) < 1200 for k in kids) and kids[0]["section"] == "Intro:"
    assert "".join(c["text"] for c in D.recursive_chunks("a" * 2000, 900, 0)) == "a" * 2000
    df = spark.createDataFrame([(1, "abc" * 1000), (2, ""), (3, None)], "doc_id long, text string")
    w = D.fixed_windows(df).orderBy("chunk_no").collect()
    assert [r.chunk_no for r in w] == [0, 1, 2] and w[-1].text.endswith("abc")
    ids = D.chunk_ids(D.chunk(df, "recursive"), "r").orderBy("chunk_no").collect()
    assert ids[0].prev_chunk_id is None and ids[0].next_chunk_id == ids[1].chunk_id


def test_course_rows(spark):
    df = spark.createDataFrame([(1, "# Pflicht\nEC.0001 | Micro\n# Wahl\n| EC.0002 | Macro |")], "doc_id int, text string")
    assert [(r.code, r.course_type, r.title) for r in D.course_rows(df).orderBy("line_no").collect()] == [("EC.0001", "Mandatory", "Micro"), ("EC.0002", "Elective", "Macro")]


def test_retrieval(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    near = S.knn(v.where("vec_id = 2"), v, 2)
    assert rows(near.select("vec_id", "rank")) == [(1, 1), (3, 2)]
    x = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "g int, m int")
    assert rows(S.filter_or_all(x, F.col("m") == 1, ["g"])) == [(1, 1), (2, 0)]
    q = spark.createDataFrame([(1, "Which modules has the Master Business Informatics, 90 ECTS?")], "id int, text string")
    c = spark.createDataFrame([("a", ["Business Informatics"], "Master", 90), ("b", ["Law"], "Master", 90)], "program_key string, names array<string>, degree_level string, total_ects int")
    best = S.detect_program(q, c).first()
    assert best.program_key == "a" and best.score == 40 + 4 + 4 + 12 + 12
    assert spark.range(1).select(S.snippet(F.lit("x" * 400))).first()[0] == "x" * 350 + "…"
    m = spark.range(1).select(S.manual_rank_metrics(F.array(F.lit(2), F.lit(4))).alias("m")).first().m
    assert (m.recall_1, m.recall_3, m.reciprocal_rank) == (0, 1, 0.5)


def test_html(spark):
    page = '<html><body><nav><a href="/n">n</a></nav><h1>Top</h1><p>Text <a href="b.html">B</a></p><h2>Sub</h2><table><tr><th>Name:</th><td>Ann</td></tr></table></body></html>'
    df = spark.createDataFrame([(1, "https://x.example/a/", page), (2, "https://x.example", None)], "page_id long, url string, html string")
    assert [(r.heading, r.text) for r in H.sections(df).orderBy("section_no").collect()] == [("Top", "Text B"), ("Sub", "Name:\nAnn")]
    assert H.table_map(df).where("page_id = 1").first().fields == {"Name": "Ann"}
    assert {(r.url, r.text) for r in H.links(df).collect()} == {("https://x.example/n", "n"), ("https://x.example/a/b.html", "B")}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    assert rows(H.reachable(spark.createDataFrame([("a",)], "url string"), edges, 2)) == [("a", 0), ("b", 1), ("c", 2)]
    tree = spark.createDataFrame([(1, None, "r"), (2, 1, "s"), (3, 2, "t")], "id int, parent int, name string")
    assert dict(rows(H.tree_paths(tree)))[3] == "r > s > t"
    one = spark.range(1).select(H.best_title(F.array(F.lit("Home"), F.lit("Long title"), F.lit("Short")), ["home"]).alias("t")).first().t
    assert one == "Short"


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "k int, v string")
    c = {r.field: r for r in R.field_completeness(df, ["k", "v"]).collect()}
    assert c["v"].present == 1 and c["v"].missing == 2 and R.field_completeness(df.limit(0), ["k"]).first().rate is None
    assert quality.score(spark, {"a": 0.5}, {"a": 0.4, "b": 0.6}) == 0.2
    assert quality.score(spark, {"a": 2.0}, {"a": 0.4, "b": 0.6}, renormalise=True) == 1.0
    assert spark.range(1).select(quality.credit_consistency(F.lit(90), F.array(F.lit(30)))).first()[0] == "mismatch"


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"items": [{"k": 1}, {"k": 2}]}')
    (tmp_path / "b.jsonl").write_text('{"k": 1}\nnot json\n{"k": 3}\n')
    (tmp_path / "c.txt").write_text('{"k": 1}, {"k": 2} junk {"k": 3}')
    (tmp_path / "d.csv").write_bytes("﻿k,v\n1,x\n".encode())
    from pyspark.sql.types import IntegerType, StructType

    s = StructType().add("k", IntegerType())
    assert [r.k for r in readers.json_wrapped(spark, str(tmp_path / "a.json"), s).collect()] == [1, 2]
    good, bad = readers.json_lines_quarantined(spark, str(tmp_path / "b.jsonl"), StructType().add("k", IntegerType()))
    assert good.count() == 2 and bad.count() == 1
    assert readers.json_lines(spark, str(tmp_path / "b.jsonl"), s).where("k is not null").count() == 2
    assert [r.k for r in readers.json_loose(spark, str(tmp_path / "c.txt"), s).collect()] == [1, 2, 3]
    assert readers.csv(spark, str(tmp_path / "d.csv")).columns == ["k", "v"]
    assert readers.binary(spark, str(tmp_path), "*.csv").count() == 1
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert sinks.append_new(spark, new, str(tmp_path / "t"), "k").count() == 2
    sinks.append_new(spark, new, str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_stream_sessions(spark, tmp_path):
    schema = "session_id long, ts timestamp, turn long, role string, text string"
    data = spark.sql("select 1L session_id, timestamp'2024-01-01' ts, 0L turn, 'user' role, 'hi' text union all select 1L, timestamp'2024-01-01', 1L, 'assistant', 'yes' union all select 1L, timestamp'2024-01-01', 2L, 'user', null")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = sessions.stream_sessions(stream).writeStream.format("memory").queryName("folded").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    assert rows(spark.table("folded")) == rows(sessions.fold_sessions(data.drop("ts"))) == [(1, 3, "hi", "yes")]


def test_stream_ingest_and_windows(spark, tmp_path):
    schema = "k long, ts timestamp, event_type string, value double"
    one = spark.sql("select 1L k, timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value union all select 1L, timestamp'2024-01-01 00:20:00', 'a', 3.0D union all select 2L, timestamp'2024-01-01 01:10:00', 'a', 5.0D")
    one.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start finds nothing new
        sessions.ingest_new(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "k", "ts").awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
    got = {(str(r.window_start), r.n, r.mean, r.most) for r in sessions.latency_windows(one).collect()}
    assert got == {("2024-01-01 00:00:00", 2, 2.0, 3.0), ("2024-01-01 01:00:00", 1, 5.0, 5.0)}
    assert sessions.sliding_latency(one, "2 hours", "1 hour").count() == 3
    assert rows(sessions.visits(one.withColumnRenamed("k", "user_id"), "30 minutes").select("user_id", "n")) == [(1, 2), (2, 1)]
