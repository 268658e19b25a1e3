"""Slot-filling dialogues: fixed conversations, and the stream against the ordered fold."""

import datetime
import random

import pytest

from lectern.streaming import dialogue as D

TURNS = "session_id long, turn long, ts timestamp, role string, text string"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)



CATALOG = [(11, "Business Informatics"), (12, "Business Law"), (30, "Computer Science"), (31, None), (None, "Nothing")]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, "program_id long, name string")


def talk(spark, catalog, *texts):
    turns = spark.createDataFrame([(1, 2 * i, at(i), "user", t) for i, t in enumerate(texts)] + [(1, 1, at(0), "assistant", "__hero__:plan_mobility")], TURNS)
    return sorted(D.fold_dialogues(turns, catalog).collect(), key=lambda r: r.turn)


def test_mobility(spark, catalog):
    got = talk(spark, catalog, "hello", "__HERO__:plan_mobility ", "Management", "ss-2026 and HS 2026", "show more", "mehr bitte", "and now?")
    assert [r.action for r in got] == ["question", "intro", "ask_semester", "mobility", "more", "more", "question"]
    assert got[3].semesters == ["FS-2026", "HS-2026"] and got[3].interest == "and" and got[5].shown == 75
    got = talk(spark, catalog, "__hero__:plan_mobility", "FS-2026", "hs", "Law, FS-2026 HS-2027 HS-2028.", None)
    assert [r.action for r in got] == ["intro", "ask_interest", "ask_interest", "mobility", "question"]
    assert got[3].interest == "Law" and got[3].semesters == ["FS-2026", "HS-2027"]


def test_study_program(spark, catalog):
    got = talk(spark, catalog, "__hero__:plan_study_program", "", "Business", "99", "8 semesters", "11", "thanks", "UE-SIN.01022 please", "I passed UE-EIG.00003")
    assert [r.action for r in got] == ["intro", "ask_program", "choose_program", "unknown_id", "unknown_id", "plan", "ask_electives", "plan", "plan"]
    assert got[5].program_id == 11 and got[5]["count"] == 8 and got[7].codes == ["UE-SIN.01022"] and got[8].codes == ["UE-SIN.01022", "UE-EIG.00003"]
    got = talk(spark, catalog, "__hero__:complete_study_plan", "Bachelor in Computer Science 180 ECTS", "in 6")
    assert [(r.action, r.program_id, r["count"], r.ects) for r in got[1:]] == [("ask_count", 30, None, 180), ("plan", 30, 6, 180)]
    assert [r.action for r in talk(spark, catalog, "__hero__:complete_study_plan", "Alchemy")] == ["intro", "unknown_program"]


def test_semester(spark, catalog):
    got = talk(spark, catalog, "__hero__:plan_semester", "soon", "Computer Science SA2026", "none", "UE-SIN.01022", "suggest 20 ects", "UE-SIN.00007", "__hero__:plan_mobility")
    assert [r.action for r in got] == ["intro", "ask_semester", "courses", "ask_completed", "remaining", "suggest", "selected", "intro"]
    assert got[2].semesters == ["HS-2026"] and got[5].ects == 20 and got[7].semesters == [] and got[7].program_id is None


def made(seed, sessions):
    r = random.Random(seed)
    said = [*D.COMMANDS, "Business", "Computer Science", "11", "30", "6 semesters", "FS-2026", "AS 2027 Law", "next", "UE-SIN.01022", "passed UE-EIG.00003", "suggest", "180 ects", "", None, "Ökologie"]
    return [(s, t, at(20 * t + 25 * (t > 6)), r.choice(["user", "user", "assistant"]), r.choice(said)) for s in range(sessions) for t in range(r.randint(1, 14))]


def test_stream_equals_fold(spark, catalog, tmp_path):
    rows = made(3, 12) + [(None, 1, at(0), "user", "x"), (5, None, at(0), "user", "x"), (5, 1, None, "user", "x"), (1, 0, at(0), "user", "zzz"), (1, 0, at(0), "user", "zzz")]
    whole = spark.createDataFrame(rows, TURNS)
    for k, (low, high) in enumerate([(-9, 4), (4, 9), (9, 99)]):
        whole.where(f"turn is null or turn >= {low} and turn < {high}").coalesce(1).write.parquet(f"{tmp_path}/in/batch={k}")
    want = sorted(map(str, D.fold_dialogues(whole, catalog).collect()))
    D.stateful(spark)
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = []
    for _ in range(2):  # a second start goes on from the checkpoint and adds nothing
        q = D.stream_dialogues(stream, catalog).writeStream.outputMode("append").foreachBatch(lambda b, _: found.extend(b.collect()))
        q = q.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(map(str, found)) == want and len(want) > 40


def test_silence_ends_a_flow(spark, catalog):
    rows = [(1, 0, at(0), "user", "__hero__:plan_mobility"), (1, 1, at(30), "user", "FS-2026"), (1, 2, at(61), "user", "Law"), (1, 3, at(62), "user", "more")]
    assert [r.action for r in sorted(D.fold_dialogues(spark.createDataFrame(rows, TURNS), catalog).collect(), key=lambda r: r.turn)] == ["intro", "ask_interest", "question", "question"]


def test_empty(spark, catalog):
    none = spark.createDataFrame([], TURNS)
    assert D.fold_dialogues(none, catalog.limit(0)).count() == 0
