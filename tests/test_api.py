import datetime

import pytest

from lectern import schema
from lectern.operators import quality
from lectern.plans import api


@pytest.fixture(scope="module")
def t(spark):
    def at(day):
        return datetime.datetime(2025, 1, day)

    rows = {
        "faculty": [(1, "WiSo", "SES", "SES", "u1", "ses"), schema.UNMATCHED_FACULTY],
        "language": [(1, "Deutsch"), (2, "Französisch"), (3, "Englisch")],
        "domain": [(1, "Economics", 1)],
        "professor": [(1, "Prof.", "Anna", "Muster", "a@x.example", None)],
        "studyprogram": [
            (1, "Wirtschaftsinformatik", "Bachelor", 6, 180.0, None, "Autumn", 1, 1, None, "Business Informatics", "Wirtschaftsinformatik", ""),
            (2, "Law", "Master", 4, 90.0, None, "Both", 100, None, None, None, None, None), (3, "Minor Law", "Bachelor", 4, 60.0, None, None, 1, None, None, "Minor Law", None, None),
        ],
        "course": [
            ("UE-EC.0001", None, "Statistik I", 6.0, "numbers", None, None, None, True, None, None, True, None, 1, 1), ("UE-EC.0002", None, "Statistique I", 6.0, None, None, None, None, False, None, None, False, None, 1, 1),
            ("UE-EC.0003", None, "Statistik II", 6.0, None, None, None, None, None, None, None, True, None, 1, None), ("UE-EC.0004", "EC.9", "Law", 3.0, None, "goals", None, None, None, None, None, None, None, None, None),
        ],
        "consist_of": [
            (1, "UE-EC.0001", "Statistik I", "Mandatory", "1. Studienjahr", 1), (1, "UE-EC.0002", "Statistique I", "Mandatory", "1. Studienjahr", 2), (1, "UE-EC.0003", "Statistik II", "Mandatory", "1. Studienjahr", 3),
            (1, "UE-EC.0004", "", "Elective", None, 4), (2, "UE-EC.0004", "Law", "Mandatory", " ", 5),
        ],
        "semester": [("HS-2025", 2025, "Autumn"), ("FS-2026", 2026, "Spring"), ("FS-2025", 2025, "Spring")],
        "courseoffering": [
            (1, "UE-EC.0001", "HS-2025", "Weekly", "Monday 08:15 - 10:00", "l1"), (2, "UE-EC.0002", "HS-2025", "Weekly", "Monday 08:15 - 10:00", None), (3, "UE-EC.0003", "FS-2026", "Weekly", "Tuesday 08:15 - 10:00", "l3"),
            (4, "UE-EC.0004", "HS-2025", "Block", None, "l4"), (5, "UE-EC.0001", "FS-2025", "Weekly", None, "l5"), (6, "UE-EC.0003", "HS-2025", "Weekly", None, None),
        ],
        "is_taught_in": [(1, 1), (2, 2), (3, 1), (4, 3)],
        "has_lang": [(1, 1), (1, 2)],
        "teaches": [("UE-EC.0001", 1)],
        "session": [(1, 1, datetime.date(2025, 9, 16), "08:15", "10:00", None, None)],
        "programdocument": [(1, 1, "Plan", "d1", "study_plan", at(1)), (2, 1, "Flyer", "d2", "brochure", None), (3, 1, "New", "d3", "study_plan", at(2))],
    }
    return {name: spark.createDataFrame(rows.get(name, []), s) for name, s in schema.TABLES.items()}


def codes(df, column="code"):
    return [r[column] for r in df.collect()]


def test_programs(t):
    got = api.programs(t).collect()
    assert [r.program_id for r in got] == [1, 2, 3] and [r.program_type for r in got] == ["mono", "major", "minor"]
    assert [d.doc_id for d in got[0].program_documents] == [3, 1, 2] and got[1].program_documents == []
    assert codes(api.programs(t, total_ects=">=90", faculty_name="ses"), "program_id") == [1]
    assert codes(api.programs(t, name="law", program_type="minor"), "program_id") == [3]
    assert api.program(t, 9).count() == 0


def test_courses(t):
    assert codes(api.program_courses_by_metadata(t, degree_level="Bachelor", semester_type="Autumn", language="deut")) == ["UE-EC.0001", "UE-EC.0003"]
    assert codes(api.program_courses_by_metadata(t, q="goals")) == ["UE-EC.0004", "UE-EC.0004"]
    assert codes(api.program_courses(t, 1, ects="<6")) == ["UE-EC.0004"]
    assert codes(api.course_sections(t, 1, non_empty_only="true")) == ["UE-EC.0001", "UE-EC.0002", "UE-EC.0003"]
    few = api.courses(t, code="EC.0001").collect()
    assert few[0].link_course_catalogue == "l1" and [x.sem_id for x in few[0].course_catalogue_links] == ["HS-2025", "FS-2025"]
    many = api.courses(t).collect()
    assert len(many) == 4 and all(r.link_course_catalogue is None for r in many)
    assert codes(api.courses(t, mobility="true", semester="HS-2025")) == ["UE-EC.0001", "UE-EC.0003"]
    assert codes(api.courses(t, program_name="Law", limit=1)) == ["UE-EC.0004"]
    assert api.course(t, "ec.0003").first().link_course_catalogue == "l3"


def test_offerings(t):
    assert {r.link_course_catalogue for r in api.offerings(t, "HS-2025").collect()} == {None}
    assert codes(api.offerings(t, "FS-2026"), "link_course_catalogue") == ["l3"]
    with pytest.raises(ValueError):
        api.offerings(t, "")
    one = api.offering(t, 1)
    assert one["sessions"].first().weekday == "Dienstag" and one["professors"].first().last_name == "Muster" and codes(one["languages"], "description") == ["Deutsch"]


def test_planner(t):
    assert [(r.sem_id, r.label) for r in api.semesters(t).collect()] == [("FS-2026", "FS 2026"), ("HS-2025", "HS 2025"), ("FS-2025", "FS 2025")]
    p = api.planner_programs(t, "fr").collect()
    assert [r.display_name for r in p] == ["Law", "Minor Law", "Wirtschaftsinformatik"] and p[2].languages == ["Deutsch", "Französisch"] and p[0].languages == []
    c = {r.code: r for r in api.planner_courses(t, "HS-2025", "1,2").collect()}
    assert [x.program_id for x in c["UE-EC.0004"].elective_for] == [1] and [x.program_id for x in c["UE-EC.0004"].mandatory_for] == [2]
    plan = api.plan_proposal(t, 1, 6)
    assert plan["totals"].first().mandatory_ects == 12.0 and plan["choice_groups"].first().codes == ["UE-EC.0001", "UE-EC.0002"]
    slots = {r.group_no: r.semester_number for r in plan["slots"].collect()}
    assert slots[1] == 1 and slots[3] > 1 and len(slots) == 2
    chosen = api.plan_proposal(t, 1, 6, selected=["EC.0004"], completed="UE-EC.0003")["slots"].collect()
    assert {r.group_no for r in chosen} == {1, 4}


def test_documents_and_tools(t):
    assert codes(api.program_documents(t, 1, "study_plan"), "doc_id") == [3, 1]
    assert codes(api.studyplans(t, degree_level="Bachelor"), "doc_id") == [3, 1]
    assert [(r.code, r.attempt) for r in api.mobility(t, ["HS-2025"], interest="numbers", language="deut").collect()][0] == ("UE-EC.0001", 0)
    assert codes(api.call(t, "get_programs", {"name": "law", "unknown": 1}), "program_id") == [2, 3]
    with pytest.raises(KeyError):
        api.call(t, "drop_tables", {})


def test_foreign_keys(t):
    bad = {r.name: r.orphans for r in quality.foreign_key_checks(t, schema.FOREIGN_KEYS).collect()}
    assert len(bad) == 23 and sum(bad.values()) == 0
    assert all(ok for _, ok in quality.schema_checks(t, {n: k for n, k in schema.PRIMARY_KEYS.items()}))
