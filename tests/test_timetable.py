"""Timetables of plans: times of texts, block courses, and places for what has no times."""

from lectern.operators import planning


def test_every_course_has_a_place(spark):
    rows = [
        (1, 0, "A", True, "Weekly", "Montag 8:15-10:00; Friday 13:15 - 15:00, Hörsaal B 2"), (1, 1, "B", True, "BLOCK", None), (1, 2, "C", True, "Weekly", "later, Main hall"), (1, 3, "D", False, None, None),
        (1, 8, "E", True, None, None), (2, 0, "F", None, None, "x"), (2, 1, "G", True, "Block", "Dienstag 10:15 – 12:00"),
    ]
    table = spark.createDataFrame(rows, "plan long, place long, code string, offered boolean, offering_type string, day_time_info string")
    got = {(r.code, r.day, r.start, r.end, r.location, r.how) for r in planning.plan_timetable(table).collect()}
    assert got == {
        ("A", "Monday", 495, 600, "Hörsaal B", "text"), ("A", "Friday", 795, 900, "Hörsaal B", "text"), ("B", "Monday", 0, 0, "Blockkurs", "block"), ("C", "Wednesday", 480, 600, "Main hall", "placed"),
        ("D", "Thursday", 540, 660, "Raum 103", "name"), ("E", "Thursday", 600, 720, "Raum 108", "placed"), ("F", "Monday", 480, 600, "Raum 100", "name"), ("G", "Tuesday", 615, 720, "", "text"),
    }
    assert planning.plan_timetable(table.limit(0)).count() == 0
