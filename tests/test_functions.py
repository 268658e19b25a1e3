import datetime

from pyspark.sql import functions as F

from lectern.functions import intent
from lectern.functions import text as T
from lectern.functions import values as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalisers(spark):
    assert one(spark, T.squeeze(F.lit("  a \n b  "))) == "a b"
    assert one(spark, T.fold_accents(F.lit("Éàüß"))) == "Eauß"
    assert one(spark, T.fold_accents_all(F.lit("ﬁ é"))) == "fi e"
    assert one(spark, T.normalize_plan(F.lit("Éléments (avancé) de l'algèbre II"))) == "elements l algebre ii"
    assert one(spark, T.normalize_match(F.lit("L’Économie & Droit"))) == "leconomie and droit"
    assert one(spark, T.normalize_query(F.lit("B.A./Plan-d'Études"))) == "b a plan d études"
    assert one(spark, T.normalize_page(F.lit(" a \t b\r\n\n\n\nc&amp;d "))) == "a b\n\nc&d"
    assert one(spark, T.subject_name(F.lit("Informatique"))) == "computer science"
    assert one(spark, T.faculty_key(F.lit("Faculty of Management, Economics and Social Sciences"))) == "SES" and one(spark, T.faculty_key(F.lit("law"))) == "LAW"
    assert one(spark, T.document_type(F.lit("Studienplan"))) == "study_plan" and one(spark, T.document_type_loose(F.lit("Prüfungen"))) == "regulation"


def test_codes_and_times(spark):
    assert one(spark, T.code_strict(F.lit("ue-AB.12 345"))) == "AB12345"
    assert one(spark, T.extract_codes(F.lit("UE-SES.00123, siehe EC-A12.34567 und EC-A12.34567"))) == ["UE-SES.00123", "EC-A12.34567"]
    blocks = one(spark, T.time_blocks(F.lit("Tuesday 08:15 - 10:00; Dienstag 17:15–19:00; Montag 9")))
    assert [(b.day, b.start, b.end) for b in blocks] == [("Tuesday", 495, 600), ("Tuesday", 1035, 1140)]
    assert one(spark, T.time_blocks(F.lit("nichts"))) == []


def test_course_type_says_what_the_application_does(spark):
    got = {x: one(spark, T.course_type(F.lit(x))) for x in ("Wahlübung", "Wahl\0pflicht", "options; nicht\u00a0obligatorisch", "option, obligatoire", "Wahl_1", "Wahlen", "Übung à choix")}
    assert [x for x, kind in got.items() if kind == "Mandatory"] == ["option, obligatoire", "Wahl_1", "Wahlen"] and set(got.values()) == {"Mandatory", "Elective"}


def test_inference(spark):
    assert one(spark, T.course_type(F.lit("Wahlpflicht"))) == "Elective"
    assert one(spark, T.course_type(F.lit("nicht obligatorisch, Wahl"))) == "Elective"
    assert one(spark, T.course_type(F.lit(""))) == "Mandatory"
    assert one(spark, T.course_type_or_null(F.lit("x"))) is None
    assert one(spark, T.credits(F.lit("BA-120-60-30-ETCS"))) == [120, 60, 30]
    assert one(spark, T.credits(F.lit("90 + 30 ECTS"))) == [90, 30]
    assert one(spark, T.credits(F.lit("Slavistik plan_60_05032015.pdf"))) == [60]
    assert one(spark, T.credits(F.lit("nothing"))) == []
    assert one(spark, T.degree_level(F.lit("https://x.example/master/plan.pdf"))) == "M"
    assert one(spark, T.year_of(F.lit("plan-2021-v2"))) == 2021
    assert one(spark, T.language_of(F.lit("https://x.example/fr/page"))) == "fr"
    assert one(spark, T.study_year(F.lit("Zweites Studienjahr"))) == 2
    assert one(spark, T.study_year(F.lit("Première année"))) == 1
    assert one(spark, T.sequence_part(F.lit("Info II: Statistik I"))) == 1
    assert one(spark, T.series_key(F.lit("MAN04: Statistik II"))) == "statistik"
    assert one(spark, T.initials(F.lit("Digital Neuro Science"))) == "dns"
    assert one(spark, T.quality_bucket(F.lit(6000), F.lit(800))) == "high"
    assert one(spark, T.name_similarity(F.lit("Computer Science"), F.lit("computer science"))) == 1.0
    assert one(spark, T.parse_program_key(F.lit("SES|master|90|Economics"))).total_ects == 90


def test_people_and_addresses(spark):
    p = one(spark, T.split_person(F.lit("Muster  Anna")))
    assert (p.first_name, p.last_name) == ("Anna", "Muster")
    p = one(spark, T.split_person(F.lit("Anna Maria Muster"), "last_is_last_name"))
    assert (p.first_name, p.last_name) == ("Anna Maria", "Muster")
    assert one(spark, T.person_like(F.lit("Müller Jean-Luc"))) and not one(spark, T.person_like(F.lit("Rue 12")))
    assert one(spark, T.url_canonical(F.lit("HTTPS://WWW.Example.org/A/?q=1#x"))) == "https://example.org/A"
    assert one(spark, T.url_stem(F.lit("https://x.example/a/plan.v2.pdf?x=1"))) == "plan.v2"


def test_values(spark):
    assert one(spark, V.swiss_date(F.lit("29.02.2024"))) == datetime.date(2024, 2, 29)
    assert one(spark, V.swiss_date(F.lit("31.02.2024"))) is None
    s = one(spark, V.semester(F.lit("AS-2025 , SS-2026")))
    assert (s.sem_id, s.year, s.kind) == ("HS-2025", 2025, "Autumn")
    assert one(spark, V.semester(F.lit(""))) is None
    assert one(spark, V.semester_query(F.lit("im hs 2025 oder SP-2026"))) == ["HS-2025", "FS-2026"]
    assert one(spark, V.minutes_of(F.lit("8:05"))) == 485 and one(spark, V.format_minutes(F.lit(485))) == "08:05"
    assert one(spark, V.clamp01(F.lit(1.5))) == 1.0 and one(spark, V.clamp01(F.lit(None).cast("double"))) is None
    assert one(spark, V.rate(F.lit(1), F.lit(0))) is None and one(spark, V.rate(F.lit(1), F.lit(0), 0.0)) == 0.0
    assert one(spark, V.split_list(F.lit("Anna, Bert; Cara and Dora"))) == ["Anna", "Bert", "Cara", "Dora"]
    assert one(spark, V.split_languages(F.lit("zweisprachig F / D"))) == ["Französisch", "Deutsch"]
    assert one(spark, V.season(F.lit("Autumn or spring"))) == "Both"
    parts = {"a": (F.lit(0.5), 0.4), "b": (F.lit(None).cast("double"), 0.6)}
    assert round(one(spark, V.weighted_score(parts)), 9) == 0.2 and round(one(spark, V.renormalised_score(parts)), 9) == 0.5


def test_intent(spark):
    ask = lambda q: one(spark, intent.plan(F.lit(q)))
    assert ask("What is EC-A12.34567?").args == {"code": "EC-A12.34567"}
    p = ask("Mandatory courses in the Bachelor of Business Informatics in spring")
    assert p.tool == "get_program_courses_by_metadata" and p.args["course_type"] == "Mandatory" and p.args["degree_level"] == "Bachelor"
    assert ask("Courses with more than 6 ECTS").args == {"ects": ">6"}
    assert ask("Which programs are there?").tool == "get_programs"
    assert ask("Hello").tool is None
    assert one(spark, intent.store(F.lit("Which article of the regulation"))) == "regulations"
