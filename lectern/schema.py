"""The catalogue's nineteen tables as typed schemas, with their keys and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of every table.
TABLES = {
    "faculty": "faculty_id int, name_de string, name_fr string, name_en string, url string, faculty_key string",
    "room": "room_id string",
    "language": "lang_id int, description string",
    "professor": "prof_id int, title string, first_name string, last_name string, email string, office string",
    "domain": "domain_id int, name string, faculty_id int",
    "studyprogram": "program_id int, name string, degree_level string, semesters int, total_ects double, elective_ects string, study_start string, faculty_id int, director int, source_last_page_url string, name_en string, name_de string, name_fr string",
    "course": "code string, alternative_code string, name string, ects double, description string, learning_goals string, admission_conditions string, remarks string, soft_skills boolean, outside_domain boolean, benefri boolean, mobility boolean, unipop boolean, faculty_id int, domain_id int",
    "has_lang": "program_id int, lang_id int",
    "teaches": "code string, prof_id int",
    "consist_of": "program_id int, code string, course_name string, course_type string, description string, ordinal long",
    "semester": "sem_id string, year int, type string",
    "courseoffering": "offering_id int, code string, sem_id string, offering_type string, day_time_info string, link_course_catalogue string",
    "session": "session_id int, offering_id int, date date, start_time string, end_time string, room_id string, unit_type string",
    "is_taught_in": "offering_id int, lang_id int",
    "evaluation": "eval_id int, code string, date date, time string, eval_type string",
    "examined_in": "eval_id int, room_id string",
    "programdocument": "doc_id int, program_id int, label string, url string, doc_type string, fetched_at timestamp",
    "programcoursestaging": "staging_id int, program_id int, source_doc_id int, page_no int, section string, raw_text string, extracted_code string, extracted_title string, reference_type string, inferred_type string, module string, fetched_at timestamp",
    "reglementationdocument": "reg_doc_id int, tree string, title string, document_page_url string, pdf_url string, doc_pdf binary, fetched_at timestamp",
}
PRIMARY_KEYS = {
    "faculty": ["faculty_id"], "room": ["room_id"], "language": ["lang_id"], "professor": ["prof_id"], "domain": ["domain_id"], "studyprogram": ["program_id"], "course": ["code"], "has_lang": ["program_id", "lang_id"],
    "teaches": ["code", "prof_id"], "consist_of": ["program_id", "code"], "semester": ["sem_id"], "courseoffering": ["offering_id"], "session": ["session_id"], "is_taught_in": ["offering_id", "lang_id"],
    "evaluation": ["eval_id"], "examined_in": ["eval_id", "room_id"], "programdocument": ["doc_id"], "programcoursestaging": ["staging_id"], "reglementationdocument": ["reg_doc_id"],
}
FOREIGN_KEYS = [
    ("domain", "faculty_id", "faculty", "faculty_id"), ("studyprogram", "faculty_id", "faculty", "faculty_id"), ("studyprogram", "director", "professor", "prof_id"), ("course", "faculty_id", "faculty", "faculty_id"),
    ("course", "domain_id", "domain", "domain_id"), ("has_lang", "program_id", "studyprogram", "program_id"), ("has_lang", "lang_id", "language", "lang_id"), ("teaches", "code", "course", "code"),
    ("teaches", "prof_id", "professor", "prof_id"), ("consist_of", "program_id", "studyprogram", "program_id"), ("consist_of", "code", "course", "code"), ("courseoffering", "code", "course", "code"),
    ("courseoffering", "sem_id", "semester", "sem_id"), ("session", "offering_id", "courseoffering", "offering_id"), ("session", "room_id", "room", "room_id"), ("is_taught_in", "offering_id", "courseoffering", "offering_id"),
    ("is_taught_in", "lang_id", "language", "lang_id"), ("evaluation", "code", "course", "code"), ("examined_in", "eval_id", "evaluation", "eval_id"), ("examined_in", "room_id", "room", "room_id"),
    ("programdocument", "program_id", "studyprogram", "program_id"), ("programcoursestaging", "program_id", "studyprogram", "program_id"), ("programcoursestaging", "source_doc_id", "programdocument", "doc_id"),
]
#: The row that stands for a faculty that couldn't be matched.
UNMATCHED_FACULTY = (100, "Fakultät konnte nicht zugeordnet werden", "Faculté na pas pu être associée", "Faculty could not be matched", "about:default-faculty", "default")


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    """All tables without rows."""
    return {t: spark.createDataFrame([], s) for t, s in TABLES.items()}


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of a folder of parquet tables."""
    return {t: spark.read.schema(s).parquet(f"{path}/{t}") for t, s in TABLES.items()}
