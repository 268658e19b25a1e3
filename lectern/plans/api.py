"""The catalogue's queries over its nineteen tables; an argument that is None filters nothing.

Every function takes the tables by name (see ``lectern.schema``) and returns a frame in its result order.
Nested lists are arrays of structs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import code_loose, code_strict, extract_codes, study_year
from lectern.functions.values import GERMAN_DAYS, weekday_name
from lectern.operators import planning
from lectern.operators import relational as R
from lectern.storage import persist_shared

Tables = dict[str, DataFrame]


def _documents(t: Tables) -> DataFrame:
    """(program_id, program_documents): every programme's documents, newest first."""
    one = F.struct(F.col("fetched_at").isNull().alias("last"), F.coalesce(-F.unix_micros("fetched_at"), F.lit(0)).alias("at"), (-F.col("doc_id")).alias("no"), "doc_id", "label", "url", "doc_type", "fetched_at")
    keep = lambda x: F.struct(*[x[c].alias(c) for c in ("doc_id", "label", "url", "doc_type", "fetched_at")])
    return t["programdocument"].groupBy("program_id").agg(F.transform(F.array_sort(F.collect_list(one)), keep).alias("program_documents"))


def _with_documents(df: DataFrame, t: Tables) -> DataFrame:
    none = F.array().cast("array<struct<doc_id:int,label:string,url:string,doc_type:string,fetched_at:timestamp>>")
    return df.join(_documents(t), "program_id", "left").withColumn("program_documents", F.coalesce("program_documents", none))


def _faculty(t: Tables, prefix: str, key: str = "faculty_id") -> DataFrame:
    return t["faculty"].select(F.col("faculty_id").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in ("name_en", "name_de", "name_fr")])


def _program_filter(name=None, name_en=None, name_de=None, name_fr=None, degree_level=None, faculty_id=None, faculty_name=None, study_start=None, total_ects=None, total_ects_operator=None, program_type=None) -> Column:  # noqa: ANN001
    kind = R.program_type(F.col("total_ects"), F.col("degree_level"))
    return R.all_of([
        R.optional_like(["name", "name_en", "name_de", "name_fr"], name), R.optional_like(["name_en", "name"], name_en), R.optional_like(["name_de", "name"], name_de), R.optional_like(["name_fr", "name"], name_fr),
        R.optional_equal("degree_level", degree_level), R.optional_equal("faculty_id", faculty_id), R.optional_like(["pf_name_en", "pf_name_de", "pf_name_fr"], faculty_name), R.optional_equal("study_start", study_start),
        R.optional_compare("total_ects", total_ects, total_ects_operator), R.optional_equal(kind, program_type),
    ])


def programs(t: Tables, **filters) -> DataFrame:  # noqa: ANN003
    """Programmes with their type, faculty and documents, by name, level and credits."""
    p = R.lookup(t["studyprogram"], _faculty(t, "pf"), "faculty_id").where(_program_filter(**filters))
    out = p.select("program_id", "name", "name_en", "name_de", "name_fr", "degree_level", "total_ects", R.program_type(F.col("total_ects"), F.col("degree_level")).alias("program_type"), "study_start", "faculty_id", F.col("pf_name_en").alias("faculty_name"))
    return _with_documents(out, t).orderBy(F.coalesce("name_en", "name"), "degree_level", "total_ects")


def program(t: Tables, program_id: int) -> DataFrame:
    """One programme with its documents; no row if it is unknown."""
    return _with_documents(t["studyprogram"].where(F.col("program_id") == program_id), t)


def _offered(t: Tables, semester: str | None = None, kind: str | None = None) -> DataFrame:
    """Codes that are offered in a semester (by id or type, contained) or in a kind of semester."""
    s = t["semester"].select("sem_id", "type")
    o = t["courseoffering"].select("code", "sem_id").join(s, "sem_id", "left")
    if semester is not None:
        o = o.where(R.optional_like(["sem_id", "type"], semester.strip()))
    if kind is not None:
        o = o.where(F.col("type") == kind)
    return o.select("code").distinct()


def _taught_in(t: Tables, language: str) -> DataFrame:
    lang = t["language"].where(F.col("description").ilike(f"%{language.strip()}%")).select("lang_id")
    return t["is_taught_in"].join(lang, "lang_id", "left_semi").join(t["courseoffering"].select("offering_id", "code"), "offering_id").select("code").distinct()


def _courses(t: Tables) -> DataFrame:
    """Courses with the names of faculty and domain."""
    d = t["domain"].select("domain_id", F.col("name").alias("domain_name"))
    return R.lookup(R.lookup(t["course"], _faculty(t, "cf"), "faculty_id"), d, "domain_id")


def _course_filter(ects=None, ects_operator=None, domain_id=None, domain_name=None, name_contains=None, mobility=None, soft_skills=None) -> Column:  # noqa: ANN001
    return R.all_of([
        R.optional_compare("ects", ects, ects_operator), R.optional_equal("domain_id", domain_id), R.optional_like(["domain_name"], domain_name), R.optional_like(["name"], name_contains),
        R.optional_equal("mobility", R.tri_state(mobility)), R.optional_equal("soft_skills", R.tri_state(soft_skills)),
    ])


def _semi(df: DataFrame, t: Tables, semester=None, semester_type=None, language=None) -> DataFrame:  # noqa: ANN001
    if semester is not None:
        df = df.join(_offered(t, semester), "code", "left_semi")
    if semester_type is not None:
        df = df.join(_offered(t, kind=semester_type), "code", "left_semi")
    return df if language is None else df.join(_taught_in(t, language), "code", "left_semi")


def _split(filters: dict, names: tuple[str, ...]) -> dict:
    return {k: filters.pop(k) for k in names if k in filters}


_COURSE = ("ects", "ects_operator", "domain_id", "domain_name", "name_contains", "mobility", "soft_skills")
_SEMI = ("semester", "semester_type", "language")


def program_courses_by_metadata(t: Tables, course_type: str | None = None, section_contains: str | None = None, q: str | None = None, limit: int | None = None, **filters) -> DataFrame:  # noqa: ANN003
    """Courses of all programmes that fit, with programme columns and documents; 100 rows if no limit is given."""
    course, semi = _split(filters, _COURSE), _split(filters, _SEMI)
    p = R.lookup(t["studyprogram"], _faculty(t, "pf"), "faculty_id").where(_program_filter(**filters))
    p = p.select("program_id", F.col("name").alias("program_name"), *[F.col(c).alias(f"program_{c}") for c in ("name_en", "name_de", "name_fr")], "degree_level", "total_ects", R.program_type(F.col("total_ects"), F.col("degree_level")).alias("program_type"), "study_start")
    co = t["consist_of"].select("program_id", "code", F.col("course_name").alias("co_name"), "course_type", F.col("description").alias("program_course_description"))
    co = co.where(R.all_of([R.optional_equal("course_type", course_type), R.optional_like(["program_course_description"], section_contains)]))
    c = _semi(_courses(t).where(_course_filter(**course)), t, **semi)
    x = p.join(co, "program_id").join(c, "code")
    x = x.where(R.all_of([R.optional_like(["program_name", "program_name_en", "program_name_de", "program_name_fr", "name", "description", "learning_goals", "co_name", "program_course_description", "domain_name"], q)]))
    x = x.withColumn("program_sort_name", F.coalesce("program_name_en", "program_name")).withColumnRenamed("cf_name_en", "faculty_name").drop("cf_name_de", "cf_name_fr", "co_name").distinct()
    top = x.orderBy("program_sort_name", "degree_level", "total_ects", F.asc_nulls_last("program_course_description"), "code").limit(100 if limit is None else limit)
    return _with_documents(top, t).orderBy("program_sort_name", "degree_level", "total_ects", F.asc_nulls_last("program_course_description"), "code")


def program_courses(t: Tables, program_id: int, course_type: str | None = None, section_contains: str | None = None, q: str | None = None, limit: int | None = None, **filters) -> DataFrame:  # noqa: ANN003
    """Distinct courses of one programme by code; 100 rows if no limit is given."""
    course, semi = _split(filters, _COURSE), _split(filters, _SEMI)
    co = t["consist_of"].where((F.col("program_id") == program_id) & R.all_of([R.optional_equal("course_type", course_type)])).select("code", "course_type", F.col("course_name").alias("co_name"), F.col("description").alias("program_course_description"))
    x = co.join(_semi(_courses(t).where(_course_filter(**course)), t, **semi), "code")
    x = x.where(R.all_of([R.optional_like(["program_course_description"], section_contains), R.optional_like(["name", "description", "learning_goals", "co_name", "program_course_description", "domain_name"], q)]))
    return x.withColumnRenamed("cf_name_en", "faculty_name").drop("cf_name_de", "cf_name_fr", "co_name").distinct().orderBy("code").limit(100 if limit is None else limit)


def course_sections(t: Tables, program_id: int, code: str | None = None, course_type: str | None = None, section_contains: str | None = None, non_empty_only: str | bool | None = None, limit: int | None = None) -> DataFrame:
    """Section rows of one programme, those without a section last; a table without the section column has none."""
    co = t["consist_of"].where(F.col("program_id") == program_id)
    section = F.col("description") if "description" in co.columns else F.lit(None).cast("string")
    x = co.withColumn("section_heading", section).where(R.all_of([R.optional_equal("code", code), R.optional_equal("course_type", course_type), R.optional_like(["section_heading"], section_contains and section_contains.strip())]))
    if R.tri_state(non_empty_only):
        x = x.where(R.non_empty(F.col("section_heading")))
    c = t["course"].select("code", "ects", F.col("name").alias("canonical_course_name"))
    out = x.join(c, "code", "left").select("program_id", "code", F.coalesce("course_name", "canonical_course_name").alias("course_name"), "course_type", "section_heading", "ects", "canonical_course_name")
    return out.orderBy(F.asc_nulls_last("section_heading"), "course_type", "code").limit(100 if limit is None else limit)


def _links(t: Tables) -> DataFrame:
    """(code, link_course_catalogue, course_catalogue_links): the latest link of a course and all of them, by falling semester id."""
    o = t["courseoffering"].where("link_course_catalogue is not null")
    all_ = F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("sem_id", F.lit("")).alias("s"), F.col("offering_id").alias("o"), "sem_id", "link_course_catalogue")), False), lambda x: F.struct(x["o"].alias("offering_id"), x["sem_id"].alias("sem_id"), x["link_course_catalogue"].alias("link_course_catalogue")))
    return o.groupBy("code").agg(all_.alias("course_catalogue_links")).withColumn("link_course_catalogue", F.get("course_catalogue_links", 0)["link_course_catalogue"])


def _found_courses(t: Tables, code: str | None = None, faculty_id: int | None = None, faculty_name: str | None = None, program_id: int | None = None, program_name: str | None = None, q: str | None = None, **filters) -> DataFrame:  # noqa: ANN003
    """All courses that fit, each once."""
    course, semi = _split(filters, _COURSE), _split(filters, _SEMI)
    x = _courses(t).where(_course_filter(**course)).where(R.all_of([None if code is None else R.code_match("code", code), R.optional_equal("faculty_id", faculty_id), R.optional_like(["cf_name_en", "cf_name_de", "cf_name_fr"], faculty_name)]))
    x = _semi(x, t, **semi)
    if program_id is not None or program_name is not None or q is not None:
        p = t["studyprogram"].select("program_id", *[F.col(c).alias(f"p_{c}") for c in ("name", "name_en", "name_de", "name_fr")])
        names = ["p_name", "p_name_en", "p_name_de", "p_name_fr"]
        co = t["consist_of"].select("program_id", "code", F.col("course_name").alias("co_name"), F.col("description").alias("co_description")).join(p, "program_id", "left")
        y = x.join(co, "code", "left").where(R.all_of([R.optional_equal("program_id", program_id), R.optional_like(names, program_name), R.optional_like(["name", "description", "learning_goals", "co_name", "co_description", "domain_name", *names], q)]))
        x = x.join(y.select("code").distinct(), "code", "left_semi")
    return x.withColumnRenamed("cf_name_en", "faculty_name").drop("cf_name_de", "cf_name_fr").distinct()


def courses(t: Tables, limit: int | None = None, **filters) -> DataFrame:  # noqa: ANN003
    """Distinct courses by code, 50 if no limit is given; catalogue links only where one to three rows are found."""
    top = _found_courses(t, **filters).orderBy("code").limit(50 if limit is None else limit)
    return R.hide_if_many(R.hide_if_many(top.join(_links(t), "code", "left"), "link_course_catalogue", 3), "course_catalogue_links", 3).orderBy("code")


def course(t: Tables, code: str) -> DataFrame:
    """One course by code with its most recent link."""
    x = _courses(t).where(R.code_match("code", code)).orderBy("code").limit(1)
    return x.withColumnRenamed("cf_name_en", "faculty_name").drop("cf_name_de", "cf_name_fr").join(_links(t).drop("course_catalogue_links"), "code", "left")


def offerings(t: Tables, sem_id: str | None) -> DataFrame:
    """A semester's offerings with course names; links are hidden where there are more than three rows."""
    if not sem_id:
        raise ValueError("sem_id is required")
    x = t["courseoffering"].where(F.col("sem_id") == sem_id).join(t["course"].select("code", "name"), "code")
    note = F.when(F.col("_n") > 3, "Course catalogue links are only returned when 3 or fewer offerings match.")
    x = x.withColumn("_n", F.count("*").over(Window.partitionBy("sem_id"))).withColumn("link_note", note).withColumn("link_course_catalogue", F.when(F.col("_n") <= 3, F.col("link_course_catalogue"))).drop("_n")
    return x.orderBy(F.asc_nulls_last("name"), "code", "offering_id")


def program_documents(t: Tables, program_id: int, doc_type: str | None = None) -> DataFrame:
    """A programme's documents, newest first."""
    x = t["programdocument"].where((F.col("program_id") == program_id) & R.all_of([R.optional_equal("doc_type", doc_type)]))
    return x.orderBy(F.desc_nulls_last("fetched_at"), F.desc("doc_id"))


def studyplans(t: Tables, degree_level: str | None = None, faculty_id: int | None = None) -> DataFrame:
    """Study plans with their programmes."""
    p = t["studyprogram"].where(R.all_of([R.optional_equal("degree_level", degree_level), R.optional_equal("faculty_id", faculty_id)])).select("program_id", F.col("name").alias("program_name"), "degree_level", "total_ects", "faculty_id")
    return t["programdocument"].where("doc_type = 'study_plan'").join(p, "program_id").orderBy("program_name", "degree_level", F.desc_nulls_last("fetched_at"))


def semesters(t: Tables) -> DataFrame:
    """Labelled semesters, years falling, autumn first."""
    autumn = F.when(F.col("type") == "Autumn", 0).otherwise(1)
    return t["semester"].select("sem_id", "year", "type", R.semester_label(F.col("type"), F.col("year")).alias("label")).orderBy(F.desc("year"), autumn, F.desc("sem_id"))


def planner_programs(t: Tables, locale: str | None = None, degree_level: str | None = None, q: str | None = None, limit: int | None = None) -> DataFrame:
    """Programmes with a name in the locale and their languages; 500 rows if no limit is given."""
    p = t["studyprogram"].where(R.all_of([R.optional_equal("degree_level", degree_level), R.optional_like(["name", "name_de", "name_en", "name_fr"], q)]))
    langs = t["has_lang"].join(t["language"], "lang_id").groupBy("program_id").agg(R.sorted_set(F.col("description")).alias("languages"))
    x = R.lookup(p.join(langs, "program_id", "left"), _faculty(t, "f"), "faculty_id")
    order = R.LOCALE_ORDER.get((locale or "de").lower(), R.LOCALE_ORDER["de"])
    out = x.select("program_id", "degree_level", "total_ects", "study_start", "faculty_id", F.col("f_name_en").alias("faculty_name"), R.locale_fallback(*order).alias("display_name"), "name_de", "name_en", "name_fr", F.coalesce("languages", F.array().cast("array<string>")).alias("languages"))
    return out.orderBy(F.asc_nulls_last("display_name"), "degree_level", "total_ects", "program_id").limit(500 if limit is None else limit)


def planner_courses(t: Tables, sem_id: str, program_ids: str | list[str], locale: str | None = None) -> DataFrame:
    """A semester's offerings of some programmes: languages, and the programmes they are mandatory or elective for."""
    ids = R.id_list(program_ids)
    if not sem_id or not ids:
        raise ValueError("sem_id and program_ids are required")
    order = R.LOCALE_ORDER.get((locale or "de").lower(), R.LOCALE_ORDER["de"])
    p = t["studyprogram"].where(F.col("program_id").isin(ids)).select("program_id", R.locale_fallback(*order).alias("program_name"))
    per = t["consist_of"].join(p, "program_id").groupBy("code").agg(
        F.array_sort(F.collect_set(F.when(F.col("course_type") == "Mandatory", F.struct("program_id", "program_name")))).alias("mandatory_for"),
        F.array_sort(F.collect_set(F.when(F.col("course_type") == "Elective", F.struct("program_id", "program_name")))).alias("elective_for"),
        F.array_sort(F.collect_set(F.struct("program_id", "program_name", "course_type"))).alias("programs"),
    )
    langs = t["is_taught_in"].join(t["language"], "lang_id").groupBy("offering_id").agg(R.sorted_set(F.col("description")).alias("teaching_languages"))
    c = t["course"].select("code", F.col("name").alias("course_name"), "description", "learning_goals", "ects")
    x = t["courseoffering"].where(F.col("sem_id") == sem_id).join(per, "code").join(c, "code").join(langs, "offering_id", "left")
    return x.withColumn("teaching_languages", F.coalesce("teaching_languages", F.array().cast("array<string>"))).orderBy(F.asc_nulls_last("course_name"), "code", "offering_id")


def _bare(code: str) -> str:
    """A code as ``code_strict`` writes it."""
    return re.sub("[^A-Z0-9]", "", re.sub(r"^UE[-\s]?", "", code.strip().upper()))


def plan_courses(t: Tables, program_id: int, completed: str = "") -> DataFrame:
    """A programme's courses as the planner takes them, without the completed ones. Offerings of other courses are left out before they are joined."""
    own = persist_shared(t["consist_of"].where(F.col("program_id") == program_id), "programme-courses")
    offered = persist_shared(R.lookup(t["courseoffering"], own.select("code").distinct(), "code", "left_semi"), "programme-offerings")
    sem = offered.join(t["semester"], "sem_id")
    when = F.struct(F.col("year"), (F.col("type") == "Autumn").cast("int"))
    kinds = sem.groupBy("code").agg(R.sorted_set(F.col("type")).alias("semester_types"), F.max_by("day_time_info", when).alias("day_time_info"), F.max_by("sem_id", when).alias("sem_id"))
    langs = offered.select("offering_id", "code").join(t["is_taught_in"], "offering_id").join(t["language"], "lang_id").groupBy("code").agg(R.sorted_set(F.col("description")).alias("languages"))
    c = t["course"].select("code", F.col("name").alias("canonical"), "ects")
    x = own.join(c, "code").join(kinds, "code", "left").join(langs, "code", "left")
    none = F.array().cast("array<string>")
    done = [k for k in (completed or "").split(",") if k.strip()]
    if done:
        x = x.where(~code_strict(F.col("code")).isin([_bare(k) for k in done]))
    return x.select(
        F.col("program_id").cast("long").alias("plan"), F.col("ordinal").alias("row_no"), "code", F.coalesce(F.nullif("course_name", F.lit("")), "canonical", "code").alias("name"), "ects", "course_type", F.col("description").alias("section"),
        F.coalesce("semester_types", none).alias("semester_types"), F.coalesce("languages", none).alias("languages"), study_year(F.col("description")).alias("suggested_year"), "day_time_info", "sem_id",
    )


def plan_proposal(t: Tables, program_id: int, semesters: int = 8, total_ects: float | None = None, selected: list[str] = (), completed: str = "") -> dict[str, DataFrame]:
    """A plan over 1 to 16 semesters: totals, choice groups, semester slots, electives."""
    semesters = max(1, min(16, semesters))
    grouped = planning.equivalence_groups(plan_courses(t, program_id, completed))
    groups = planning.roll_up(grouped)
    mandatory = groups.where("course_type = 'Mandatory'")
    electives = groups.where("course_type <> 'Mandatory'")
    wanted = electives.where(F.exists("codes", lambda c: code_strict(c).isin([_bare(s) for s in selected]))) if selected else electives.limit(0)
    slots = planning.plan_semesters(mandatory.unionByName(wanted), semesters, total_ects, bool(selected))
    sums = mandatory.agg(F.coalesce(F.sum("planned_ects"), F.lit(0.0)).alias("mandatory_ects"))
    own = t["studyprogram"].where(F.col("program_id") == program_id).select(F.coalesce(F.lit(total_ects), "total_ects", F.lit(180.0)).alias("total_ects"))
    totals = own.join(sums, F.lit(True)).select("total_ects", (F.col("total_ects") / semesters).alias("target_ects_per_semester"), "mandatory_ects", F.greatest(F.lit(0.0), F.col("total_ects") - F.col("mandatory_ects")).alias("elective_ects_required"))
    return {"totals": totals, "choice_groups": mandatory.where("requires_choice"), "slots": slots, "elective_courses": grouped.where("course_type <> 'Mandatory'")}


def offering(t: Tables, offering_id: int) -> dict[str, DataFrame]:
    """One offering with its languages, teachers, and dated sessions with their German weekday."""
    o = t["courseoffering"].where(F.col("offering_id") == offering_id)
    langs = t["is_taught_in"].where(F.col("offering_id") == offering_id).join(t["language"], "lang_id").select("description").distinct().orderBy("description")
    profs = o.select("code").join(t["teaches"], "code").join(t["professor"], "prof_id").select("prof_id", "title", "first_name", "last_name", "email").distinct().orderBy("last_name", "first_name")
    dates = t["session"].where(F.col("offering_id") == offering_id).withColumn("weekday", weekday_name(F.col("date"), GERMAN_DAYS)).orderBy("date", "start_time", "session_id")
    return {"offering": o.join(t["course"].select("code", F.col("name").alias("course_name"), "ects"), "code"), "languages": langs, "professors": profs, "sessions": dates}


def mobility(t: Tables, semesters: list[str], interest: str | None = None, language: str | None = None, enough: int = 50) -> DataFrame:
    """(sem_id, code, attempt): mobility courses of up to two semesters, searched ever wider until enough are found.

    Tries are for interest and language, for interest, and for language. What a course offers doesn't depend on the try or the semester, so it is
    found out once, and a course's first try follows from it.
    """
    t = t | {k: persist_shared(t[k], k) for k in ("courseoffering", "semester")}
    able = _courses(t).where(_course_filter(mobility=True)).select("code").distinct()
    marks = {}
    if interest is not None:
        marks["_asked"] = _found_courses(t, mobility=True, q=interest).select("code").distinct()
    if language is not None:
        marks["_spoken"] = _taught_in(t, language)
    for mark, codes in marks.items():
        able = able.join(codes.withColumn(mark, F.lit(True)), "code", "left")
    able = persist_shared(able, "mobility-courses")
    asked, spoken = (F.coalesce(F.col(m), F.lit(False)) if m in marks else F.lit(True) for m in ("_asked", "_spoken"))
    attempt = F.when(asked & spoken, 0).when(asked, 1).when(spoken, 2)
    out = None
    for s in semesters[:2]:
        first = able.join(_offered(t, s), "code", "left_semi").select("code", attempt.alias("attempt")).where("attempt is not null")
        one = R.until_enough(persist_shared(first, "attempts"), enough).select(F.lit(s).alias("sem_id"), "code", "attempt")
        out = one if out is None else out.unionByName(one)
    return out.orderBy("sem_id", "attempt", "code")


#: The callable surface: name -> (function, arguments that are let through).
TOOLS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "get_programs": (programs, ("name", "name_en", "name_de", "name_fr", "degree_level", "faculty_id", "faculty_name", "study_start", "total_ects", "total_ects_operator", "program_type")),
    "get_program": (program, ("program_id",)),
    "get_program_courses_by_metadata": (program_courses_by_metadata, ("name", "name_en", "name_de", "name_fr", "degree_level", "faculty_id", "faculty_name", "study_start", "total_ects", "total_ects_operator", "program_type", "course_type", "section_contains", "q", "limit", *_COURSE, *_SEMI)),
    "get_program_courses": (program_courses, ("program_id", "course_type", "section_contains", "q", "limit", *_COURSE, *_SEMI)),
    "get_course_sections": (course_sections, ("program_id", "code", "course_type", "section_contains", "non_empty_only", "limit")),
    "get_courses": (courses, ("code", "faculty_id", "faculty_name", "program_id", "program_name", "q", "limit", *_COURSE, *_SEMI)),
    "get_course_by_code": (course, ("code",)),
    "get_offerings": (offerings, ("sem_id",)),
    "get_program_documents": (program_documents, ("program_id", "doc_type")),
    "get_studyplans": (studyplans, ("degree_level", "faculty_id")),
    "get_semesters": (semesters, ()),
    "get_planner_programs": (planner_programs, ("locale", "degree_level", "q", "limit")),
    "get_planner_courses": (planner_courses, ("sem_id", "program_ids", "locale")),
    "get_study_program_plan": (plan_proposal, ("program_id", "semesters", "total_ects", "selected", "completed")),
    "get_offering": (offering, ("offering_id",)),
    "search_mobility": (mobility, ("semesters", "interest", "language", "enough")),
    "extract_codes": (lambda t, text: t["course"].sparkSession.range(1).select(F.explode(extract_codes(F.lit(text))).alias("code")), ("text",)),
    "match_code": (lambda t, code: t["course"].where(code_loose(F.col("code")) == code.upper().strip().removeprefix("UE-")), ("code",)),
}


def call(t: Tables, tool: str, args: dict) -> DataFrame | dict[str, DataFrame]:
    """Run a tool with those arguments that it lets through; unknown tools are an error, unknown arguments are left out."""
    if tool not in TOOLS:
        raise KeyError(f"unknown tool: {tool}")
    run, allowed = TOOLS[tool]
    return run(t, **{k: v for k, v in args.items() if k in allowed and v is not None})
