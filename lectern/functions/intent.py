"""What a question asks for, by rules: which store to search, and which structured query to run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that choose the store; regulations first, then base data, then study plans.
STORES = (
    ("regulations", ("reglement", "regulation", "ordnung", "article", "artikel", "paragraph", "§")),
    ("base_data", ("faculty", "faculties", "domain", "study program", "study programme", "programmes", "degree", "university", "department", "base data")),
    ("studyplans", ("studienplan", "study plan", "module", "modul", "kurs", "course", "ects", "pflicht", "mandatory", "bachelor", "master", "semester", "program", "curriculum")),
)
#: Words of the parts of a structured question, in three languages.
WORDS = {
    "course": ("course", "module", "kurs", "cours", "enseignement"),
    "program": ("program", "studiengang", "studiengänge", "studiengaenge"),
    "mandatory": ("mandatory", "required", "pflicht", "obligatorisch", "obligatoire"),
    "elective": ("elective", "wahl", "optionnel", "à option", "a option"),
    "autumn": ("autumn", "fall", "herbst", "automne"),
    "spring": ("spring", "frühling", "fruehling", "printemps"),
    "bachelor": ("bachelor", "baccalauréat", "baccalaureat"),
    "master": ("master", "maîtrise", "maitrise"),
    "doctorate": ("doctorate", "phd", "doktorat", "doctorat"),
}
LANGUAGES = (("English", ("english", "anglais", "englisch")), ("German", ("german", "deutsch", "allemand")), ("French", ("french", "français", "francais", "franzoesisch", "französisch")))
QUESTION_LANGUAGES = (("de", ("welche", "welcher", "studiengang", "kurse", "pflicht", "wahl", "deutsch", "herbst", "frühling", "fruehling")), ("fr", ("quels", "quelles", "programme", "cours", "obligatoire", "optionnel", "français", "francais", "automne", "printemps")))
#: Words of comparisons.
COMPARISONS = ((">=", "at least|minimum|min"), ("<=", "at most|maximum|max"), (">", "greater than|more than|above|over"), ("<", "less than|fewer than|below|under"))


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds any of the words, inside longer words too."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def _choose(c: Column, cases, otherwise) -> Column:  # noqa: ANN001
    out = F.lit(otherwise)
    for value, words in reversed(cases):
        out = F.when(has_any(c, words), value).otherwise(out)
    return out


def store(question: Column) -> Column:
    return _choose(F.lower(question), STORES, "studyplans")


def question_language(question: Column) -> Column:
    return _choose(F.lower(question), QUESTION_LANGUAGES, "en")


def course_code(question: Column) -> Column:
    return F.nullif(F.regexp_extract(question, r"(?<![A-Za-z0-9_])([A-Z]{2}-[A-Z][0-9]{2}\.[0-9]{5})(?![0-9A-Za-z_])", 1), F.lit(""))


def credit_filter(question: Column) -> Column:
    """"12", ">12", "<=30" of words like "more than 12 ECTS"; null if no credits are named."""
    q = F.lower(question)
    words = "|".join(w for _, w in COMPARISONS)
    pattern = rf"({words}|>=|<=|>|<|=)?\s*([0-9]{{1,3}})\s*(?:total\s*)?ects"
    word, number = F.regexp_extract(q, pattern, 1), F.regexp_extract(q, pattern, 2)
    sign = F.when(word.isin(">=", "<=", ">", "<"), word).otherwise("")
    for s, ws in COMPARISONS:
        sign = F.when(word.isin(*ws.split("|")), s).otherwise(sign)
    return F.when(number != "", F.concat(sign, number))


def program_name(question: Column) -> Column:
    """The programme a question names after its degree, or after the words for courses; null if none is left when cleaned."""
    ends = r"(?:\s+with\s+[0-9].*|\s+[0-9]{2,3}\s*ects.*|\?.*)?$"
    found = F.lit("")
    for p in (
        rf"(?i)\b(?:courses?|modules?|kurse?|cours)\s+(?:in|for|of|im|für|fuer|dans|du|des|en|pour)\s+(.+?){ends}",
        rf"(?i)\b(?:bachelor|master|doctorate)\s+(?!level)(.+?)(?:\s+program.*)?{ends}",
        rf"(?i)\b(?:bachelor|master|doctorate)\s+(?:of|in)\s+(.+?){ends}",
    ):
        m = F.regexp_extract(question, p, 1)
        found = F.when(m != "", m).otherwise(found)
    cut = F.regexp_replace(found, r"(?i)\b(?:program\w*|studiengang\w*|courses?|modules?|kurse?|cours|mandatory|elective|pflicht|wahl|obligatoire|optionnel|include\w*|first|study year|studienjahr|ann[eé]e)\b.*$", "")
    cut = F.regexp_replace(cut, r"(?i)^(?:im|in|the|dans|du|des|für|fuer|for|of)\s+", "")
    cut = F.regexp_replace(cut, r"^[\s?.,;:-]+|[\s?.,;:-]+$", "")
    return F.when(~F.lower(cut).isin("", "level", "program", "programs", "course", "courses"), F.initcap(cut))


def plan(question: Column) -> Column:
    """(tool, args): the structured query of a question by the first rule that fits; null tool if none does.

    A course code asks for that course; words for courses ask for a programme's courses by what is named, or, with
    credits alone, for courses of these credits; words for programmes ask for programmes.
    """
    q = F.lower(question)
    is_ = lambda k: has_any(q, WORDS[k])
    pick = lambda *cases: F.coalesce(*[F.when(c, F.lit(v)) for v, c in cases])
    code, credits, name = course_code(question), credit_filter(question), program_name(question)
    degree = pick(("Bachelor", is_("bachelor")), ("Master", is_("master")), ("Doctorate", is_("doctorate")))
    kind = pick(("minor", F.contains(q, F.lit("minor"))), ("major", F.contains(q, F.lit("major"))), ("mono", F.contains(q, F.lit("mono"))))
    course_type = pick(("Mandatory", is_("mandatory")), ("Elective", is_("elective")))
    semester = pick(("Autumn", is_("autumn")), ("Spring", is_("spring")))
    language = F.nullif(_choose(q, LANGUAGES, ""), F.lit(""))
    by_credits = is_("course") & name.isNull() & degree.isNull() & kind.isNull() & credits.isNotNull() & course_type.isNull()
    of_program = is_("course") & (name.isNotNull() | degree.isNotNull() | credits.isNotNull() | kind.isNotNull() | course_type.isNotNull())
    tool = (
        F.when(code.isNotNull(), "get_course_by_code").when(by_credits, "get_courses").when(of_program, "get_program_courses_by_metadata").when(is_("program") & ~is_("course"), "get_programs")
    )
    mine = lambda t, v: F.when(F.coalesce(tool == t, F.lit(False)), v)
    many = lambda v: F.when(tool.isin("get_program_courses_by_metadata", "get_programs"), v)
    pairs = [
        ("code", mine("get_course_by_code", code)), ("ects", mine("get_courses", credits)), ("program_name", mine("get_program_courses_by_metadata", name)), ("degree_level", many(degree)),
        ("total_ects", many(credits)), ("program_type", many(kind)), ("course_type", mine("get_program_courses_by_metadata", course_type)), ("semester_type", mine("get_program_courses_by_metadata", semester)),
        ("language", mine("get_program_courses_by_metadata", language)),
    ]
    entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in pairs]))
    return F.struct(tool.alias("tool"), F.map_from_entries(entries).alias("args"))
