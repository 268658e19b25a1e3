"""Text functions on columns: normalisers, codes, schedules, credits, names, addresses."""

from __future__ import annotations

import difflib
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- white space, accents, normalisers ----

#: Letters with accents of Latin-1 and what they fold to.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def fold_accents(c: Column) -> Column:
    """Letters without their accents, for Latin-1; see ``fold_accents_all`` for every script."""
    return F.translate(c, _ACCENTED, _PLAIN)


def fold_accents_all(c: Column) -> Column:
    """Compatibility decomposition without combining marks, for every script."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))

    return fold(c)


def normalize_plan(c: Column) -> Column:
    """For course titles: no accents, no brackets, no language letters, letters and digits only."""
    x = F.lower(fold_accents(F.coalesce(c, F.lit(""))))
    x = F.regexp_replace(x, r"\([^)]*\)", " ")
    x = F.regexp_replace(x, r"(?<![a-z0-9_])(?:fr|de|en|f|d|e)(?![a-z0-9_])", " ")
    return F.trim(F.regexp_replace(x, r"[^a-z0-9]+", " "))


def normalize_match(c: Column) -> Column:
    """For matching: no accents, & as and, apostrophes gone, letters and digits only."""
    x = F.replace(fold_accents(F.lower(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[’'`]", ""), "[^a-z0-9]+", " "))


def normalize_query(c: Column) -> Column:
    """For search: lower case, & as and, separators and punctuation as spaces; accents stay."""
    x = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and "))
    return squeeze(F.regexp_replace(F.regexp_replace(x, "[_/-]", " "), r"[^\p{L}\p{N}\s]", " "))


def normalize_title(c: Column) -> Column:
    """For keys of titles: no accents, letters and digits only; null stays null."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(c)), "[^a-z0-9]+", " "))


def normalize_label(c: Column) -> Column:
    """For labels: lower case, white space squeezed."""
    return squeeze(F.lower(c))


def normalize_page(c: Column) -> Column:
    """For page texts: line ends as \\n, runs of blanks and tabs as one space, two line ends at most, trimmed."""
    x = F.replace(F.regexp_replace(c, r"\r\n?", "\n"), F.lit("&amp;"), F.lit("&"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def substitute(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Whole-phrase substitutions in the order of ``rules``; a later rule sees what earlier ones wrote."""
    return squeeze(reduce(lambda x, r: F.regexp_replace(x, rf"(?<![a-z0-9])(?:{r[0]})(?![a-z0-9])", r[1]), rules, c))


#: Names of subjects in German and French and what they are called in English, in this order.
SUBJECTS = [
    ("informatik", "computer science"), ("informatique", "computer science"), ("wirtschaftsinformatik", "business informatics"), ("informatique de gestion", "business informatics"),
    ("betriebswirtschaftslehre", "business administration"), ("gestion dentreprise", "business administration"), ("volkswirtschaftslehre", "economics"), ("sciences economiques", "economics"),
    ("humanmedizin", "human medicine"), ("medecine humaine", "human medicine"), ("medizin", "medicine"), ("medecine", "medicine"), ("mathematik", "mathematics"), ("mathematiques", "mathematics"),
    ("physik", "physics"), ("physique", "physics"), ("chemie", "chemistry"), ("chimie", "chemistry"), ("geographie", "geography"), ("biologie", "biology"), ("biochimie", "biochemistry"),
    ("sportwissenschaften", "sport sciences"), ("sciences du sport", "sport sciences"), ("digitale neurowissenschaft", "digital neuroscience"), ("neurosciences digitales", "digital neuroscience"),
    ("experimentelle biomedizinische forschung", "experimental biomedical research"), ("recherche biomedicale experimentale", "experimental biomedical research"),
    ("islam und gesellschaft", "islam and society"), ("islam et societe", "islam and society"), ("familien kinder und jugendstudien", "family children youth studies"),
    ("etudes sur la famille lenfance et la jeunesse", "family children youth studies"), ("umweltgeisteswissenschaften und nachhaltigkeitsforschung", "environmental humanities sustainability studies"),
    ("humanites environnementales et durabilite", "environmental humanities sustainability studies"), ("unterricht auf der primarstufe", "teacher education primary level"),
    ("formation a lenseignement pour le degre primaire", "teacher education primary level"), ("unterricht auf der sekundarstufe i", "teacher education secondary level i"),
    ("formation a lenseignement pour le degre secondaire i", "teacher education secondary level i"), ("unterricht an maturitatsschulen", "teacher education baccalaureate schools"),
    ("maturitatsschulen", "baccalaureate schools"), ("erziehungswissenschaften", "education sciences"), ("sciences de leducation", "education sciences"),
]
#: Further names that only the patching of unmatched documents knows, in this order.
PATCH_SUBJECTS = [
    ("sciences de lenvironnement", "environmental sciences"), ("sciences de l environnement", "environmental sciences"), ("umweltwissenschaften", "environmental sciences"),
    ("environmental sciences and humanities", "environmental humanities sustainability studies"), ("environmental sciences humanities", "environmental humanities sustainability studies"),
    ("umweltgeisteswissenschaften und nachhaltigkeitsforschung", "environmental humanities sustainability studies"), ("interreligiose studien", "interreligious studies"), ("interreligioese studien", "interreligious studies"),
    ("interreligiose", "interreligious"), ("humanmedizin", "human medicine"), ("medecine humaine", "human medicine"), ("medizin", "medicine"), ("medecine", "medicine"),
    ("unterricht auf der sekundarstufe i und an maturitatsschulen", "teacher education secondary level i and baccalaureate schools"), ("unterricht an maturitatsschulen", "teacher education baccalaureate schools"),
    ("unterricht auf der sekundarstufe i", "teacher education secondary level i"), ("unterricht auf der primarstufe", "teacher education primary level"),
]


def subject_name(c: Column) -> Column:
    """A subject's name for matching across languages."""
    return substitute(normalize_match(c), SUBJECTS)


# ---- tokens and similarity ----

#: Words of questions that carry no subject.
QUESTION_STOPWORDS = (
    "what which who when where how are is the a an of in for to and or with without offered taught courses course modules module programme program study studies plan "
    "year semester bachelor master welche welcher welches werden wird sind ist im des der die das ein eine einer einem einen von zu zum zur und oder mit ohne angeboten "
    "unterrichtet gelehrt kurse kurs modul studiengang studienplan jahr ersten erstes erste quels quelles cours sont dans du de la le les pour annee"
).split()


def tokens(c: Column, stopwords: list[str] = (), least: int = 1, digits: bool = True) -> Column:
    """Distinct words of a normalised text, without stopwords, short words and (if not ``digits``) numbers."""
    words = F.filter(F.split(c, r"\s+"), lambda w: (F.length(w) >= least) & (F.lit(digits) | ~w.rlike("^[0-9]+$")))
    return F.array_distinct(F.array_except(words, F.array(*[F.lit(s) for s in stopwords]).cast("array<string>")))


def ratcliff_obershelp(a: Column, b: Column) -> Column:
    """Matching-blocks similarity of two texts, 0 to 1; null if either is null."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype=object)

    return ratio(a, b)


def name_similarity(a: Column, b: Column) -> Column:
    """The larger of the token overlap and 0.6 of the text similarity, to four digits."""
    ta, tb = tokens(normalize_match(a)), tokens(normalize_match(b))
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect(ta, tb)), F.greatest(F.size(ta), F.size(tb))), F.lit(0.0))
    return F.round(F.greatest(overlap, F.coalesce(ratcliff_obershelp(normalize_match(a), normalize_match(b)), F.lit(0.0)) * 0.6), 4)


def initials(c: Column) -> Column:
    """First letters of the words of three letters or more, lower case; null unless two to eight of them."""
    words = F.filter(F.regexp_extract_all(c, F.lit(r"([\p{L}]+)"), F.lit(1)), lambda w: F.length(w) > 2)
    x = F.lower(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return F.when(F.length(x).between(2, 8), x)


# ---- codes ----


def code_strict(c: Column) -> Column:
    """Upper case, without the UE prefix, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"^UE[-\s]?", ""), "[^A-Z0-9]", "")


def code_loose(c: Column) -> Column:
    """Upper case and trimmed, without the UE- prefix."""
    return F.regexp_replace(F.upper(F.trim(c)), "^UE-", "")


def code_bare(c: Column) -> Column:
    """Upper case letters and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def extract_codes(c: Column) -> Column:
    """Distinct course codes, loose ones (AB.12345, UE-ABC.00123) before strict ones (AB-A12.34567)."""
    x = F.upper(c)
    loose = F.regexp_extract_all(x, F.lit(r"(?<![A-Z0-9])((?:UE-)?[A-Z]{2,4}\.\d{4,5})(?!\d)"), F.lit(1))
    strict = F.regexp_extract_all(x, F.lit(r"(?<![A-Z0-9])([A-Z]{2,4}-[A-Z]\d{2}\.\d{5})(?!\d)"), F.lit(1))
    return F.array_distinct(F.concat(loose, strict))


#: Fixed value: course codes as converted pages write them, with blanks around the point and between digits.
PAGE_CODE = r"\b(?:UE\s*-\s*)?(?=[A-Z0-9]{2,4}\s*\.)[A-Z0-9]*[A-Z][A-Z0-9]*\s*\.\s*(?:[0-9]\s*){5}\b"


def page_codes(c: Column) -> Column:
    """Distinct codes of a converted page's line, in order, without blanks and with the UE- prefix."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", ""), "^UE-", "")
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({PAGE_CODE})"), F.lit(1)), lambda x: F.concat(F.lit("UE-"), bare(x))))


# ---- schedules ----

#: Names of the days in three languages.
WEEKDAYS = {
    "monday": "Monday", "tuesday": "Tuesday", "wednesday": "Wednesday", "thursday": "Thursday", "friday": "Friday", "saturday": "Saturday", "sunday": "Sunday",
    "montag": "Monday", "dienstag": "Tuesday", "mittwoch": "Wednesday", "donnerstag": "Thursday", "freitag": "Friday", "samstag": "Saturday", "sonntag": "Sunday",
    "lundi": "Monday", "mardi": "Tuesday", "mercredi": "Wednesday", "jeudi": "Thursday", "vendredi": "Friday", "samedi": "Saturday", "dimanche": "Sunday",
}
_BLOCK = r"(?i)(" + "|".join(WEEKDAYS) + r")\s+(\d{1,2}):(\d{2})\s*[-–]\s*(\d{1,2}):(\d{2})"


def english_day(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in WEEKDAYS.items() for x in p])[F.lower(c)]


def time_blocks(c: Column) -> Column:
    """Weekly blocks of a free text as structs of day (English), start and end (minutes of the day)."""
    part = lambda k: F.regexp_extract_all(c, F.lit(_BLOCK), F.lit(k))
    z = F.arrays_zip(part(1).alias("day"), part(2).alias("h1"), part(3).alias("m1"), part(4).alias("h2"), part(5).alias("m2"))
    return F.transform(
        z,
        lambda x: F.struct(
            english_day(x["day"]).alias("day"),
            (x["h1"].cast("int") * 60 + x["m1"].cast("int")).alias("start"),
            (x["h2"].cast("int") * 60 + x["m2"].cast("int")).alias("end"),
        ),
    )


# ---- inference from free text ----


def _first(cases: list[tuple[str, str]], c: Column, otherwise: str | None = None) -> Column:
    out = F.lit(otherwise).cast("string")
    for pattern, value in reversed(cases):
        out = F.when(c.rlike(pattern), value).otherwise(out)
    return out


_ELECTIVE_WORDS = r"wahlpflicht|wahlbereich|wahlmodul|wahlf[aä]cher|freie?\s*wahl|wahl|optionnel|optionnelle|options?|(?:au|a)\s+choix|choix|elective|optional|choose"
_MANDATORY_WORDS = r"obligatorisch|pflicht|verpflichtend|obligatoire|mandatory|required|core"
_ELECTIVE, _MANDATORY = rf"\b(?:{_ELECTIVE_WORDS})\b", rf"\b(?:{_MANDATORY_WORDS})\b"
_GAP = r"[\s\x0B\p{Z}\x{FEFF}]+"
_NEGATED_WORDS = rf"nicht{_GAP}obligatorisch|pas{_GAP}obligatoire|not{_GAP}mandatory"


def course_type(*texts: Column) -> Column:
    """Elective or Mandatory by words of either kind; with both, a negated obligation makes it Elective; else Mandatory.

    Words end at whatever is no ASCII letter, digit or underscore, as in the application: "Wahlübung" says Wahl.
    """
    x = F.lower(F.replace(F.concat_ws("\n", *texts), F.lit("\0"), F.lit("")))
    says = lambda words: x.rlike(rf"(?<![a-z0-9_])(?:{words})(?![a-z0-9_])")
    elective, mandatory, negated = says(_ELECTIVE_WORDS), says(_MANDATORY_WORDS), says(_NEGATED_WORDS)
    # a negated obligation holds a mandatory word, so that texts without an elective one are Mandatory in any case
    return F.when(elective & (~mandatory | negated), "Elective").otherwise("Mandatory")


def course_type_or_null(*texts: Column) -> Column:
    """As ``course_type`` for staging: null where nothing is said; a compulsory elective is Elective."""
    x = F.lower(F.concat_ws("\n", *texts))
    return F.when(x.rlike(_ELECTIVE), "Elective").when(x.rlike(_MANDATORY), "Mandatory")


def url_text(c: Column) -> Column:
    """An address with its escapes decoded; as it is if they are malformed."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def credits(c: Column) -> Column:
    """All credit numbers (1 to 240) of a text in order of the evidence, each once.

    Evidence: "90+30 ECTS", clusters like "120-60-30 ECTS", codes like "BA120", and plausible numbers of
    study-plan file names.
    """
    x = url_text(c)
    unit = r"(?:ects|etcs|kreditpunkte|credits?|punkte|points?)\b"
    direct = F.flatten(F.transform(F.regexp_extract_all(x, F.lit(rf"(?i)\b(\d{{1,3}}(?:\s*\+\s*\d{{1,3}})?)\s*{unit}"), F.lit(1)), lambda v: F.split(v, r"\s*\+\s*")))
    cluster = F.flatten(
        F.transform(
            F.regexp_extract_all(x, F.lit(r"(?i)\b(\d{1,3}(?:\s*(?:-|_|/|und|et|and|\+)\s*\d{1,3})+)\s*-?\s*(?:ects|etcs|credits?|kreditpunkte)\b"), F.lit(1)),
            lambda v: F.regexp_extract_all(v, F.lit(r"(\d{1,3})"), F.lit(1)),
        )
    )
    code = F.regexp_extract_all(x, F.lit(r"(?i)(?:^|[^a-z0-9])(?:ba|bachelor|bsc|ma|master|msc|bc|bcp|bp|major|minor|fach|nebenfach|hauptfach|plan|studienplan)[_\-\s]*(\d{1,3})(?=[^a-z0-9]|$)"), F.lit(1))
    name = F.regexp_extract(x, r"([^/?]*)(?:\?.*)?$", 1)
    hinted = name.rlike("(?i)studienplan|plan|ple|ba|ma|bsc|msc|ects|etcs")
    #: Credits that study plans have.
    usual = [9, 14, 20, 30, 35, 50, 60, 90, 105, 106, 120, 150, 180, 240]
    loose = F.when(hinted, F.filter(F.regexp_extract_all(name, F.lit(r"(?<!\d)(\d{1,3})(?!\d)"), F.lit(1)), lambda v: v.cast("int").isin(usual))).otherwise(F.array().cast("array<string>"))
    numbers = F.transform(F.concat(direct, cluster, code, loose), lambda v: v.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda v: v.between(1, 240)))


def degree_level(c: Column) -> Column:
    """D, M or B by the words and path parts of a text; null if none."""
    x = F.lower(url_text(c))
    return _first(
        [(r"\b(?:doctorat|doktorat|doctorate|phd|doctoral)\b", "D"), (r"\b(?:master|msc|ma|spmsc|commsc|premsc)\b", "M"), (r"\b(?:bachelor|bsc|ba)\b", "B"), ("/do[ck]torat/", "D"), ("/ma/|[_-]ma", "M"), ("/ba/|[_-]ba", "B")],
        x,
    )


def year_of(c: Column) -> Column:
    """The first year from 2000 to 2099 that stands alone; null if none."""
    return F.regexp_extract(url_text(c), r"(?<![0-9A-Za-z])(20\d{2})(?![0-9A-Za-z])", 1).try_cast("int")


def language_of(c: Column) -> Column:
    """A language code by path part, separated code or language name; null if none."""
    x = F.lower(url_text(c))
    by_path = F.nullif(F.regexp_extract(x, r"/(de|fr|en|it|es)(?:/|$)", 1), F.lit(""))
    sep = lambda k: rf"(?:^|[_\-\s]){k}(?:$|[_\-\s.])"
    names = {"de": "deutsch|allemand", "fr": "fran[cç]ais|french", "en": "engl", "it": "italien|italiano", "es": "español|spanisch"}
    return F.coalesce(by_path, _first([(f"{sep(k)}|{n}", k) for k, n in names.items()], x))


def category_of(c: Column, level: Column) -> Column:
    """nebenfach, zusatzfach, transition, teaching by words, else by level; null if none."""
    x = F.lower(url_text(c))
    by_level = F.when(level == "B", "bachelor").when(level == "M", "master").when(level == "D", "doctorate")
    return F.coalesce(_first([("minor|nebenfach|nebenprogramm|branche complementaire", "nebenfach"), (r"zusatzfach|\+30|plus30|bcp30", "zusatzfach"), ("trans", "transition"), ("teach|enseignement", "teaching")], x), by_level)


#: Keys of the faculties and words that name them, in the order of precedence.
FACULTIES = [("eduform|education|erziehungs", "EDUFORM"), ("interfaculty|interfak", "INTERFACULTY"), ("law|ius|droit|rechts", "LAW"), ("philo|lettres|arts", "PHILO"), ("scimed|science|med", "SCIMED"), ("ses|management|economics", "SES"), ("theo|théologie", "THEO")]


def faculty_of(c: Column) -> Column:
    """The key of the faculty that a text's words name; null if none."""
    return _first(FACULTIES, F.lower(c))


#: Full names of the faculties, in the order of precedence, and short words that stand for them after these.
FACULTY_NAMES = [
    ("science and medicine", "SCIMED"), ("management economics and social sciences", "SES"), ("law", "LAW"), ("humanities", "PHILO"), ("theology", "THEO"), ("faculty of education", "EDUFORM"),
    ("fakultat fur erziehungs und bildungswissenschaften", "EDUFORM"), ("fakultaet fuer erziehungs und bildungswissenschaften", "EDUFORM"), ("swiss centre for islam and society", "INTERFACULTY"),
    ("institute for family research and counseling", "INTERFACULTY"), ("environmental sciences and humanities institute", "INTERFACULTY"),
    ("scimed", "SCIMED"), ("ses", "SES"), ("ius", "LAW"), ("theo", "THEO"), ("philo|lettres", "PHILO"), ("edu", "EDUFORM"),
]


def faculty_key(c: Column) -> Column:
    """The key itself, or the key of the faculty whose name a text holds; null if none."""
    upper = F.upper(F.trim(c))
    return F.when(upper.isin("SCIMED", "SES", "LAW", "PHILO", "THEO", "EDUFORM", "INTERFACULTY"), upper).otherwise(F.get(F.transform(F.array(subject_name(c)), lambda x: _first(FACULTY_NAMES, x)), 0))  # the name is formed once


def study_year(c: Column) -> Column:
    """1, 2 or 3 by ordinal and year words of three languages; null if none."""
    x = F.lower(fold_accents(c))
    out = F.lit(None).cast("int")
    for n, words in ((3, "3rd|third|drittes|dritten|troisieme|3eme"), (2, "2nd|second|zweites|zweiten|deuxieme|2eme"), (1, "1st|first|erstes|ersten|premiere?|1ere")):
        out = F.when(x.rlike(rf"(?:\b(?:{words})|\b{n}\.?)\s*(?:study\s+)?(?:year|studienjahr|jahr|annee)\b"), n).otherwise(out)
    return out


def sequence_part(c: Column) -> Column:
    """The part number (1 to 5, Roman or Arabic) of a title, read after its prefix first; null if none."""
    number = F.create_map(*[F.lit(x) for p in {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, **{str(k): k for k in range(1, 6)}}.items() for x in p])
    one = lambda x: number[F.regexp_extract(normalize_plan(x), r"(?:^| )(iii|ii|iv|i|v|[1-5])(?= |$)", 1)]
    return F.coalesce(one(F.regexp_replace(c, "^[^:]*:", "")), F.when(F.contains(c, F.lit(":")), one(c)))  # each text is read once; without a prefix there is only one


def series_key(c: Column) -> Column:
    """A title without prefix and part numbers: what parts of one series share."""
    x = normalize_plan(F.regexp_replace(c, "^[^:]*:", ""))
    return squeeze(F.regexp_replace(x, r"(?<![a-z0-9])(?:iii|ii|iv|i|v|[1-5])(?![a-z0-9])", " "))


def document_type(label: Column) -> Column:
    """study_plan, regulation, brochure or other, by the words of a label (staged documents)."""
    return _first([("study plan|studienplan|plan d['’ ]?[eé]tudes", "study_plan"), ("regulation|r[eè]glement|ordnung", "regulation"), ("brochure|flyer", "brochure")], F.lower(label), "other")


def document_type_loose(label: Column) -> Column:
    """As ``document_type`` for programme imports: any plan is a study plan, and examination papers are regulations."""
    return _first([("plan", "study_plan"), ("r[eè]glement|regulation|prüf", "regulation"), ("brosch|flyer|brochure", "brochure")], F.lower(label), "other")


def elective_credits(c: Column) -> Column:
    """Lines that speak of electives and of credits, joined by a bar; null if none."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.lower(x).rlike(_ELECTIVE) & x.rlike(r"(?i)\d+\s*(?:ects|credits?|kreditpunkte)"))
    return F.when(F.size(lines) > 0, F.array_join(F.array_distinct(F.transform(lines, squeeze)), " | "))


def anchors(c: Column) -> Column:
    """Distinct anchors of a regulation in order: articles, paragraphs, credit mentions, module codes."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"((?:Art\.|§)\s*\d+[a-z]?|\d+(?:\.\d+)?\s*ECTS|\b[A-Z]{2,4}\.\d{4,5})"), F.lit(1))))


def quality_bucket(chars: Column, words: Column) -> Column:
    """very_low, low, medium or high: a bucket needs enough characters and enough words."""
    return F.when((chars < 200) | (words < 30), "very_low").when((chars < 1000) | (words < 150), "low").when((chars < 5000) | (words < 700), "medium").otherwise("high")


def heading_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?m)^#{1,6}\s+\S+"))


def credit_mentions(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?i)\b\d{1,3}\s*(?:ects|cr[eé]dits?|kreditpunkte?)\b"))


# ---- people ----


def split_person(c: Column, style: str = "last_is_first_name") -> Column:
    """(first_name, last_name) by one of the three conventions in use.

    last_is_first_name: "Muster Anna"; first_is_last_name: the same, but all further words are first names;
    last_is_last_name: "Anna Muster".
    """
    w = F.split(squeeze(c), " ")
    n = F.size(w)
    head = lambda k: F.array_join(F.slice(w, F.lit(1), k), " ")
    one = F.struct(F.lit(None).cast("string").alias("first_name"), w[0].alias("last_name"))
    two = {
        "last_is_first_name": F.struct(F.element_at(w, -1).alias("first_name"), head(n - 1).alias("last_name")),
        "first_is_last_name": F.struct(F.array_join(F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0))), " ").alias("first_name"), w[0].alias("last_name")),
        "last_is_last_name": F.struct(head(n - 1).alias("first_name"), F.element_at(w, -1).alias("last_name")),
    }[style]
    return F.when(n >= 2, two).otherwise(one)


def person_like(c: Column) -> Column:
    """Whether a text can be a person's name: letters only, six words at most, no words of addresses."""
    x = F.trim(c)
    return F.coalesce(
        (F.length(x).between(2, 90)) & x.rlike(r"^[\p{L}][\p{L} .,'’-]+$") & ~x.rlike(r"(?i)\b(?:room|raum|rue|route|avenue|building|moodle|office|address|http|www)\b") & (F.size(F.split(x, r"\s+")) <= 6),
        F.lit(False),
    )


# ---- addresses and keys ----


def url_stem(c: Column) -> Column:
    """The file name of an address without query and last extension."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/?#]*)(?:[?#].*)?$", 1), r"\.[^.]*$", "")


def url_canonical(c: Column) -> Column:
    """Lower-case scheme and host, without www., fragment, query and last slash."""
    x = F.regexp_replace(c, r"[?#].*$", "")
    host = F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    return F.regexp_replace(F.concat(F.regexp_replace(host, "://www\\.", "://"), F.regexp_replace(x, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")), "/+$", "")


def url_kind(c: Column) -> Column:
    return _first([(r"(?i)\.pdf(?:$|[?#])", "pdf"), ("(?i)^mailto:", "mail"), ("(?i)calameo", "calameo"), ("(?i)^https?://", "page")], c, "unknown")


def program_key(faculty: Column, level: Column, ects: Column, name: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in (faculty, level, ects, name)])


def parse_program_key(c: Column) -> Column:
    """(faculty, degree_level, total_ects, program_name); null unless four parts are there."""
    p = F.transform(F.split(c, r"\|"), lambda x: F.nullif(F.trim(x), F.lit("")))
    return F.when(F.size(p) >= 4, F.struct(p[0].alias("faculty"), F.initcap(p[1]).alias("degree_level"), p[2].try_cast("double").cast("int").alias("total_ects"), p[3].alias("program_name")))
