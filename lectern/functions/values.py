"""Dates, times, numbers, maps and lists as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import squeeze

# ---- dates and times ----


def swiss_date(c: Column) -> Column:
    """dd.mm.yyyy as a date; null if malformed or no day of the calendar."""
    x = F.trim(c)
    return F.when(x.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.try_to_timestamp(x, F.lit("dd.MM.yyyy")).cast("date"))


def time_range(c: Column) -> Column:
    """(start, end) as HH:mm of a text like "08:15 - 10:00"; nulls if there is none."""
    part = lambda k: F.nullif(F.regexp_extract(c, r"(\d{2}:\d{2})\s*-\s*(\d{2}:\d{2})", k), F.lit(""))
    return F.struct(part(1).alias("start"), part(2).alias("end"))


def date_time_range(c: Column) -> Column:
    """(date, start, end) of a text that holds a date and a time range."""
    t = time_range(c)
    return F.struct(swiss_date(F.regexp_extract(c, r"(\d{2}\.\d{2}\.\d{4})", 1)).alias("date"), t["start"].alias("start"), t["end"].alias("end"))


#: German names of the days, Monday first.
GERMAN_DAYS = ("Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag")
ENGLISH_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def weekday_name(day: Column, names: tuple[str, ...] = ENGLISH_DAYS) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), F.weekday(day))


def minutes_of(c: Column) -> Column:
    """Minutes of the day of H:mm; null if malformed."""
    h, m = (F.regexp_extract(c, r"^\s*(\d{1,2}):(\d{2})", k).try_cast("int") for k in (1, 2))
    return h * 60 + m


def format_minutes(c: Column) -> Column:
    return F.concat(F.lpad(F.floor(c / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((c % 60).cast("int").cast("string"), 2, "0"))


def semester(c: Column) -> Column:
    """(sem_id, year, kind) of the first semester in a text; SS counts as FS (Spring), AS as HS (Autumn)."""
    raw, year = (F.regexp_extract(c, r"(?<![A-Za-z0-9_])(FS|HS|SS|AS)-(\d{4})(?!\d)", k) for k in (1, 2))
    half = F.when(raw.isin("FS", "SS"), "FS").otherwise("HS")
    return F.when(
        raw != "",
        F.struct(F.concat(half, F.lit("-"), year).alias("sem_id"), year.try_cast("int").alias("year"), F.when(half == "FS", "Spring").otherwise("Autumn").alias("kind")),
    )


def semester_query(c: Column) -> Column:
    """Semester ids of a question: HS, AS, SA for autumn and FS, SS, SP for spring, with a year after a dash or blank."""
    found = F.regexp_extract_all(F.upper(c), F.lit(r"(?<![A-Z0-9])((?:HS|AS|SA|FS|SS|SP)[- ]?20\d{2})"), F.lit(1))
    return F.transform(found, lambda x: F.concat(F.when(F.left(x, F.lit(2)).isin("HS", "AS", "SA"), "HS-").otherwise("FS-"), F.right(x, F.lit(4))))


def season(c: Column) -> Column:
    """Autumn, Spring or Both by these English words of a text; null if neither is named."""
    x = F.lower(c)
    autumn, spring = x.contains("autumn"), x.contains("spring")
    return F.when(autumn & spring, "Both").when(autumn, "Autumn").when(spring, "Spring")


# ---- numbers ----


def clamp01(c: Column) -> Column:
    """Between 0 and 1; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def rate(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole; ``empty`` (null or 0) if there is no whole. Both conventions are in use."""
    return F.coalesce(F.try_divide(part, whole), F.lit(empty)) if empty is not None else F.try_divide(part, whole)


def as_rate(c: Column) -> Column:
    """Values above 1 are percents."""
    return F.when(c > 1, c / 100).otherwise(c)


def half_units(c: Column) -> Column:
    """Credits as whole numbers of halves."""
    return F.round(c * 2).cast("int")


def yes_no(c: Column) -> Column:
    """True, False or null of words in five languages."""
    x = F.lower(F.trim(c))
    return F.when(x.isin("ja", "yes", "oui", "si", "sì", "true"), True).when(x.isin("nein", "no", "non", "false"), False)


def weighted_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """Sum of clamped values times weights; a null value counts as 0."""
    return sum((F.coalesce(clamp01(v), F.lit(0.0)) * w for v, w in parts.values()), F.lit(0.0))


def renormalised_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """As ``weighted_score`` over the values that are there, by their weights' sum; null if none is."""
    have = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in parts.values()), F.lit(0.0))
    return F.try_divide(weighted_score(parts), F.nullif(have, F.lit(0.0)))


# ---- lists and maps ----


def first_value(m: Column, keys: list[str]) -> Column:
    """The first value of a map, by ``keys``, that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(m[k]), F.lit("")) for k in keys])


def first_column(df_columns: list[str], aliases: list[str]) -> Column:
    """The first non-blank of those alias columns that exist; null if none does."""
    have = [F.nullif(F.trim(F.col(f"`{a}`").cast("string")), F.lit("")) for a in aliases if a in df_columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def split_list(c: Column) -> Column:
    """Entries parted by commas, semicolons or the word and."""
    return F.filter(F.transform(F.split(c, r"(?i)[,;]|\band\b"), lambda x: F.trim(x)), lambda x: x != "")


def split_languages(c: Column) -> Column:
    """Languages of a course; bilingual courses name the first one first."""
    x = squeeze(c)
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    two = F.when(x.rlike(r"(?i)f\s*/\s*d"), pair("Französisch", "Deutsch")).when(x.rlike(r"(?i)d\s*/\s*f"), pair("Deutsch", "Französisch")).otherwise(F.array(F.lit("Zweisprachig")))
    many = F.filter(F.transform(F.split(x, r"[,/]"), lambda v: F.trim(v)), lambda v: v != "")
    return F.when(x.rlike("(?i)zweisprachig"), two).otherwise(F.coalesce(many, F.array().cast("array<string>")))


def distinct_texts(c: Column) -> Column:
    """A list's texts squeezed, blanks left out, each once, in order."""
    return F.array_distinct(F.filter(F.transform(c, squeeze), lambda x: x != ""))


def nested(json: Column, path: str) -> Column:
    """The text at a dotted path of a JSON text; null if it isn't there."""
    return F.get_json_object(json, "$." + path)
