"""Column functions over whole tables of texts, each with SQL that computes the same from the same texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import html as H
from lectern.operators import retrieval as S
from lectern.session import table
from lectern.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


_CODES = "concat(p_name, ' UE-', left(p_type, 3), '.', lpad(CAST(p_partkey AS VARCHAR(20)), 5, '0'), ', ', upper(left(p_name, 2)), '-', upper(right(p_name, 1)), lpad(CAST(p_size AS VARCHAR(20)), 2, '0'), '.', lpad(CAST(p_partkey AS VARCHAR(20)), 5, '0'))"


@query(rf"""WITH t AS (SELECT p_partkey, {_CODES} AS c, 'UE ' || p_brand AS b FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(upper(b), '^UE[-\s]?', ''), '[^A-Z0-9]', '', 'g') AS strict, regexp_replace(upper(trim(substr(c, length(c) - 23))), '^UE-', '') AS loose, regexp_replace(upper(c), '[^A-Z0-9]', '', 'g') AS bare,
 array_to_string(list_concat(list_distinct(regexp_extract_all(upper(c), '(?:^|[^A-Z0-9])((?:UE-)?[A-Z]{{2,4}}\.\d{{4,5}})(?:[^\d]|$)', 1)), regexp_extract_all(upper(c), '(?:^|[^A-Z0-9])([A-Z]{{2,4}}-[A-Z]\d{{2}}\.\d{{5}})(?:[^\d]|$)', 1)), ',') AS codes FROM t""")
def text_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes within the texts of parts: normalised in three ways, and taken out."""
    x = table(spark, d, "part").select("p_partkey", F.expr(_CODES).alias("c"), F.concat(F.lit("UE "), "p_brand").alias("b"))
    end = F.substr("c", F.char_length("c") - 23)
    return x.select("p_partkey", T.code_strict(F.col("b")).alias("strict"), T.code_loose(end).alias("loose"), T.code_bare(F.col("c")).alias("bare"), F.array_join(T.extract_codes(F.col("c")), ",").alias("codes"))


_TITLE = "concat(CASE WHEN p_size % 4 = 0 THEN 'Part II: ' ELSE '' END, p_name, ' ', p_type, CASE WHEN p_size % 3 = 0 THEN ' (EN, IV) ' ELSE ' ' END, CASE WHEN p_size % 7 = 0 THEN 'III' WHEN p_size % 7 < 3 THEN CAST(p_size % 7 AS VARCHAR(5)) WHEN p_size % 7 = 3 THEN 'e i' ELSE '' END)"
_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '\([^)]*\)', ' ', 'g'), '\b(?:fr|de|en|f|d|e)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_AFTER = "regexp_replace(c, '^[^:]*:', '')"


@query(rf"""WITH t AS (SELECT p_partkey, {_TITLE} AS c FROM part), n AS (SELECT *, {_PLAIN.format(_AFTER)} AS a, {_PLAIN.format("c")} AS w FROM t),
s AS (SELECT *, COALESCE(NULLIF(regexp_extract(a, '(?:^| )(iii|ii|iv|i|v|[1-5])(?: |$)', 1), ''), NULLIF(regexp_extract(w, '(?:^| )(iii|ii|iv|i|v|[1-5])(?: |$)', 1), '')) AS p, list_filter(regexp_extract_all(c, '\p{{L}}+'), lambda x: length(x) > 2) AS l FROM n)
SELECT p_partkey, CAST(COALESCE(CASE p WHEN 'i' THEN 1 WHEN 'ii' THEN 2 WHEN 'iii' THEN 3 WHEN 'iv' THEN 4 WHEN 'v' THEN 5 END, TRY_CAST(p AS INTEGER), 0) AS INTEGER) AS part, trim(regexp_replace(regexp_replace(a, '\b(?:iii|ii|iv|i|v|[1-5])\b', ' ', 'g'), '\s+', ' ', 'g')) AS series,
 CASE WHEN len(l) BETWEEN 2 AND 8 THEN lower(array_to_string(list_transform(l, lambda x: left(x, 1)), '')) END AS initials FROM s""")
def text_titles(spark: SparkSession, d: str) -> DataFrame:
    """Part numbers, series and initials of titles."""
    x, c = table(spark, d, "part").select("p_partkey", F.expr(_TITLE).alias("c")), F.col("c")
    return x.select("p_partkey", F.coalesce(T.sequence_part(c), F.lit(0)).alias("part"), T.series_key(c).alias("series"), T.initials(c).alias("initials"))


_PERSON = "concat(p_name, CASE WHEN p_size % 2 = 0 THEN concat('  ', p_type) ELSE '' END, CASE WHEN p_size > 45 THEN ' Room' WHEN p_size > 40 THEN p_brand ELSE '' END)"


@query(rf"""WITH t AS (SELECT p_partkey, {_PERSON} AS c FROM part UNION ALL SELECT -1 - s_suppkey, s_name FROM supplier), w AS (SELECT *, string_split(trim(regexp_replace(c, '\s+', ' ', 'g')), ' ') AS w FROM t)
SELECT p_partkey, CASE WHEN len(w) > 1 THEN w[-1] END AS first_a, CASE WHEN len(w) > 1 THEN array_to_string(w[1:len(w) - 1], ' ') ELSE w[1] END AS last_a, CASE WHEN len(w) > 1 THEN array_to_string(w[2:], ' ') END AS first_b, w[1] AS last_b,
 CASE WHEN len(w) > 1 THEN array_to_string(w[1:len(w) - 1], ' ') END AS first_c, w[-1] AS last_c, length(trim(c)) BETWEEN 2 AND 90 AND regexp_full_match(trim(c), '\p{{L}}[\p{{L}} .,''’-]+') AND NOT regexp_matches(c, '(?i)\b(?:room|raum|rue|route|avenue|building|moodle|office|address|http|www)\b') AND len(w) <= 6 AS person FROM w""")
def text_people(spark: SparkSession, d: str) -> DataFrame:
    """Names parted by the three conventions, and whether they can be a person's."""
    x = table(spark, d, "part").select("p_partkey", F.expr(_PERSON).alias("c")).unionByName(table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("p_partkey"), F.col("s_name").alias("c")))
    a, b, c = (T.split_person(F.col("c"), s) for s in ("last_is_first_name", "first_is_last_name", "last_is_last_name"))
    parts = [y[f"{n}_name"].alias(f"{n}_{k}") for k, y in (("a", a), ("b", b), ("c", c)) for n in ("first", "last")]
    return x.select("p_partkey", *parts, T.person_like(F.col("c")).alias("person"))


@query(r"""WITH t AS (SELECT doc_id, source, text, '# ' || replace(text, '. ', '.' || chr(10) || '## ') || chr(10) || n_chars || ' ECTS, Art. ' || doc_id || 'b' AS c FROM documents)
SELECT doc_id, CASE WHEN length(text) > 350 THEN sha256(left(text, 350) || '…') ELSE sha256(text) END AS snippet, CAST(len(regexp_extract_all(c, '(?m)^#{1,6}\s+\S+')) AS INTEGER) AS headings, CAST(len(regexp_extract_all(c, '(?i)\b\d{1,3}\s*(?:ects|cr[eé]dits?|kreditpunkte?)\b')) AS INTEGER) AS credits,
 array_to_string(list_sort(list_distinct(regexp_extract_all(c, '(?:Art\.|§)\s*\d+[a-z]?|\d+(?:\.\d+)?\s*ECTS|\b[A-Z]{2,4}\.\d{4,5}'))), '|') AS anchors,
 CASE WHEN source = 'src3' THEN 'src3' WHEN regexp_matches(lower(text), 'regl|règlement|exam') THEN 'regulations' WHEN regexp_matches(lower(text), 'plan|course|cours|kurs') THEN 'study_plan' WHEN regexp_matches(lower(text), 'mobil|exchange|austausch') THEN 'mobility' ELSE 'general' END AS category FROM t WHERE text IS NOT NULL""")
def text_measures(spark: SparkSession, d: str) -> DataFrame:
    """Snippets, headings, credit mentions, anchors and categories of whole documents."""
    x, c = table(spark, d, "documents").where("text is not null"), F.col("c")
    page = F.concat(F.lit("# "), F.replace("text", F.lit(". "), F.lit(".\n## ")), F.lit("\n"), F.col("n_chars").cast("string"), F.lit(" ECTS, Art. "), F.col("doc_id").cast("string"), F.lit("b"))
    given = F.when(F.col("source") == "src3", " SRC3 ")
    return x.withColumn("c", page).select("doc_id", F.sha2(S.snippet(F.col("text")), 256).alias("snippet"), T.heading_count(c).alias("headings"), T.credit_mentions(c).alias("credits"), F.array_join(T.anchors(c), "|").alias("anchors"), S.category(given, F.col("text")).alias("category"))


_LABEL = "concat(p_name, ' ', CASE WHEN p_size < 10 THEN 'Studienplan' WHEN p_size < 15 THEN 'Plan d’études' WHEN p_size < 20 THEN 'Prüfungsordnung' WHEN p_size < 25 THEN 'Règlement' WHEN p_size < 30 THEN 'Broschüre' WHEN p_size < 35 THEN 'Flyer' ELSE p_type END)"


@query(rf"""WITH t AS (SELECT p_partkey, {_LABEL} AS c, lower({_LABEL}) AS l, p_type, p_brand, p_size FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(l, 'study plan|studienplan|plan d[''’ ]?[eé]tudes') THEN 'study_plan' WHEN regexp_matches(l, 'regulation|r[eè]glement|ordnung') THEN 'regulation' WHEN regexp_matches(l, 'brochure|flyer') THEN 'brochure' ELSE 'other' END AS kind,
 CASE WHEN contains(l, 'plan') THEN 'study_plan' WHEN regexp_matches(l, 'r[eè]glement|regulation|prüf') THEN 'regulation' WHEN regexp_matches(l, 'brosch|flyer|brochure') THEN 'brochure' ELSE 'other' END AS loose,
 COALESCE(NULLIF(trim(CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_type END), ''), NULLIF(trim(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END), ''), 'unknown') AS label,
 concat_ws(chr(10), c, 'program_name: ' || p_type, 'program_key: ' || p_brand, CASE WHEN p_size % 2 = 0 THEN 'level: Master' END, 'ects_points: ' || p_size, CASE WHEN p_size % 3 = 0 THEN 'section: 2. Jahr 2. Studienjahr first year second year third year' END) AS enriched FROM t""")
def text_labels(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of documents by their labels, labels of sources, and questions with their metadata."""
    even, third = F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0
    x = table(spark, d, "part").select("p_partkey", F.expr(_LABEL).alias("c"), "p_type", "p_brand", "p_size", F.when(even, " ").otherwise(F.col("p_type")).alias("a"), F.when(third, "").otherwise(F.col("p_brand")).alias("b"))
    full = S.enriched_query(F.col("c"), F.col("p_type"), F.col("p_brand"), F.when(even, "Master"), F.col("p_size"), F.when(third, "2"))
    return x.select("p_partkey", T.document_type(F.col("c")).alias("kind"), T.document_type_loose(F.col("c")).alias("loose"), S.source_label("a", "b").alias("label"), full.alias("enriched"))


@query("SELECT user_id, round(COALESCE(sum(value) FILTER (WHERE event_type = 'view'), 0), 4) AS view_ms, round(COALESCE(sum(value) FILTER (WHERE event_type = 'click'), 0), 4) AS click_ms FROM events GROUP BY user_id")
def span_latencies(spark: SparkSession, d: str) -> DataFrame:
    """Sums of named spans of every user, from a list of measurements."""
    m = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("name"), F.col("value").alias("ms"))).alias("m"))
    return m.select("user_id", *[_rounded(c, n) for c, n in zip(S.latency_columns(F.col("m"), ["view", "click"]), ["view_ms", "click_ms"])])


def _rounded(c: Column, name: str) -> Column:
    return F.round(c, 4).alias(name)


@query(r"""WITH t AS (SELECT page_id, url, split_part(split_part(url, '://', 2), '.', 1) AS label FROM pages), u AS (SELECT *, lower(trim(url)) AS u, lower(trim(label)) AS t, lower(concat_ws(' ', label, url)) AS s, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM t)
SELECT page_id, NOT (u = '' OR regexp_matches(u, '^(?:mailto:|tel:|javascript:)') OR regexp_matches(u, '/map|agenda|calendar|#') OR t IN ('back', 'quick links', 'schnellzugriff', 'fr', 'de', 'en', 'map & orientation', 'maps/orientation', 'agenda')) AS content_link,
 ends_with(host, 'example.com') AND NOT regexp_matches(lower(url), '\.(?:pdf|docx?|xlsx?|zip|jpe?g|png)(?:\?|$)') AS page_address, (starts_with(path, '/en') OR starts_with(path, '/fr')) AND (contains(s, 'th') OR contains(s, 'page')) AND NOT contains(s, 'utm') AS relevant,
 COALESCE(NULLIF(regexp_extract(lower(url), '/(de|fr|en|it|es)(?:/|$)', 1), ''), 'none') AS language, COALESCE(TRY_CAST(regexp_extract(url, '(?:^|[^0-9A-Za-z])(20\d{2})(?:[^0-9A-Za-z]|$)', 1) AS INTEGER), 0) AS year FROM u""")
def address_facts(spark: SparkSession, d: str) -> DataFrame:
    """Which addresses of pages count as links, pages and relevant, and the language and year that they name."""
    u = F.col("url")
    x = table(spark, d, "pages").select("page_id", "url", F.split_part(F.split_part(u, F.lit("://"), F.lit(2)), F.lit("."), F.lit(1)).alias("label"))
    kept = H.is_relevant(F.col("label"), u, ["th", "page"], ["utm"], ["/en", "/fr"])
    return x.select("page_id", H.is_content_link(F.col("label"), u).alias("content_link"), H.is_page_address(u, "example.com").alias("page_address"), kept.alias("relevant"), F.coalesce(T.language_of(u), F.lit("none")).alias("language"), F.coalesce(T.year_of(u), F.lit(0)).alias("year"))


_PLAN = "concat(p_name, CASE WHEN p_size % 2 = 0 THEN concat(' BA', p_size, ' ') ELSE ' ' END, p_size * 6, CASE WHEN p_size % 5 = 0 THEN concat('+', p_size) ELSE '' END, ' ECTS ', p_type)"
_USUAL = "(9, 14, 20, 30, 35, 50, 60, 90, 105, 106, 120, 150, 180, 240)"


@query(rf"""WITH t AS (SELECT p_partkey, {_PLAN} AS c, p_type, p_brand, p_size, p_name FROM part), n AS (SELECT *, list_concat(list_concat(
  flatten(list_transform(regexp_extract_all(c, '(?i)\b(\d{{1,3}}(?:\s*\+\s*\d{{1,3}})?)\s*(?:ects|etcs|kreditpunkte|credits?|punkte|points?)\b', 1), lambda v: regexp_split_to_array(v, '\s*\+\s*'))),
  flatten(list_transform(regexp_extract_all(c, '(?i)\b(\d{{1,3}}(?:\s*(?:-|_|/|und|et|and|\+)\s*\d{{1,3}})+)\s*-?\s*(?:ects|etcs|credits?|kreditpunkte)\b', 1), lambda v: regexp_extract_all(v, '\d{{1,3}}')))),
  list_concat(regexp_extract_all(c, '(?i)(?:^|[^a-z0-9])(?:ba|bachelor|bsc|ma|master|msc|bc|bcp|bp|major|minor|fach|nebenfach|hauptfach|plan|studienplan)[_\-\s]*(\d{{1,3}})(?:[^a-z0-9]|$)', 1), list_filter(regexp_extract_all(c, '\d+'), lambda v: v::INTEGER IN {_USUAL}))) AS found FROM t)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(found, lambda v: v::INTEGER), lambda v: v BETWEEN 1 AND 240))), ',') AS credits, sha1(p_name || p_partkey) AS doc_key, concat_ws('|', p_brand, CASE WHEN p_size % 2 = 0 THEN 'bachelor' ELSE '' END, p_size, p_name) AS program_key,
 CASE WHEN p_size % 2 = 0 THEN 'Bachelor' ELSE 'none' END AS level, p_size AS total, p_name AS name FROM n""")
def plan_facts(spark: SparkSession, d: str) -> DataFrame:
    """Credits of labels, keys of file names, and keys of programmes, made and read again."""
    x = table(spark, d, "part").select("*", F.expr(_PLAN).alias("c"), F.concat(F.lit("docs/x_"), F.sha1(F.concat("p_name", F.col("p_partkey").cast("string"))), F.lit(".json")).alias("path"))
    key = T.program_key(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, "bachelor"), F.col("p_size"), F.col("p_name"))
    x = readers.with_file_key(x).withColumn("key", key).withColumn("parts", T.parse_program_key(F.col("key")))
    return x.select("p_partkey", F.array_join(F.array_sort(T.credits(F.col("c"))), ",").alias("credits"), "doc_key", F.col("key").alias("program_key"), F.coalesce("parts.degree_level", F.lit("none")).alias("level"), F.col("parts.total_ects").alias("total"), F.col("parts.program_name").alias("name"))


_SAID = "concat(text, ' ', turn % 9 * 15, ' ECTS ', CASE turn % 4 WHEN 0 THEN '2. Jahr' WHEN 1 THEN 'third year' WHEN 2 THEN 'première année' ELSE '' END)"


@query(rf"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({_SAID}), '&', ' and '), '[_/-]', ' ', 'g'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN regexp_matches(q, 'bachelor|bsc|ba') THEN 'Bachelor' WHEN regexp_matches(q, 'master|msc|ma') THEN 'Master' ELSE 'none' END AS degree, COALESCE(TRY_CAST(regexp_extract(q, '(?:^|[^0-9a-z])(30|60|90|120|180)\s*ects(?:[^0-9a-z]|$)', 1) AS INTEGER), 0) AS ects,
 CASE WHEN regexp_matches(q, '1.? ?jahr|1st year|first year|erste[sn]? jahr|premi[eè]re ann[eé]e|1[eè]re ann[eé]e') THEN '1' WHEN regexp_matches(q, '2.? ?jahr|2nd year|second year|zweite[sn]? jahr|deuxi[eè]me ann[eé]e|2[eè]me ann[eé]e') THEN '2'
 WHEN regexp_matches(q, '3.? ?jahr|3rd year|third year|dritte[sn]? jahr|troisi[eè]me ann[eé]e|3[eè]me ann[eé]e') THEN '3' ELSE 'none' END AS year FROM t""")
def question_facts(spark: SparkSession, d: str) -> DataFrame:
    """Degrees, credits and years that the turns of all conversations name."""
    x = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", S.detect(F.expr(_SAID)).alias("d"))
    none = F.lit("none")
    return x.select("conv_id", "turn", F.coalesce("d.degree", none).alias("degree"), F.coalesce("d.ects", F.lit(0)).alias("ects"), F.coalesce("d.year", none).alias("year"))
