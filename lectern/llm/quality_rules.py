"""Line-first cleaning by quality rules, in DataFrame functions alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that parts words, and the marks that count as symbols.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Marks that may end a line of prose.
ENDINGS = ".!?…\"'”»)]:;,"
SENTENCE_END = "[.!?…] "
#: Marks that part the entries of a menu.
SEPARATORS = "|»›•·"
#: Words of notices and controls in the corpus's four languages; any of them makes a line boilerplate.
NOTICES = (
    "all rights reserved", "cookie policy", "we use cookies", "accept cookies", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "click here", "sign up for", "subscribe to our", "log in to", "lorem ipsum", "powered by", "share this",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "nous utilisons des cookies", "accepter les cookies", "cliquez ici", "abonnez-vous", "partager cet article",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "wir verwenden cookies", "cookies akzeptieren", "hier klicken", "newsletter abonnieren", "diesen artikel teilen",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos de uso", "utilizamos cookies", "aceptar cookies", "haga clic aquí", "suscríbete a", "compartir este artículo",
)
MIN_WORDS = 20
#: Words of one window for repeats, and the share (in percent) of repeated words that a text may have.
REPEAT_WINDOW, MAX_REPEATED = 8, 30
#: Share (in percent) of a text's word characters that must survive the removal of lines.
MIN_KEPT = 60


def _count(text: Column, marks: str) -> Column:
    """How many of a text's characters are one of ``marks``."""
    return F.regexp_count(text, F.lit("[" + re.escape(marks) + "]"))


def line_verdict(line: Column) -> Column:
    """The rule that a line fails: punctuation, navigation, symbols, shouting or boilerplate; null if none.

    Navigation: three menu separators or more, one at least in 20 characters. Symbols: one character in ten.
    Shouting: three doubled exclamation or question marks, one at least in 40 characters. Boilerplate: a notice's words,
    from the start of a word on.
    Punctuation: the line's last character is no mark that ends prose, and no sentence ends within the line.
    Lines without words fail nothing.
    """
    bare = F.rtrim(line, F.lit(WHITE))
    n, bars, marks = F.char_length(bare), _count(line, SEPARATORS), _count(line, SYMBOLS)
    doubled = F.char_length(line) * 2 - F.char_length(F.replace(line, F.lit("!!"), F.lit(""))) - F.char_length(F.replace(line, F.lit("??"), F.lit("")))
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when((bars >= 3) & (bars * 20 >= n), "navigation")
        .when(marks * 10 > n, "symbols")
        .when((doubled >= 6) & (doubled * 20 >= n), "shouting")
        .when(F.lower(line).rlike(r"(?<![a-z])(?:" + "|".join(NOTICES) + ")"), "boilerplate")
        .when((F.instr(F.lit(ENDINGS), F.right(bare, F.lit(1))) == 0) & ~line.rlike(SENTENCE_END), "punctuation")
    )


def repeated_places(ranked: Column) -> Column:
    """Ascending places of the windows that occur twice or more; ``ranked`` is the sorted (hash, place) of all."""
    places = F.filter(
        ranked,
        lambda x, k: (x["h"] == F.get(ranked, k - 1)["h"]) | (x["h"] == F.get(ranked, k + 1)["h"]),
    )
    return F.sort_array(F.transform(places, lambda x: x["p"]))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines
    (all), n_lines_removed, kept_chars, clean_text (null if the base fails or too little is left) and kept.

    A null text counts as empty. Every row is measured for itself, repeated ids included; nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    two = one.select(
        "doc_id",
        (F.char_length("text") - _count(F.col("text"), WHITE)).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.ltrim(x, F.lit(WHITE)) != "").alias("lines"),
        F.transform(F.filter(F.split("text", WHITE_RUN), lambda x: x != ""), lambda x: F.xxhash64(x)).alias("hashes"),
    )
    n = F.size("hashes")
    last = n - REPEAT_WINDOW
    three = two.select(
        "doc_id", "word_chars", "n_symbols", "lines", n.cast("long").alias("n_words"),
        F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice("hashes", i, F.lit(REPEAT_WINDOW))))).alias("windows"),
        F.filter("lines", lambda x: line_verdict(x).isNull()).alias("good"),
    )
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    four = three.select(
        "doc_id", "word_chars", "n_symbols", "n_words",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size("good")).alias("n_lines_removed"), F.array_join("good", "\n").alias("clean"),
        F.when(repeats, F.sort_array(F.transform("windows", lambda h, p: F.struct(h.alias("h"), p.alias("p"))))).alias("ranked"),
    )
    ranked = F.col("ranked")
    five = four.withColumn("places", repeated_places(ranked))
    places = F.col("places")
    covered = F.aggregate(
        F.transform(places, lambda p, k: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(REPEAT_WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    six = five.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    seven = six.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    eight = seven.withColumn("kept_chars", (F.char_length("clean") - _count(F.col("clean"), WHITE)).cast("long"))
    kept = ~F.col("base_failed") & (100 * F.col("kept_chars") >= MIN_KEPT * F.col("word_chars"))
    out = eight.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_lines", "n_lines_removed", "kept_chars", F.when(kept, F.col("clean")).alias("clean_text"), kept.alias("kept"),
    )
    # one element is exploded so that a filter on the results stays above them and doesn't compute them again
    return out.select(F.explode(F.array(F.struct(*out.columns))).alias("r")).select("r.*")


def digest(measured: DataFrame) -> DataFrame:
    return measured.drop("clean_text")


_SQL_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _count_sql(x: str, marks: str) -> str:
    return f"(length({x}) - length(translate({x}, {marks}, '')))"


#: The same result in DuckDB SQL, from word and line rows instead of arrays.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
pos AS (SELECT r, w, unnest(range(1, len(w) - {REPEAT_WINDOW - 2})) AS p FROM w WHERE len(w) >= {REPEAT_WINDOW}),
gram AS (SELECT r, p, array_to_string(list_slice(w, p, p + {REPEAT_WINDOW - 1}), ' ') AS g FROM pos),
rep AS (SELECT r, unnest(list(p)) AS p FROM gram GROUP BY r, g HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT p + k) AS n FROM rep, (SELECT unnest(range(0, {REPEAT_WINDOW})) AS k) GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE ltrim(line, {_SQL_WHITE}) <> ''),
m AS (SELECT r, line, length(rtrim(line, {_SQL_WHITE})) AS n, {_count_sql("line", "'" + SEPARATORS + "'")} AS bars, {_count_sql("line", "'" + SYMBOLS + "'")} AS marks,
      2 * length(line) - length(replace(line, '!!', '')) - length(replace(line, '??', '')) AS doubled,
      regexp_matches(lower(line), '(^|[^a-z])({"|".join(NOTICES).replace("'", "''")})') AS notice,
      instr('{ENDINGS.replace("'", "''")}', right(rtrim(line, {_SQL_WHITE}), 1)) > 0 OR regexp_matches(line, '{SENTENCE_END}') AS ended FROM l),
v AS (SELECT r, line, NOT (n > 0 AND ((bars >= 3 AND bars * 20 >= n) OR marks * 10 > n OR (doubled >= 6 AND doubled * 20 >= n) OR notice OR NOT ended)) AS good FROM m),
ls AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (WHERE NOT good) AS removed,
       COALESCE(sum(length(translate(line, {_SQL_WHITE}, ''))) FILTER (WHERE good), 0) AS kept_chars FROM v GROUP BY r),
a AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(translate(d.text, {_SQL_WHITE}, '')) AS BIGINT) AS word_chars,
      CAST({_count_sql("d.text", "'" + SYMBOLS + "'")} AS BIGINT) AS n_symbols, CAST(COALESCE(ls.dup, 0) AS BIGINT) AS n_dup_lines, CAST(COALESCE(cov.n, 0) AS BIGINT) AS n_repeat_words,
      CAST(COALESCE(ls.n_lines, 0) AS INTEGER) AS n_lines, CAST(COALESCE(ls.removed, 0) AS INTEGER) AS n_lines_removed, CAST(COALESCE(ls.kept_chars, 0) AS BIGINT) AS kept_chars
      FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN ls USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_lines_removed, kept_chars,
       NOT base_failed AND 100 * kept_chars >= {MIN_KEPT} * word_chars AS kept FROM b
"""
