"""Matching of documents to programmes: blocked candidates, additive scores, near-best selection, fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.operators.containment import AUTOMATON_BYTES, first_held, names_held, names_that_hold
from lectern.operators.grouped import alike
from lectern.operators.overlap import overlap_pairs
from lectern.operators.relational import latest_per_key, small
from lectern.storage import persist_shared

#: Least score of a match; how far below a document's best score its other matches may lie.
THRESHOLD, NEAR_WITH_CREDITS, NEAR_WITHOUT = 9, 2, 1
#: Words of programme names and labels that say nothing about the subject.
PROGRAMME_STOPWORDS = (
    "study studies plan plans studienplan etudes programme program programm curriculum curricula bachelor master doctorat doktorat doctorate phd major minor hauptfach nebenfach "
    "zusatzfach fach ects etcs credits kreditpunkte punkte of in and the for to de du des der die das und en pour fur fuer a le la les version current valid gultig gueltig seit from "
    "webseite website flyer brochure broschure presentation prasentation"
).split()
#: Credits of main programmes by level.
MAIN_CREDITS = {"B": (120, 150, 180, 240), "M": (90, 105, 120, 180)}


def score_pairs(programmes: DataFrame, documents: DataFrame, strong: bool = False) -> DataFrame:
    """(document_index, programme_index, score, reasons, ...) of pairs that share a subject word, an abbreviation or an address.

    ``programmes``: programme_index, names (list), faculty, level, ects, urls (list). ``documents``: document_index, text,
    label, faculty, level, ects_values (list), urls (list). Pairs of different levels, or of different faculties
    (but for PHILO and INTERFACULTY), are vetoed before anything is scored. Points: faculty 3 (a soft crossing -1),
    level 2, credits 5 (a conflict -4), name 8, 6, 4 or 2 by how much of the best name the text has, abbreviation 4,
    address 6, a generic document without name -3. With ``strong`` pairs are left unscored that ``select_matches`` would drop
    for their names alone: those that share no more than one word of any longer name, and neither abbreviation nor address.
    Pairs come from prefixes of word sets (see ``overlap``), so that frequent words are seldom met; faculty and level are part of the key.
    """
    p = programmes.select(
        "programme_index", F.col("faculty").alias("pf"), F.col("level").alias("pl"), F.col("ects").alias("pe"), F.coalesce("urls", F.array().cast("array<string>")).alias("pu"),
        F.filter(F.transform("names", lambda n: T.tokens(T.subject_name(n), PROGRAMME_STOPWORDS, digits=False)), lambda t: F.size(t) > 0).alias("names"),
        F.array_compact(F.array_distinct(F.transform("names", T.initials))).alias("abbreviations"),
    )
    d = documents.select(
        "document_index", F.col("faculty").alias("df"), F.col("level").alias("dl"), F.coalesce("ects_values", F.array().cast("array<int>")).alias("de"), F.coalesce("urls", F.array().cast("array<string>")).alias("du"),
        T.tokens(T.subject_name(F.col("text")), PROGRAMME_STOPWORDS, digits=False).alias("words"),
        F.coalesce(T.normalize_match(F.col("label")).rlike("flyer|brochure|broschure|presentation|prasentation|reglement|regulation|webseite|website"), F.lit(False)).alias("generic"),
    )
    p, d = persist_shared(p, "programmes"), persist_shared(d, "programme-documents")
    # who may meet: '*' is a programme without faculty (level), 'a' a programme as a document without one meets it
    soft_or_own = lambda c: F.when(c.isin("PHILO", "INTERFACULTY"), "s").otherwise(F.concat(F.lit("f"), c))
    of_p = lambda c: F.array(F.coalesce(c, F.lit("*")), F.lit("a"))
    of_d = lambda c: F.when(c.isNull(), F.array(F.lit("a"))).otherwise(F.array(c, F.lit("*")))
    level = lambda c: F.concat(F.lit("l"), c)
    pk = p.withColumn("f", F.explode(of_p(soft_or_own(F.col("pf"))))).withColumn("l", F.explode(of_p(level(F.col("pl")))))
    dk = d.withColumn("f", F.explode(of_d(soft_or_own(F.col("df"))))).withColumn("l", F.explode(of_d(level(F.col("dl")))))
    # equal sets of words are one set
    set_id = F.concat_ws(" ", "f", "l", F.array_join("words", " "))
    p_sets = pk.select("programme_index", "f", "l", F.explode("names").alias("words")).withColumn("words", F.array_sort("words")).withColumn("right_id", set_id)
    d_sets = dk.where(F.size("words") > 0).select("document_index", "f", "l", F.array_sort("words").alias("words")).withColumn("left_id", set_id)
    lefts, rights = d_sets.select("left_id", "f", "l", "words").distinct(), p_sets.select("right_id", "f", "l", "words").distinct()
    one, more = rights.where(F.size("words") == 1), rights.where(F.size("words") > 1)
    if strong:
        pairs = overlap_pairs(lefts, one, F.lit(1), ["f", "l"]).unionByName(overlap_pairs(lefts, more, F.lit(2), ["f", "l"], 2))
    else:
        pairs = overlap_pairs(lefts, rights, F.lit(1), ["f", "l"])
    named = pairs.join(d_sets.select("left_id", "document_index").hint("merge"), "left_id").join(p_sets.select("right_id", "programme_index").hint("merge"), "right_id").select("programme_index", "document_index")
    keys = lambda k, i, c: k.select(i, "f", "l", F.explode(F.array_distinct(c)).alias("k"))
    other = keys(pk, "programme_index", F.concat("abbreviations", "pu")).join(keys(dk, "document_index", F.concat("words", "du")).hint("merge"), ["f", "l", "k"]).select("programme_index", "document_index")
    meet = named.unionByName(other).distinct()
    # files of repeated values are small and their rows many: no side is sent to all tasks for its files' size
    both = meet.join(p.hint("merge"), "programme_index").join(d.hint("merge"), "document_index")
    soft = F.array_contains(F.array(F.lit("PHILO"), F.lit("INTERFACULTY")), F.col("pf")) & F.array_contains(F.array(F.lit("PHILO"), F.lit("INTERFACULTY")), F.col("df"))
    faculties = F.col("pf").isNotNull() & F.col("df").isNotNull()
    levels = F.col("pl").isNotNull() & F.col("dl").isNotNull()
    both = both.where(~(faculties & (F.col("pf") != F.col("df")) & ~soft) & ~(levels & (F.col("pl") != F.col("dl"))) | F.lit(False))
    best = F.array_max(F.transform("names", lambda t: F.struct((F.size(F.array_intersect(t, F.col("words"))) / F.size(t)).alias("ratio"), F.size(F.array_intersect(t, F.col("words"))).alias("overlap"))))
    x = both.withColumn("_b", best).withColumns({"name_ratio": F.coalesce("_b.ratio", F.lit(0.0)), "name_overlap": F.coalesce("_b.overlap", F.lit(0))})
    credit = F.col("pe").isNotNull() & (F.size("de") > 0)
    ratio, overlap = F.col("name_ratio"), F.col("name_overlap")
    abbreviation, address = F.arrays_overlap("abbreviations", "words"), F.arrays_overlap("pu", "du")
    name = F.when((ratio >= 0.95) & (overlap >= 1), "exact_or_near_name").when((ratio >= 0.6) & (overlap >= 2), "strong_name_overlap").when(overlap >= 2, "medium_name_overlap").when(overlap >= 1, "weak_name_overlap")
    points: list[tuple[Column, int, Column | str]] = [
        (faculties & (F.col("pf") == F.col("df")), 3, "faculty"), (faculties & (F.col("pf") != F.col("df")), -1, "soft_faculty_cross"), (levels, 2, "level"),
        (credit & F.array_contains("de", F.col("pe")), 5, "ects"), (credit & ~F.array_contains("de", F.col("pe")), -4, "ects_conflict"),
        (name == "exact_or_near_name", 8, "exact_or_near_name"), (name == "strong_name_overlap", 6, "strong_name_overlap"), (name == "medium_name_overlap", 4, "medium_name_overlap"), (name == "weak_name_overlap", 2, "weak_name_overlap"),
        (abbreviation, 4, "abbreviation"), (address, 6, "curriculum_url"), (F.col("generic") & (overlap == 0) & ~abbreviation, -3, "generic_without_name"),
    ]
    score = reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n, _ in points])
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, _, r in points]))
    return x.select("document_index", "programme_index", score.alias("score"), reasons.alias("reasons"), "name_ratio", "name_overlap", F.col("pe").alias("ects"), F.col("pl").alias("level"), F.col("de").alias("ects_values"))


def select_matches(scored: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The matches that stand: enough points, agreeing credits or very strong evidence, and a name, abbreviation or address.

    Documents with credits keep the matches within two points of the best; the others keep, of those within one
    point, the main programme of the highest credits. All exact ties stay.
    """
    strong = F.arrays_overlap("reasons", F.array(*[F.lit(r) for r in ("exact_or_near_name", "strong_name_overlap", "medium_name_overlap", "abbreviation", "curriculum_url")]))
    agrees = F.coalesce(F.array_contains("ects_values", F.col("ects")), F.lit(False))
    rescued = F.array_contains("reasons", "curriculum_url") | (F.col("name_ratio") >= 0.95)
    ok = scored.where((F.col("score") >= threshold) & strong & ((F.size("ects_values") == 0) | agrees | rescued)).withColumn("_agrees", agrees)
    w = Window.partitionBy("document_index")
    ok = ok.withColumn("_explicit", F.max("_agrees").over(w))
    best = F.max(F.when(F.col("_explicit") & ~F.col("_agrees"), None).otherwise(F.col("score"))).over(w)
    near = ok.withColumn("_best", best).where(F.when(F.col("_explicit"), F.col("_agrees") & (F.col("score") >= F.col("_best") - NEAR_WITH_CREDITS)).otherwise(F.col("score") >= F.col("_best") - NEAR_WITHOUT))
    main = F.lit(False)
    for level, credits in MAIN_CREDITS.items():
        main = F.when(F.col("level") == level, F.col("ects").isin(*credits)).otherwise(main)
    rank = F.struct(F.coalesce(main, F.lit(False)).cast("int").alias("m"), F.coalesce("ects", F.lit(-1)).alias("e"), F.col("score").alias("s"))
    near = near.withColumn("_rank", rank).withColumn("_top", F.max("_rank").over(w))
    return near.where(F.col("_explicit") | (F.col("_rank") == F.col("_top"))).select("document_index", "programme_index", "score", "reasons")


def match_documents(programmes: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_index, programme_index, score, reasons): the matches that ``select_matches`` leaves of the pairs of ``score_pairs``.

    Scores and selection depend on what a document and a programme say, and all ties stay; so equal documents and equal programmes
    are scored and selected as one, and copies meet only in the matches that stand.
    """
    (p, programmes_of), (d, documents_of) = alike(programmes, "programme_index"), alike(documents, "document_index")
    stand = persist_shared(select_matches(score_pairs(p, d, strong=True)), "matches").withColumnsRenamed({"programme_index": "_p", "document_index": "_d"})
    met = stand.join(programmes_of.withColumnRenamed("class", "_p").hint("merge"), "_p").join(documents_of.withColumnRenamed("class", "_d").hint("merge"), "_d")
    return met.select("document_index", "programme_index", "score", "reasons")


def match_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(id, program_id, how): exact name (of any language) within level and credits, else containment either way.

    ``wanted``: id, name, level, ects; ``known``: program_id, names (list), level, ects. Null and empty names match nothing.
    """
    links, wanted_of, known_of = name_links(wanted, known)
    met = links.join(wanted_of.withColumnRenamed("class", "wanted_class").hint("merge"), "wanted_class").join(known_of.withColumnRenamed("class", "known_class").hint("merge"), "known_class")
    return met.select("id", "program_id", "how")


def count_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(id, n, how): how many programmes ``match_names`` finds for each id, and by which way; ids without any are left out. No pair is made of copies."""
    links, wanted_of, known_of = name_links(wanted, known)
    sizes = known_of.groupBy(F.col("class").alias("known_class")).agg(F.count("*").alias("size"))
    counts = links.join(sizes, "known_class").groupBy(F.col("wanted_class").alias("class")).agg(F.sum("size").alias("n"), F.min("how").alias("how"))
    return wanted_of.join(counts.hint("merge"), "class").select("id", "n", "how")


def name_links(wanted: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, wanted members, known members): ``match_names`` between classes of equal rows, and the members of the classes (see ``alike``)."""
    (w, wanted_of), (k, known_of) = alike(wanted.where("id is not null"), "id"), alike(known, "program_id")
    links = _match_names(persist_shared(w, "wanted-names"), persist_shared(k, "known-names"))
    return links.withColumnsRenamed({"id": "wanted_class", "program_id": "known_class"}), wanted_of, known_of


def _match_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """As ``match_names``. Containment is found between distinct names, by an automaton and by postings (see ``containment``), before
    level and credits join the rows."""
    flat = known.select("program_id", "level", "ects", F.explode("names").alias("n")).select("program_id", "level", "ects", F.lower(F.trim("n")).alias("name")).where("name <> ''").distinct()
    w = wanted.select("id", F.lower(F.trim("name")).alias("text"), "level", "ects").where("text <> ''")
    same = [F.col("w.level") == F.col("k.level"), F.col("w.ects").eqNullSafe(F.col("k.ects"))]
    exact = w.alias("w").join(flat.alias("k"), [*same, F.col("w.text") == F.col("k.name")]).select("w.id", "k.program_id", F.lit("exact").alias("how")).distinct()
    exact = persist_shared(exact, "exact-names")
    rest = w.join(exact.select("id").distinct(), "id", "left_anti")
    held = persist_shared(names_held(rest.select("text").distinct(), "text", flat, ["text"]).unionByName(names_that_hold(flat, rest)).distinct(), "held-names")
    pairs = rest.join(held, "text").alias("w").join(flat.alias("k"), [*same, F.col("w.name") == F.col("k.name")])
    return exact.unionByName(pairs.select("w.id", "k.program_id", F.lit("contains").alias("how")).distinct())


def staged_lookup(df: DataFrame, column: str, dimension: DataFrame, name: str, key: str, aliases: dict[str, str], default) -> DataFrame:  # noqa: ANN001
    """``df`` with ``key`` by the exact name, else by its alias, else ``default``; ``how`` tells which."""
    spark = df.sparkSession
    alias = spark.createDataFrame(list(aliases.items()) or [("", "")], "_alias string, _meant string")
    dim = dimension.select(F.lower(F.trim(name)).alias("_name"), F.col(key).alias("_key")).dropDuplicates(["_name"])
    x = df.withColumn("_v", F.lower(F.trim(column))).join(F.broadcast(alias), F.col("_v") == F.lower("_alias"), "left")  # a hand-written table
    x = x.join(dim.withColumnRenamed("_key", "_exact"), F.col("_v") == F.col("_name"), "left").drop("_name")  # the planner sends small dimensions to all tasks by itself
    x = x.join(dim.withColumnRenamed("_key", "_by_alias"), F.lower("_meant") == F.col("_name"), "left").drop("_name")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_by_alias").isNotNull(), "alias").otherwise("default")
    return x.withColumn(key, F.coalesce("_exact", "_by_alias", F.lit(default))).withColumn("how", how).drop("_v", "_alias", "_meant", "_exact", "_by_alias")


def tree_lookup(df: DataFrame, column: str, dimension: DataFrame, to: str = "tree_key", limit: int = AUTOMATON_BYTES) -> DataFrame:
    """``df`` with the first key, by ``dimension.priority``, whose key or name the tree text in ``column`` holds, as ``to``; null if none.

    ``dimension``: key, name, priority. Case doesn't matter. A dimension of at most ``limit`` bytes goes to all tasks as one automaton and
    the rows stay where they are; a larger one goes in blocks over the distinct texts (see ``containment``).
    """
    own = dimension.select("key", F.explode(F.array("key", "name")).alias("name"), "priority").select("key", F.lower(F.col("name").cast("string")).alias("name"), "priority").where("name <> ''")
    if small(own, limit):
        rows = own.orderBy("priority", "key").collect()
        keys = F.array(*[F.lit(r.key) for r in rows]) if rows else F.array(F.lit(None).cast("string"))
        return first_held(df.withColumn("_tree", F.lower(column)), "_tree", [r.name for r in rows], "_at").withColumn(to, F.get(keys, F.col("_at"))).drop("_tree", "_at")
    text = F.lower(column)
    found = names_held(df.select(text.alias("text")).distinct(), "text", own, ["text"], limit).join(own, "name").groupBy("text").agg(F.min_by("key", F.struct("priority", "key")).alias(to))
    return df.join(found.withColumnRenamed("text", "_tree"), text == F.col("_tree"), "left").drop("_tree")


def representatives(manifest: DataFrame, key: str, seq: str) -> DataFrame:
    """Of every group the row of the highest score; the first one wins ties."""
    return latest_per_key(manifest, [key], [F.desc("score"), F.asc(seq)])
