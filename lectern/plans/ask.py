"""Questions to chunks: detection, metadata filters, year filter with fallback, rule ranking, for many questions at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import intent
from lectern.functions import text as T
from lectern.operators import retrieval as S
from lectern.plans import api

#: Phrases that place a chunk in a study year.
_ORDINALS = {"1": ("erstes", "ersten", "first"), "2": ("zweites", "zweiten", "second"), "3": ("drittes", "dritten", "third")}


def of_year(year: Column, section: Column, text: Column) -> Column:
    """Whether a chunk's section or text names the study year; true if no year is asked for."""
    both = F.concat_ws(" ", T.normalize_query(section), T.normalize_query(text))
    found = F.lit(False)
    for y, (a, b, c) in _ORDINALS.items():
        words = [f"{y} jahr", f"{y} studienjahr", f"{a} studienjahr", f"{b} studienjahr", f"{a} jahr", f"{b} jahr", f"{c} year"]
        found = F.when(year == y, reduce(lambda p, q: p | q, [F.contains(both, F.lit(w)) for w in words])).otherwise(found)
    return year.isNull() | found


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = 10, neighbours: DataFrame | None = None) -> DataFrame:
    """(id, rank, chunk_id, score, program_key) of the ``k`` best chunks of every question.

    ``questions``: id, text. ``chunks``: chunk_id, text, program_key, program_name, degree_level, total_ects, section,
    chunk_type, contains_table, doc_label. A question with a detected programme sees that programme's chunks that
    state no other degree or credits; the others see their ``neighbours`` (id, chunk_id), as found by vector, or the
    chunks that share a word with them. Of these, the year's chunks if there are any; ties go to the first chunk id.
    """
    q = questions.select("id", "text", S.detect(F.col("text")).alias("d"), T.tokens(T.normalize_query(F.col("text")), T.QUESTION_STOPWORDS, 3).alias("qt"))
    found = S.detect_program(questions, S.program_catalog(chunks)).select("id", F.col("program_key").alias("wanted"))
    q = q.join(found, "id", "left").select("id", "d.degree", "d.ects", "d.year", "qt", "wanted")
    words = chunks.select("chunk_id", F.explode(F.array_distinct(F.split(T.normalize_query(F.col("text")), " "))).alias("w"))
    loose = q.where("wanted is null")
    wide = neighbours.join(loose.select("id"), "id", "left_semi").select("id", "chunk_id") if neighbours is not None else loose.select("id", F.explode("qt").alias("w")).join(words, "w").select("id", "chunk_id").distinct()
    bound = q.where("wanted is not null").join(chunks.select("chunk_id", F.col("program_key").alias("wanted")), "wanted").select("id", "chunk_id")
    x = bound.unionByName(wide).join(q, "id").join(chunks, "chunk_id")
    x = x.where((F.col("degree").isNull() | F.col("degree_level").isNull() | (F.col("degree") == F.col("degree_level"))) & (F.col("ects").isNull() | F.col("total_ects").isNull() | (F.col("ects") == F.col("total_ects"))))
    in_year = of_year(F.col("year"), F.col("section"), F.col("text"))
    x = S.filter_or_all(x, in_year, ["id"])
    text = T.normalize_query(F.concat_ws(" ", "text", "program_key", "program_name", "degree_level", "section", "doc_label"))
    flags = {
        "program": F.col("wanted").isNotNull(), "degree": F.col("degree") == F.col("degree_level"), "ects": F.col("ects") == F.col("total_ects"), "year": F.col("year").isNotNull() & in_year,
        "table_chunk": F.col("chunk_type") == "table", "contains_table": F.col("contains_table"), "code": F.col("text").rlike(r"(?<![\p{L}\p{N}_])[A-ZÄÖÜ]{2,4}\.[0-9]{5}(?![\p{L}\p{N}_])"),
        "plan_label": F.contains(T.normalize_query(F.col("doc_label")), F.lit("studienplan")),
    }
    shared = F.size(F.array_intersect("qt", F.split(text, " ")))
    return S.top_k(x.withColumn("score", S.rule_score(flags, shared)), "score", k, ["id"], ["chunk_id"]).select("id", "rank", "chunk_id", "score", F.col("wanted").alias("program_key"))


def route(questions: DataFrame) -> DataFrame:
    """(id, mode, store, tool, args): api where a rule gives a structured query, else the store to search."""
    p = questions.select("id", intent.plan(F.col("text")).alias("p"), intent.store(F.col("text")).alias("store"))
    return p.select("id", F.when(F.col("p.tool").isNotNull(), "api").otherwise("rag").alias("mode"), "store", "p.tool", "p.args")


def answer(tables: api.Tables, question: str):  # noqa: ANN201
    """The frame of a structured question's query over the catalogue; None if no rule fits."""
    spark = tables["course"].sparkSession
    r = spark.range(1).select(intent.plan(F.lit(question)).alias("p")).first().p
    if r.tool is None:
        return None
    named = {"program_name": "name"} if r.tool != "get_courses" else {}
    return api.call(tables, r.tool, {named.get(k, k): v for k, v in r.args.items()})
