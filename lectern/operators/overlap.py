"""Exact overlap joins of word sets, by prefix and size filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.storage import persist_shared


def overlap_pairs(left: DataFrame, right: DataFrame, need: Column, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """(left_id, right_id, shared): pairs of sets with at least ``need`` words in common, and how many they have.

    ``left``: left_id, words (distinct, no nulls); ``right``: right_id, words; ``need`` is a column over ``size``, the number of words of
    the right set, and at least ``least`` >= 1; ``by`` names columns that must be equal (nulls are one value). Ids are unique.

    Words are put in one order, by the number of pairs that they could make. If two sets share t words, the t-th last of the
    shared ones in that order has t - 1 shared words behind it; so the first shared word is among the first size - t + 1 of either
    set, and only these prefixes (t = ``need`` right, ``least`` left, which is less) are joined. The most frequent words stand last and are met
    only where a set has little else. Left sets are cut to words that some right set has, for others aren't shared;
    left sets, then, of fewer than ``least`` words, and right ones of fewer than they need, drop out. What meets is counted
    exactly. Empty tables and empty sets have no pairs.
    """
    by = by or []
    r = right.select("right_id", *by, "words", F.size("words").alias("size")).withColumn("need", F.greatest(need, F.lit(least))).where("size >= need")
    r = persist_shared(r, "right-sets")
    r_rows = r.select("right_id", *by, "need", F.explode("words").alias("word"))
    l_rows = persist_shared(_known_words(left, r_rows, by), "left-words")
    # few sums leave a task
    weights = persist_shared(l_rows.groupBy(*by, "word").agg((F.count("*") * F.first("n_right")).alias("weight")), "word-weights")

    def ordered(rows: DataFrame, keys: list[str]) -> DataFrame:
        weighed = rows.alias("x").join(weights.alias("w"), [F.col("x.word") == F.col("w.word"), *_same(by, "x", "w")], "left").select("x.*", F.coalesce("weight", F.lit(0)).alias("weight"))
        words = F.transform(F.array_sort(F.collect_list(F.struct("weight", "word"))), lambda x: x["word"])
        return weighed.groupBy(*keys, *by).agg(words.alias("words"))

    head = lambda keys, taken: [*keys, *by, F.explode(F.slice("words", F.lit(1), taken)).alias("word")]
    lefts = persist_shared(ordered(l_rows, ["left_id"]).where(F.size("words") >= least), "left-sets")
    rights = persist_shared(ordered(r_rows, ["right_id", "need"]), "right-sets")
    lp = lefts.select(*head(["left_id"], F.size("words") - least + 1))
    rp = rights.select(*head(["right_id"], (F.size("words") - F.col("need") + 1).cast("int")))
    # files of repeated values are small and their rows many: no side is sent to all tasks for its files' size
    meet = lp.alias("l").join(rp.hint("merge").alias("r"), [F.col("l.word") == F.col("r.word"), *_same(by, "l", "r")]).select("left_id", "right_id").distinct()
    both = meet.join(lefts.select("left_id", F.col("words").alias("left_words")).hint("merge"), "left_id").join(rights.select("right_id", "words", "need").hint("merge"), "right_id")
    return both.withColumn("shared", F.size(F.array_intersect("left_words", "words"))).where("shared >= need").select("left_id", "right_id", "shared")


def _same(by: list[str], a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]


def _known_words(left: DataFrame, r_rows: DataFrame, by: list[str]) -> DataFrame:
    """(left_id, by, word, n_right) of the words that some right set has, and how many have them."""
    counts = r_rows.groupBy(*by, "word").agg(F.count("*").alias("n_right"))
    rows = left.select("left_id", *by, F.explode("words").alias("word")).alias("l")
    return rows.join(counts.alias("r"), [F.col("l.word") == F.col("r.word"), *_same(by, "l", "r")]).select("l.*", "n_right")


def counted_pairs(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """As ``overlap_pairs`` with a small ``need`` for all: the shared words are counted one by one.

    For two words of many a prefix leaves out one word, and nearly all that meets is a result; then counting is less work
    than checking. Pairs are counted before they move.
    """
    l, r = left.select("left_id", F.explode("words").alias("word")), right.select("right_id", F.explode("words").alias("word"))
    return l.join(r, "word").groupBy("left_id", "right_id").agg(F.count("*").cast("int").alias("shared")).where(F.col("shared") >= least)
