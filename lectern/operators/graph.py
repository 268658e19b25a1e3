"""Connected components of a link table, by contraction, and by alternating large and small stars of what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.skew import dealt_join
from lectern.storage import forget, persist_shared


#: A contraction that leaves more than this share of the links is the last; fewer links than this aren't contracted.
SHRINKS, FEW_LINKS = 0.9, 20_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = FEW_LINKS) -> DataFrame:
    """(id, component) of every id in ``links``; a component is called by its least id.

    First, as long as that leaves markedly fewer links, every id becomes the least of itself and its neighbours, and links between equal ones go. A
    component's least id stays, and a link (u, m) to u's least neighbour becomes the link of m to what m becomes, so that components are kept. What is
    left is settled by stars, and the names go back the way the ids came. Links with a null and self links count as none.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    e = persist_shared(e, "links")
    total, became = e.count(), []
    while total >= max(few, 1):
        near, left = _contracted(e, total)
        became.append(near)
        forget(e)
        before, e, total = total, left, left.count()
        if total > SHRINKS * before:
            break
    named = _stars(e, total, max_rounds)
    for near in reversed(became):
        named = named.withColumnsRenamed({"id": "m"})
        names = near.groupBy("m").agg(F.count("*").alias("n")).join(named.hint("merge"), "m", "left").withColumn("component", F.coalesce("component", "m"))
        named = dealt_join(near.select("u", "m"), names, "m", "u", near.count()).select(F.col("u").alias("id"), "component")
    return named


def _contracted(e: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """What every id of the links becomes (u, m, n: its links), and the links between these."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = persist_shared(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")), "nearest")
    half = dealt_join(e, near, "u", "v", total).select(F.col("v").alias("u"), F.col("m").alias("x"))
    ends = dealt_join(half, near, "u", "x", total).where("x <> m").select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v"))
    return near, persist_shared(ends.distinct(), "contracted")


def _stars(e: DataFrame, total: int, max_rounds: int) -> DataFrame:
    """(id, component) by alternating large and small stars of distinct links (u, v), u > v, in a shared table.

    Every round rewires each id's neighbours to the least of them and is written to the shared folder;
    rounds grow with the logarithm of the longest chain. The neighbours of an id that has a large part of all links are
    dealt over several tasks. The driver sees two sums a round, never the links.
    """
    before = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n"))
        large = dealt_join(both.where("v > u"), least, "u", "v", total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = dealt_join(large, least, "u", "v", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, persist_shared(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        forget(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
