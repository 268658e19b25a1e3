"""Similarity join of names: matching blocks only for pairs that bounds on lengths and characters leave."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.overlap import overlap_pairs
from lectern.storage import persist_shared

#: Length of the substrings that candidates share.
GRAM = 2


def grams(name: str, n: int = GRAM) -> list[str]:
    """Substrings of ``n`` characters, the k-th time that one occurs as its own element, so that sets count as bags."""
    seen: Counter = Counter()
    out = []
    for i in range(len(name) - n + 1):
        g = name[i : i + n]
        out.append(f"{g}\0{seen[g]}")
        seen[g] += 1
    return out


def _with_grams(names: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([grams(t) for t in texts], pa.list_(pa.string())), pa.array([len(t) for t in texts], pa.int32())], names=["name", "words", "n"])

    return names.mapInArrow(work, "name string, words array<string>, n int")


def _ratios(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs with their matching-blocks ratio, of those that reach it; characters in common are counted first, for they bound it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            matcher = difflib.SequenceMatcher(None, autojunk=False)
            last = None
            for i, (x, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if y != last:
                    matcher.set_seq2(y)
                    last = y
                matcher.set_seq1(x)
                if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and (r := matcher.ratio()) >= least:
                    rows.append(i)
                    found.append(r)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(found, pa.float64())], names=["a", "b", "ratio"])

    return pairs.mapInArrow(work, "a string, b string, ratio double")


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, ratio): distinct names of ``left.name`` and ``right.name`` whose matching-blocks ratio is at least ``least`` > 0.

    The ratio is 2 m / (len a + len b) for m characters in matching blocks. Between two blocks some character of a or b stands outside of
    all blocks, or they would be one; so there are at most 1 + (len a + len b - 2 m) blocks, and the names share at least as many pairs of
    neighbours as m less the number of blocks (``least_shared``), counted as often as they occur. Pairs that share so many come from an overlap
    join of prefixes; names too short for the bound to say anything are met by those of fitting lengths that have a character in common.
    Only what meets is compared block by block. Nulls are similar to nothing, empty names to empty names (ratio 1).
    """
    distinct = lambda df: persist_shared(_with_grams(df.select(F.col("name").cast("string").alias("name")).where("name is not null").distinct()), "names")
    lefts, rights = distinct(left), distinct(right)
    most = (2 - least) / least  # how many times longer a partner can be
    longest = (rights.agg(F.max("n")).first()[0] or 0) + 1
    table = {n: need for n in range(longest) if (need := least_shared(n, least)) >= 1}
    need = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("n")), F.lit(0)) if table else F.lit(0)
    bounded, loose = rights.withColumn("need", need).where("need >= 1"), rights.withColumn("need", need).where("need < 1")
    keyed = bounded.select(F.col("name").alias("right_id"), "words")
    by_size = {max(0, n - GRAM + 1): k for n, k in table.items()}
    need_of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in by_size.items() for x in kv]), F.col("size")), F.lit(1)) if by_size else F.lit(1)
    pairs = overlap_pairs(lefts.select(F.col("name").alias("left_id"), "words"), keyed, need_of).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    # too short for a bound: a character in common, and lengths that fit
    letters = lambda df, c: df.select(F.col("name").alias(c), F.col("n").alias(f"n_{c}"), F.explode(F.array_distinct(F.split("name", ""))).alias("letter")).where("letter <> ''")
    reach = int(most * max([n for n in range(longest) if n not in table], default=0)) + 1
    near = letters(lefts.where(F.col("n") <= reach), "a").join(letters(loose, "b"), "letter").where((F.col("n_a") <= most * F.col("n_b") + 1e-9) & (F.col("n_b") <= most * F.col("n_a") + 1e-9))
    found = _ratios(pairs.unionByName(near.select("a", "b")).distinct().repartition("b").sortWithinPartitions("b"), least)
    empty = lefts.where("n = 0").select(F.col("name").alias("a")).join(rights.where("n = 0").select(F.col("name").alias("b"), F.lit(1.0).alias("ratio")))
    return found.unionByName(empty)


def least_shared(n: int, least: float) -> int:
    """How many pairs of neighbours a name of ``n`` characters shares at least with any name of a ratio of ``least`` or more."""
    out = n
    for other in range(int(n * least / (2 - least)), int(n * (2 - least) / least) + 2):
        m = -int(-(least * (n + other) / 2 - 1e-9) // 1)
        if m <= min(n, other):
            out = min(out, m - 1 - (n + other - 2 * m))
    return max(out, 0)
