"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more rows than this, and than its share below, is dealt out over several tasks.
HOT_ROWS = 1_000
#: At most so many keys can be hot: a hot key has more than one in so many of all rows. Bounds what is broadcast.
MOST_HOT = 50_000
#: Fewer rows in all are any one task's work, and are joined plainly.
FEW_ROWS = 20_000


def dealt_join(rows: DataFrame, sizes: DataFrame, key: str, by: str | list[str], total: int, how: str = "inner", n: str = "n", few: int = FEW_ROWS) -> DataFrame:
    """``rows`` joined with ``sizes``, which has one row for each key and, in ``n``, about how many of ``rows`` it has.

    Keys with more than HOT_ROWS and one in MOST_HOT of the ``total`` rows are dealt by a hash of ``by``: a hot key's
    rows go to as many tasks as it fills, its row of ``sizes`` is copied to each. Every pair is joined once, as by a plain join;
    the hot keys, MOST_HOT at most, are sent to all tasks. Below ``few`` rows in all nothing is dealt. ``how`` is inner,
    left or left_semi.
    """
    if total < few:
        return rows.join(sizes, key, how)
    limit = max(HOT_ROWS, total // MOST_HOT)
    parts = F.ceil(F.col(n) / limit).cast("int")
    hot = sizes.where(F.col(n) > limit).select(F.col(key), parts.alias("_parts"))
    columns = [by] if isinstance(by, str) else by
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*columns), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copies = F.when(F.col(n) > limit, parts).otherwise(1)
    spread = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return salted.join(spread, [key, "_salt"], how).drop("_salt")
