"""Relational building blocks: optional predicates, joins, aggregates, ranks, sets."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A dimension of up to so many bytes, as measured on its rows, is sent to all tasks.
BROADCAST_BYTES = 64_000_000

# ---- predicates (an argument that is None filters nothing) ----


def all_of(conditions: Iterable[Column | None]) -> Column:
    """Conjunction of the conditions that are given; true if there are none."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def optional_equal(column: str | Column, value) -> Column | None:  # noqa: ANN001
    return None if value is None else (F.col(column) if isinstance(column, str) else column) == F.lit(value)


def optional_like(columns: Sequence[str], text: str | None) -> Column | None:
    """Case-insensitive containment in any of the columns; % and _ in ``text`` keep their pattern meaning."""
    if text is None:
        return None
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False)) for c in columns])


_SYMBOLS = {"<=": "lte", ">=": "gte", "<": "lt", ">": "gt", "=": "eq"}
_COMPARE = {"eq": lambda c, v: c == v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v}


def numeric_filter(value: str | float | None, operator: str | None = None) -> tuple[str, float] | None:
    """(operator name, number) of ``">=6"``, ``"6"`` or 6; a symbol overrides ``operator``; None if there is no number."""
    if value is None:
        return None
    m = re.match(r"\s*(<=|>=|<|>|=)?\s*(.+?)\s*$", str(value))
    if not m:
        return None
    try:
        number = float(m.group(2))
    except ValueError:
        return None
    return _SYMBOLS.get(m.group(1) or "", operator if operator in _COMPARE else "eq"), number


def optional_compare(column: str, value: str | float | None, operator: str | None = None) -> Column | None:
    found = numeric_filter(value, operator)
    return None if found is None else _COMPARE[found[0]](F.col(column), F.lit(found[1]))


def tri_state(value: str | bool | None) -> bool | None:
    """True, False or None (no filter) of a query argument."""
    if isinstance(value, bool) or value is None:
        return value
    return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(str(value).strip().lower())


def id_list(value: str | Sequence[str] | None) -> list[int]:
    """Whole numbers of comma-parted and repeated arguments, in order, each once."""
    parts = [] if value is None else [value] if isinstance(value, str) else list(value)
    found = [p.strip() for x in parts for p in str(x).split(",")]
    return list(dict.fromkeys(int(float(p)) for p in found if re.fullmatch(r"[+-]?\d+(\.0*)?", p)))


def to_int(c: Column) -> Column:
    """Whole numbers only; anything else is null."""
    d = c.try_cast("double")
    return F.when(d == F.floor(d), d.cast("long"))


def code_match(column: str, code: str, prefix: str = "UE-") -> Column:
    """The code itself, or the code without prefix in upper case."""
    c = F.col(column)
    return (c == code) | (F.upper(F.replace(c, F.lit(prefix), F.lit(""))) == code.upper().replace(prefix, ""))


def non_empty(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def present(df: DataFrame, column: str, trimmed: bool = True) -> Column:
    """Whether a value says something: not null, not an empty text, list or map (elements are not looked into)."""
    kind = dict(df.dtypes)[column]
    c = F.col(f"`{column}`")
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if kind == "string":
        return F.coalesce(F.length(F.trim(c) if trimmed else c) > 0, F.lit(False))
    return c.isNotNull()


def locale_fallback(*columns: str) -> Column:
    """The first column that is neither null nor empty; the last one as it is."""
    *some, last = columns
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in some], F.col(last))


#: Orders of names by locale; German is the default.
LOCALE_ORDER = {"de": ("name_de", "name_en", "name_fr", "name"), "en": ("name_en", "name_de", "name_fr", "name"), "fr": ("name_fr", "name_de", "name_en", "name")}


def program_type(ects: Column, level: Column) -> Column:
    """minor, major or mono by credits and level; null credits, or credits between the types, give null.

    Below 90 credits a programme is a minor. A master's 90 make a major and 120 a mono; a bachelor's 90 and
    more a major and 180 a mono.
    """
    by_level = F.when(level == "Master", F.when(ects == 90, "major").when(ects == 120, "mono")).when(level == "Bachelor", F.when(ects < 180, "major").when(ects == 180, "mono"))
    return F.when(ects < 90, "minor").otherwise(F.when(ects.isNotNull(), by_level))


#: How a doctorate's level is written.
DOCTORATES = ("d", "do", "phd", "doctorate", "doctorat")


def without_doctorates(df: DataFrame, level: str) -> tuple[DataFrame, DataFrame]:
    """(other programmes, doctorates); a programme without a level is none of the latter."""
    is_one = F.coalesce(F.lower(F.trim(level)).isin(*DOCTORATES), F.lit(False))
    return df.where(~is_one), df.where(is_one)


def semester_label(kind: Column, year: Column) -> Column:
    """HS or FS (nothing for other kinds) and the year."""
    return F.concat(F.when(kind == "Autumn", "HS ").when(kind == "Spring", "FS ").otherwise(""), year.cast("string"))


# ---- joins ----


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df`` hold at most ``limit`` bytes: 16 a value, and what texts, bytes and lists take."""
    size = F.lit(16 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "string" or kind == "binary":
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def lookup(facts: DataFrame, dimension: DataFrame, on: list[str] | str, how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join a dimension: sent to all tasks if its measured bytes are few, by a shuffle otherwise."""
    return facts.join(F.broadcast(dimension) if small(dimension, limit) else dimension, on, how)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first by ``order``; equal to DISTINCT ON and to a lateral LIMIT 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def either_key(left: DataFrame, right: DataFrame, left_key: str, right_keys: Sequence[str]) -> DataFrame:
    """Join on any of several right keys as a union of equal joins, each pair once. ``left`` and ``right`` need _l and _r ids."""
    parts = [left.join(right.withColumn("_k", F.col(k)), F.col(left_key) == F.col("_k")).drop("_k") for k in right_keys]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["_l", "_r"])


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key is set but unknown to the parent."""
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def compare_keys(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, status): matched, missing (expected only) or extra (actual only)."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(1))
    a = actual.select(key).distinct().withColumn("_a", F.lit(1))
    status = F.when(F.col("_e").isNull(), "extra").when(F.col("_a").isNull(), "missing").otherwise("matched")
    return e.join(a, key, "full").select(key, status.alias("status"))


def overlapping(a: DataFrame, b: DataFrame, day: str, start: str, end: str, left: str = "l", right: str = "r") -> DataFrame:
    """Pairs on the same day whose half-open intervals meet; touching ends don't. Columns come back as l.* and r.*."""
    x, y = a.alias(left), b.alias(right)
    return x.join(y, (F.col(f"{left}.{day}") == F.col(f"{right}.{day}")) & (F.col(f"{left}.{start}") < F.col(f"{right}.{end}")) & (F.col(f"{right}.{start}") < F.col(f"{left}.{end}")))


def binned_overlaps(df: DataFrame, id_col: str, keys: list[str], start: str, end: str, width: float) -> DataFrame:
    """(keys, a, b) of intervals that overlap, a < b, by bins of ``width`` so that a key with very many intervals is many tasks' work.

    A pair that shares several bins is kept in the bin where the later start lies.
    """
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    x = df.select(*keys, F.col(id_col).alias("i"), F.col(start).alias("s"), F.col(end).alias("e"), F.explode(bins).alias("bin"))
    l, r = x.alias("l"), x.alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "bin"]]
    meet = (F.col("l.i") < F.col("r.i")) & (F.col("l.s") < F.col("r.e")) & (F.col("r.s") < F.col("l.e"))
    home = F.floor(F.greatest("l.s", "r.s") / width) == F.col("l.bin")
    return l.join(r, reduce(lambda p, q: p & q, same) & meet & home).select(*[F.col(f"l.{k}") for k in keys], F.col("l.i").alias("a"), F.col("r.i").alias("b"))


# ---- aggregates ----


def sorted_set(c: Column) -> Column:
    """Distinct non-null values in order; an empty list if there are none."""
    return F.array_sort(F.collect_set(c))


def sorted_list(keys: list[Column], value: Column) -> Column:
    """Values in the order of ``keys`` (nulls first), as an aggregate."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], value.alias("v")))), lambda x: x["v"])


def composite_key_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: total, distinct_keys, duplicates, null_keys of a composite key (nulls count as a value)."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("null_keys"),
    )


def duplicate_groups(df: DataFrame, keys: list[str], top: int = 25) -> DataFrame:
    """The ``top`` key values that occur more than once, most frequent first."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), *keys).limit(top)


def duplicate_surplus(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row, surplus: rows beyond the first of each key whose parts all say something."""
    full = reduce(lambda a, b: a & b, [present(df, k) for k in keys])
    return df.where(full).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def distribution(df: DataFrame, column: str, missing: str = "<NULL>") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))


def field_completeness(df: DataFrame, fields: list[str], trimmed: bool = True) -> DataFrame:
    """(field, present, missing, total, rate) of every field, in one pass; rate is null for an empty table."""
    flags = [F.sum(present(df, f, trimmed).cast("long")).alias(f"p{i}") for i, f in enumerate(fields)]
    one = df.agg(F.count("*").alias("total"), *flags)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f"p{i}"), F.lit(0)).alias("present")) for i, f in enumerate(fields)]))
    flat = one.select("total", rows.alias("r")).select("r.field", "r.present", "total")
    return flat.select("field", "present", (F.col("total") - F.col("present")).alias("missing"), "total", F.try_divide("present", "total").alias("rate"))


def missing_examples(df: DataFrame, id_col: str, fields: list[str], top: int = 5) -> DataFrame:
    """(field, id, n) of the first ``top`` rows, by id, that miss a field."""
    flags = F.array(*[F.when(~present(df, f), F.lit(f)) for f in fields])
    rows = df.select(F.col(id_col).alias("id"), F.explode(F.array_compact(flags)).alias("field"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("field").orderBy("id"))).where(F.col("n") <= top)


def group_completeness(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(group, rate): share of rows in which all of a group's fields say something."""
    both = {g: reduce(lambda a, b: a & b, [present(df, f) for f in fs]) for g, fs in groups.items()}
    one = df.agg(*[F.avg(c.cast("double")).alias(g) for g, c in both.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.col(g).alias("rate")) for g in groups])).alias("r")).select("r.group", "r.rate")


def language_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: total, at_least_two, all_languages of parallel name columns."""
    n = reduce(lambda a, b: a + b, [present(df, c).cast("int") for c in columns])
    return df.agg(F.count("*").alias("total"), F.count(F.when(n >= 2, 1)).alias("at_least_two"), F.count(F.when(n == len(columns), 1)).alias("all_languages"))


def shared_resources(df: DataFrame, resource: str, owner: str, suspicious: int = 3) -> DataFrame:
    """(resource, owners, kind): single, shared, or suspicious beyond ``suspicious`` owners."""
    n = F.countDistinct(owner)
    kind = F.when(F.col("owners") > suspicious, "suspicious").when(F.col("owners") > 1, "shared").otherwise("single")
    return df.groupBy(resource).agg(n.alias("owners")).withColumn("kind", kind)


def url_references(df: DataFrame, url: str, owner: str, top: int = 25) -> DataFrame:
    """The ``top`` addresses that are referred to more than once: references and distinct owners."""
    return df.groupBy(url).agg(F.count("*").alias("refs"), F.countDistinct(owner).alias("owners")).where("refs > 1").orderBy(F.desc("refs"), url).limit(top)


def with_deltas(df: DataFrame, order: list[str], measures: list[str], partition: list[str] | None = None) -> DataFrame:
    """Every measure's change from the row before; null in the first row."""
    w = (Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))).orderBy(*order)
    return df.withColumns({f"{m}_delta": F.col(m) - F.lag(m).over(w) for m in measures})


def with_count(df: DataFrame, name: str, what: Column, partition: list[str] | None = None) -> DataFrame:
    """``df`` with a count over each partition's rows, or over all rows (counted apart, as one number for all tasks)."""
    if partition:
        return df.withColumn(name, F.count(what).over(Window.partitionBy(*partition)))
    return df.join(F.broadcast(df.agg(F.count(what).alias(name))), F.lit(True))  # one row


def hide_if_many(df: DataFrame, column: str, limit: int = 3, partition: list[str] | None = None) -> DataFrame:
    """Null the column out where the result (or its part) has more than ``limit`` rows."""
    return with_count(df, "_rows", F.lit(1), partition).withColumn(column, F.when(F.col("_rows") <= limit, F.col(column))).drop("_rows")


def page(df: DataFrame, order: list[Column], offset: int = 0, size: int = 25) -> DataFrame:
    """Rows offset .. offset + size - 1 in a fixed order; only that many leave a task."""
    top = df.orderBy(*order).limit(offset + size)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    return top.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > offset).drop("_n")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by ``order``."""
    return latest_per_key(df, keys, [F.asc_nulls_first(c) for c in order])


def merge_refs(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row of each key; every field takes its first non-null value by ``order``."""
    return df.groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


# ---- sets ----


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; two empty ones are equal (1)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_ratio(part: Column, whole: Column) -> Column:
    """Share of the distinct elements of ``part`` that ``whole`` has; null if there are none."""
    return F.try_divide(F.size(F.array_intersect(part, whole)), F.size(F.array_distinct(part)))


def set_status(expected: Column, actual: Column) -> Column:
    """exact, partial or none, by what two sets share."""
    same = (F.size(F.array_except(expected, actual)) == 0) & (F.size(F.array_except(actual, expected)) == 0)
    return F.when(same, "exact").when(F.size(F.array_intersect(expected, actual)) > 0, "partial").otherwise("none")


def staged_union(attempts: list[DataFrame], key: str, order: list[str], enough: int) -> DataFrame:
    """Rows of the first attempts, until ``enough`` distinct keys are gathered; a key keeps its earliest attempt."""
    tagged = reduce(DataFrame.unionByName, [a.withColumn("attempt", F.lit(i)) for i, a in enumerate(attempts)])
    return until_enough(latest_per_key(tagged, [key], [F.asc("attempt"), *[F.asc(c) for c in order]]), enough)


def until_enough(first: DataFrame, enough: int) -> DataFrame:
    """Of rows with the number of their attempt those of the first attempts, until ``enough`` rows are gathered."""
    sizes = first.groupBy("attempt").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.attempt") < F.col("a.attempt"), "left").groupBy("a.attempt").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("had"))
    return first.join(F.broadcast(before.where(F.col("had") < enough)), "attempt")  # as many rows as attempts
