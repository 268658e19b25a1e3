"""Relational, load and quality queries on the star tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import etl, matching, quality
from lectern.operators import relational as R
from lectern.session import table
from lectern.storage import persist_shared

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT o.o_orderkey, c.c_name, n.n_name, o.o_orderpriority, round(o.o_totalprice, 2) AS total, CAST(l.n_lines AS BIGINT) AS n_lines, l.parts
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN (SELECT l_orderkey, count(*) AS n_lines, string_agg(CAST(l_partkey AS VARCHAR) || ':' || l_returnflag, ';' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS parts FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
WHERE (o.o_orderpriority ILIKE '%urgent%' OR c.c_mktsegment ILIKE '%urgent%' OR o.o_orderpriority ILIKE '%1%') AND o.o_totalprice >= 1000
  AND EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o.o_orderkey AND x.l_returnflag = 'R')
ORDER BY n.n_name, o.o_totalprice DESC, o.o_orderkey LIMIT 100""")
def catalog_filter_search(spark: SparkSession, d: str) -> DataFrame:
    """Optional filters, a star join, a semi join and a nested ordered list; 100 rows."""
    o, c, n, l = (table(spark, d, t) for t in ("orders", "customer", "nation", "lineitem"))
    returned = l.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    joined = R.lookup(R.lookup(o.withColumnRenamed("o_custkey", "c_custkey"), c, "c_custkey", "inner").withColumnRenamed("c_nationkey", "n_nationkey"), n, "n_nationkey", "inner")
    like = [R.optional_like(["o_orderpriority", "c_mktsegment"], "urgent"), R.optional_like(["o_orderpriority"], "1")]
    wanted = R.all_of([like[0] | like[1], R.optional_compare("o_totalprice", ">=1000"), R.optional_equal("o_orderstatus", None)])
    found = joined.where(wanted).join(returned, "o_orderkey", "left_semi")
    top = found.orderBy("n_name", F.desc("o_totalprice"), "o_orderkey").limit(100)  # the page is cut before lists are built
    keys = [F.col(k) for k in ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")]
    parts = R.sorted_list(keys, F.concat_ws(":", "l_partkey", "l_returnflag"))
    lines = l.join(F.broadcast(top.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.array_join(parts, ";").alias("parts"))
    return top.join(F.broadcast(lines), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "c_name", "n_name", "o_orderpriority", F.round("o_totalprice", 2).alias("total"), "n_lines", "parts")


@query("""
SELECT o_orderkey, CASE WHEN size < 90 THEN 'minor' WHEN level = 'Master' AND size = 90 THEN 'major' WHEN level = 'Master' AND size = 120 THEN 'mono'
  WHEN level = 'Bachelor' AND size < 180 THEN 'major' WHEN level = 'Bachelor' AND size = 180 THEN 'mono' END AS kind
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 30.0 * (1 + o_orderkey % 7) END AS size, CASE WHEN o_orderpriority < '3' THEN 'Bachelor' ELSE 'Master' END AS level FROM orders)""")
def program_type_case(spark: SparkSession, d: str) -> DataFrame:
    """The order-sensitive case over credits and level."""
    k = F.col("o_orderkey")
    size = F.when(k % 11 != 0, 30.0 * (1 + k % 7))
    level = F.when(F.col("o_orderpriority") < "3", "Bachelor").otherwise("Master")
    return table(spark, d, "orders").select("o_orderkey", R.program_type(size, level).alias("kind"))


@query("""
SELECT c_custkey, COALESCE(NULLIF(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), NULLIF(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END, ''), 'none') AS label FROM customer""")
def locale_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first name that is neither null nor empty."""
    x = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise("").alias("a"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_name")).otherwise("").alias("b"), F.lit("none").alias("z"))
    return x.select("c_custkey", R.locale_fallback("a", "b", "z").alias("label"))


@query("""
SELECT o.o_orderkey, c.c_name, CASE WHEN count(*) OVER (PARTITION BY CAST(o.o_orderdate AS DATE)) <= 3 THEN c.c_mktsegment END AS link
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderdate >= TIMESTAMP '1996-01-01' AND o.o_orderdate < TIMESTAMP '1997-01-01'""")
def offerings_by_semester(spark: SparkSession, d: str) -> DataFrame:
    """One period's rows with their names; the link is hidden on days of more than three rows."""
    o = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1997-01-01'").withColumnRenamed("o_custkey", "c_custkey")
    x = R.lookup(o, table(spark, d, "customer"), "c_custkey", "inner").select("o_orderkey", "c_name", F.col("c_mktsegment").alias("link"), F.to_date("o_orderdate").alias("day"))
    return R.hide_if_many(x, "link", 3, ["day"]).drop("day")


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def exists_semi(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""
SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
  WHERE o.o_custkey = c.c_custkey AND l.l_returnflag = 'R' AND p.p_size <= 5)""")
def exists_three_way(spark: SparkSession, d: str) -> DataFrame:
    """Existence through three tables, as a semi join on distinct keys."""
    small = table(spark, d, "part").where("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    l = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").join(small, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(l, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}.{k}' AS name, count(*) FILTER (WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p})) AS orphans, count({k}) AS total, CASE WHEN count({k}) = 0 THEN NULL ELSE count(*) FILTER (WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p})) / count({k}) END AS rate FROM {c}"
        for c, k, p, pk in _KEYS
    )
)
def orphan_check_all(spark: SparkSession, d: str) -> DataFrame:
    """Orphans of every foreign key."""
    return quality.foreign_key_checks({t: table(spark, d, t) for t in {x for c, _, p, _ in _KEYS for x in (c, p)}}, _KEYS)


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' AND o.o_orderpriority = '1-URGENT')")
def anti_without_children(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order that is under way."""
    urgent = table(spark, d, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The latest order of every customer, as one aggregate instead of a sort."""
    best = F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("b")
    return table(spark, d, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "b.o_orderkey", "b.o_orderstatus", F.round("b.o_totalprice", 2).alias("total"))


@query("""
SELECT c.c_custkey, CAST(COALESCE(x.n, 0) AS BIGINT) AS n_docs, COALESCE(x.docs, '') AS docs FROM customer c LEFT JOIN
 (SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus, '|' ORDER BY o_orderdate DESC, o_orderkey DESC) AS docs FROM orders GROUP BY o_custkey) x ON x.o_custkey = c.c_custkey""")
def nested_order_docs(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's orders as one list, newest first; an empty list if there are none."""
    one = F.struct("o_orderdate", "o_orderkey", F.concat_ws(":", "o_orderkey", "o_orderstatus").alias("v"))
    docs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_docs"), F.array_join(F.transform(F.sort_array(F.collect_list(one), False), lambda x: x["v"]), "|").alias("docs"))
    return table(spark, d, "customer").select("c_custkey").join(docs, "c_custkey", "left").select("c_custkey", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("docs", F.lit("")).alias("docs"))


@query("""
SELECT l_suppkey, COALESCE(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS flags,
 COALESCE(string_agg(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_returnflag END, ',' ORDER BY CASE WHEN l_linestatus = 'O' THEN l_returnflag END), '') AS open_flags,
 COALESCE(string_agg(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_returnflag END, ',' ORDER BY CASE WHEN l_linestatus = 'F' THEN l_returnflag END), '') AS closed_flags FROM lineitem GROUP BY l_suppkey""")
def conditional_collections(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values, and distinct values under conditions, as sorted lists."""
    when = lambda s: F.array_join(R.sorted_set(F.when(F.col("l_linestatus") == s, F.col("l_returnflag"))), ",")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(R.sorted_set(F.col("l_returnflag")), ",").alias("flags"), when("O").alias("open_flags"), when("F").alias("closed_flags"))


@query("""
SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_keys, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(COALESCE(sum(CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN n END), 0) AS BIGINT) AS null_keys
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)""")
def composite_pk_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return R.composite_key_report(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1 ORDER BY n DESC, text LIMIT 25")
def duplicate_groups_topn(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicate_groups(table(spark, d, "documents"), ["text"], 25)


_FIELDS = ("doc_id", "text", "lang", "source", "n_chars")


@query(
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) FILTER (WHERE {p}) AS present, count(*) FILTER (WHERE NOT COALESCE({p}, FALSE)) AS missing, count(*) AS total, count(*) FILTER (WHERE {p}) / count(*) AS rate FROM documents"
        for f, p in ((f, f"length(trim({f})) > 0" if f in ("text", "lang", "source") else f"{f} IS NOT NULL") for f in _FIELDS)
    )
)
def field_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Completeness of all fields in one pass."""
    return R.field_completeness(table(spark, d, "documents"), list(_FIELDS))


@query("""
SELECT COALESCE(CAST(l.quality AS VARCHAR), '<NULL>') AS value, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def distribution_null_bucket(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return R.distribution(x, "quality")


@query("""
SELECT l_partkey, owners, CASE WHEN owners > 3 THEN 'suspicious' WHEN owners > 1 THEN 'shared' ELSE 'single' END AS kind FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1)""")
def shared_resource_classification(spark: SparkSession, d: str) -> DataFrame:
    return R.shared_resources(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", 3)


@query("""
SELECT month, n_orders, total, CAST(n_orders - lag(n_orders) OVER (ORDER BY month) AS DOUBLE) AS n_orders_delta, round(total - lag(total) OVER (ORDER BY month), 2) AS total_delta
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)""")
def stage_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Monthly measures and their changes; the window sees months only."""
    x = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return R.with_deltas(x, ["month"], ["n_orders", "total"]).withColumns({"total_delta": F.round("total_delta", 2), "n_orders_delta": F.col("n_orders_delta").cast("double")})


@query("""
WITH p AS (SELECT avg(CASE WHEN length(trim(text)) > 0 THEN 1.0 ELSE 0 END) AS completeness, avg(CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN 1.0 ELSE 0 END) AS valid_types, count(DISTINCT text) / count(*) AS unique_urls FROM documents),
q AS (SELECT count(DISTINCT doc_id) AS n FROM labels), t AS (SELECT count(*) AS n FROM documents)
SELECT round(0.30 * completeness + 0.15 * valid_types + 0.20 * least(1, q.n / t.n) + 0.10 * unique_urls, 6) AS score,
 round((0.30 * completeness + 0.15 * valid_types + 0.20 * least(1, q.n / t.n) + 0.10 * unique_urls) / 0.75, 6) AS renormalised FROM p, q, t""")
def weighted_quality_score(spark: SparkSession, d: str) -> DataFrame:
    """A component score with missing parts: as zeros, and renormalised over the parts that are there."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    one = docs.agg(
        F.avg(R.present(docs, "text").cast("double")).alias("completeness"), F.avg(F.coalesce(F.col("lang").isin("en", "de", "fr", "es"), F.lit(False)).cast("double")).alias("valid_types"),
        (F.count_distinct("text") / F.count("*")).alias("unique_urls"), F.count("*").alias("n"),
    )
    one = one.join(labels.agg(F.count_distinct("doc_id").alias("labelled")), F.lit(True))
    weights = quality.COMPONENTS["document_quality"]
    values = {"completeness": F.col("completeness"), "valid_types": F.col("valid_types"), "parsed": F.col("labelled") / F.col("n"), "unique_urls": F.col("unique_urls")}
    parts = {k: (values.get(k, F.lit(None).cast("double")), w) for k, w in weights.items()}
    return one.select(F.round(quality.weighted_score(parts), 6).alias("score"), F.round(quality.renormalised_score(parts), 6).alias("renormalised"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(l_extendedprice, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST, l_quantity DESC NULLS LAST, l_extendedprice DESC NULLS LAST) AS rn FROM lineitem) WHERE rn = 1""")
def staging_latest_rank(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc_nulls_last(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return R.latest_per_key(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round("l_extendedprice", 2).alias("price"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return etl.upsert_last(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query("""
SELECT user_id, max(event_id) AS event_id, max_by(click, event_id) FILTER (WHERE click IS NOT NULL) AS click, max_by(purchase, event_id) FILTER (WHERE purchase IS NOT NULL) AS purchase
FROM (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN value END AS click, CASE WHEN event_type = 'purchase' THEN value END AS purchase FROM events) GROUP BY user_id""")
def upsert_keep_old(spark: SparkSession, d: str) -> DataFrame:
    """Updates whose nulls keep the old values."""
    of = lambda t: F.when(F.col("event_type") == t, F.col("value")).alias(t)
    return etl.upsert_keep(table(spark, d, "events").select("user_id", "event_id", of("click"), of("purchase")), ["user_id"], "event_id")


@query("SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS brand_key FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)")
def surrogate_keys(spark: SparkSession, d: str) -> DataFrame:
    return etl.surrogate_keys(table(spark, d, "part"), "p_brand", "brand_key")


@query("""
SELECT lang, count(*) AS n, round(avg(length(text)), 4) AS mean_chars, median(length(text)) AS median_chars, min(length(text)) AS least, max(length(text)) AS most FROM documents GROUP BY lang""")
def multi_aggregate_median(spark: SparkSession, d: str) -> DataFrame:
    n = F.char_length("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean_chars"), F.median(n).alias("median_chars"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"))


@query("""
WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_mktsegment < 'F'), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 0)
SELECT COALESCE(c.k, s.k) AS nationkey, CASE WHEN c.k IS NULL THEN 'extra' WHEN s.k IS NULL THEN 'missing' ELSE 'matched' END AS status FROM c FULL JOIN s ON c.k = s.k""")
def set_compare(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment < 'F'").select(F.col("c_nationkey").alias("nationkey"))
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("nationkey"))
    return R.compare_keys(c, s, "nationkey")


@query("""
WITH a AS (SELECT l_suppkey, list_sort(list(DISTINCT l_returnflag) FILTER (WHERE l_linestatus = 'O')) AS e, list_sort(list(DISTINCT l_returnflag) FILTER (WHERE l_quantity > 48)) AS x FROM lineitem GROUP BY l_suppkey),
b AS (SELECT l_suppkey, COALESCE(e, []) AS e, COALESCE(x, []) AS x FROM a)
SELECT l_suppkey, CASE WHEN e = x THEN 'exact' WHEN len(list_intersect(e, x)) > 0 THEN 'partial' ELSE 'none' END AS status,
 array_to_string(list_sort(list_filter(e, lambda v: NOT list_contains(x, v))), ',') AS missing, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(e, v))), ',') AS extra FROM b""")
def credit_set_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two sets of each key: exact, partial or none, and what either lacks."""
    flags = lambda c: R.sorted_set(F.when(c, F.col("l_returnflag")))
    x = table(spark, d, "lineitem").groupBy("l_suppkey").agg(flags(F.col("l_linestatus") == "O").alias("e"), flags(F.col("l_quantity") > 48).alias("x"))
    lack = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return x.select("l_suppkey", R.set_status(F.col("e"), F.col("x")).alias("status"), lack("e", "x").alias("missing"), lack("x", "e").alias("extra"))


@query("""
WITH t AS (SELECT DISTINCT p_partkey, p_brand, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part WHERE p_partkey IS NOT NULL AND p_brand IS NOT NULL AND p_name IS NOT NULL),
c AS (SELECT p_brand, w, min(p_partkey) AS c FROM t GROUP BY p_brand, w)
SELECT p_brand, 'member' AS kind, c AS a, p_partkey AS b, CAST(1 AS DOUBLE) AS similarity FROM t JOIN c USING (p_brand, w) WHERE p_partkey <> c
UNION ALL SELECT x.p_brand, 'classes', x.c, y.c, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w)))::DOUBLE, 6) FROM c x JOIN c y ON x.p_brand = y.p_brand AND x.c < y.c AND list_has_any(x.w, y.w)""")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Token Jaccard of all parts of a brand that share a word, by classes of equal token sets.

    A class is called by its least part. Rows of kind 'member' hold a class (a) and each other part of it (b), those of
    kind 'classes' two classes that share a word: every part of the one has that similarity to every part of the other.
    """
    w = F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " ")))
    t = table(spark, d, "part").select("p_partkey", "p_brand", w.alias("w")).where("p_partkey is not null and p_brand is not null and w is not null").distinct()
    c = persist_shared(t.groupBy("p_brand", "w").agg(F.min("p_partkey").alias("c")), "token-classes")
    members = t.join(c, ["p_brand", "w"]).where("p_partkey <> c").select("p_brand", F.lit("member").alias("kind"), F.col("c").alias("a"), F.col("p_partkey").alias("b"), F.lit(1.0).alias("similarity"))
    e = c.select("c", "p_brand", "w", F.explode("w").alias("k"))
    a, b = e.alias("a"), e.alias("b")
    # two classes of a brand have different sets, though with repeated part keys perhaps one name
    pairs = a.join(b, (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.k") == F.col("b.k")) & (F.struct("a.c", "a.w") < F.struct("b.c", "b.w")))
    home = F.array_min(F.array_intersect("a.w", "b.w")) == F.col("a.k")
    apart = pairs.where(home).select("a.p_brand", F.lit("classes").alias("kind"), F.col("a.c").alias("a"), F.col("b.c").alias("b"), F.round(R.jaccard(F.col("a.w"), F.col("b.w")), 6).alias("similarity"))
    return members.unionByName(apart)


@query("""
WITH a(alias, meant) AS (VALUES ('n1', 'NATION_1'), ('two', 'NATION_2'), ('third', 'NATION_3')),
x AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'n1' WHEN 1 THEN 'TWO' WHEN 2 THEN 'nation_' || (c_custkey % 30) WHEN 3 THEN ' Third ' ELSE 'elsewhere' END AS v FROM customer)
SELECT x.c_custkey, COALESCE(n.n_nationkey, m.n_nationkey, 100) AS n_nationkey, CASE WHEN n.n_nationkey IS NOT NULL THEN 'exact' WHEN m.n_nationkey IS NOT NULL THEN 'alias' ELSE 'default' END AS how
FROM x LEFT JOIN nation n ON lower(trim(n.n_name)) = lower(trim(x.v)) LEFT JOIN a ON a.alias = lower(trim(x.v)) LEFT JOIN nation m ON lower(m.n_name) = lower(a.meant)""")
def alias_lookup_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A dimension key by exact name, alias or default."""
    k = F.col("c_custkey")
    v = F.when(k % 5 == 0, "n1").when(k % 5 == 1, "TWO").when(k % 5 == 2, F.concat(F.lit("nation_"), (k % 30).cast("string"))).when(k % 5 == 3, " Third ").otherwise("elsewhere")
    x = table(spark, d, "customer").select("c_custkey", v.alias("v"))
    return matching.staged_lookup(x, "v", table(spark, d, "nation"), "n_name", "n_nationkey", {"n1": "NATION_1", "two": "NATION_2", "third": "NATION_3"}, 100).drop("v")


@query("""
SELECT o.o_orderkey, s.rule, s.k FROM orders o JOIN (SELECT c_custkey, c_custkey AS k, 'own' AS rule FROM customer WHERE c_acctbal > 9000 UNION SELECT c_nationkey * 100, c_custkey, 'alternative' FROM customer WHERE c_acctbal > 9000) s ON s.c_custkey = o.o_custkey
WHERE NOT (s.rule = 'alternative' AND EXISTS (SELECT 1 FROM customer c WHERE c.c_acctbal > 9000 AND c.c_custkey = o.o_custkey AND c.c_custkey = s.k))""")
def either_key_join(spark: SparkSession, d: str) -> DataFrame:
    """A join on one of two keys, as a union of equal joins; a pair that fits both is kept once."""
    c = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("code"), (F.col("c_nationkey") * 100).cast("long").alias("alternative"), F.col("c_custkey").alias("_r"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("_l"))
    out = R.either_key(o, c, "o_custkey", ["code", "alternative"])
    return out.select("o_orderkey", F.when(F.col("o_custkey") == F.col("code"), "own").otherwise("alternative").alias("rule"), F.col("code").alias("k"))


@query("""
SELECT grouping, value, CAST(sum(total) AS BIGINT) AS total, CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(failed) AS BIGINT) AS failed FROM (
 WITH c AS (SELECT * FROM (VALUES ('price positive', 'orders', 'error', (SELECT bool_and(o_totalprice > 0) FROM orders)), ('known status', 'orders', 'error', (SELECT bool_and(o_orderstatus IN ('F', 'O', 'P')) FROM orders)),
  ('discount range', 'lineitem', 'warning', (SELECT bool_and(l_discount BETWEEN 0 AND 0.1) FROM lineitem)), ('mostly small', 'lineitem', 'info', (SELECT avg(CASE WHEN l_quantity <= 25 THEN 1.0 ELSE 0 END) >= 0.9 FROM lineitem))) t(name, category, severity, ok))
 SELECT 'all' AS grouping, 'all' AS value, 1 AS total, CAST(ok AS INT) AS passed, CAST(NOT ok AS INT) AS failed FROM c UNION ALL SELECT 'category', category, 1, CAST(ok AS INT), CAST(NOT ok AS INT) FROM c UNION ALL SELECT 'severity', severity, 1, CAST(ok AS INT), CAST(NOT ok AS INT) FROM c) GROUP BY ALL""")
def check_summary(spark: SparkSession, d: str) -> DataFrame:
    """Row rules of two tables, one pass each, summed by category and severity."""
    rules = [
        quality.Rule("price positive", "orders", "orders", F.col("o_totalprice") > 0), quality.Rule("known status", "orders", "orders", F.col("o_orderstatus").isin("F", "O", "P")),
        quality.Rule("discount range", "lineitem", "lineitem", F.col("l_discount").between(0, 0.1), "warning"), quality.Rule("mostly small", "lineitem", "lineitem", F.col("l_quantity") <= 25, "info", 0.9),
    ]
    return quality.summary(quality.row_checks({t: table(spark, d, t) for t in ("orders", "lineitem")}, rules))


@query("""
SELECT metric, value, source FROM (SELECT metric, value, source, row_number() OVER (PARTITION BY metric ORDER BY CASE source WHEN 'R' THEN 1 WHEN 'A' THEN 2 WHEN 'N' THEN 3 ELSE 4 END, source) AS rn
 FROM (SELECT l_suppkey AS metric, l_returnflag AS source, round(avg(CASE WHEN l_quantity > 10 THEN l_discount END), 6) AS value FROM lineitem GROUP BY 1, 2) WHERE value IS NOT NULL) WHERE rn = 1""")
def source_priority(spark: SparkSession, d: str) -> DataFrame:
    """Of every metric the value of the preferred source that has one."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("metric"), F.col("l_returnflag").alias("source")).agg(F.round(F.avg(F.when(F.col("l_quantity") > 10, F.col("l_discount"))), 6).alias("value"))
    return quality.prefer(x, ["R", "A", "N"])


@query("""
SELECT o_orderpriority, o_orderkey, round(o_totalprice, 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 10""")
def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rn")).where("rn <= 10").select("o_orderpriority", "o_orderkey", F.round("o_totalprice", 2).alias("total"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paginated(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 25 rows."""
    return R.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 50, 25).select("o_orderkey", F.round("o_totalprice", 2).alias("total"))


@query("""
SELECT s.s_suppkey, count(l.l_suppkey) AS n_lines, count(DISTINCT l.l_orderkey) AS n_orders FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R' AND l.l_quantity > 49 GROUP BY s.s_suppkey""")
def zero_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of an outer join: keys without rows have zeros. The facts are summed before they meet the keys."""
    l = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_lines"), F.count_distinct("l_orderkey").alias("n_orders"))
    return table(spark, d, "supplier").select("s_suppkey").join(l, "s_suppkey", "left").select("s_suppkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("""
WITH x AS (SELECT *, CASE WHEN NOT COALESCE(l_quantity > 0, FALSE) THEN 'quantity' WHEN NOT COALESCE(l_discount <= 0.08, FALSE) THEN 'discount' END AS a, CASE WHEN NOT COALESCE(l_tax <= 0.07, FALSE) THEN 'tax' END AS b FROM lineitem)
SELECT COALESCE(NULLIF(concat_ws(',', a, b), ''), 'valid') AS reasons, count(*) AS n FROM x GROUP BY 1""")
def quarantine_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break rules, counted by the rules they break."""
    good, bad = etl.quarantine(table(spark, d, "lineitem"), {"quantity": F.col("l_quantity") > 0, "discount": F.col("l_discount") <= 0.08, "tax": F.col("l_tax") <= 0.07})
    rows = good.agg(F.count("*").alias("n")).select(F.lit("valid").alias("reasons"), "n")
    return rows.unionByName(bad.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n")))


@query("""
WITH t AS (SELECT 0 AS attempt, c_custkey AS k FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT 1, c_custkey FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT 2, c_custkey FROM customer),
f AS (SELECT k, min(attempt) AS attempt FROM t GROUP BY k), s AS (SELECT attempt, count(*) AS n FROM f GROUP BY attempt)
SELECT f.k, f.attempt FROM f WHERE (SELECT COALESCE(sum(n), 0) FROM s WHERE s.attempt < f.attempt) < 50""")
def staged_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Widening attempts until 50 keys are gathered."""
    c = table(spark, d, "customer")
    tries = [c.where(w).select(F.col("c_custkey").alias("k")) for w in ("c_acctbal > 9900", "c_acctbal > 9500", "true")]
    return R.staged_union(tries, "k", ["k"], 50).select("k", "attempt")
