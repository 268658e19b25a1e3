"""Document, page, retrieval, planning and stream queries on the driver's tables, with SQL twins where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import intent
from lectern.functions import text as T
from lectern.functions import values as V
from lectern.operators import documents as D
from lectern.operators import html as H
from lectern.operators import matching, planning, similarity, vector_cells
from lectern.operators import relational as R
from lectern.operators import retrieval as S
from lectern.operators.graph import connected_components
from lectern.operators.overlap import counted_pairs, overlap_pairs
from lectern.session import table
from lectern.storage import persist_shared, shared_dir
from lectern.streaming import sessions

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


# ---- intervals and plans ----


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 60000000.0 AS s, epoch_us(ts) / 60000000.0 + value AS f FROM events WHERE value > 0)
SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.f AND b.s < a.f""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping events of each user, [ts, ts + value minutes), by bins of an hour."""
    e = _intervals(spark, d)
    return R.binned_overlaps(e, "event_id", ["user_id"], "s", "f", 60.0)


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000.0
    return table(spark, d, "events").where("value > 0").select("user_id", "event_id", start.alias("s"), (start + F.col("value")).alias("f"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) / 60000000.0 AS s, epoch_us(ts) / 60000000.0 + value AS f FROM events WHERE value > 0),
x AS (SELECT user_id, s AS t, 1 AS d FROM e UNION ALL SELECT user_id, f, -1 FROM e)
SELECT user_id, CAST(max(depth) AS BIGINT) AS depth FROM (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS depth FROM x) GROUP BY user_id""")
def overlap_depth(spark: SparkSession, d: str) -> DataFrame:
    """The most events of a user that run at one moment."""
    return planning.overlap_depth(_intervals(spark, d), ["user_id"], "s", "f")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, -l_partkey - 1 AS b FROM lineitem), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, component) USING KEY (id) AS (SELECT DISTINCT a, a FROM s UNION (SELECT s.a, min(n.component) FROM r n JOIN s ON s.b = n.id JOIN recurring.r o ON o.id = s.a WHERE n.component < o.component GROUP BY s.a))
SELECT id, component FROM r""")
def equivalence_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of all orders and parts that lineitems link. Part k stands as -k - 1, apart from order k."""
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("a"), (-F.col("l_partkey").cast("long") - 1).alias("b"))
    return connected_components(e)


def _plan_courses(spark: SparkSession, d: str) -> DataFrame:
    """Orders as courses of their customers' plans: credits by price, type by status, semesters by number, times by key."""
    k = F.col("o_orderkey")
    day = F.element_at(F.array(*[F.lit(x) for x in V.ENGLISH_DAYS]), (k % 5 + 1).cast("int"))
    hour = 8 + k % 9
    times = F.concat(day, F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":15 - "), F.lpad((hour + 2).cast("string"), 2, "0"), F.lit(":00"))
    semesters = F.when(k % 3 == 0, F.array(F.lit("Autumn"))).when(k % 3 == 1, F.array(F.lit("Spring"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("plan"), k.alias("row_no"), k.cast("string").alias("code"), F.concat(F.lit("Course "), (k % 400).cast("string"), F.lit(" "), F.element_at(F.array(F.lit("I"), F.lit("II")), (k % 2 + 1).cast("int"))).alias("name"),
        (3.0 + F.floor(F.col("o_totalprice")) % 4).alias("ects"), F.when(F.col("o_orderstatus") == "F", "Mandatory").otherwise("Elective").alias("course_type"), F.col("o_orderpriority").alias("section"),
        semesters.alias("semester_types"), F.array(F.when(k % 2 == 0, "Deutsch").otherwise("Français")).alias("languages"), F.when(k % 4 < 2, (k % 3 + 1).cast("int")).alias("suggested_year"), times.alias("day_time_info"),
    )


@query(None)
def greedy_slotting(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's orders as a study plan over eight semesters."""
    c = _plan_courses(spark, d).withColumn("group_no", F.col("row_no"))
    return planning.plan_semesters(planning.roll_up(c), 8, 180.0)


@query(None)
def knapsack_plan(spark: SparkSession, d: str) -> DataFrame:
    """For every customer the orders that come nearest to 30 credits without a clash."""
    c = _plan_courses(spark, d)
    c = c.select("plan", "code", "ects", (F.col("course_type") == "Mandatory").alias("mandatory"), F.lit(False).alias("required"), T.time_blocks(F.col("day_time_info")).alias("blocks"))
    return planning.suggest_courses(c)


@query(None)
def equivalent_courses(spark: SparkSession, d: str) -> DataFrame:
    """Courses of every plan that count once, in groups."""
    c = planning.equivalence_groups(_plan_courses(spark, d))
    return c.groupBy("plan", "group_no").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    c = _plan_courses(spark, d)
    return c.select("plan", "code", F.explode(T.time_blocks(F.col("day_time_info"))).alias("b")).select("plan", "code", "b.day", "b.start", "b.end")


@query("""
WITH c AS (SELECT o_custkey AS plan, CAST(o_orderkey AS VARCHAR) AS code, o_orderkey % 5 AS day, (8 + o_orderkey % 9) * 60 + 15 AS s, (10 + o_orderkey % 9) * 60 AS e FROM orders), t AS (SELECT DISTINCT plan, day, s, e FROM c),
g AS (SELECT a.plan, a.day, a.s, max(b.s) AS last FROM t a JOIN t b ON a.plan = b.plan AND a.day = b.day AND b.s >= a.s AND b.s < a.e GROUP BY ALL), k AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.plan = g.plan AND h.day = g.day AND h.s < g.s AND h.last >= g.last)),
r AS (SELECT k.plan, k.day, k.s, count(*) AS n, count(DISTINCT code) AS courses, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM k JOIN c ON c.plan = k.plan AND c.day = k.day AND c.s BETWEEN k.s AND k.last GROUP BY ALL)
SELECT plan, CAST(row_number() OVER (PARTITION BY plan ORDER BY n DESC, ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'][day + 1], s) - 1 AS INTEGER) AS group_no, codes FROM r WHERE courses > 1""")
def conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sets of clashing courses of every plan."""
    return planning.conflict_groups(_blocks(spark, d))


_TIMES = "CASE WHEN o_totalprice >= 300000 THEN concat('Friday ', 8 + o_orderkey % 9, ':15 - ', 10 + o_orderkey % 9, ':00, Raum A', o_custkey % 50, '; Monday 13:15 - 15:00') WHEN o_totalprice >= 200000 THEN concat('nach Absprache, Hörsaal ', o_custkey % 7) END"
_OFFERED = "o_orderpriority <> '5-LOW'"
_KIND = "CASE WHEN o_orderstatus = 'P' THEN 'Block' ELSE 'Weekly' END"


@query(f"""
WITH o AS (SELECT o_custkey AS plan, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, CAST(o_orderkey AS VARCHAR) AS code, {_OFFERED} AS offered, {_KIND} AS kind, {_TIMES} AS info, o_orderkey % 9 AS h, o_custkey FROM orders),
w AS (SELECT *, CASE WHEN NOT offered THEN 'name' WHEN contains(info, 'Friday') THEN 'text' WHEN kind = 'Block' THEN 'block' ELSE 'placed' END AS how, 480 + place // 5 * 120 + CASE WHEN NOT offered AND place % 2 = 1 THEN 60 ELSE 0 END AS b FROM o)
SELECT plan, place, code, 'Friday' AS day, CAST((8 + h) * 60 + 15 AS INTEGER) AS start, CAST((10 + h) * 60 AS INTEGER) AS end, 'Raum A' || o_custkey % 50 AS location, how FROM w WHERE how = 'text' UNION ALL SELECT plan, place, code, 'Monday', 795, 900, 'Raum A' || o_custkey % 50, how FROM w WHERE how = 'text'
UNION ALL SELECT plan, place, code, 'Monday', 0, 0, 'Blockkurs', how FROM w WHERE how = 'block'
UNION ALL SELECT plan, place, code, ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'][place % 5 + 1], CAST(b AS INTEGER), CAST(b + 120 AS INTEGER), CASE WHEN how = 'placed' AND contains(info, 'Hörsaal') THEN 'Hörsaal ' || o_custkey % 7 ELSE 'Raum ' || (100 + place) END, how FROM w WHERE how IN ('placed', 'name')""")
def plan_timetables(spark: SparkSession, d: str) -> DataFrame:
    """Every plan's courses in its week: by the times of their texts, as block courses, or by their place in the plan."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("plan"), place.cast("long").alias("place"), F.col("o_orderkey").cast("string").alias("code"), F.expr(_OFFERED).alias("offered"), F.expr(_KIND).alias("offering_type"), F.expr(_TIMES).alias("day_time_info"))
    return planning.plan_timetable(o)


@query("""
WITH c AS (SELECT o_custkey AS plan, CAST(o_orderkey AS VARCHAR) AS code, o_orderkey % 5 AS day, (8 + o_orderkey % 9) * 60 + 15 AS s, (10 + o_orderkey % 9) * 60 AS e FROM orders)
SELECT a.plan, a.code AS a, b.code AS b FROM c a JOIN c b ON a.plan = b.plan AND a.day = b.day AND a.code < b.code AND a.s < b.e AND b.s < a.e""")
def schedule_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a plan's courses whose weekly blocks, read from free text, overlap."""
    return _clashes(_blocks(spark, d))


def _clashes(b: DataFrame) -> DataFrame:
    x = R.overlapping(b, b, "day", "start", "end").where("l.plan = r.plan and l.code < r.code")
    return x.select("l.plan", F.col("l.code").alias("a"), F.col("r.code").alias("b"))


@query("""
WITH RECURSIVE c AS (SELECT o_custkey AS plan, CAST(o_orderkey AS VARCHAR) AS code, ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'][o_orderkey % 5 + 1] AS day, CAST((8 + o_orderkey % 9) * 60 + 15 AS INTEGER) AS s, CAST((10 + o_orderkey % 9) * 60 AS INTEGER) AS e FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY plan, day ORDER BY s, e, code) AS rn FROM c),
l AS (SELECT DISTINCT plan, day, NULL::VARCHAR AS code, NULL::INTEGER AS s, NULL::INTEGER AS e, 0::BIGINT AS rn, []::INTEGER[] AS ends, NULL::BIGINT AS lane FROM c
 UNION ALL SELECT plan, day, code, s, e, rn, CASE WHEN k = 0 THEN list_append(ends, e) ELSE list_concat(list_append(ends[1:k - 1], e), ends[k + 1:]) END, CASE WHEN k = 0 THEN len(ends) ELSE k - 1 END
 FROM (SELECT r.*, l.ends, COALESCE(list_position(list_transform(l.ends, lambda x: x <= r.s), true), 0) AS k FROM l JOIN r ON r.plan = l.plan AND r.day = l.day AND r.rn = l.rn + 1))
SELECT plan, day, code, s AS start, e AS end, CAST(lane AS INTEGER) AS lane FROM l WHERE rn > 0""")
def timetable_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Every block's first free lane."""
    return planning.lanes(_blocks(spark, d))


# ---- streams' batch twins ----


@query("""
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1, 2""")
def time_bucket_latency(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling hours by type."""
    return sessions.latency_windows(table(spark, d, "events")).withColumns({"mean": F.round("mean", 6), "window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")})


@query("""
SELECT conv_id AS session_id, count(*) AS turns, max_by(text, turn) FILTER (WHERE role = 'user') AS last_user, max_by(text, turn) FILTER (WHERE role = 'assistant') AS last_assistant FROM conversations GROUP BY conv_id""")
def session_fold(spark: SparkSession, d: str) -> DataFrame:
    return sessions.fold_sessions(table(spark, d, "conversations").withColumnRenamed("conv_id", "session_id"))


@query("""
WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM x) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS visit_start, count(*) AS n FROM y GROUP BY user_id, g""")
def visit_windows(spark: SparkSession, d: str) -> DataFrame:
    """Visits that end after six hours without events."""
    return sessions.visits(table(spark, d, "events"), "6 hours").withColumn("visit_start", F.date_format("visit_start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


# ---- texts ----

_STORE_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(q, '{w}')''' for w in ws)} THEN '{s}'" for s, ws in intent.STORES) + " ELSE 'studyplans' END"
_LANG_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(q, '{w}')''' for w in ws)} THEN '{s}'" for s, ws in intent.QUESTION_LANGUAGES) + " ELSE 'en' END"


@query(f"SELECT conv_id, turn, {_STORE_SQL} AS store, {_LANG_SQL} AS language FROM (SELECT conv_id, turn, lower(text) AS q FROM conversations)")
def intent_routing(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", intent.store(c).alias("store"), intent.question_language(c).alias("language"))


@query("""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?')) AS INTEGER) AS n_numbers, COALESCE(array_to_string(list_distinct_ordered, ','), '') AS versions
FROM (SELECT doc_id, text, list_transform(list_filter(list_zip(v, range(1, len(v) + 1)), lambda z: list_position(v, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_ordered FROM
 (SELECT doc_id, text, regexp_extract_all(text, '(?i)(?:version|license|by-nc) ([0-9]+(?:[.][0-9]+)?)', 1) AS v FROM documents))""")
def credit_number_extract(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with a word of their kind before them, in order, each once."""
    v = F.array_distinct(F.regexp_extract_all("text", F.lit("(?i)(?:version|license|by-nc) ([0-9]+(?:[.][0-9]+)?)"), F.lit(1)))
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[0-9]+(?:[.][0-9]+)?")).alias("n_numbers"), F.array_join(v, ",").alias("versions"))


@query(rf"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(replace(translate(lower(text), '{T._ACCENTED}', '{T._PLAIN}'), '&', ' and '), '[’''`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents""")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """The matching form of every text, as a hash."""
    return table(spark, d, "documents").select("doc_id", F.sha2(T.normalize_match(F.col("text")).cast("binary"), 256).alias("digest"))


@query("""
SELECT doc_id, CASE WHEN c < 200 OR w < 30 THEN 'very_low' WHEN c < 1000 OR w < 150 THEN 'low' WHEN c < 5000 OR w < 700 THEN 'medium' ELSE 'high' END AS bucket, CAST(w AS INTEGER) AS n_words
FROM (SELECT doc_id, length(text) AS c, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS w FROM documents)""".replace("\\\\", "\\"))
def text_quality_bucket(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_count("text", F.lit(r"[^ \t\n\r]+"))
    return table(spark, d, "documents").select("doc_id", T.quality_bucket(F.char_length("text"), words).alias("bucket"), words.alias("n_words"))


@query("""
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, substr(text, CAST(chunk_no * 1050 + 1 AS BIGINT), 1200) AS text
FROM (SELECT doc_id, text, unnest(range(0, 1 + CAST(greatest(0, ceil((length(text) - 1200) / 1050.0)) AS BIGINT))) AS chunk_no FROM documents WHERE length(text) > 0)""")
def fixed_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 1200 characters that overlap by 150."""
    return D.fixed_windows(table(spark, d, "documents"))


@query(None)
def paragraph_pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of whole blocks within sections."""
    return D.chunk(table(spark, d, "documents"), "semantic").select("doc_key", "chunk_no", "text", "contains_table")


@query(None)
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.chunk(table(spark, d, "documents"), "sections").select("doc_key", "chunk_no", "text", "section")


@query(None)
def parent_child_chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.chunk(table(spark, d, "documents"), "parent_child").select("doc_key", "chunk_no", "parent_no", "text")


@query(None)
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.chunk(table(spark, d, "documents"), "recursive").select("doc_key", "chunk_no", "text")


@query("""
WITH c AS (SELECT doc_id, chunk_no, substr(text, CAST(chunk_no * 1050 + 1 AS BIGINT), 1200) AS text FROM (SELECT doc_id, text, unnest(range(0, 1 + CAST(greatest(0, ceil((length(text) - 1200) / 1050.0)) AS BIGINT))) AS chunk_no FROM documents WHERE length(text) > 0)),
n AS (SELECT *, CAST(doc_id AS VARCHAR) || '::fixed::chunk::' || lpad(CAST(chunk_no AS VARCHAR), 4, '0') AS chunk_id FROM c)
SELECT chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id, right(lag(text) OVER w, 180) AS tail FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no)""")
def chunk_prev_next(spark: SparkSession, d: str) -> DataFrame:
    """Ids of neighbouring chunks and the tail of the one before."""
    c = D.fixed_windows(table(spark, d, "documents")).withColumn("doc_key", F.col("doc_id").cast("string"))
    tail = F.right(F.lag("text").over(Window.partitionBy("doc_key").orderBy("chunk_no")), F.lit(180))
    return D.chunk_ids(c.withColumn("tail", tail), "fixed").select("chunk_id", "prev_chunk_id", "next_chunk_id", "tail")


# ---- pages ----


@query("""
SELECT page_id, regexp_replace(concat(lower(regexp_replace(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1), '://www[.]', '://')), regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')), '/+$', '') AS url,
 COALESCE(NULLIF(regexp_extract(lower(url), '/(en|fr|de|it)(?:/|$)', 1), ''), '-') AS language FROM (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS u FROM pages)""")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.url_canonical(u).alias("url"), F.coalesce(H.url_language(u), F.lit("-")).alias("language"))


@query(r"""
WITH l AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', 2)) AS label FROM pages),
a AS (SELECT page_id, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href[1] = '/' THEN regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href ELSE 'other' END AS url, trim(regexp_replace(regexp_replace(label, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM l)
SELECT DISTINCT page_id, url, text, CASE WHEN regexp_matches(s, '[.]pdf') THEN 'pdf' WHEN regexp_matches(s, 'contact|office|service|support|help|beratung') THEN 'support_or_contact' WHEN regexp_matches(s, 'sport|culture|association|student|activity|event') THEN 'social_or_activity'
 WHEN regexp_matches(s, 'housing|accommodation|living|restaurant|library|infrastructure') THEN 'campus_life_resource' ELSE 'reference' END AS kind FROM (SELECT *, lower(text || ' ' || url) AS s FROM a)""")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    """Links of every page, absolute, with their kind."""
    return H.links(table(spark, d, "pages")).select("page_id", "url", "text", H.link_kind(F.col("text"), F.col("url")).alias("kind"))


@query(None)
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections below the headings of every page."""
    return H.sections(table(spark, d, "pages"))


@query("""
WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), e AS (SELECT DISTINCT a.page_id AS source, b.page_id AS target FROM h a JOIN h b ON b.page_id = a.page_id + 1 OR b.page_id = a.page_id * 2 + 1),
l1 AS (SELECT DISTINCT target FROM e WHERE source = 0), l2 AS (SELECT DISTINCT e.target FROM e JOIN l1 ON e.source = l1.target)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT 0 AS url, 0 AS depth UNION ALL SELECT target, 1 FROM l1 UNION ALL SELECT target, 2 FROM l2) GROUP BY url""")
def link_traversal(spark: SparkSession, d: str) -> DataFrame:
    """Pages within two links of the first one."""
    p = table(spark, d, "pages").select("page_id")
    out = p.select(F.col("page_id").alias("source"), F.explode(F.array(F.col("page_id") + 1, F.col("page_id") * 2 + 1)).alias("target")).join(p.select(F.col("page_id").alias("target")), "target", "left_semi")
    return H.reachable(p.where("page_id = 0").select(F.col("page_id").alias("url")), out, 2)


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS source, p_partkey + 3 AS target FROM part WHERE p_size % 2 = 0 UNION SELECT p_partkey, p_partkey * 2 + 1 FROM part WHERE p_size % 3 = 0 UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_size % 5 <> 0), k AS (SELECT e.* FROM e JOIN part ON p_partkey = target),
r(url, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT k.target, depth + 1 FROM r JOIN k ON k.source = r.url WHERE depth < 20)
SELECT url, min(depth) AS depth FROM r GROUP BY url""")
def link_depths(spark: SparkSession, d: str) -> DataFrame:
    """Parts within twenty links of the first one."""
    p, k = table(spark, d, "part").select("p_partkey", "p_size"), F.col("p_partkey")
    targets = F.array(F.when(F.col("p_size") % 2 == 0, k + 3), F.when(F.col("p_size") % 3 == 0, k * 2 + 1), F.when(F.col("p_size") % 5 != 0, k + 1))
    links = p.select(k.alias("source"), F.explode(F.array_compact(targets)).alias("target")).join(p.select(k.alias("target")), "target", "left_semi")
    return H.reachable(p.where("p_partkey = 0").select(k.alias("url")), links, 20)


# ---- retrieval ----

_SIM = "round(sqrt(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 6)"
_HITS = f"""hits AS (SELECT query_id, vec_id, distance, rank, label, query_label FROM (SELECT q.vec_id AS query_id, v.vec_id, {_SIM} AS distance, v.label, q.label AS query_label,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM}, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 8)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the stated set of ids divisible by 100, against all vectors."""
    e = table(spark, d, "embeddings")
    return S.knn(e.where("vec_id % 100 = 0"), e, 8, "l2", 6)


@query(f"WITH {_HITS} SELECT query_id, vec_id, distance, CAST(rank AS INTEGER) AS rank FROM hits")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """The eight nearest vectors of every query."""
    return _hits(spark, d)


@query(f"WITH {_HITS} SELECT query_id, vec_id, distance, CAST(rank AS INTEGER) AS rank FROM hits")
def stored_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The eight nearest vectors of every query, from vectors stored in trained cells."""
    e, at = table(spark, d, "embeddings"), f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    vector_cells.write_cells(e, at, 64)
    return vector_cells.nearest_in_cells(spark, at, e.where("vec_id % 100 = 0"), 8, 6).drop("cells_read")


@query(f"""WITH {_HITS} SELECT query_id, max(CASE WHEN label = query_label AND rank <= 1 THEN 1 ELSE 0 END) AS recall_1, max(CASE WHEN label = query_label AND rank <= 3 THEN 1 ELSE 0 END) AS recall_3, max(CASE WHEN label = query_label AND rank <= 5 THEN 1 ELSE 0 END) AS recall_5,
 sum(CASE WHEN label = query_label AND rank <= 5 THEN 1 ELSE 0 END) / 5.0 AS precision_5, round(COALESCE(1.0 / min(CASE WHEN label = query_label THEN rank END), 0), 6) AS reciprocal_rank FROM hits GROUP BY query_id""")
def knn_label_eval(spark: SparkSession, d: str) -> DataFrame:
    """Rank metrics of the neighbours, relevant if they share the query's label."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    h = _hits(spark, d).join(e, "vec_id").join(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    m = S.rank_metrics(h.withColumn("relevant", F.col("label") == F.col("wanted")), ["query_id"])
    return m.withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query("""
WITH q AS (SELECT string_split('the of and in to that', ' ') AS w), s AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 100 ELSE 0 END + CASE WHEN source = 'src3' THEN 20 ELSE 0 END + CASE WHEN n_chars > 2000 THEN 10 ELSE 0 END
 + 2.0 * len(list_intersect(q.w, list_distinct(string_split(lower(text), ' ')))) AS score FROM documents, q)
SELECT doc_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 20""")
def rule_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Documents by additive rules; the best 20."""
    words = F.array(*[F.lit(w) for w in "the of and in to that".split()])
    shared = F.size(F.array_intersect(words, F.split(F.lower("text"), " ")))
    flags = {"program": F.col("lang") == "en", "degree": F.col("source") == "src3", "ects": F.col("n_chars") > 2000}
    top = table(spark, d, "documents").select("doc_id", S.rule_score(flags, shared).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)
    return S.top_k(top, "score", 20, [], ["doc_id"]).select("doc_id", "score", "rank")


@query("""
WITH r AS (SELECT 0 AS run_no, doc_id AS chunk_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en' QUALIFY rank <= 30
 UNION ALL SELECT 1, doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE source = 'src1' QUALIFY rank <= 30 UNION ALL SELECT 2, doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 30),
f AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY run_no, rank) AS seen FROM r)
SELECT chunk_id, CAST(merged_rank AS INTEGER) AS merged_rank FROM (SELECT chunk_id, row_number() OVER (ORDER BY run_no, rank, chunk_id) AS merged_rank FROM f WHERE seen = 1) WHERE merged_rank <= 50""")
def multi_query_merge(spark: SparkSession, d: str) -> DataFrame:
    """Three runs merged, first occurrences first."""
    docs = table(spark, d, "documents")
    runs = None
    for i, where in enumerate(("lang = 'en'", "source = 'src1'", "true")):
        top = docs.where(where).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(30)
        one = S.top_k(top, "n_chars", 30, [], ["doc_id"]).select(F.lit(i).alias("run_no"), F.lit(0).alias("g"), F.col("doc_id").alias("chunk_id"), "rank")
        runs = one if runs is None else runs.unionByName(one)
    return S.merge_runs(runs, 50, ["g"]).select("chunk_id", "merged_rank")


@query("""
WITH b AS (SELECT item_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: length(x) >= 6)) AS w FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: length(x) >= 6)) AS w FROM documents),
s AS (SELECT d.doc_id, b.item_id, len(list_intersect(b.w, d.w)) AS n, len(list_intersect(b.w, d.w)) / len(b.w) AS ratio FROM d JOIN b ON len(list_intersect(b.w, d.w)) >= 2),
p AS (SELECT doc_id, item_id, CASE WHEN ratio >= 0.95 THEN 8 WHEN ratio >= 0.6 THEN 6 ELSE 4 END AS score FROM s)
SELECT doc_id, item_id, CAST(score AS INTEGER) AS score FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM p) WHERE score >= best - 1""".replace("\\\\", "\\"))
def near_duplicate_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents scored against short texts by shared long words; ties within a point of the best stay."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "), " "), lambda x: F.length(x) >= 6))
    b, x = table(spark, d, "benchmark").select("item_id", words.alias("w")), table(spark, d, "documents").select("doc_id", words.alias("w"))
    left = persist_shared(x.select(F.col("doc_id").alias("left_id"), F.col("w").alias("words")), "long-words")
    right = b.select(F.col("item_id").alias("right_id"), F.col("w").alias("words"))
    size = right.select("right_id", F.size("words").alias("size"))
    # six tenths of the words and more score 6 or 8; a document with such a match keeps none that has less
    strong = overlap_pairs(left, right, F.floor((6 * F.col("size") + 9) / 10), least=2)
    strong = persist_shared(R.lookup(strong, size, "right_id", "inner").withColumn("score", F.when(F.col("shared") / F.col("size") >= 0.95, 8).otherwise(6)), "strong-matches")
    best = strong.groupBy("left_id").agg(F.max("score").alias("best"))
    near = strong.join(best, "left_id").where("score >= best - 1").select("left_id", "right_id", "score")
    weak = counted_pairs(left.join(best, "left_id", "left_anti"), right, 2).select("left_id", "right_id", F.lit(4).alias("score"))
    return near.unionByName(weak).select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"), "score")


@query(None)
def similar_part_names(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of different names and types of parts whose matching-blocks ratio is 0.85 or more."""
    names = table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"))
    return similarity.similar_names(names, names, 0.85).where("a < b").select("a", "b", F.round("ratio", 6).alias("ratio"))


@query(r"""
WITH t AS (SELECT conv_id, turn, role, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: length(x) >= 3)) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(len(list_intersect(a.w, b.w)) / NULLIF(len(a.w), 0), 6) AS overlap FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'""")
def answer_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Share of a question's words that the answer takes up."""
    c = table(spark, d, "conversations")
    plain = F.regexp_replace("text", r"[^\p{L}\p{N}]+", " ")
    a = c.where("role = 'user'").select("conv_id", "turn", plain.alias("q"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), plain.alias("a"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(S.answer_overlap(F.col("q"), F.col("a")), 6).alias("overlap"))


@query(r"""
WITH p AS (SELECT p_partkey, p_brand, p_size, [p_name, p_name || ' ' || lower(p_type)] AS names, string_split(p_name, ' ') AS words, p_type FROM part),
b AS (SELECT d.p_partkey * 10 AS document_index, p.p_partkey AS programme_index, d.p_size = p.p_size AS agrees,
 list_max(list_transform(p.names, lambda n: struct_pack(ratio := len(list_intersect(list_distinct(string_split(n, ' ')), d.words)) / len(list_distinct(string_split(n, ' '))), overlap := len(list_intersect(list_distinct(string_split(n, ' ')), d.words))))) AS best
 FROM p AS d JOIN p ON d.p_brand = p.p_brand AND list_has_any(d.words, p.words)),
s AS (SELECT document_index, programme_index, agrees, best.ratio AS ratio, CASE WHEN best.ratio >= 0.95 THEN 'exact_or_near_name' WHEN best.ratio >= 0.6 AND best.overlap >= 2 THEN 'strong_name_overlap' WHEN best.overlap >= 2 THEN 'medium_name_overlap' ELSE 'weak_name_overlap' END AS how,
 3 + CASE WHEN agrees THEN 5 ELSE -4 END + CASE how WHEN 'exact_or_near_name' THEN 8 WHEN 'strong_name_overlap' THEN 6 WHEN 'medium_name_overlap' THEN 4 ELSE 2 END AS score FROM b),
k AS (SELECT *, bool_or(agrees) OVER (PARTITION BY document_index) AS explicit FROM s WHERE score >= 9 AND how <> 'weak_name_overlap' AND (agrees OR ratio >= 0.95)),
n AS (SELECT *, max(CASE WHEN agrees OR NOT explicit THEN score END) OVER (PARTITION BY document_index) AS best FROM k)
SELECT document_index, programme_index, CAST(score AS INTEGER) AS score, 'faculty,' || CASE WHEN agrees THEN 'ects,' ELSE 'ects_conflict,' END || how AS reasons FROM n WHERE agrees AND score >= best - 2""")
def document_matching(spark: SparkSession, d: str) -> DataFrame:
    """All parts, as documents, matched to all parts, as programmes: additive scores, vetoes, near-best ties."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("programme_index"), F.array("p_name", F.concat_ws(" ", "p_name", "p_type")).alias("names"), F.col("p_brand").alias("faculty"), F.lit(None).cast("string").alias("level"), F.col("p_size").alias("ects"), F.array("p_type").alias("urls"))
    o = table(spark, d, "part").select((F.col("p_partkey") * 10).alias("document_index"), F.concat_ws(" ", F.lit("studienplan"), "p_name").alias("text"), F.lit("plan").alias("label"), F.col("p_brand").alias("faculty"), F.lit(None).cast("string").alias("level"), F.array("p_size").alias("ects_values"), F.array().cast("array<string>").alias("urls"))
    return matching.match_documents(p, o).select("document_index", "programme_index", "score", F.array_join("reasons", ",").alias("reasons"))
