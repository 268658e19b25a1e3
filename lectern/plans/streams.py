"""Streamed queries: dialogues over conversations, and tables that grow by committed batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import table
from lectern.sources import store
from lectern.storage import shared_dir
from lectern.streaming import dialogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table, one file or a folder of them, as a stream of its files. What is there is one batch, so that neither the number of files nor their order counts."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}[.]parquet")


def run_out(stream: DataFrame, at: str, **options: str) -> DataFrame:
    """All that a stream has now, written to a table in the folder ``at``."""
    w = stream.writeStream.format("parquet").options(path=f"{at}/rows", checkpointLocation=f"{at}/checkpoint", **options)
    w.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


@query(r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, length(text) % 6 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, turn * 10 + (turn // 4) * 15 AS ts FROM conversations WHERE role = 'user'),
u AS (SELECT conv_id, turn, rn, ts, k, CASE k WHEN 0 THEN 'plan_mobility' WHEN 1 THEN 'plan_study_program' END AS command, CASE WHEN k = 2 THEN ['FS-20' || (10 + n % 30)] ELSE [] END AS sems, CASE k WHEN 2 THEN 'topic' || (n % 7) WHEN 3 THEN (n % 20) || ' semesters' WHEN 4 THEN 'NATION_' || (n % 25) WHEN 5 THEN 'show more' END AS rest,
 CASE k WHEN 2 THEN 2010 + n % 30 WHEN 3 THEN n % 20 END AS num, CASE WHEN k = 3 AND n % 20 BETWEEN 1 AND 16 THEN n % 20 END AS cnt, CASE WHEN k = 3 AND n % 20 BETWEEN 1 AND 16 THEN '' ELSE 'x' END AS q,
 CASE WHEN k = 4 THEN (SELECT list(n_nationkey::BIGINT ORDER BY n_nationkey) FROM nation WHERE contains(n_name, 'NATION_' || (n % 25))) END AS progs FROM t),
s AS (SELECT conv_id, 0::BIGINT AS rn, -1::BIGINT AS turn, 0::BIGINT AS ts, NULL::VARCHAR AS flow, NULL::VARCHAR AS said_flow, NULL::VARCHAR AS action, NULL::VARCHAR AS step, NULL::BIGINT AS prog, NULL::BIGINT AS cnt, []::BIGINT[] AS offered, []::VARCHAR[] AS sems, NULL::VARCHAR AS interest, NULL::BIGINT AS shown FROM t WHERE rn = 1
 UNION ALL SELECT conv_id, rn, turn, ts, CASE WHEN action = 'mobility' THEN NULL ELSE flow END, flow, action, CASE WHEN action = 'plan' THEN 'electives' ELSE step END, prog, cnt, CASE WHEN action = 'choose_program' THEN progs[1:8] WHEN action = 'plan' THEN [] ELSE offered END, sems, interest,
 CASE action WHEN 'more' THEN shown + 25 WHEN 'mobility' THEN 25 ELSE shown END FROM (
  SELECT *, CASE WHEN more THEN 'more' WHEN command IS NOT NULL THEN 'intro' WHEN flow = 'plan_mobility' THEN CASE WHEN len(sems) = 0 THEN 'ask_semester' WHEN interest IS NULL THEN 'ask_interest' ELSE 'mobility' END
   WHEN flow = 'plan_study_program' THEN CASE WHEN wrong THEN 'unknown_id' WHEN prog IS NOT NULL THEN CASE WHEN cnt IS NULL THEN 'ask_count' WHEN step = 'electives' THEN 'ask_electives' ELSE 'plan' END WHEN q = '' THEN 'ask_program' WHEN progs IS NULL THEN 'unknown_program' ELSE 'choose_program' END ELSE 'question' END AS action
  FROM (SELECT * REPLACE (CASE WHEN choosing AND list_contains(offered, num) THEN num WHEN studies AND prog IS NULL AND NOT wrong AND len(progs) = 1 THEN progs[1] ELSE prog END AS prog) FROM (
   SELECT *, choosing AND NOT list_contains(offered, num) AS wrong FROM (
    SELECT conv_id, rn, turn, ts, k, command, q, num, progs, flow, more, step, prog, shown, offered, studies, studies AND len(offered) > 0 AND prog IS NULL AND num IS NOT NULL AS choosing,
     CASE WHEN flow = 'plan_mobility' AND plain THEN CASE WHEN len(own) = 0 OR list_contains(sems, own[1]) THEN sems ELSE list_concat(sems, own)[1:2] END ELSE sems END AS sems, CASE WHEN flow = 'plan_mobility' AND plain THEN rest ELSE interest END AS interest,
     CASE WHEN studies AND (k = 3 OR len(offered) = 0 OR prog IS NOT NULL) THEN COALESCE(said_cnt, cnt) ELSE cnt END AS cnt
    FROM (SELECT *, NOT more AND command IS NULL AS plain, NOT more AND command IS NULL AND flow = 'plan_study_program' AS studies FROM (
     SELECT conv_id, rn, turn, ts, k, q, num, progs, rest, own, said_cnt, more, command, CASE WHEN starts THEN command ELSE flow END AS flow, CASE WHEN NOT starts THEN step END AS step, CASE WHEN NOT starts THEN prog END AS prog, CASE WHEN NOT starts THEN cnt END AS cnt,
      CASE WHEN starts THEN [] ELSE offered END AS offered, CASE WHEN starts THEN [] ELSE sems END AS sems, CASE WHEN NOT starts THEN interest END AS interest, shown FROM (SELECT *, NOT more AND command IS NOT NULL AS starts FROM (
      SELECT s.conv_id, u.rn, u.turn, u.ts, u.k, u.q, u.num, u.progs, u.rest, u.sems AS own, u.cnt AS said_cnt, u.command, NOT late AND s.shown IS NOT NULL AND u.k = 5 AS more, CASE WHEN NOT late THEN flow END AS flow, CASE WHEN NOT late THEN step END AS step, CASE WHEN NOT late THEN prog END AS prog,
       CASE WHEN NOT late THEN s.cnt END AS cnt, CASE WHEN late THEN [] ELSE offered END AS offered, CASE WHEN late THEN [] ELSE s.sems END AS sems, CASE WHEN NOT late THEN interest END AS interest, CASE WHEN NOT late THEN shown END AS shown
      FROM (SELECT s.*, s.turn >= 0 AND u.ts - s.ts > 30 AS late, u.rn AS nx FROM s JOIN u ON u.conv_id = s.conv_id AND u.rn = s.rn + 1) s JOIN u ON u.conv_id = s.conv_id AND u.rn = s.nx)))))))))
SELECT conv_id AS session_id, turn, said_flow AS flow, action, COALESCE(prog, -1) AS program_id, array_to_string(sems, ',') AS semesters, CAST(COALESCE(cnt, -1) AS INTEGER) AS count, interest, CAST(COALESCE(shown, -1) AS INTEGER) AS shown FROM s WHERE rn > 0""")
def slot_dialogues(spark: SparkSession, d: str) -> DataFrame:
    """What every user turn of the conversations leads to, as a stream: turns are commands, semesters, numbers, names or words by the length of their text."""
    dialogue.stateful(spark)
    c, n = stream_of(spark, d, "conversations"), F.char_length("text")
    s = lambda x: x.cast("string")
    said = F.element_at(
        F.array(
            F.lit("__hero__:plan_mobility"), F.lit("__hero__:plan_study_program"), F.concat(F.lit("topic"), s(n % 7), F.lit(" FS-20"), s(n % 30 + 10)), F.concat(s(n % 20), F.lit(" semesters")),
            F.concat(F.lit("NATION_"), s(n % 25)), F.lit("show more"),
        ), (n % 6 + 1).cast("int"),
    )
    minutes = F.col("turn") * 10 + F.floor(F.col("turn") / 4) * 15
    turns = c.select(F.col("conv_id").alias("session_id"), "turn", F.timestamp_seconds(F.lit(1_704_067_200) + minutes * 60).alias("ts"), "role", said.alias("text"))
    catalog = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("program_id"), F.col("n_name").alias("name"))
    done = run_out(dialogue.stream_dialogues(turns, catalog, late="1000 days"), f"{shared_dir(spark)}/dialogues-{uuid.uuid4().hex}")
    none = lambda c: F.coalesce(F.col(c), F.lit(-1).cast(done.schema[c].dataType)).alias(c)
    return done.select("session_id", "turn", "flow", "action", none("program_id"), F.array_join("semesters", ",").alias("semesters"), none("count"), "interest", none("shown"))


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 * o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders
 WHERE o_totalprice >= 20000 AND (o_custkey % 10 <> 3 OR o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT')""")
def stored_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders in a stored table after a load that is sent twice, changed rows, deleted keys, one part's rows replaced at once, and a compaction."""
    o = table(spark, d, "orders")
    rows = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    t = store.StoredTable(spark, f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}", rows.schema, ["o_orderkey"], buckets=16)
    for _ in range(2):
        t.insert_new(rows, writer="load", batch=0)
    t.upsert(o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"), (2 * F.col("o_totalprice")).alias("o_totalprice")))
    t.delete(o.where("o_totalprice < 20000"))
    part = F.col("o_custkey") % 10 == 3
    t.replace(part, rows.where(part & (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") >= 20000)).join(o.where("o_orderpriority = '1-URGENT'").select("o_orderkey"), "o_orderkey", "left_anti"))
    t.compact()
    return t.read()


@query("SELECT DISTINCT user_id, event_type FROM events")
def ingested_once(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a stream of events, each inserted once; the stream is started again from nothing, and its batches are known."""
    rows = stream_of(spark, d, "events").select("user_id", "event_type")
    at = f"{shared_dir(spark)}/ingested-{uuid.uuid4().hex}"
    t = store.StoredTable(spark, f"{at}/table", rows.schema, ["user_id", "event_type"], buckets=8)
    for k in range(2):
        t.ingest(rows, f"{at}/checkpoint-{k}", "events").awaitTermination()
    return t.read()
