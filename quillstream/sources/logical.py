"""Logical tables of the pipeline over the star-schema test tables, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text

def read(spark: SparkSession, sf_dir: str, name: str, where: str = "true") -> DataFrame:
    """A test table; `where` is a condition on its own columns, for keys that a logical table builds from them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").where(where)


def raw_messages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").selectExpr("doc_id", "source AS channel_id", "cast(doc_id AS string) AS id", "concat('tg:', source, ':post:', doc_id) AS source_ref", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id AS int), 0) AS date", "text", "lang")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if it has fewer partitions than there are cores; a larger table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cleaned_messages(spark: SparkSession, d: str) -> DataFrame:
    """raw_messages with the clean text `c` and `low`, its lower-case form: columns that the text functions share."""
    return spread(raw_messages(spark, d)).withColumn("c", text.clean_text(F.col("text"))).withColumn("low", F.lower("c"))


def thread_messages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").selectExpr("conv_id * 1000 + turn AS id", "conv_id * 1000 AS thread_id", "CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id", "CASE WHEN turn = 0 THEN 'post' ELSE 'comment' END AS message_type", "text")


def processed_refs(spark: SparkSession, d: str) -> DataFrame:
    return raw_messages(spark, d).where("doc_id % 4 <> 0").select("doc_id", "channel_id", "source_ref", "date")


def failures(spark: SparkSession, d: str) -> DataFrame:
    return raw_messages(spark, d).where("doc_id % 10 = 0").selectExpr("doc_id", "channel_id", "source_ref", "doc_id % 3 + 1 AS attempts", "date AS last_attempt_at")


def sources(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return read(spark, d, "nation", where).selectExpr("concat('src', n_nationkey) AS channel_id", "concat('source_', n_nationkey) AS source_id", "CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) END AS username", "CASE WHEN n_regionkey = 0 THEN 'error' WHEN n_regionkey = 1 THEN 'paused' ELSE 'active' END AS status")


def tasks(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return read(spark, d, "events", where).selectExpr("event_id AS id", "concat('agent_', user_id % 7) AS agent_name", "event_type AS task_type", "event_type <> 'error' AS success", "CASE WHEN event_id % 17 <> 0 THEN cast(floor(value * 10) AS bigint) END AS ms", "ts AS created_at", "CASE WHEN event_id % 19 <> 0 THEN ts + INTERVAL 14 DAYS END AS expires_at", "concat('src', user_id % 20) AS channel_id", "user_id")


def handoffs(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return read(spark, d, "orders", where).selectExpr("o_orderkey AS id", "concat('agent_', o_custkey % 7) AS source_agent", "concat('agent_', o_orderkey % 5) AS target_agent", "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'completed' WHEN '2' THEN 'failed' WHEN '3' THEN 'rejected' WHEN '4' THEN 'pending' ELSE 'accepted' END AS status", "CASE WHEN o_orderkey % 11 <> 0 THEN cast(floor(o_totalprice) AS bigint) END AS ms", "cast(o_orderdate AS timestamp_ntz) AS created_at")


def jobs(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return read(spark, d, "orders", where).selectExpr("concat('job_', o_orderkey) AS job_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'export' ELSE 'process' END AS job_type", "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status", "cast(o_orderdate AS timestamp_ntz) AS created_at", "o_custkey % 100 AS progress")


def agents(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return read(spark, d, "supplier", where).selectExpr("concat('agent_', s_suppkey) AS name", "CASE WHEN s_suppkey % 4 = 0 THEN 'export' ELSE 'process' END AS agent_type", "s_suppkey % 5 <> 0 AS is_active", "filter(array('text', CASE WHEN s_suppkey % 2 = 0 THEN 'topics' END, CASE WHEN s_suppkey % 3 = 0 THEN 'export' END), x -> x IS NOT NULL) AS capabilities", "s_suppkey * 7 % 50 AS tasks", "s_suppkey % 7 AS errors", "s_acctbal AS mean_ms")


def handoff_events(spark: SparkSession, d: str) -> DataFrame:
    """Each hand-off is accepted first; those that ended have another event."""
    h = handoffs(spark, d)
    first = h.selectExpr("id", "1 AS seq", "'accepted' AS status", "created_at + INTERVAL 1 HOUR AS at", "'started' AS result", "cast(null AS string) AS error", "cast(null AS bigint) AS ms")
    last = h.where("status NOT IN ('pending', 'accepted')").selectExpr("id", "2 AS seq", "status", "created_at + INTERVAL 2 HOUR AS at", "CASE WHEN status = 'completed' THEN concat('r', id) END AS result", "CASE WHEN status = 'failed' THEN 'boom' END AS error", "ms")
    return first.unionByName(last)


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of proposed topics: seven topics for each channel, the first a singleton."""
    return raw_messages(spark, d).selectExpr("channel_id", "cast(doc_id % 7 AS int) AS topic_seq", "CASE WHEN doc_id % 7 = 0 THEN 'singleton' ELSE 'cluster' END AS type", "doc_id AS pos", "source_ref AS anchor_ref", "CASE WHEN doc_id % 13 <> 0 THEN ((doc_id * 37) % 101) / 100.0D END AS score", "length(text) AS text_length")


#: The same tables for the oracle; a query names those that it needs.
SQL = {
    "raw": "SELECT doc_id, source AS channel_id, CAST(doc_id AS VARCHAR) AS id, 'tg:' || source || ':post:' || doc_id AS source_ref, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS date, text, lang FROM documents",
    "threads": "SELECT conv_id * 1000 + turn AS id, conv_id * 1000 AS thread_id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id, CASE WHEN turn = 0 THEN 'post' ELSE 'comment' END AS message_type, text FROM conversations",
    "processed": "SELECT doc_id, channel_id, source_ref, date FROM raw WHERE doc_id % 4 <> 0",
    "failures": "SELECT doc_id, channel_id, source_ref, doc_id % 3 + 1 AS attempts, date AS last_attempt_at FROM raw WHERE doc_id % 10 = 0",
    "sources": "SELECT 'src' || n_nationkey AS channel_id, 'source_' || n_nationkey AS source_id, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) END AS username, CASE WHEN n_regionkey = 0 THEN 'error' WHEN n_regionkey = 1 THEN 'paused' ELSE 'active' END AS status FROM nation",
    "tasks": "SELECT event_id AS id, 'agent_' || (user_id % 7) AS agent_name, event_type AS task_type, event_type <> 'error' AS success, CASE WHEN event_id % 17 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS ms, ts AS created_at, CASE WHEN event_id % 19 <> 0 THEN ts + INTERVAL 14 DAY END AS expires_at, 'src' || (user_id % 20) AS channel_id, user_id FROM events",
    "handoffs": "SELECT o_orderkey AS id, 'agent_' || (o_custkey % 7) AS source_agent, 'agent_' || (o_orderkey % 5) AS target_agent, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'completed' WHEN '2' THEN 'failed' WHEN '3' THEN 'rejected' WHEN '4' THEN 'pending' ELSE 'accepted' END AS status, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS ms, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders",
    "jobs": "SELECT 'job_' || o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'export' ELSE 'process' END AS job_type, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at, o_custkey % 100 AS progress FROM orders",
    "agents": "SELECT 'agent_' || s_suppkey AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'export' ELSE 'process' END AS agent_type, s_suppkey % 5 <> 0 AS is_active, list_filter(['text', CASE WHEN s_suppkey % 2 = 0 THEN 'topics' END, CASE WHEN s_suppkey % 3 = 0 THEN 'export' END], lambda x: x IS NOT NULL) AS capabilities, s_suppkey * 7 % 50 AS tasks, s_suppkey % 7 AS errors, s_acctbal AS mean_ms FROM supplier",
    "handoff_events": "SELECT id, 1 AS seq, 'accepted' AS status, created_at + INTERVAL 1 HOUR AS at, 'started' AS result, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS BIGINT) AS ms FROM handoffs UNION ALL SELECT id, 2, status, created_at + INTERVAL 2 HOUR, CASE WHEN status = 'completed' THEN 'r' || id END, CASE WHEN status = 'failed' THEN 'boom' END, ms FROM handoffs WHERE status NOT IN ('pending', 'accepted')",
    "proposals": "SELECT channel_id, CAST(doc_id % 7 AS INTEGER) AS topic_seq, CASE WHEN doc_id % 7 = 0 THEN 'singleton' ELSE 'cluster' END AS type, doc_id AS pos, source_ref AS anchor_ref, CASE WHEN doc_id % 13 <> 0 THEN CAST((doc_id * 37) % 101 AS DOUBLE) / 100.0 END AS score, length(text) AS text_length FROM raw",
}
NEEDS = {"handoff_events": ["handoffs"], "processed": ["raw"], "failures": ["raw"], "proposals": ["raw"]}


def with_tables(body: str, *names: str, **more: str) -> str:
    """body after WITH clauses for the logical tables named, and for more ones."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    clauses = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(clauses)} {body}" if clauses else body
