"""Queries that ask a store for one key, and for the statistics of one agent or day; keys are turned into filters that reach the scans."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import functions as F

from quillstream.functions import templates
from quillstream.operators import export, keyed, normalise, threads, topics
from quillstream.plans.analytics import DAILY, RANKED, _daily
from quillstream.plans.messages import CLEANED
from quillstream.session import shared_folder
from quillstream.sources import lines
from quillstream.sources import logical as L
from quillstream.streaming import rollup

C = F.col
REF, CARD, BUNDLE = "tg:src10:post:10", "topic:tg:src3:post:23", "src3/4"


def _number(key: str) -> int:
    """The number at the end of a key; a key without one is that of nothing."""
    found = re.fullmatch(r".*?(\d+)", key)
    return int(found[1]) if found else -1


def by_ref(table, s, d, ref):
    """The row of a message table with this reference: its channel and number are filters on columns of the file."""
    channel, number = re.fullmatch(r"tg:([^:]+):post:(\d+)", ref).groups()
    return table(s, d).where((C("channel_id") == channel) & (C("doc_id") == int(number)) & (C("source_ref") == ref))


def _topics_of(s, d, channel):
    """The gate's row of each topic of a channel; other channels are not read."""
    return topics.gate(topics.rank_anchors(L.proposals(s, d).where(C("channel_id") == channel)))


def card(s, d, topic_id):
    return _topics_of(s, d, topic_id.split(":")[2]).where((C("topic_id") == topic_id) & C("passed"))


def bundle(s, d, key):
    channel, seq = key.split("/")
    return _topics_of(s, d, channel).where(C("topic_seq") == int(seq))


def looked_up(s, d):
    """The parts of store_lookups: (store, rows, key, what is told of the row)."""
    return [
        ("raw", by_ref(L.raw_messages, s, d, REF), "source_ref", C("lang")),
        ("processed", by_ref(L.processed_refs, s, d, REF), "source_ref", C("date").cast("string")),
        ("card", card(s, d, CARD), "topic_id", C("type")),
        ("bundle", bundle(s, d, BUNDLE), F.concat_ws("/", "channel_id", "topic_seq"), C("type")),
        ("source", L.sources(s, d, f"n_nationkey = {_number('source_5')}"), "source_id", C("status")),
        ("job", L.jobs(s, d, f"o_orderkey = {_number('job_7')}"), "job_id", C("status")),
        ("agent", L.agents(s, d, f"s_suppkey = {_number('agent_3')}"), "name", C("agent_type")),
        ("task", L.tasks(s, d).where("id = 11"), C("id").cast("string"), C("task_type")),
        ("handoff", L.handoffs(s, d).where("id = 32"), C("id").cast("string"), C("status")),
    ]


def store_lookups(s, d):
    """One row of each of the nine stores by its key."""
    out = None
    for store, rows, key, what in looked_up(s, d):
        part = rows.select(F.lit(store).alias("store"), (C(key) if isinstance(key, str) else key).alias("key"), what.alias("what"))
        out = part if out is None else out.unionByName(part)
    return out


def stats_of_agent(s, d, agent="agent_3", first="2024-01-02", last="2024-01-20"):
    """An agent's days, or all agents', the latest day first, then by name."""
    t = _daily(s, d).where((C("day") >= F.lit(first).cast("date")) & (C("day") <= F.lit(last).cast("date")))
    t = t.where(C("agent_name") == agent) if agent else t
    return t.orderBy(F.desc("day"), "agent_name", "task_type").select("agent_name", "day", "task_type", "tasks", "ok", "mean_ms")


def stats_of_day(s, d, agent="agent_3", day="2024-01-05", task_type=None):
    t = _daily(s, d).where((C("agent_name") == agent) & (C("day") == F.lit(day).cast("date")))
    return t.where(C("task_type") == task_type) if task_type else t


def maintained_daily(s, d):
    """The daily rollup from three batches that came one after the other, each adding to the days it has tasks of."""
    path = f"{shared_folder(s)}/rollups/{s.range(1).select(F.uuid()).first()[0]}"
    for n in range(3):
        rollup.add_batch(L.tasks(s, d).where(C("id") % 3 == n), path, n)
    return rollup.read(s, path)


def _cursors(s, d):
    """Where threads of three comments and more were left: at their first comment."""
    c = L.thread_messages(s, d).where("message_type = 'comment'")
    return c.groupBy("thread_id").agg(F.min("id").alias("last_comment"), F.count("*").alias("n")).where("n >= 3")


def comment_scan(s, d, limit=2):
    """The next comments of each thread: two after its cursor, or the newest two where it has none."""
    c = L.thread_messages(s, d).where("message_type = 'comment'")
    return threads.comments_above(c, _cursors(s, d), limit).select("thread_id", "id", C("place").cast("long").alias("place"))


PROMPT = "Message {id} of {channel} ({{{lang}}}), {share:.3f} of all:\n{text}"


def rendered_prompts(s, d):
    """A prompt for each message; a language that is not known is N/A."""
    m = L.raw_messages(s, d)
    fields = {"id": C("id"), "channel": C("channel_id"), "lang": F.when(C("lang") != "fr", C("lang")), "share": C("doc_id") / F.lit(1000), "text": F.substring("text", 1, 80)}
    return m.select("doc_id", templates.rendered(PROMPT, fields, "N/A").alias("prompt"))


def archived_tasks(s, d):
    """Expired tasks by day written as archives, listed, and read back: the number of those of each archive."""
    folder = f"{shared_folder(s)}/archives/{s.range(1).select(F.uuid()).first()[0]}"
    t = L.tasks(s, d).select("id", "task_type", "ms")
    made = export.archive_all({k: t.where(C("task_type") == k) for k in ("click", "error", "view", "none")}, folder, datetime(2024, 6, 1, 12, 30, 5))
    listed = export.archives(s, folder).select("filename")
    back = None
    for path in filter(None, made.values()):
        part = export.read_archive(s, path, t.schema).groupBy(F.lit(path.rpartition("/")[2]).alias("filename")).agg(F.count("*").alias("n"), F.sum("ms").alias("ms"))
        back = part if back is None else back.unionByName(part)
    return listed.join(back, "filename").select("filename", "n", "ms")


def first_lines(s, d):
    """The first lines of written files of messages, a file for each ten thousand: 40 lines of each by their physical number, of which
    blank ones are left out."""
    folder = f"{shared_folder(s)}/lines/{s.range(1).select(F.uuid()).first()[0]}"
    m = L.raw_messages(s, d).withColumn("part", F.expr("doc_id div 10000")).repartition("part").sortWithinPartitions("part", "doc_id")
    m.select("part", F.when(F.length("text") % 3 > 0, F.to_json(F.struct("doc_id", "lang"))).otherwise(" ").alias("value")).write.partitionBy("part").text(folder)
    return lines.first_records(s, folder, "doc_id long, lang string", 40).select("line", "doc_id", "lang")


def normalised_messages(s, d):
    """Turns of conversations as a source gives them; every fourth thread is not known, system turns have their text as message."""
    c = L.read(s, d, "conversations").selectExpr("concat('@@conv', conv_id % 5) AS channel", "CASE WHEN turn = 0 THEN 'post' ELSE 'comment' END AS kind", "conv_id * 1000 + turn AS id", "CASE WHEN role <> 'system' THEN text END AS text", "CASE WHEN role = 'system' THEN text END AS message", "CASE WHEN turn % 5 <> 4 THEN timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(conv_id AS int), turn) END AS date", "CASE WHEN turn % 3 = 2 THEN conv_id * 1000 + turn - 1 ELSE 0 END AS reply_to", "CASE WHEN conv_id % 4 <> 0 THEN cast(conv_id * 1000 AS string) END AS thread", "length(text) AS views")
    return normalise.messages(c, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))


def conflict_log(s, d):
    """Messages read again in a clean form: where that differs from what is stored, it is logged and not stored."""
    m = L.raw_messages(s, d).select("source_ref", "text", "date", "lang")
    new = L.cleaned_messages(s, d).select("source_ref", C("c").alias("text"), "date", "lang")
    payload = F.to_json(F.struct(F.when(C("lang") != "en", C("lang")).alias("lang")))
    return keyed.conflict_log(m, new, "source_ref", ["text", "date"], F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"), payload)


QUERIES = {"normalised_messages": normalised_messages, "conflict_log": conflict_log, "comment_scan": comment_scan, "rendered_prompts": rendered_prompts, "archived_tasks": archived_tasks, "first_lines": first_lines, "store_lookups": store_lookups, "stats_of_agent": stats_of_agent, "stats_of_day": stats_of_day, "maintained_daily": maintained_daily}

_t = L.with_tables
_STAMP = "'\"' || strftime(date, '%Y-%m-%dT%H:%M:%S') || '+00:00\"'"
ORACLES = {
    "normalised_messages": f"SELECT CAST(id AS VARCHAR) AS id, kind AS message_type, 'tg:' || channel || ':' || kind || ':' || id AS source_ref, channel AS channel_id, coalesce(date, TIMESTAMP '2024-06-01') AS date, text, CASE WHEN kind = 'comment' AND conv_id % 4 <> 0 THEN CAST(conv_id * 1000 AS VARCHAR) ELSE CAST(id AS VARCHAR) END AS thread_id, CASE WHEN kind = 'comment' THEN CASE WHEN turn % 3 = 2 THEN CAST(id - 1 AS VARCHAR) WHEN conv_id % 4 <> 0 THEN CAST(conv_id * 1000 AS VARCHAR) ELSE CAST(id AS VARCHAR) END END AS parent_message_id, CAST(NULL AS VARCHAR) AS language, '{{\"date\":' || coalesce({_STAMP}, 'null') || ',\"edit_date\":null,\"forwards\":null,\"grouped_id\":null,\"id\":' || id || ',\"media\":null,\"message\":' || CASE WHEN role = 'system' THEN CAST(to_json(text) AS VARCHAR) ELSE 'null' END || ',\"post_author\":null,\"replies\":null,\"views\":' || length(text) || '}}' AS raw_payload FROM (SELECT *, 'conv' || (conv_id % 5) AS channel, CASE WHEN turn = 0 THEN 'post' ELSE 'comment' END AS kind, conv_id * 1000 + turn AS id, CASE WHEN turn % 5 <> 4 THEN TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id AS INTEGER)) + to_seconds(turn) END AS date FROM conversations)",
    "conflict_log": _t(f"SELECT source_ref, TIMESTAMP '2024-06-01' AS observed_at, 'changed: text' AS reason, CASE WHEN lang <> 'en' THEN '{{\"lang\":\"' || lang || '\"}}' END AS new_payload_json, c AS new_text, date AS new_date FROM cleaned WHERE c <> text", "raw", cleaned=CLEANED),
    "comment_scan": _t("SELECT thread_id, id, place FROM (SELECT t.thread_id, t.id, row_number() OVER (PARTITION BY t.thread_id ORDER BY CASE WHEN c.last_comment IS NULL THEN -t.id ELSE t.id END) AS place FROM threads t LEFT JOIN (SELECT thread_id, min(id) AS last_comment FROM threads WHERE message_type = 'comment' GROUP BY 1 HAVING count(*) >= 3) c USING (thread_id) WHERE message_type = 'comment' AND (c.last_comment IS NULL OR t.id > c.last_comment)) WHERE place <= 2", "threads"),
    "rendered_prompts": _t("SELECT doc_id, 'Message ' || id || ' of ' || channel_id || ' ({' || CASE WHEN lang <> 'fr' THEN lang ELSE 'N/A' END || '}), ' || printf('%.3f', doc_id / 1000) || ' of all:' || chr(10) || substr(text, 1, 80) AS prompt FROM raw", "raw"),
    "archived_tasks": _t("SELECT task_type || '_20240601_123005.ndjson.gz' AS filename, count(*) AS n, CAST(sum(ms) AS BIGINT) AS ms FROM tasks WHERE task_type IN ('click', 'error', 'view') GROUP BY 1", "tasks"),
    "first_lines": _t("SELECT line, doc_id, lang FROM (SELECT row_number() OVER (PARTITION BY doc_id // 10000 ORDER BY doc_id) - 1 AS line, doc_id, lang, text FROM raw) WHERE line < 40 AND length(text) % 3 > 0", "raw"),
    "store_lookups": _t(f"SELECT 'raw' AS store, source_ref AS key, lang AS what FROM raw WHERE source_ref = '{REF}' UNION ALL SELECT 'processed', source_ref, CAST(date AS VARCHAR) FROM processed WHERE source_ref = '{REF}' UNION ALL SELECT 'card', topic_id, type FROM gate WHERE topic_id = '{CARD}' AND passed UNION ALL SELECT 'bundle', channel_id || '/' || topic_seq, type FROM gate WHERE channel_id || '/' || topic_seq = '{BUNDLE}' UNION ALL SELECT 'source', source_id, status FROM sources WHERE source_id = 'source_5' UNION ALL SELECT 'job', job_id, status FROM jobs WHERE job_id = 'job_7' UNION ALL SELECT 'agent', name, agent_type FROM agents WHERE name = 'agent_3' UNION ALL SELECT 'task', CAST(id AS VARCHAR), task_type FROM tasks WHERE id = 11 UNION ALL SELECT 'handoff', CAST(id AS VARCHAR), status FROM handoffs WHERE id = 32", "processed", "sources", "jobs", "agents", "tasks", "handoffs", "proposals", **RANKED),
    "stats_of_agent": _t(f"SELECT agent_name, day, task_type, tasks, ok, mean_ms FROM ({DAILY}) WHERE agent_name = 'agent_3' AND day BETWEEN DATE '2024-01-02' AND DATE '2024-01-20'", "tasks"),
    "stats_of_day": _t(f"SELECT * FROM ({DAILY}) WHERE agent_name = 'agent_3' AND day = DATE '2024-01-05'", "tasks"),
    "maintained_daily": _t(DAILY, "tasks"),
}
