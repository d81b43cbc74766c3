"""Queries on what records break of their contracts, and on copies of tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstream.functions import schema_rules, schemas, text
from quillstream.operators import copies
from quillstream.session import shared_folder
from quillstream.sources import logical as L

C = F.col
#: When the copy of the jobs was taken.
COPIED = "1997-01-01 00:00:00"


def _told(df, key, broken):
    """Records that break something; what they break as one text.

    A filter on that text would be moved below it and have all rules evaluated twice; an array of no or one text is not.
    """
    return df.select(key, F.explode(F.filter(F.array(F.array_join(broken, ",")), lambda v: v != "")).alias("violations"))


def message_contract(s, d):
    """Events kept as JSON messages: only clicks and views are of a known type, sign-ups have no text, large values keep their payload as text."""
    e = L.spread(L.read(s, d, "events")).selectExpr("*", "concat('src', user_id % 20) AS channel_id", "CASE event_type WHEN 'click' THEN 'post' WHEN 'view' THEN 'comment' ELSE event_type END AS message_type")
    payload = F.parse_json(F.when(C("value") > 50, F.lit('"large"')).otherwise(C("props")))
    record = F.to_json(F.struct(C("event_id").cast("string").alias("id"), "message_type", F.concat_ws(":", F.lit("tg"), "channel_id", "message_type", "event_id").alias("source_ref"), "channel_id", C("ts").cast("string").alias("date"), F.when(C("event_type") != "signup", C("props")).alias("text"), payload.alias("raw_payload")))
    return _told(e, "event_id", schema_rules.broken_json(record, schemas.RAW_MESSAGE))


def document_contract(s, d):
    """Processed documents: a short text counts as none, and the value of a token is absent where the text has none."""
    m = L.raw_messages(s, d)
    token = F.nullif(F.regexp_extract("text", 'token = "([0-9a-f]+)"', 1), F.lit(""))
    clean = m.select(F.concat(F.lit("doc:"), "source_ref").alias("id"), "source_ref", C("id").alias("source_message_id"), "channel_id", C("date").alias("processed_at"), F.when(F.length("text") >= 40, text.clean_text(C("text"))).alias("text_clean"), C("lang").alias("language"), F.array(F.struct(F.lit("token").alias("type"), token.alias("value"), F.lit(0.9).alias("confidence"))).alias("entities"))
    return _told(clean, "id", schema_rules.broken(clean, schemas.PROCESSED_DOCUMENT))


def _first(s, d, n):
    return L.proposals(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("channel_id", "topic_seq").orderBy("pos"))).where(C("rn") <= n)


def card_contract(s, d):
    """Cards of the first three anchors of each topic; its sources are those of high score."""
    anchor = F.struct("channel_id", C("pos").cast("string").alias("message_id"), F.lit("post").alias("message_type"), "anchor_ref", "score")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rn", anchor.alias("a")))), lambda x: x.getField("a"))
    t = _first(s, d, 3).groupBy("channel_id", "topic_seq", "type").agg(in_order.alias("anchors"))
    cards = t.select(F.concat_ws(":", "channel_id", "topic_seq").alias("id"), F.when(C("topic_seq") != 3, C("type")).alias("title"), C("channel_id").alias("summary"), F.array("type").alias("scope_in"), F.when(C("topic_seq") > 0, F.array(F.lit("other"))).otherwise(F.array().cast("array<string>")).alias("scope_out"), "type", "anchors", F.transform(F.filter("anchors", lambda a: a.getField("score") >= 0.7), lambda a: a.getField("anchor_ref")).alias("sources"), F.current_timestamp().alias("updated_at"))
    return _told(cards, "id", schema_rules.broken(cards, schemas.TOPIC_CARD))


def bundle_contract(s, d):
    """Bundles of the first four proposals of each topic; a proposal of low or no score has a role that is not known."""
    role = F.when(C("score") >= 0.75, "anchor").when(C("score") >= 0.25, "supporting").otherwise("other")
    item = F.struct("channel_id", C("pos").cast("string").alias("message_id"), F.lit("post").alias("message_type"), C("anchor_ref").alias("source_ref"), role.alias("role"), "score")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rn", item.alias("a")))), lambda x: x.getField("a"))
    bundles = _first(s, d, 4).groupBy("channel_id", "topic_seq").agg(in_order.alias("items")).select(F.concat_ws(":", "channel_id", "topic_seq").alias("topic_id"), "items", F.current_timestamp().alias("updated_at"))
    return _told(bundles, "topic_id", schema_rules.broken(bundles, schemas.TOPIC_BUNDLE))


def entry_contract(s, d):
    """Web pages as entries: a page with a fragment is a comment, one that is numbered a page, and its number tells when it was made."""
    p = L.read(s, d, "pages")
    kind = F.when(F.contains("url", F.lit("#")), "comment").when(F.contains("url", F.lit("?page=")), "page")
    entries = p.select(C("page_id").cast("string").alias("id"), F.struct(F.lit("page").alias("type"), kind.alias("message_type"), C("url").alias("source_ref")).alias("source"), F.nullif(F.regexp_extract("url", "[?]page=([0-9]+)", 1), F.lit("")).alias("created_at"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), C("html").alias("content"))
    return _told(entries, "id", schema_rules.broken(entries, schemas.KNOWLEDGE_BASE_ENTRY))


def copied_changes(s, d):
    """Jobs against a written copy of how they were: without those made since, with those purged since, none failed yet."""
    now = L.jobs(s, d)
    before = now.where(C("created_at") < F.lit(COPIED).cast("timestamp_ntz")).withColumn("status", F.when(C("status") == "failed", "running").otherwise(C("status")))
    copy, made = copies.opened(s, copies.copy(before, f"{shared_folder(s)}/copies", ["job_id"]))
    now = now.where("progress <> 42")
    return copies.differences(now, copy, ["job_id"], (copies.tree(now, ["job_id"]), made)).withColumn("columns", F.array_join("columns", ","))


def migration_totals(s, d):
    """Tables copied, and their copies verified."""
    tables = {"tasks": (L.tasks(s, d), ["id"]), "handoffs": (L.handoffs(s, d), ["id"]), "jobs": (L.jobs(s, d), ["job_id"])}
    return copies.migrate(s, tables, f"{shared_folder(s)}/copies")


QUERIES = {
    "message_contract": message_contract,
    "document_contract": document_contract,
    "card_contract": card_contract,
    "bundle_contract": bundle_contract,
    "entry_contract": entry_contract,
    "copied_changes": copied_changes,
    "migration_totals": migration_totals,
}

_t = L.with_tables
_FIRST = "SELECT *, row_number() OVER (PARTITION BY channel_id, topic_seq ORDER BY pos) AS rn FROM proposals"
ORACLES = {
    "message_contract": "SELECT * FROM (SELECT event_id, concat_ws(',', CASE WHEN event_type = 'signup' THEN 'text: required' END, CASE WHEN event_type NOT IN ('click', 'view') THEN 'message_type: enum,source_ref: pattern' END, CASE WHEN value > 50 THEN 'raw_payload: type' END) AS violations FROM events) WHERE violations <> ''",
    "document_contract": _t("SELECT * FROM (SELECT 'doc:' || source_ref AS id, concat_ws(',', CASE WHEN length(text) < 40 THEN 'text_clean: required' END, CASE WHEN NOT regexp_matches(text, 'token = \"[0-9a-f]+\"') THEN 'entities[0].value: required' END) AS violations FROM raw) WHERE violations <> ''", "raw"),
    "card_contract": _t(f"SELECT * FROM (SELECT channel_id || ':' || topic_seq AS id, concat_ws(',', CASE WHEN topic_seq = 3 THEN 'title: required' END, CASE WHEN topic_seq = 0 THEN 'scope_out: minItems' END, CASE WHEN coalesce(max(score), 0) < 0.7 THEN 'sources: minItems' END, CASE WHEN type = 'cluster' AND count(*) < 2 THEN 'anchors: minItems' END, string_agg('anchors[' || (rn - 1) || '].score: required', ',' ORDER BY rn) FILTER (type = 'cluster' AND score IS NULL)) AS violations FROM ({_FIRST}) WHERE rn <= 3 GROUP BY channel_id, topic_seq, type) WHERE violations <> ''", "proposals"),
    "bundle_contract": _t(f"SELECT channel_id || ':' || topic_seq AS topic_id, string_agg('items[' || (rn - 1) || '].role: enum', ',' ORDER BY rn) AS violations FROM ({_FIRST}) WHERE rn <= 4 AND (score IS NULL OR score < 0.25) GROUP BY channel_id, topic_seq", "proposals"),
    "entry_contract": "SELECT * FROM (SELECT CAST(page_id AS VARCHAR) AS id, concat_ws(',', CASE WHEN NOT regexp_matches(url, '[?]page=[0-9]') THEN 'created_at: required' END, CASE WHEN NOT contains(url, '#') AND contains(url, '?page=') THEN 'source.message_type: enum' END) AS violations FROM pages) WHERE violations <> ''",
    "copied_changes": _t(f"SELECT * FROM (SELECT job_id, CASE WHEN created_at >= TIMESTAMP '{COPIED}' THEN CASE WHEN progress <> 42 THEN 'missing' END WHEN progress = 42 THEN 'extra' WHEN status = 'failed' THEN 'changed' END AS status, CASE WHEN created_at < TIMESTAMP '{COPIED}' AND progress <> 42 AND status = 'failed' THEN 'status' ELSE '' END AS columns FROM jobs) WHERE status IS NOT NULL", "jobs"),
    "migration_totals": _t("SELECT name, n AS n_source, n AS n_target, CAST(0 AS BIGINT) AS leaves, true AS equal FROM (SELECT 'tasks' AS name, count(*) AS n FROM tasks UNION ALL SELECT 'handoffs', count(*) FROM handoffs UNION ALL SELECT 'jobs', count(*) FROM jobs UNION ALL SELECT 'total', (SELECT count(*) FROM tasks) + (SELECT count(*) FROM handoffs) + (SELECT count(*) FROM jobs))", "tasks", "handoffs", "jobs"),
}
