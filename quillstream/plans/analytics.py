"""Queries over topics, tasks, hand-offs, sources and keyed tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstream.functions import text
from quillstream.functions.ids import message_url
from quillstream.operators import keyed, topics
from quillstream.sources import logical as L

C = F.col
AS_OF = "2024-06-01 00:00:00"
NTZ = f"TIMESTAMP_NTZ '{AS_OF}'"


def _ranked(s, d):
    return topics.rank_anchors(L.proposals(s, d))


def _daily(s, d):
    return L.tasks(s, d).groupBy("agent_name", F.to_date("created_at").alias("day"), "task_type").agg(F.count("*").alias("tasks"), F.count_if("success").alias("ok"), F.count_if(~C("success")).alias("failed"), F.sum("ms").alias("total_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms")).withColumn("mean_ms", F.round(text.ratio(C("total_ms"), C("tasks")), 6)).withColumn("success_rate", F.round(text.ratio(C("ok"), C("tasks")), 6))


def _stats(t, *keys):
    return t.groupBy(*keys).agg(F.count("*").alias("tasks"), F.count_if("success").alias("ok"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.count_distinct(F.to_date("created_at")).alias("days"), F.count_distinct("task_type").alias("types"))


def _synthetic_topics(s, d):
    """Topic lists that exercise grouping: the language, one of eleven groups, and the laboratory keyword."""
    m = L.raw_messages(s, d)
    return m.select("doc_id", "source_ref", "text", F.array_compact(F.array(F.concat(F.lit("lang_"), "lang"), F.concat(F.lit("mod_"), (C("doc_id") % 11).cast("string")), F.when(F.contains("text", F.lit("test")), "laboratory"))).alias("topics"))


def keyword_clusters(s, d, least=2, most=10):
    """Topics by the number of documents, with samples; the refs of a group are rows of keyword_cluster_members, never gathered."""
    e = _synthetic_topics(s, d).select("doc_id", "source_ref", F.explode(F.array_distinct("topics")).alias("topic"), F.substring("text", 1, 100).alias("sample"))
    top = e.groupBy("topic").agg(F.count("*").alias("n"), F.min("source_ref").alias("first_ref")).where(C("n") >= least).orderBy(F.desc("n"), "topic").limit(most)
    # the filter on the rank cuts each topic to three rows before they are shuffled
    first = e.withColumn("rn", F.row_number().over(Window.partitionBy("topic").orderBy("doc_id"))).where("rn <= 3")
    samples = first.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "sample"))), lambda x: x.getField("sample")), "|").alias("samples"))
    return top.join(samples, "topic").select("topic", "n", "samples", "first_ref")


def running_avg(s, d):
    """Mean of an agent's tasks up to each one: what the days before add up to, and a window within the day."""
    t = L.tasks(s, d).select("id", "agent_name", "created_at", "ms", F.to_date("created_at").alias("day"))
    before = Window.partitionBy("agent_name").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = t.groupBy("agent_name", "day").agg(F.sum("ms").alias("s"), F.count("ms").alias("n"))
    days = days.select("agent_name", "day", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    own = Window.partitionBy("agent_name", "day").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    joined = t.join(days, ["agent_name", "day"])
    total = C("s0") + F.coalesce(F.sum("ms").over(own), F.lit(0))
    return joined.select("id", "agent_name", F.try_divide(total.cast("double"), C("n0") + F.count("ms").over(own)).alias("mean_ms"))


def _cards(s, d):
    """Cards of the topics that pass, with what the model would write made from the anchors."""
    r = _ranked(s, d)
    last = r.groupBy("channel_id", "topic_seq").agg(F.max("pos").alias("last"))
    c = topics.gate(r).where("passed").join(last, ["channel_id", "topic_seq"])
    return c.selectExpr("topic_id", "'Untitled Topic' AS title", "concat(type, ' of ', anchors) AS summary", "array(type, channel_id) AS scope_in", "filter(array(CASE WHEN topic_seq > 0 THEN 'singleton' END), x -> x IS NOT NULL) AS scope_out", "CASE WHEN topic_seq % 2 = 0 THEN array(type, 'even') END AS tags", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(last AS int), 0) AS updated_at")


def topic_cards(s, d):
    """Cards with their anchors in order, of one ranking."""
    g = topics.graded(L.proposals(s, d)).where("passed and role = 'anchor'")
    refs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "anchor_ref"))), lambda x: x.getField("anchor_ref")), ",")
    return g.groupBy(*topics.TOPIC, "topic_id", "type", "anchors").agg(refs.alias("anchor_refs")).select("topic_id", "type", "anchors", "anchor_refs", F.lit("Untitled Topic").alias("title"))


def kb_topics(s, d):
    """Topic cards as knowledge-base entries; the table of their sources is resolved_sources, by topic_id."""
    return topics.kb_entries(_cards(s, d)).withColumns({c: F.array_join(c, ",") for c in ("topics", "tags")})


def keyword_cluster_members(s, d, least=2, most=10):
    """Every document of the topics of keyword_clusters, a row each; the order within a topic is that of doc_id."""
    e = _synthetic_topics(s, d).select("doc_id", "source_ref", F.explode(F.array_distinct("topics")).alias("topic"))
    top = e.groupBy("topic").agg(F.count("*").alias("n")).where(C("n") >= least).orderBy(F.desc("n"), "topic").limit(most)
    return e.join(F.broadcast(top), "topic").select("topic", "n", "doc_id", "source_ref")


def topic_jaccard(s, d):
    t = _synthetic_topics(s, d).select("doc_id", C("topics").alias("a"), F.array(F.concat(F.lit("mod_"), (C("doc_id") % 5).cast("string")), F.lit("lang_en")).alias("b"))
    inter, union = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return t.select("doc_id", F.round(F.when(union == 0, 1.0).otherwise(inter / union), 6).alias("jaccard"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("only_a"))


def resolved_sources(s, d):
    items = topics.resolved_order(topics.bundle_items(L.proposals(s, d)))
    m = L.raw_messages(s, d).select(C("source_ref").alias("ref"), "channel_id", "id").join(L.sources(s, d).select("channel_id", "username"), "channel_id", "left")
    return items.join(m, "ref", "left").select("topic_id", "ref", "role", "score", "place", message_url(C("channel_id"), C("username"), C("id")).alias("url"))


def source_health(s, d):
    """Failures since the last success of each source; attempts are in the order of time, then id."""
    a = L.tasks(s, d)
    last = a.groupBy("channel_id").agg(F.max(F.when(C("success"), F.struct("created_at", "id"))).alias("last_ok"), F.max("created_at").alias("last_attempt_at"), F.max(F.when(~C("success"), C("created_at"))).alias("last_error_at"))
    after = a.join(last, "channel_id").where(~C("success") & (C("last_ok").isNull() | (F.struct("created_at", "id") > C("last_ok")))).groupBy("channel_id").agg(F.count("*").alias("fail_count"))
    return last.join(after, "channel_id", "left").select("channel_id", F.coalesce("fail_count", F.lit(0)).cast("long").alias("fail_count"), C("last_ok.created_at").alias("last_success_at"), "last_error_at", "last_attempt_at")


def _upsert(s, d):
    r = L.raw_messages(s, d)
    old = r.select("source_ref", F.lit("old").alias("state"), "date", F.lit(1).alias("version"))
    new = r.where("doc_id % 3 = 0").select("source_ref", F.lit("new").alias("state"), C("date") + F.expr("INTERVAL 1 DAY"), F.lit(2).alias("version")).toDF("source_ref", "state", "date", "version")
    return keyed.upsert(old, new, ["source_ref"], "version", ["date"])


def _registry(s, d):
    t = L.tasks(s, d)
    return _stats(t, "agent_name").withColumn("error_rate", F.round(100.0 * (1 - text.ratio(C("ok"), C("tasks"))), 6))


QUERIES = {
    "anchors_dedup": lambda s, d: topics.dedup_anchors(L.proposals(s, d).unionAll(L.proposals(s, d).withColumn("pos", C("pos") + 1000000))).select("channel_id", "topic_seq", "anchor_ref", "pos"),
    "anchors_top3": lambda s, d: _ranked(s, d).select("channel_id", "topic_seq", "anchor_ref", "score", "rank"),
    "quality_gate": lambda s, d: topics.gate(_ranked(s, d)),
    "topic_cards": topic_cards,
    "supporting_candidates": lambda s, d: L.proposals(s, d).join(_ranked(s, d), ["channel_id", "topic_seq", "anchor_ref"], "left_anti").select("channel_id", "topic_seq", "anchor_ref", "score"),
    "topic_bundles": lambda s, d: topics.bundle_items(L.proposals(s, d)),
    "resolved_sources": resolved_sources,
    "card_bundle": lambda s, d: topics.gate(_ranked(s, d)).select("topic_id", "passed").join(topics.bundle_items(L.proposals(s, d)).groupBy("topic_id").agg(F.count("*").alias("items")), "topic_id", "left"),
    "kb_topics": kb_topics,
    "keyword_clusters": keyword_clusters,
    "keyword_cluster_members": keyword_cluster_members,
    "topic_jaccard": topic_jaccard,
    "agent_daily": _daily,
    "agent_summary": lambda s, d: _stats(L.tasks(s, d)),
    "agent_by_type": lambda s, d: _stats(L.tasks(s, d), "agent_name", "task_type"),
    "stats_range": lambda s, d: _daily(s, d).where("day >= DATE '2024-01-02' AND day <= DATE '2024-01-20'").select("agent_name", "day", "task_type", "tasks"),
    "task_history_page": lambda s, d: L.tasks(s, d).where("agent_name = 'agent_3'").orderBy(F.desc("created_at"), "id").limit(100).select("id", "task_type", "created_at"),
    "expired_tasks": lambda s, d: L.tasks(s, d).where(f"expires_at < {NTZ}").orderBy("expires_at", "id").limit(1000).select("id", "expires_at"),
    "ttl_keep": lambda s, d: keyed.split_expired(L.tasks(s, d), F.expr(f"expires_at < {NTZ}"))[0].select("id", "expires_at"),
    "retention_split": lambda s, d: (lambda kept, gone: kept.select(F.lit("kept").alias("part")).unionAll(gone.select(F.lit("archived"))).groupBy("part").agg(F.count("*").alias("n")))(*keyed.split_expired(L.tasks(s, d), F.expr(f"expires_at < {NTZ}"))),
    "handoffs_by_agent": lambda s, d: L.handoffs(s, d).where("source_agent = 'agent_2' AND status = 'completed'").orderBy(F.desc("created_at"), "id").limit(50).select("id", "target_agent", "created_at"),
    "expired_handoffs": lambda s, d: L.handoffs(s, d).where("created_at < TIMESTAMP_NTZ '1995-02-01 00:00:00'").orderBy("created_at", "id").limit(200).select("id", "created_at"),
    "terminal_handoffs": lambda s, d: L.handoffs(s, d).where("status IN ('completed', 'failed')").orderBy(F.desc("created_at"), "id").limit(10000).select("id", "status"),
    "handoff_stats": lambda s, d: L.handoffs(s, d).agg(F.count("*").alias("total"), F.count_if(C("status") == "completed").alias("completed"), F.count_if(C("status") == "failed").alias("failed"), F.count_if(C("status") == "rejected").alias("rejected"), F.count_if(C("status").isin("pending", "accepted", "in_progress")).alias("in_progress"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms")),
    "top_agent_pairs": lambda s, d: L.handoffs(s, d).groupBy("source_agent", "target_agent").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_agent", "target_agent").limit(10),
    "handoff_fold": lambda s, d: L.handoffs(s, d).groupBy("source_agent", "target_agent").agg(F.max_by("status", "id").alias("status"), F.max("id").alias("last_id"), F.min(F.when(C("status") == "accepted", C("created_at"))).alias("accepted_at")),
    "running_avg": running_avg,
    "best_agent": lambda s, d: _registry(s, d).orderBy("error_rate", F.asc_nulls_last("mean_ms"), "agent_name").limit(1).select("agent_name", "error_rate", "mean_ms"),
    "registry_stats": lambda s, d: _registry(s, d).select("agent_name", "tasks", "error_rate", F.round("mean_ms", 2).alias("mean_ms")),
    "error_rate": lambda s, d: L.tasks(s, d).groupBy("task_type").agg(F.round(100.0 * F.count_if(~C("success")) / F.count("*"), 6).alias("error_rate")),
    "latency_histogram": lambda s, d: L.tasks(s, d).groupBy("task_type").agg(*[F.count_if(C("ms") <= b).alias(f"le_{b}") for b in (10, 100, 500, 1000, 5000)], F.count("ms").alias("n")),
    "health_rollup": lambda s, d: L.sources(s, d).agg(F.when(F.bool_or(C("status") == "error"), "degraded").when(F.bool_or(C("status") == "paused"), "warning").otherwise("ok").alias("health"), F.count("*").alias("n")),
    "source_health": source_health,
    "capability_lookup": lambda s, d: _stats(L.tasks(s, d), "agent_name", "task_type").select("agent_name", C("task_type").alias("capability")).join(L.sources(s, d).selectExpr("concat('agent_', cast(substr(source_id, 8) AS int) % 7) AS agent_name").distinct(), "agent_name", "left_semi"),
    "insert_if_absent": lambda s, d: keyed.insert_if_absent(L.processed_refs(s, d), L.raw_messages(s, d).select("source_ref", "doc_id"), "source_ref", C("doc_id")),
    "conflicts": lambda s, d: keyed.conflicts(L.raw_messages(s, d).select("source_ref", "lang"), L.raw_messages(s, d).select("source_ref", F.when(C("doc_id") % 9 == 0, "xx").otherwise(C("lang")).alias("lang")), "source_ref", ["lang"]).select("source_ref", "lang", "old_lang"),
    "upsert_latest": _upsert,
    "bundle_replace": lambda s, d: keyed.upsert(L.tasks(s, d).selectExpr("agent_name AS topic_id", "cast(null AS timestamp_ntz) AS time_from", "id AS version"), L.tasks(s, d).selectExpr("agent_name AS topic_id", "expires_at AS time_from", "id + 1 AS version"), ["topic_id", "time_from"], "version"),
    "delete_by_key": lambda s, d: keyed.delete(L.failures(s, d), L.processed_refs(s, d), "source_ref").select("source_ref", "attempts"),
}

RANKED = {
    "dedup": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, topic_seq, anchor_ref ORDER BY pos) AS k FROM proposals) WHERE k = 1",
    "ranked": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY channel_id, topic_seq ORDER BY coalesce(score, 0) DESC, anchor_ref) AS INTEGER) AS rank FROM dedup) WHERE type = 'singleton' OR rank <= 3",
    "gate": "SELECT channel_id, topic_seq, type, count(*) AS anchors, 'topic:' || arg_min(anchor_ref, rank) AS topic_id, CASE WHEN type = 'singleton' THEN max(CASE WHEN rank = 1 THEN coalesce(score, 0) END) >= 0.75 AND max(CASE WHEN rank = 1 THEN text_length END) >= 300 ELSE count(*) >= 2 AND min(coalesce(score, 0)) >= 0.6 END AS passed FROM ranked GROUP BY channel_id, topic_seq, type",
    "good": "SELECT channel_id, topic_seq, topic_id FROM gate WHERE passed",
    "both_items": "SELECT topic_id, anchor_ref AS ref, 'anchor' AS role, score FROM ranked JOIN good USING (channel_id, topic_seq) UNION ALL SELECT topic_id, anchor_ref, 'supporting', score FROM proposals JOIN good USING (channel_id, topic_seq) WHERE score >= 0.5",
    "items": "SELECT topic_id, ref, role, score FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, ref ORDER BY role, score DESC NULLS LAST) AS k FROM both_items) WHERE k = 1",
    "bundle": "SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY role, coalesce(score, 0) DESC, ref) AS INTEGER) AS item FROM items",
}
SYN = "SELECT doc_id, source_ref, text, list_filter(['lang_' || lang, 'mod_' || (doc_id % 11), CASE WHEN contains(text, 'test') THEN 'laboratory' END], lambda x: x IS NOT NULL) AS topics FROM raw"
DAILY = "SELECT agent_name, CAST(created_at AS DATE) AS day, task_type, count(*) AS tasks, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, CAST(sum(ms) AS BIGINT) AS total_ms, min(ms) AS min_ms, max(ms) AS max_ms, round(coalesce(CAST(sum(ms) AS DOUBLE) / count(*), 0), 6) AS mean_ms, round(CAST(count(*) FILTER (success) AS DOUBLE) / count(*), 6) AS success_rate FROM tasks GROUP BY 1, 2, 3"
STATS = "count(*) AS tasks, count(*) FILTER (success) AS ok, round(avg(ms), 6) AS mean_ms, min(ms) AS min_ms, max(ms) AS max_ms, count(DISTINCT CAST(created_at AS DATE)) AS days, count(DISTINCT task_type) AS types FROM tasks"
REGISTRY = "SELECT agent_name, count(*) AS tasks, round(100.0 * (1 - CAST(count(*) FILTER (success) AS DOUBLE) / count(*)), 6) AS error_rate, round(avg(ms), 6) AS mean_ms FROM tasks GROUP BY 1"


def _t(body, *names, **more):
    return L.with_tables(body, *(names or ("tasks",)), **more)


ORACLES = {
    "anchors_dedup": _t("SELECT channel_id, topic_seq, anchor_ref, min(pos) AS pos FROM proposals GROUP BY ALL", "proposals"),
    "anchors_top3": _t("SELECT channel_id, topic_seq, anchor_ref, score, rank FROM ranked", "proposals", **RANKED),
    "quality_gate": _t("SELECT * FROM gate", "proposals", **RANKED),
    "topic_cards": _t("SELECT topic_id, g.type, anchors, (SELECT string_agg(anchor_ref, ',' ORDER BY rank) FROM ranked r WHERE r.channel_id = g.channel_id AND r.topic_seq = g.topic_seq) AS anchor_refs, 'Untitled Topic' AS title FROM gate g WHERE passed", "proposals", **RANKED),
    "supporting_candidates": _t("SELECT channel_id, topic_seq, anchor_ref, score FROM proposals p WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.channel_id = p.channel_id AND r.topic_seq = p.topic_seq AND r.anchor_ref = p.anchor_ref)", "proposals", **RANKED),
    "topic_bundles": _t("SELECT * FROM bundle", "proposals", **RANKED),
    "resolved_sources": _t("SELECT topic_id, ref, role, score, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY role, score IS NULL OR score = 0, score DESC NULLS LAST, ref) AS INTEGER) AS place, CASE WHEN length(username) > 0 THEN 'https://t.me/' || username || '/' || id WHEN regexp_matches(r.channel_id, '^[A-Za-z0-9_]{5,}$') THEN 'https://t.me/' || r.channel_id || '/' || id END AS url FROM items LEFT JOIN raw r ON r.source_ref = ref LEFT JOIN sources s ON s.channel_id = r.channel_id", "proposals", "sources", **RANKED),
    "card_bundle": _t("SELECT topic_id, passed, items FROM gate LEFT JOIN (SELECT topic_id, count(*) AS items FROM bundle GROUP BY 1) USING (topic_id)", "proposals", **RANKED),
    "kb_topics": _t("SELECT 'kb:topic:' || topic_id AS kb_id, 'topic' AS source_type, topic_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(last AS INTEGER)) AS created_at, 'Untitled Topic' AS title, type || ' of ' || anchors || chr(10) || chr(10) || '**Scope In:** ' || type || ', ' || channel_id || chr(10) || '**Scope Out:** ' || CASE WHEN topic_seq > 0 THEN 'singleton' ELSE '' END AS content, topic_id AS topics, CASE WHEN topic_seq % 2 = 0 THEN type || ',even' ELSE '' END AS tags FROM gate JOIN (SELECT channel_id, topic_seq, max(pos) AS last FROM ranked GROUP BY 1, 2) USING (channel_id, topic_seq) WHERE passed", "proposals", **RANKED),
    "keyword_clusters": _t("SELECT topic, count(*) AS n, string_agg(sample, '|' ORDER BY doc_id) FILTER (rn <= 3) AS samples, min(source_ref) AS first_ref FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS rn FROM (SELECT doc_id, source_ref, substr(text, 1, 100) AS sample, unnest(list_distinct(topics)) AS topic FROM syn)) GROUP BY topic HAVING count(*) >= 2 ORDER BY n DESC, topic LIMIT 10", "raw", syn=SYN),
    "keyword_cluster_members": _t("SELECT topic, n, doc_id, source_ref FROM members JOIN (SELECT topic, count(*) AS n FROM members GROUP BY topic HAVING count(*) >= 2 ORDER BY n DESC, topic LIMIT 10) USING (topic)", "raw", syn=SYN, members="SELECT doc_id, source_ref, unnest(list_distinct(topics)) AS topic FROM syn"),
    "topic_jaccard": _t("SELECT doc_id, round(len(list_intersect(topics, b)) / len(list_distinct(topics || b)), 6) AS jaccard, array_to_string(list_sort(list_filter(topics, lambda x: NOT list_contains(b, x))), ',') AS only_a FROM (SELECT *, ['mod_' || (doc_id % 5), 'lang_en'] AS b FROM syn)", "raw", syn=SYN),
    "agent_daily": _t(DAILY),
    "agent_summary": _t(f"SELECT {STATS}"),
    "agent_by_type": _t(f"SELECT agent_name, task_type, {STATS} GROUP BY 1, 2".replace("count(DISTINCT task_type) AS types", "CAST(1 AS BIGINT) AS types")),
    "stats_range": _t(f"SELECT agent_name, day, task_type, tasks FROM ({DAILY}) WHERE day BETWEEN DATE '2024-01-02' AND DATE '2024-01-20'"),
    "task_history_page": _t("SELECT id, task_type, created_at FROM tasks WHERE agent_name = 'agent_3' ORDER BY created_at DESC, id LIMIT 100"),
    "expired_tasks": _t(f"SELECT id, expires_at FROM tasks WHERE expires_at < TIMESTAMP '{AS_OF}' ORDER BY expires_at, id LIMIT 1000"),
    "ttl_keep": _t(f"SELECT id, expires_at FROM tasks WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{AS_OF}'"),
    "retention_split": _t(f"SELECT CASE WHEN expires_at < TIMESTAMP '{AS_OF}' THEN 'archived' ELSE 'kept' END AS part, count(*) AS n FROM tasks GROUP BY 1"),
    "handoffs_by_agent": _t("SELECT id, target_agent, created_at FROM handoffs WHERE source_agent = 'agent_2' AND status = 'completed' ORDER BY created_at DESC, id LIMIT 50", "handoffs"),
    "expired_handoffs": _t("SELECT id, created_at FROM handoffs WHERE created_at < TIMESTAMP '1995-02-01' ORDER BY created_at, id LIMIT 200", "handoffs"),
    "terminal_handoffs": _t("SELECT id, status FROM handoffs WHERE status IN ('completed', 'failed') ORDER BY created_at DESC, id LIMIT 10000", "handoffs"),
    "handoff_stats": _t("SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status IN ('pending', 'accepted', 'in_progress')) AS in_progress, round(avg(ms), 6) AS mean_ms, min(ms) AS min_ms, max(ms) AS max_ms FROM handoffs", "handoffs"),
    "top_agent_pairs": _t("SELECT source_agent, target_agent, count(*) AS n FROM handoffs GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10", "handoffs"),
    "handoff_fold": _t("SELECT source_agent, target_agent, arg_max(status, id) AS status, max(id) AS last_id, min(created_at) FILTER (status = 'accepted') AS accepted_at FROM handoffs GROUP BY 1, 2", "handoffs"),
    "running_avg": _t("SELECT id, agent_name, CAST(sum(ms) OVER w AS DOUBLE) / nullif(count(ms) OVER w, 0) AS mean_ms FROM tasks WINDOW w AS (PARTITION BY agent_name ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)"),
    "best_agent": _t(f"SELECT agent_name, error_rate, mean_ms FROM ({REGISTRY}) ORDER BY error_rate, mean_ms, agent_name LIMIT 1"),
    "registry_stats": _t(f"SELECT agent_name, tasks, error_rate, round(mean_ms, 2) AS mean_ms FROM ({REGISTRY})"),
    "error_rate": _t("SELECT task_type, round(100.0 * CAST(count(*) FILTER (NOT success) AS DOUBLE) / count(*), 6) AS error_rate FROM tasks GROUP BY 1"),
    "latency_histogram": _t("SELECT task_type, " + ", ".join(f"count(*) FILTER (ms <= {b}) AS le_{b}" for b in (10, 100, 500, 1000, 5000)) + ", count(ms) AS n FROM tasks GROUP BY 1"),
    "health_rollup": _t("SELECT CASE WHEN bool_or(status = 'error') THEN 'degraded' WHEN bool_or(status = 'paused') THEN 'warning' ELSE 'ok' END AS health, count(*) AS n FROM sources", "sources"),
    "source_health": _t("SELECT t.channel_id, count(*) FILTER (NOT success AND (ok IS NULL OR (created_at, id) > (ok.created_at, ok.id))) AS fail_count, any_value(ok.created_at) AS last_success_at, max(created_at) FILTER (NOT success) AS last_error_at, max(created_at) AS last_attempt_at FROM tasks t LEFT JOIN (SELECT channel_id, max({'created_at': created_at, 'id': id}) AS ok FROM tasks WHERE success GROUP BY 1) o ON o.channel_id = t.channel_id GROUP BY 1"),
    "capability_lookup": _t("SELECT DISTINCT agent_name, task_type AS capability FROM tasks WHERE agent_name IN (SELECT 'agent_' || (CAST(substr(source_id, 8) AS INT) % 7) FROM sources)", "tasks", "sources"),
    "insert_if_absent": _t("SELECT source_ref, doc_id FROM raw WHERE doc_id % 4 = 0", "raw"),
    "conflicts": _t("SELECT source_ref, 'xx' AS lang, lang AS old_lang FROM raw WHERE doc_id % 9 = 0", "raw"),
    "upsert_latest": _t("SELECT source_ref, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state, date, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM raw", "raw"),
    "bundle_replace": _t("SELECT topic_id, time_from, max(version) AS version FROM (SELECT agent_name AS topic_id, NULL AS time_from, id AS version FROM tasks UNION ALL SELECT agent_name, expires_at, id + 1 FROM tasks) GROUP BY 1, 2"),
    "delete_by_key": _t("SELECT source_ref, attempts FROM failures WHERE doc_id % 4 = 0", "failures"),
}
