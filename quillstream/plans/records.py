"""Queries over stored records: contracts, lookups, jobs, agents, hand-offs, cards, bundles, exports and run options."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstream.functions import ids, text
from quillstream.operators import contracts, export, handoffs, keyed, topics
from quillstream.plans.analytics import RANKED, _cards, _ranked
from quillstream.sources import logical as L

C = F.col
#: Rows of a page and the channel that the scans below ask for.
PAGE, CHANNEL = 50, "src3"


def message_violations(s, d):
    """Messages that break a rule; every seventh one is given a wrong reference, every ninth no text."""
    m = L.raw_messages(s, d).withColumn("message_type", F.when(C("doc_id") % 11 == 0, "story").otherwise("post"))
    m = m.withColumn("source_ref", F.when(C("doc_id") % 7 == 0, F.concat(F.lit("tg:a:b:"), "source_ref")).otherwise(C("source_ref"))).withColumn("text", F.when(C("doc_id") % 9 != 0, C("text")))
    out = contracts.violations(m, contracts.message_rules())
    return out.where(F.size("violations") > 0).select("doc_id", F.array_join("violations", ",").alias("violations"))


def card_violations(s, d):
    """Topics that break a rule of cards, with the first three anchors of each by place."""
    first = L.proposals(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("channel_id", "topic_seq").orderBy("pos"))).where("rn <= 3")
    cards = first.groupBy("channel_id", "topic_seq", "type").agg(F.collect_list(F.struct("anchor_ref", "score")).alias("anchors"))
    out = contracts.violations(cards.withColumn("topic_id", F.concat_ws(":", "channel_id", "topic_seq")), contracts.card_rules())
    return out.where(F.size("violations") > 0).select("topic_id", "type", F.size("anchors").cast("long").alias("anchors"), F.array_join("violations", ",").alias("violations"))


def point_lookups(s, d, ref="tg:src10:post:10", job="job_7", agent="agent_3"):
    """One row of each store by its key; each filter reaches the scan or the columns that make the key."""
    r = L.raw_messages(s, d).where(C("source_ref") == ref).select(F.lit("raw").alias("store"), C("source_ref").alias("key"))
    p = L.processed_refs(s, d).where(C("source_ref") == ref).select(F.lit("processed"), "source_ref")
    j = L.jobs(s, d).where(C("job_id") == job).select(F.lit("job"), "job_id")
    a = L.agents(s, d).where(C("name") == agent).select(F.lit("agent"), "name")
    return r.union(p).union(j).union(a)


def _bundles(s, d):
    """Bundles of the topics: current ones for even topics, snapshots of a day for others; some hold for every channel."""
    return _ranked(s, d).select("channel_id", "topic_seq").distinct().selectExpr("concat(channel_id, '/', topic_seq) AS topic_id", "CASE WHEN topic_seq % 2 = 1 THEN timestamp_ntz'2024-01-01 00:00:00' END AS time_from", "CASE WHEN topic_seq % 2 = 1 THEN timestamp_ntz'2024-01-02 00:00:00' END AS time_to", "CASE WHEN topic_seq <> 4 THEN array(channel_id) END AS channels", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(topic_seq) AS updated_at")


def current_bundles(s, d):
    b = _bundles(s, d).where("time_from IS NULL AND time_to IS NULL").where(C("channels").isNull() | F.array_contains("channels", CHANNEL))
    return b.orderBy(F.desc("updated_at"), "topic_id").select("topic_id", "updated_at")


def cards_by_channel(s, d):
    c = _cards(s, d).where(F.array_contains("scope_in", CHANNEL))
    return c.orderBy(F.desc("updated_at"), "topic_id").select("topic_id", "updated_at")


def registry_counts(s, d):
    """Agents in total, active, by type and by capability, one row for each count."""
    a = L.agents(s, d)
    count = lambda df, name: df.groupBy(name.alias("what")).agg(F.count("*").alias("n"))
    by_type = count(a, F.concat(F.lit("type:"), "agent_type"))
    by_capability = count(a.select(F.explode("capabilities").alias("c")), F.concat(F.lit("capability:"), "c"))
    return count(a, F.lit("total")).union(count(a.where("is_active"), F.lit("active"))).union(by_type).union(by_capability)


def best_agent_for(s, d, capability="topics", preferred="export"):
    """The agent with the capability of least error rate, then least mean time, then name; of the preferred type if there is any."""
    a = L.agents(s, d).where(C("is_active") & F.array_contains("capabilities", capability))
    rate = text.ratio(C("errors"), C("tasks"))
    return a.orderBy((C("agent_type") != preferred).cast("int"), rate, "mean_ms", "name").limit(1).select("name", "agent_type", F.round(rate, 6).alias("error_rate"))


def merged_sources(s, d):
    """Anchors and items of the topics that pass, merged by reference: an anchor's role and score win, only others have a
    justification, and what is absent is absent from the JSON."""
    ranked = _ranked(s, d)
    good = topics.gate(ranked).where("passed").select(*topics.TOPIC, "topic_id")
    anchors = ranked.join(good, list(topics.TOPIC)).select("topic_id", C("anchor_ref").alias("ref"), C("score").alias("anchor_score"), F.lit(True).alias("is_anchor"))
    items = L.proposals(s, d).where("score >= 0.5").join(good, list(topics.TOPIC)).select("topic_id", C("anchor_ref").alias("ref"), C("score").alias("item_score"), F.concat(F.lit("as "), "type").alias("reason"))
    both = anchors.join(items, ["topic_id", "ref"], "full_outer")
    role = F.when(C("is_anchor"), "anchor").otherwise("supporting")
    record = F.to_json(F.struct(role.alias("role"), F.when(C("is_anchor").isNull(), C("reason")).alias("justification"), C("ref").alias("source_ref")))
    return both.select("topic_id", "ref", F.when(C("is_anchor"), C("anchor_score")).otherwise(C("item_score")).alias("score"), record.alias("record"))


def topic_details(s, d):
    """A detail for each topic that passes: the name of its file, its items and its sources in order."""
    items = topics.resolved_order(topics.bundle_items(L.proposals(s, d)))
    refs = F.transform(F.array_sort(F.collect_list(F.struct("place", "ref"))), lambda x: x.getField("ref"))
    t = items.groupBy("topic_id").agg(F.count("*").alias("n_items"), F.count_if(C("role") == "anchor").alias("n_anchors"), F.array_join(refs, ",").alias("sources"))
    return t.select("topic_id", export.detail_name(C("topic_id")).alias("file"), "n_items", "n_anchors", "sources")


def exported_lines(s, d):
    """Records of an export as canonical JSON lines, with their size in bytes."""
    m = L.raw_messages(s, d).select(ids.prefixed("kb:msg:", C("source_ref")).alias("id"), "channel_id", F.when(C("doc_id") % 3 == 0, C("lang")).alias("language"))
    return export.ndjson(m, "id").select("value", F.octet_length("value").cast("long").alias("bytes"))


def copied_tables(s, d):
    """Counts of a copied table and its source, of which the copy of tasks lacks a row, and whether all agree."""
    pairs = {"tasks": (L.tasks(s, d), L.tasks(s, d).where("id <> 5")), "handoffs": (L.handoffs(s, d), L.handoffs(s, d))}
    return export.verified(pairs)


def rendered_messages(s, d):
    """The numbered list of a channel's messages in a prompt; anchors are left out and leave gaps in the numbers."""
    p = L.proposals(s, d).where(C("channel_id") == CHANNEL).withColumn("n", F.row_number().over(Window.partitionBy("channel_id", "topic_seq").orderBy("pos")))
    rest = p.join(_ranked(s, d).select(*topics.TOPIC, "anchor_ref"), [*topics.TOPIC, "anchor_ref"], "left_anti")
    return rest.select("topic_seq", "n", F.format_string("%d. [%s] score: %s", "n", "anchor_ref", F.coalesce(F.format_number("score", 2), F.lit("N/A"))).alias("line"))


def run_selection(s, d, force=False, retry_failed=True, limit=None):
    """Messages that a run takes: all with force; the failed ones with retry_failed; else those neither done nor failed."""
    m = L.raw_messages(s, d)
    if not force:
        done, failed = L.processed_refs(s, d).select("source_ref"), L.failures(s, d).select("source_ref")
        m = m.join(failed, "source_ref", "left_semi") if retry_failed else m.join(done, "source_ref", "left_anti").join(failed, "source_ref", "left_anti")
    out = m.select("source_ref", "date")
    return out.orderBy("date", "source_ref").limit(limit) if limit else out


def singleton_lengths(s, d):
    """Whether a singleton's first anchor is long enough; one whose document is not there fails."""
    first = topics.rank_anchors(L.proposals(s, d)).where("type = 'singleton' AND rank = 1").select("channel_id", "anchor_ref")
    docs = L.processed_refs(s, d).select(C("source_ref").alias("anchor_ref"), "doc_id").join(L.raw_messages(s, d).select("doc_id", F.length("text").alias("n")), "doc_id")
    return first.join(docs, "anchor_ref", "left").select("channel_id", "anchor_ref", F.coalesce(C("n") >= 300, F.lit(False)).alias("passed"))


def row_codecs(s, d):
    """Lists as JSON text, null where empty, and back, empty where null."""
    lists = L.raw_messages(s, d).select("doc_id", F.when(C("doc_id") % 3 == 0, F.array()).when(C("doc_id") % 3 == 1, F.array("lang", "channel_id")).cast("array<string>").alias("tags"))
    packed = lists.select("doc_id", F.when(F.size("tags") > 0, F.to_json("tags")).alias("packed"))
    return packed.select("doc_id", "packed", F.size(F.coalesce(F.from_json("packed", "array<string>"), F.array())).cast("long").alias("n"))


def media(s, d):
    """Media of a message as a nested record, from its payload; null where there is none."""
    k = F.get_json_object("props", "$.k").cast("long")
    m = F.when(k % 3 == 0, F.struct(F.lit("photo").alias("type"), F.lit(True).alias("has_photo"), F.lit(False).alias("has_document"), F.lit(None).cast("string").alias("mime"), (k * 1024).alias("size"))).when(k % 3 == 1, F.struct(F.lit("document").alias("type"), F.lit(False).alias("has_photo"), F.lit(True).alias("has_document"), F.lit("application/pdf").alias("mime"), (k * 2048).alias("size")))
    return L.read(s, d, "events").select("event_id", m.alias("media")).select("event_id", "media.type", "media.has_photo", "media.has_document", "media.mime", "media.size")


def _page(df, *order):
    return df.orderBy(*order).limit(PAGE)



QUERIES = {
    "contract_violations": message_violations,
    "card_violations": card_violations,
    "point_lookups": point_lookups,
    "processed_page": lambda s, d: _page(L.processed_refs(s, d).where("date >= TIMESTAMP_NTZ '2024-01-01 02:00:00'"), "date", "source_ref").select("source_ref", "date"),
    "cards_by_channel": cards_by_channel,
    "current_bundles": current_bundles,
    "job_list": lambda s, d: _page(L.jobs(s, d).where("job_type = 'export' AND status = 'completed'"), F.desc("created_at"), "job_id").select("job_id", "created_at"),
    "job_update": lambda s, d: keyed.upsert(L.jobs(s, d).selectExpr("job_id", "job_type", "status", "progress", "1 AS version"), L.jobs(s, d).where("progress % 2 = 0").selectExpr("job_id", "'other' AS job_type", "'cancelled' AS status", "100L AS progress", "2 AS version"), ["job_id"], "version", ["job_type"]),
    "expired_jobs": lambda s, d: L.jobs(s, d).where("created_at < TIMESTAMP_NTZ '1996-01-01 00:00:00' AND status IN ('completed', 'failed')").agg(F.count("*").alias("expired")),
    "agent_list": lambda s, d: L.agents(s, d).where("agent_type = 'process' AND is_active").orderBy("name").select("name", "agent_type"),
    "task_history_by_channel": lambda s, d: L.tasks(s, d).where("channel_id = 'src3' AND created_at >= TIMESTAMP_NTZ '2024-01-02 00:00:00' AND created_at <= TIMESTAMP_NTZ '2024-01-20 00:00:00'").orderBy(F.desc("created_at"), "id").limit(100).select("id", "created_at"),
    "handoffs_by_target": lambda s, d: _page(L.handoffs(s, d).where("target_agent = 'agent_2'"), F.desc("created_at"), "id").select("id", "source_agent", "status"),
    "handoff_updates": lambda s, d: handoffs.fold(L.handoff_events(s, d)),
    "registry_counts": registry_counts,
    "registry_health": lambda s, d: L.agents(s, d).agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.array_join(F.array_sort(F.collect_set("agent_type")), ",").alias("types")),
    "capability_index": lambda s, d: L.agents(s, d).select(F.explode("capabilities").alias("capability"), "name"),
    "best_agent_for": best_agent_for,
    "merged_sources": merged_sources,
    "topic_details": topic_details,
    "topic_catalogue": lambda s, d: export.catalogue(_cards(s, d).select("topic_id", "summary"), "topic_id", ["summary"]),
    "exported_lines": exported_lines,
    "copied_tables": copied_tables,
    "rendered_messages": rendered_messages,
    "run_selection": run_selection,
    "singleton_lengths": singleton_lengths,
    "row_codecs": row_codecs,
    "media": media,
    "iso_dates": lambda s, d: L.raw_messages(s, d).select("doc_id", text.iso(C("date")).alias("iso"), (text.parse_iso(F.concat(text.iso(C("date")), F.lit("Z"))) == C("date")).alias("same")),
    "durations": lambda s, d: L.tasks(s, d).select("id", text.duration_ms(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), C("created_at")).alias("ms")),
}

_t = L.with_tables
_CARDS = "SELECT topic_id, type, channel_id, anchors, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(last AS INTEGER)) AS updated_at FROM gate JOIN (SELECT channel_id, topic_seq, max(pos) AS last FROM ranked GROUP BY 1, 2) USING (channel_id, topic_seq) WHERE passed"
_RESOLVED = "SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY role, score IS NULL OR score = 0, score DESC NULLS LAST, ref) AS place FROM items"
ORACLES = {
    "contract_violations": _t("SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 9 = 0 OR text IS NULL THEN 'text_missing' END, CASE WHEN doc_id % 7 = 0 THEN 'source_ref_form' END, CASE WHEN doc_id % 11 = 0 THEN 'message_type_known' END) AS violations FROM raw WHERE doc_id % 9 = 0 OR text IS NULL OR doc_id % 7 = 0 OR doc_id % 11 = 0", "raw"),
    "card_violations": _t("SELECT channel_id || ':' || topic_seq AS topic_id, type, count(*) AS anchors, 'anchors_of_type' AS violations FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, topic_seq ORDER BY pos) AS rn FROM proposals) WHERE rn <= 3 GROUP BY channel_id, topic_seq, type HAVING type = 'cluster' AND (count(*) < 2 OR count(score) < count(*))", "proposals"),
    "point_lookups": _t("SELECT 'raw' AS store, source_ref AS key FROM raw WHERE source_ref = 'tg:src10:post:10' UNION ALL SELECT 'processed', source_ref FROM processed WHERE source_ref = 'tg:src10:post:10' UNION ALL SELECT 'job', job_id FROM jobs WHERE job_id = 'job_7' UNION ALL SELECT 'agent', name FROM agents WHERE name = 'agent_3'", "raw", "processed", "jobs", "agents"),
    "processed_page": _t(f"SELECT source_ref, date FROM processed WHERE date >= TIMESTAMP '2024-01-01 02:00:00' ORDER BY date, source_ref LIMIT {PAGE}", "processed"),
    "cards_by_channel": _t(f"SELECT topic_id, updated_at FROM cards WHERE channel_id = '{CHANNEL}'", "proposals", **RANKED, cards=_CARDS),
    "current_bundles": _t(f"SELECT DISTINCT channel_id || '/' || topic_seq AS topic_id, TIMESTAMP '2024-01-01 00:00:00' + to_days(topic_seq) AS updated_at FROM ranked WHERE topic_seq % 2 = 0 AND (topic_seq = 4 OR channel_id = '{CHANNEL}')", "proposals", **RANKED),
    "job_list": _t(f"SELECT job_id, created_at FROM jobs WHERE job_type = 'export' AND status = 'completed' ORDER BY created_at DESC, job_id LIMIT {PAGE}", "jobs"),
    "job_update": _t("SELECT job_id, job_type, CASE WHEN progress % 2 = 0 THEN 'cancelled' ELSE status END AS status, CASE WHEN progress % 2 = 0 THEN 100 ELSE progress END AS progress, CASE WHEN progress % 2 = 0 THEN 2 ELSE 1 END AS version FROM jobs", "jobs"),
    "expired_jobs": _t("SELECT count(*) AS expired FROM jobs WHERE created_at < TIMESTAMP '1996-01-01' AND status IN ('completed', 'failed')", "jobs"),
    "agent_list": _t("SELECT name, agent_type FROM agents WHERE agent_type = 'process' AND is_active", "agents"),
    "task_history_by_channel": _t("SELECT id, created_at FROM tasks WHERE channel_id = 'src3' AND created_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20' ORDER BY created_at DESC, id LIMIT 100", "tasks"),
    "handoffs_by_target": _t(f"SELECT id, source_agent, status FROM handoffs WHERE target_agent = 'agent_2' ORDER BY created_at DESC, id LIMIT {PAGE}", "handoffs"),
    "handoff_updates": _t("SELECT id, CASE WHEN status = 'pending' THEN 'accepted' ELSE status END AS status, CASE WHEN status IN ('pending', 'accepted') THEN 'started' WHEN status = 'completed' THEN 'r' || id END AS result, CASE WHEN status = 'failed' THEN 'boom' END AS error, CASE WHEN status NOT IN ('pending', 'accepted') THEN ms END AS ms, created_at + INTERVAL 1 HOUR AS accepted_at, CASE WHEN status NOT IN ('pending', 'accepted') THEN created_at + INTERVAL 2 HOUR END AS completed_at FROM handoffs", "handoffs"),
    "registry_counts": _t("SELECT 'total' AS what, count(*) AS n FROM agents UNION ALL SELECT 'active', count(*) FROM agents WHERE is_active UNION ALL SELECT 'type:' || agent_type, count(*) FROM agents GROUP BY 1 UNION ALL SELECT 'capability:' || c, count(*) FROM (SELECT unnest(capabilities) AS c FROM agents) GROUP BY 1", "agents"),
    "registry_health": _t("SELECT count(*) AS total, count(*) FILTER (is_active) AS active, string_agg(DISTINCT agent_type, ',' ORDER BY agent_type) AS types FROM agents", "agents"),
    "capability_index": _t("SELECT unnest(capabilities) AS capability, name FROM agents", "agents"),
    "best_agent_for": _t("SELECT name, agent_type, round(r, 6) AS error_rate FROM (SELECT *, coalesce(CAST(errors AS DOUBLE) / nullif(tasks, 0), 0) AS r FROM agents) WHERE is_active AND list_contains(capabilities, 'topics') ORDER BY agent_type <> 'export', r, mean_ms, name LIMIT 1", "agents"),
    "merged_sources": _t("SELECT coalesce(a.topic_id, i.topic_id) AS topic_id, coalesce(a.ref, i.ref) AS ref, CASE WHEN a.ref IS NOT NULL THEN a.score ELSE i.score END AS score, CASE WHEN a.ref IS NOT NULL THEN '{\"role\":\"anchor\",\"source_ref\":\"' || a.ref || '\"}' ELSE '{\"role\":\"supporting\",\"justification\":\"as ' || i.type || '\",\"source_ref\":\"' || i.ref || '\"}' END AS record FROM (SELECT topic_id, anchor_ref AS ref, score FROM ranked JOIN good USING (channel_id, topic_seq)) a FULL JOIN (SELECT topic_id, anchor_ref AS ref, score, type FROM proposals JOIN good USING (channel_id, topic_seq) WHERE score >= 0.5) i ON a.topic_id = i.topic_id AND a.ref = i.ref", "proposals", **RANKED),
    "topic_details": _t("SELECT topic_id, 'topic_' || replace(topic_id, ':', '_') || '.json' AS file, count(*) AS n_items, count(*) FILTER (role = 'anchor') AS n_anchors, string_agg(ref, ',' ORDER BY place) AS sources FROM resolved GROUP BY topic_id", "proposals", **RANKED, resolved=_RESOLVED),
    "topic_catalogue": _t("SELECT '[' || string_agg('{\"topic_id\":\"' || topic_id || '\",\"summary\":\"' || type || ' of ' || anchors || '\"}', ',' ORDER BY topic_id) || ']' AS value FROM cards", "proposals", **RANKED, cards=_CARDS),
    "exported_lines": _t("SELECT value, strlen(value) AS bytes FROM (SELECT '{\"channel_id\":\"' || channel_id || '\",\"id\":\"kb:msg:' || source_ref || '\",\"language\":' || CASE WHEN doc_id % 3 = 0 THEN '\"' || lang || '\"' ELSE 'null' END || '}' AS value FROM raw)", "raw"),
    "copied_tables": _t("SELECT 'tasks' AS name, count(*) AS n_source, count(*) FILTER (id <> 5) AS n_target, false AS equal FROM tasks UNION ALL SELECT 'handoffs', count(*), count(*), true FROM handoffs", "tasks", "handoffs"),
    "rendered_messages": _t(f"SELECT topic_seq, CAST(n AS INTEGER) AS n, n || '. [' || anchor_ref || '] score: ' || CASE WHEN score IS NULL THEN 'N/A' ELSE printf('%.2f', score) END AS line FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, topic_seq ORDER BY pos) AS n FROM proposals WHERE channel_id = '{CHANNEL}') p WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.channel_id = p.channel_id AND r.topic_seq = p.topic_seq AND r.anchor_ref = p.anchor_ref)", "proposals", **RANKED),
    "run_selection": _t("SELECT source_ref, date FROM raw WHERE source_ref IN (SELECT source_ref FROM failures)", "raw", "failures"),
    "singleton_lengths": _t("SELECT r.channel_id, anchor_ref, coalesce(text_length >= 300 AND p.source_ref IS NOT NULL, false) AS passed FROM ranked r LEFT JOIN processed p ON p.source_ref = anchor_ref WHERE type = 'singleton' AND rank = 1", "processed", "proposals", **RANKED),
    "row_codecs": _t("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN '[\"' || lang || '\",\"' || channel_id || '\"]' END AS packed, CAST(CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 0 END AS BIGINT) AS n FROM raw", "raw"),
    "media": "SELECT event_id, CASE k % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'document' END AS type, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_photo, CASE k % 3 WHEN 0 THEN false WHEN 1 THEN true END AS has_document, CASE k % 3 WHEN 1 THEN 'application/pdf' END AS mime, CASE k % 3 WHEN 0 THEN k * 1024 WHEN 1 THEN k * 2048 END AS size FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)",
    "iso_dates": _t("SELECT doc_id, strftime(date, '%Y-%m-%dT%H:%M:%S') AS iso, true AS same FROM raw", "raw"),
    "durations": _t("SELECT id, CAST(floor((epoch_us(created_at) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000) AS BIGINT) AS ms FROM tasks", "tasks"),
}
