"""What the pipeline hands on in full: cards, resolved sources, details, entries and the agents' export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quillstream.functions import ids, json_ops, text
from quillstream.operators import export, topics
from quillstream.plans.analytics import RANKED
from quillstream.plans.messages import KB_CTE
from quillstream.sources import logical as L

C = F.col
AS_OF, VERSION = "2024-06-01 00:00:00", "export:v1.0.0"
MODEL = {"model_id": "m1", "pipeline_version": "v1", "prompt_id": "sha256:0", "prompt_name": "topics"}


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _told(s, d):
    """What the model told of a topic: nothing at all of every fifth, no scopes of others."""
    t = L.proposals(s, d).select("channel_id", "topic_seq", "type").distinct()
    return t.selectExpr("channel_id", "topic_seq", "CASE WHEN topic_seq <> 4 THEN concat('About ', type) END AS title", "CASE WHEN topic_seq <> 4 THEN channel_id END AS summary", "CASE WHEN topic_seq < 3 THEN array(type, channel_id) WHEN topic_seq = 3 THEN array() END AS scope_in", "CASE WHEN topic_seq > 3 THEN array('other') END AS scope_out", "CASE WHEN topic_seq = 2 THEN array('two') END AS tags")


def _items(s, d):
    return topics.bundle_items(L.proposals(s, d)).withColumn("justification", F.when(C("item") % 2 == 0, F.concat(F.lit("as "), "role")))


def cards_in_full(s, d):
    c = topics.full_cards(L.proposals(s, d), _told(s, d), _as_of(), MODEL)
    joined = {c: F.array_join(c, "|") for c in ("scope_in", "scope_out", "sources", "tags")}
    return c.withColumns(joined).withColumn("anchors", F.to_json("anchors"))


def sources_in_full(s, d):
    """A source of a topic with its place and its record: link, score and justification where there are any."""
    return topics.resolved_records(_items(s, d), L.sources(s, d))


def details_in_full(s, d):
    """The file of each topic, in lines that make it up one after the other: time and version, sources, the bundle's items, the card.

    A line is a row, so a topic of any size is spread; a writer sorts by part and line.
    """
    items = _items(s, d)
    part = lambda k: ids.ref_part(C("ref"), k)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = json_ops.canonical(channel_id=part(1), justification=C("justification"), message_id=part(3), message_type=part(2), role=C("role"), score=C("score"), source_ref=C("ref"))
    cards = topics.full_cards(L.proposals(s, d), _told(s, d), _as_of(), MODEL)
    told = json_ops.canonical(**{c: stamp(c) if c == "updated_at" else C(c) for c in cards.columns if c != "metadata"})
    # the metadata is JSON already
    made = cards.select(C("id").alias("topic_id"), told.alias("card"), "metadata").withColumn("card", F.concat(F.expr("left(card, length(card) - 1)"), F.lit(',"metadata":'), "metadata", F.lit("}")))
    line = lambda df, n, at, value: df.select("topic_id", F.lit(n).alias("part"), at.alias("line"), value.alias("value"))
    comma = lambda at: F.when(at > 1, ",").otherwise("")
    one = F.lit(1)
    head = F.concat(F.lit(f'{{"export_version":"{VERSION}","exported_at":"'), stamp(_as_of()), F.lit('","resolved_sources":['))
    foot = F.concat(F.lit('],"topic_id":"'), "topic_id", F.lit('","updated_at":"'), stamp(_as_of()), F.lit('"},"topic_card":'), "card", F.lit("}"))
    parts = [
        line(made, 0, one, head),
        line(topics.resolved_records(items, L.sources(s, d)), 1, C("place"), F.concat(comma(C("place")), "record")),
        line(made, 2, one, F.lit('],"topic_bundle":{"items":[')),
        line(items, 3, C("item"), F.concat(comma(C("item")), item)),
        line(made, 4, one, foot),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("file", export.detail_name(C("topic_id")))


def entries_in_full(s, d):
    """Messages as whole entries: the source as a record, and metadata of what is known: how it was processed, and its link."""
    m = L.cleaned_messages(s, d).withColumn("summary", text.lead_summary(C("c"))).join(L.sources(s, d).select("channel_id", "username"), "channel_id", "left")
    source = json_ops.canonical(channel_id=C("channel_id"), message_id=C("id"), message_type=ids.ref_kind(C("source_ref")), source_ref=C("source_ref"), type=F.lit("telegram_message"))
    how = F.when(C("doc_id") % 3 == 0, F.struct(C("lang").alias("language"), F.lit(MODEL["model_id"]).alias("model_id")))
    metadata = F.to_json(F.struct(how.alias("processing"), ids.message_url(C("channel_id"), C("username"), C("id")).alias("telegram_url")))
    content = F.when(F.length("summary") > 0, F.concat_ws("\n\n", "summary", "c")).otherwise(C("c"))
    return m.select(ids.prefixed("kb:msg:", C("source_ref")).alias("id"), source.alias("source"), C("date").alias("created_at"), F.concat(F.lit("Message "), "id").alias("title"), content.alias("content"), F.array_join(text.keyword_topics(C("low")), ",").alias("topics"), F.nullif(metadata, F.lit("{}")).alias("metadata"))


def topic_entries_in_full(s, d):
    """Cards as whole entries; metadata has the card's own and the resolved sources.

    An entry is one record, so all sources of its topic meet in it; sources_in_full has them as rows.
    """
    cards = topics.full_cards(L.proposals(s, d), _told(s, d), _as_of(), MODEL)
    sources = sources_in_full(s, d).groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "record"))), lambda x: x.getField("record")).alias("records"))
    e = cards.join(sources, cards["id"] == sources["topic_id"]).drop("topic_id")
    metadata = F.concat(F.lit('{"resolved_sources":['), F.array_join("records", ","), F.lit('],"topic_card":'), "metadata", F.lit("}"))
    kb = topics.kb_entries(e.withColumnRenamed("id", "topic_id").withColumn("summary", C("summary"))).withColumns({c: F.array_join(c, ",") for c in ("topics", "tags")})
    return kb.join(e.select(C("id").alias("topic_id"), metadata.alias("metadata")), "topic_id")


def agent_lines(s, d):
    """Documents as agents export them: eight fields, with defaults for what a document lacks."""
    m = L.raw_messages(s, d).select(F.when(C("doc_id") % 5 != 0, ids.prefixed("doc:", C("source_ref"))).alias("id"), "source_ref", F.when(C("doc_id") % 7 != 0, F.length("text").cast("string")).alias("text_clean"), F.when(C("doc_id") % 2 == 0, C("channel_id")).alias("summary"), F.when(C("doc_id") % 3 == 0, F.array("lang")).alias("topics"), F.lit(None).cast("array<struct<type:string,value:string>>").alias("entities"), F.when(C("lang") != "en", C("lang")).alias("language"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return export.agent_lines(m).select("source_ref", "value")


QUERIES = {"cards_in_full": cards_in_full, "sources_in_full": sources_in_full, "details_in_full": details_in_full, "entries_in_full": entries_in_full, "topic_entries_in_full": topic_entries_in_full, "agent_lines": agent_lines}

_t = L.with_tables
_META = "'{\"algorithm\":\"llm_clustering\",\"input_scope\":{\"channel_id\":\"' || channel_id || '\",\"mode\":\"full_history\"},\"model_id\":\"m1\",\"parameters\":{\"max_anchors\":3,\"min_cluster_anchors\":2,\"min_cluster_score\":0.6,\"min_singleton_length\":300,\"min_singleton_score\":0.75,\"temperature\":0.0},\"pipeline_version\":\"v1\",\"prompt_id\":\"sha256:0\",\"prompt_name\":\"topics\",\"topicization_run_id\":\"run_20240601_000000\"}'"
_ANCHOR = "'{\"anchor_ref\":\"' || anchor_ref || '\",\"channel_id\":\"' || channel_id || '\",\"message_id\":\"' || pos || '\",\"message_type\":\"post\",\"score\":' || coalesce(score, 0.0::DOUBLE) || '}'"
CARD = {
    "card": f"SELECT g.topic_id AS id, CASE WHEN g.topic_seq <> 4 THEN 'About ' || g.type ELSE 'Untitled Topic' END AS title, CASE WHEN g.topic_seq <> 4 THEN g.channel_id ELSE '' END AS summary, CASE WHEN g.topic_seq < 3 THEN g.type || '|' || g.channel_id ELSE 'General topic content' END AS scope_in, CASE WHEN g.topic_seq > 3 THEN 'other' ELSE 'Unrelated content' END AS scope_out, g.type, a.anchors, g.channel_id AS sources, TIMESTAMP '{AS_OF}' AS updated_at, CASE WHEN g.topic_seq = 2 THEN 'two' END AS tags, {_META.replace('channel_id ||', 'g.channel_id ||')} AS metadata FROM gate g JOIN (SELECT channel_id, topic_seq, '[' || string_agg({_ANCHOR}, ',' ORDER BY rank) || ']' AS anchors FROM ranked GROUP BY channel_id, topic_seq) a USING (channel_id, topic_seq) WHERE passed",
    "item": "SELECT *, CASE WHEN item % 2 = 0 THEN 'as ' || role END AS justification, split_part(ref, ':', 2) AS channel_id, split_part(ref, ':', 4) AS message_id FROM bundle",
    "source": "SELECT i.topic_id, ref, role, score, CAST(row_number() OVER (PARTITION BY i.topic_id ORDER BY role, score IS NULL OR score = 0, score DESC NULLS LAST, ref) AS INTEGER) AS place, '{\"channel_id\":\"' || i.channel_id || '\"' || CASE WHEN role <> 'anchor' AND justification IS NOT NULL THEN ',\"justification\":\"' || justification || '\"' ELSE '' END || ',\"message_id\":\"' || message_id || '\",\"message_type\":\"post\",\"role\":\"' || role || '\"' || coalesce(',\"score\":' || score, '') || ',\"source_ref\":\"' || ref || '\"' || coalesce(',\"telegram_url\":\"https://t.me/' || CASE WHEN length(username) > 0 THEN username WHEN regexp_matches(i.channel_id, '^[A-Za-z0-9_]{5,}$') THEN i.channel_id END || '/' || message_id || '\"', '') || '}' AS record FROM item i LEFT JOIN sources s ON s.channel_id = i.channel_id",
}
_FULL = ("proposals", "sources")
_LIST = lambda c: f"'[\"' || replace({c}, '|', '\",\"') || '\"]'"
ORACLES = {
    "cards_in_full": _t("SELECT * FROM card", *_FULL, **RANKED, **CARD),
    "sources_in_full": _t("SELECT * FROM source", *_FULL, **RANKED, **CARD),
    "details_in_full": _t(f"SELECT *, 'topic_' || replace(topic_id, ':', '_') || '.json' AS file FROM (SELECT id AS topic_id, 0 AS part, 1 AS line, '{{\"export_version\":\"{VERSION}\",\"exported_at\":\"2024-06-01T00:00:00Z\",\"resolved_sources\":[' AS value FROM card UNION ALL SELECT topic_id, 1, place, CASE WHEN place > 1 THEN ',' ELSE '' END || record FROM source UNION ALL SELECT id, 2, 1, '],\"topic_bundle\":{{\"items\":[' FROM card UNION ALL SELECT topic_id, 3, item, CASE WHEN item > 1 THEN ',' ELSE '' END || '{{\"channel_id\":\"' || channel_id || '\",\"justification\":' || CASE WHEN justification IS NULL THEN 'null' ELSE '\"' || justification || '\"' END || ',\"message_id\":\"' || message_id || '\",\"message_type\":\"post\",\"role\":\"' || role || '\",\"score\":' || coalesce(CAST(score AS VARCHAR), 'null') || ',\"source_ref\":\"' || ref || '\"}}' FROM item UNION ALL SELECT id, 4, 1, '],\"topic_id\":\"' || id || '\",\"updated_at\":\"2024-06-01T00:00:00Z\"}},\"topic_card\":{{\"anchors\":' || anchors || ',\"id\":\"' || id || '\",\"scope_in\":' || {_LIST('scope_in')} || ',\"scope_out\":' || {_LIST('scope_out')} || ',\"sources\":' || {_LIST('sources')} || ',\"summary\":\"' || summary || '\",\"tags\":' || CASE WHEN tags IS NULL THEN 'null' ELSE {_LIST('tags')} END || ',\"title\":\"' || title || '\",\"type\":\"' || type || '\",\"updated_at\":\"2024-06-01T00:00:00Z\",\"metadata\":' || metadata || '}}}}' FROM card)", *_FULL, **RANKED, **CARD),
    "entries_in_full": _t("SELECT kb_id AS id, '{\"channel_id\":\"' || k.channel_id || '\",\"message_id\":\"' || r.id || '\",\"message_type\":\"post\",\"source_ref\":\"' || r.source_ref || '\",\"type\":\"telegram_message\"}' AS source, r.date AS created_at, title, CASE WHEN length(summary) > 0 THEN summary || chr(10) || chr(10) || c ELSE c END AS content, topics, CASE WHEN k.doc_id % 3 = 0 AND url IS NOT NULL THEN '{\"processing\":{\"language\":\"' || r.lang || '\",\"model_id\":\"m1\"},\"telegram_url\":\"' || url || '\"}' WHEN k.doc_id % 3 = 0 THEN '{\"processing\":{\"language\":\"' || r.lang || '\",\"model_id\":\"m1\"}}' WHEN url IS NOT NULL THEN '{\"telegram_url\":\"' || url || '\"}' END AS metadata FROM kb k JOIN raw r USING (doc_id)", "raw", "sources", **KB_CTE),
    "topic_entries_in_full": _t("SELECT c.id AS topic_id, 'kb:topic:' || c.id AS kb_id, 'topic' AS source_type, updated_at AS created_at, title, summary || chr(10) || chr(10) || '**Scope In:** ' || replace(scope_in, '|', ', ') || chr(10) || '**Scope Out:** ' || scope_out AS content, c.id AS topics, coalesce(tags, '') AS tags, '{\"resolved_sources\":[' || v || '],\"topic_card\":' || metadata || '}' AS metadata FROM card c JOIN (SELECT topic_id, string_agg(record, ',' ORDER BY place) AS v FROM source GROUP BY 1) r ON r.topic_id = c.id", *_FULL, **RANKED, **CARD),
    "agent_lines": _t("SELECT source_ref, '{\"id\":\"' || CASE WHEN doc_id % 5 <> 0 THEN 'doc:' ELSE '' END || source_ref || '\",\"source_ref\":\"' || source_ref || '\",\"text\":\"' || CASE WHEN doc_id % 7 <> 0 THEN CAST(length(text) AS VARCHAR) ELSE '' END || '\",\"summary\":' || CASE WHEN doc_id % 2 = 0 THEN '\"' || channel_id || '\"' ELSE 'null' END || ',\"topics\":' || CASE WHEN doc_id % 3 = 0 THEN '[\"' || lang || '\"]' ELSE '[]' END || ',\"entities\":[],\"language\":\"' || CASE WHEN lang <> 'en' THEN lang ELSE 'unknown' END || '\",\"metadata\":{}}' AS value FROM raw", "raw"),
}
