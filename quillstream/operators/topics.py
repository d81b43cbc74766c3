"""From proposed topics to cards, bundles and resolved sources; every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import ids, json_ops

TOPIC = ("channel_id", "topic_seq")


def dedup_anchors(proposals: DataFrame) -> DataFrame:
    """The first of a topic's anchors with the same reference."""
    order = Window.partitionBy(*TOPIC, "anchor_ref").orderBy("pos")
    return proposals.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def rank_anchors(proposals: DataFrame, keep: int = 3) -> DataFrame:
    """Anchors by score, null like 0, then reference; a cluster keeps the first `keep`, a singleton all."""
    order = Window.partitionBy(*TOPIC).orderBy(F.coalesce("score", F.lit(0.0)).desc(), "anchor_ref")
    ranked = dedup_anchors(proposals).withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where((F.col("type") == "singleton") | (F.col("rank") <= keep))


def gate(ranked: DataFrame, singleton_score: float = 0.75, singleton_length: int = 300, cluster_score: float = 0.6) -> DataFrame:
    """One row for each topic with passed: a singleton by its first anchor's score and text, a cluster by two anchors or more, all good."""
    first = F.min_by(F.struct("score", "text_length", "anchor_ref"), "rank")
    t = ranked.groupBy(*TOPIC, "type").agg(first.alias("first"), F.count("*").alias("anchors"), F.min(F.coalesce("score", F.lit(0.0))).alias("least"))
    passed = F.when(F.col("type") == "singleton", (F.coalesce("first.score", F.lit(0.0)) >= singleton_score) & (F.col("first.text_length") >= singleton_length)).otherwise((F.col("anchors") >= 2) & (F.col("least") >= cluster_score))
    return t.select(*TOPIC, "type", "anchors", F.concat(F.lit("topic:"), "first.anchor_ref").alias("topic_id"), passed.alias("passed"))


def graded(proposals: DataFrame, keep: int = 3, singleton_score: float = 0.75, singleton_length: int = 300, cluster_score: float = 0.6, least_score: float = 0.5) -> DataFrame:
    """Every proposal with topic_id, passed and anchors of its topic, and its own rank and role, of one shuffle by topic.

    rank: among the first proposals of each reference, null for others; role: anchor for those of rank_anchors, supporting for others that score
    enough, null for what is in no bundle; of equal references an anchor has the role, else the one that scores most.
    """
    topic = Window.partitionBy(*TOPIC)
    zero = F.coalesce("score", F.lit(0.0))
    p = proposals.repartition(*TOPIC)
    p = p.withColumn("__k", F.row_number().over(Window.partitionBy(*TOPIC, "anchor_ref").orderBy("pos")))
    p = p.withColumn("rank", F.when(F.col("__k") == 1, F.row_number().over(topic.orderBy(F.col("__k") != 1, zero.desc(), "anchor_ref"))).cast("int"))
    anchor = F.col("rank").isNotNull() & ((F.col("type") == "singleton") | (F.col("rank") <= keep))
    p = p.withColumn("__anchor", anchor)
    first = F.max(F.when(F.col("rank") == 1, F.struct(zero.alias("score"), "text_length", "anchor_ref"))).over(topic)
    p = p.withColumn("__first", first).withColumn("anchors", F.count_if("__anchor").over(topic)).withColumn("__least", F.min(F.when(F.col("__anchor"), zero)).over(topic))
    passed = F.when(F.col("type") == "singleton", (F.col("__first.score") >= singleton_score) & (F.col("__first.text_length") >= singleton_length)).otherwise((F.col("anchors") >= 2) & (F.col("__least") >= cluster_score))
    candidate = F.col("__anchor") | F.coalesce(F.col("score") >= least_score, F.lit(False))
    one = F.row_number().over(Window.partitionBy(*TOPIC, "anchor_ref").orderBy(~candidate, ~F.col("__anchor"), F.desc("score")))
    role = F.when(candidate & (one == 1), F.when(F.col("__anchor"), "anchor").otherwise("supporting"))
    return p.select(*proposals.columns, "rank", "anchors", F.concat(F.lit("topic:"), "__first.anchor_ref").alias("topic_id"), passed.alias("passed"), role.alias("role"))


def bundle_items(proposals: DataFrame) -> DataFrame:
    """Anchors of the topics that pass, and the channel's other proposals of the topic that score enough; an anchor wins."""
    good = graded(proposals).where("passed and role is not null")
    order = Window.partitionBy(*TOPIC).orderBy("role", F.coalesce("score", F.lit(0.0)).desc(), "anchor_ref")
    return good.select("topic_id", F.col("anchor_ref").alias("ref"), "role", "score", F.row_number().over(order).cast("int").alias("item"))


#: What a card says where the model named no scope (fixed values).
SCOPE_IN, SCOPE_OUT, TITLE = "General topic content", "Unrelated content", "Untitled Topic"
PARAMETERS = {"max_anchors": 3, "min_cluster_anchors": 2, "min_cluster_score": 0.6, "min_singleton_length": 300, "min_singleton_score": 0.75, "temperature": 0.0}


def anchor(channel: Column, ref: Column, score: Column) -> Column:
    return F.struct(ref.alias("anchor_ref"), ids.ref_part(ref, 1).alias("channel_id"), ids.ref_part(ref, 3).alias("message_id"), ids.ref_part(ref, 2).alias("message_type"), score.alias("score"))


def full_cards(proposals: DataFrame, told: DataFrame, as_of: Column, model: dict[str, str]) -> DataFrame:
    """The card of each topic that passes: what the model told of it (channel_id, topic_seq, title, summary, scope_in, scope_out, tags) with fall-backs.

    No or empty scopes are the usual ones, no title and summary are `Untitled Topic` and ''; tags may be null.  Anchors, three or all of a
    singleton, are in their order; those whose reference has not four parts are left out before they are ranked.
    """
    own = graded(proposals.where(ids.ref_part(F.col("anchor_ref"), 3).isNotNull())).where("passed and role = 'anchor'")
    anchors = F.transform(F.array_sort(F.collect_list(F.struct("rank", anchor(F.col("channel_id"), F.col("anchor_ref"), F.coalesce("score", F.lit(0.0))).alias("a")))), lambda x: x.getField("a"))
    t = own.groupBy(*TOPIC, "type", "topic_id").agg(anchors.alias("anchors")).join(told, list(TOPIC), "left")
    scope = lambda c, other: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(F.array(F.lit(other)))
    metadata = json_ops.canonical(algorithm=F.lit("llm_clustering"), input_scope=F.struct("channel_id", F.lit("full_history").alias("mode")), parameters=F.struct(*[F.lit(v).alias(k) for k, v in PARAMETERS.items()]), topicization_run_id=F.concat(F.lit("run_"), F.date_format(as_of, "yyyyMMdd_HHmmss")), **{k: F.lit(v) for k, v in model.items()})
    return t.select(F.col("topic_id").alias("id"), F.coalesce("title", F.lit(TITLE)).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), scope("scope_in", SCOPE_IN).alias("scope_in"), scope("scope_out", SCOPE_OUT).alias("scope_out"), "type", "anchors", F.array("channel_id").alias("sources"), as_of.alias("updated_at"), "tags", metadata.alias("metadata"))


def resolved_records(items: DataFrame, usernames: DataFrame) -> DataFrame:
    """items (topic_id, ref, role, score, justification) with place and record: a source as JSON, with what is there of it only.

    An anchor has no justification, a score of an anchor wins over that of an item.  A reference without four parts is left out.
    """
    part = lambda k: ids.ref_part(F.col("ref"), k)
    parts = items.where(part(3).isNotNull()).withColumns({"channel_id": part(1), "message_type": part(2), "message_id": part(3)})
    # one row for each channel, so Spark chooses the join by its size
    named = parts.join(usernames.select("channel_id", "username"), "channel_id", "left")
    why = F.when((F.col("role") != "anchor") & (F.length("justification") > 0), F.col("justification"))
    url = ids.message_url(F.col("channel_id"), F.col("username"), F.col("message_id"))
    record = F.to_json(F.struct("channel_id", why.alias("justification"), "message_id", "message_type", "role", "score", F.col("ref").alias("source_ref"), url.alias("telegram_url")))
    missing = F.col("score").isNull() | (F.col("score") == 0)
    order = Window.partitionBy("topic_id").orderBy("role", missing, F.desc("score"), "ref")
    return named.select("topic_id", "ref", "role", "score", F.row_number().over(order).cast("int").alias("place"), record.alias("record"))


def resolved_order(items: DataFrame) -> DataFrame:
    """Sources of a topic: anchors first, by score, null and 0 last, then reference."""
    missing = F.col("score").isNull() | (F.col("score") == 0)
    order = Window.partitionBy("topic_id").orderBy("role", missing, F.desc("score"), "ref")
    return items.select("topic_id", "ref", "role", "score", F.row_number().over(order).cast("int").alias("place"))


def kb_entries(cards: DataFrame) -> DataFrame:
    """Cards as knowledge-base entries: the summary with both scopes as content, the card's id as its only topic, no tags for null."""
    scope = lambda name: F.coalesce(F.array_join(name, ", "), F.lit(""))
    content = F.concat("summary", F.lit("\n\n**Scope In:** "), scope("scope_in"), F.lit("\n**Scope Out:** "), scope("scope_out"))
    return cards.select(F.concat(F.lit("kb:topic:"), "topic_id").alias("kb_id"), F.lit("topic").alias("source_type"), "topic_id", F.col("updated_at").alias("created_at"), "title", content.alias("content"), F.array("topic_id").alias("topics"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
