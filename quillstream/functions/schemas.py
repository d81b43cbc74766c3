"""The contracts of the records that stages hand to each other, as schema documents (fixed values)."""

from __future__ import annotations

REF = "^tg:[^:]+:(post|comment):[^:]+$"
TEXT, NUMBER, OBJECT = {"type": "string"}, {"type": "number"}, {"type": "object"}
TEXTS = {"type": "array", "items": TEXT}
SOME_TEXTS = TEXTS | {"minItems": 1}
MESSAGE_TYPE = {"type": "string", "enum": ["post", "comment"]}

RAW_MESSAGE = {
    "type": "object",
    "required": ["id", "message_type", "source_ref", "channel_id", "date", "text"],
    "properties": {
        "id": TEXT,
        "message_type": MESSAGE_TYPE,
        "source_ref": TEXT | {"pattern": REF},
        "channel_id": TEXT,
        "date": TEXT,
        "text": TEXT,
        "parent_message_id": TEXT,
        "thread_id": TEXT,
        "language": TEXT,
        "raw_payload": OBJECT,
    },
}

PROCESSED_DOCUMENT = {
    "type": "object",
    "required": ["id", "source_ref", "source_message_id", "channel_id", "processed_at", "text_clean"],
    "properties": {
        "id": TEXT,
        "source_ref": TEXT | {"pattern": REF},
        "source_message_id": TEXT,
        "channel_id": TEXT,
        "processed_at": TEXT,
        "text_clean": TEXT,
        "summary": TEXT,
        "topics": TEXTS,
        "entities": {"type": "array", "items": {"type": "object", "required": ["type", "value"], "properties": {"type": TEXT, "value": TEXT, "confidence": NUMBER}}},
        "language": TEXT,
        "metadata": {"type": "object", "properties": {"pipeline_version": TEXT, "model_id": TEXT, "prompt_id": TEXT, "prompt_name": TEXT, "parameters": OBJECT}},
    },
}

ANCHOR = ["channel_id", "message_id", "message_type", "anchor_ref"]
TOPIC_CARD = {
    "type": "object",
    "required": ["id", "title", "summary", "scope_in", "scope_out", "type", "anchors", "sources", "updated_at"],
    "properties": {
        "id": TEXT,
        "title": TEXT,
        "summary": TEXT,
        "scope_in": SOME_TEXTS,
        "scope_out": SOME_TEXTS,
        "type": {"type": "string", "enum": ["singleton", "cluster"]},
        "anchors": {
            "type": "array",
            "minItems": 1,
            "items": {"type": "object", "required": ANCHOR, "properties": {"channel_id": TEXT, "message_id": TEXT, "message_type": MESSAGE_TYPE, "anchor_ref": TEXT | {"pattern": REF}, "score": NUMBER, "parent_message_id": TEXT, "thread_id": TEXT}},
        },
        "sources": SOME_TEXTS,
        "updated_at": TEXT,
        "tags": TEXTS,
        "related_topics": TEXTS,
        "status": TEXT,
        "metadata": OBJECT,
    },
    "allOf": [
        {
            "if": {"properties": {"type": {"const": "cluster"}}, "required": ["type"]},
            "then": {"properties": {"anchors": {"minItems": 2, "items": {"required": [*ANCHOR, "score"]}}}},
        }
    ],
}

TOPIC_BUNDLE = {
    "type": "object",
    "required": ["topic_id", "items", "updated_at"],
    "properties": {
        "topic_id": TEXT,
        "items": {
            "type": "array",
            "minItems": 1,
            "items": {
                "type": "object",
                "required": ["channel_id", "message_id", "message_type", "source_ref", "role"],
                "properties": {"channel_id": TEXT, "message_id": TEXT, "message_type": MESSAGE_TYPE, "source_ref": TEXT | {"pattern": REF}, "role": {"type": "string", "enum": ["anchor", "supporting"]}, "parent_message_id": TEXT, "thread_id": TEXT, "score": NUMBER, "justification": TEXT},
            },
        },
        "updated_at": TEXT,
        "time_range": {"type": "object", "properties": {"from": TEXT, "to": TEXT}},
        "channels": TEXTS,
        "metadata": OBJECT,
    },
}

KNOWLEDGE_BASE_ENTRY = {
    "type": "object",
    "required": ["id", "source", "created_at", "title", "content"],
    "properties": {
        "id": TEXT,
        "source": {"type": "object", "required": ["type"], "properties": {"type": TEXT, "channel_id": TEXT, "message_id": TEXT, "message_type": MESSAGE_TYPE, "source_ref": TEXT, "topic_id": TEXT}},
        "created_at": TEXT,
        "title": TEXT,
        "content": TEXT,
        "topics": TEXTS,
        "tags": TEXTS,
        "vector": {"type": "array", "items": NUMBER},
        "metadata": OBJECT,
    },
}
