"""Schema documents as column expressions: literal records against what each rule says of them."""

import json

import pytest
from pyspark.sql import functions as F

from quillstream.functions import schema_rules, schemas

REF = "tg:c:post:1"
MESSAGE = {"id": "1", "message_type": "post", "source_ref": REF, "channel_id": "c", "date": "2024-01-01T00:00:00Z", "text": ""}
DOCUMENT = {"id": "d", "source_ref": REF, "source_message_id": "1", "channel_id": "c", "processed_at": "2024-01-01T00:00:00Z", "text_clean": "x"}
ANCHOR = {"channel_id": "c", "message_id": "1", "message_type": "post", "anchor_ref": REF, "score": 0.5}
CARD = {"id": "t", "title": "T", "summary": "S", "scope_in": ["a"], "scope_out": ["b"], "type": "cluster", "anchors": [ANCHOR, ANCHOR], "sources": [REF], "updated_at": "2024-01-01T00:00:00Z"}
ITEM = {"channel_id": "c", "message_id": "1", "message_type": "comment", "source_ref": "tg:c:comment:1", "role": "anchor"}
BUNDLE = {"topic_id": "t", "items": [ITEM], "updated_at": "2024-01-01T00:00:00Z"}
ENTRY = {"id": "e", "source": {"type": "topic"}, "created_at": "2024-01-01T00:00:00Z", "title": "T", "content": "C"}


def but(record, drop=(), **more):
    return {k: v for k, v in (record | more).items() if k not in drop}


CASES = [
    (schemas.RAW_MESSAGE, MESSAGE, []),
    (schemas.RAW_MESSAGE, but(MESSAGE, ["text", "id"]), ["id: required", "text: required"]),
    (schemas.RAW_MESSAGE, but(MESSAGE, message_type="story", source_ref="tg:a:b:post:1"), ["message_type: enum", "source_ref: pattern"]),
    (schemas.RAW_MESSAGE, but(MESSAGE, text=5, language=None, raw_payload=[]), ["text: type", "language: type", "raw_payload: type"]),
    (schemas.RAW_MESSAGE, but(MESSAGE, extra={"any": 1}, raw_payload={}), []),
    (schemas.RAW_MESSAGE, [], ["$: type"]),
    (schemas.PROCESSED_DOCUMENT, but(DOCUMENT, topics=["a"], entities=[{"type": "x", "value": "v", "confidence": 1}]), []),
    (schemas.PROCESSED_DOCUMENT, but(DOCUMENT, topics=["a", 1], entities=[{"type": "x"}, {"value": 1, "type": "y"}, 3]), ["topics[1]: type", "entities[0].value: required", "entities[1].value: type", "entities[2]: type"]),
    (schemas.PROCESSED_DOCUMENT, but(DOCUMENT, ["processed_at"], metadata={"model_id": 1, "own": 2}), ["processed_at: required", "metadata.model_id: type"]),
    (schemas.TOPIC_CARD, CARD, []),
    (schemas.TOPIC_CARD, but(CARD, anchors=[but(ANCHOR, ["score"])]), ["anchors: minItems", "anchors[0].score: required"]),
    (schemas.TOPIC_CARD, but(CARD, type="singleton", anchors=[but(ANCHOR, ["score"])]), []),
    (schemas.TOPIC_CARD, but(CARD, type="singleton", anchors=[]), ["anchors: minItems"]),
    (schemas.TOPIC_CARD, but(CARD, ["title", "type"], scope_in=[], scope_out=["x", None], anchors=[but(ANCHOR, ["message_id"], anchor_ref="x", score="1")]), ["title: required", "type: required", "scope_in: minItems", "scope_out[1]: type", "anchors[0].message_id: required", "anchors[0].anchor_ref: pattern", "anchors[0].score: type"]),
    (schemas.TOPIC_BUNDLE, BUNDLE, []),
    (schemas.TOPIC_BUNDLE, but(BUNDLE, items=[], channels="c", time_range={"from": 1}), ["items: minItems", "time_range.from: type", "channels: type"]),
    (schemas.TOPIC_BUNDLE, but(BUNDLE, items=[ITEM, but(ITEM, ["source_ref"], role="other")]), ["items[1].source_ref: required", "items[1].role: enum"]),
    (schemas.KNOWLEDGE_BASE_ENTRY, but(ENTRY, vector=[1, 0.5]), []),
    (schemas.KNOWLEDGE_BASE_ENTRY, but(ENTRY, source={"message_type": "x"}, vector=[1, "a"]), ["source.type: required", "source.message_type: enum", "vector[1]: type"]),
    (schemas.KNOWLEDGE_BASE_ENTRY, but(ENTRY, source=None), ["source: type"]),
]


def test_json_records(spark):
    for schema in {id(c[0]): c[0] for c in CASES}.values():
        own = [c for c in CASES if c[0] is schema]
        df = spark.createDataFrame([(i, json.dumps(c[1])) for i, c in enumerate(own)] + [(-1, "{no"), (-2, None)], "i int, j string")
        got = dict(df.select("i", schema_rules.broken_json(F.col("j"), schema)).collect())
        assert [got[i] for i in range(len(own))] == [c[2] for c in own]
        assert got[-1] == ["$: json"] and got[-2] is None


def test_columns_mean_the_same(spark):
    """What columns can hold: nulls are absent, and types are those of the table."""
    kinds = {
        id(schemas.RAW_MESSAGE): "id string, message_type string, source_ref string, channel_id string, date string, text string, raw_payload map<string,string>",
        id(schemas.TOPIC_CARD): "id string, title string, summary string, scope_in array<string>, scope_out array<string>, type string, anchors array<struct<channel_id: string, message_id: string, message_type: string, anchor_ref: string, score: double>>, sources array<string>, updated_at string",
        id(schemas.TOPIC_BUNDLE): "topic_id string, items array<struct<channel_id: string, message_id: string, message_type: string, source_ref: string, role: string>>, updated_at string",
        id(schemas.KNOWLEDGE_BASE_ENTRY): "id string, source struct<type: string, message_type: string>, created_at string, title string, content string, vector array<double>",
    }
    tried = 0
    for schema, record, want in CASES:
        kind = kinds.get(id(schema))
        if kind is None or not isinstance(record, dict) or any(": type" in w for w in want):
            continue
        df = spark.read.schema(kind).json(spark.sparkContext.parallelize([json.dumps(record)]))
        assert df.select(schema_rules.broken(df, schema)).first()[0] == want
        tried += 1
    assert tried > 9


def test_types_of_columns(spark):
    df = spark.sql("SELECT 1 AS a, 1.5D AS b, true AS c, timestamp'2024-01-01 00:00:00' AS d, array(1) AS e, named_struct('x', 1) AS f, cast(null AS int) AS g")
    rules = {"properties": {n: {"type": "string"} for n in "abcdefgh"}}
    assert df.select(schema_rules.broken(df, rules)).first()[0] == ["a: type", "b: type", "c: type", "e: type", "f: type"]
    rules = {"properties": {"a": {"type": "integer", "minimum": 2}, "b": {"type": ["string", "number"], "maximum": 1}, "e": {"maxItems": 0}, "f": {"additionalProperties": False, "properties": {"y": {}}}}, "required": ["g", "h"]}
    assert df.select(schema_rules.broken(df, rules)).first()[0] == ["g: required", "h: required", "a: minimum", "b: maximum", "e: maxItems", "f.x: additionalProperties"]


def test_other_rules_of_json(spark):
    rules = {"additionalProperties": False, "properties": {"a": {"type": "integer"}, "b": {"minLength": 2, "maxLength": 3}, "c": {"if": {"type": "string"}, "then": {"pattern": "^x"}, "else": {"type": "boolean"}}}}
    rows = ['{"a": 1.0, "b": "é", "c": "y", "d": 1}', '{"a": 1.5, "b": "four", "c": 1}', '{"b": 5, "c": true}', "7"]
    df = spark.createDataFrame(enumerate(rows), "i int, j string")
    got = dict(df.select("i", schema_rules.broken_json(F.col("j"), rules)).collect())
    assert got == {0: ["b: minLength", "c: pattern", "d: additionalProperties"], 1: ["a: type", "b: maxLength", "c: type"], 2: [], 3: []}


def test_rules_that_are_not_understood():
    with pytest.raises(ValueError, match="oneOf"):
        schema_rules.broken_json(F.lit("{}"), {"properties": {"a": {"oneOf": []}}})


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(json.dumps(CARD),)], "j string")
    plan = df.select(schema_rules.broken_json(F.col("j"), schemas.TOPIC_CARD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_a_record_is_parsed_once(spark):
    """Whatever the number of rules, and although only records that break some are kept."""
    from quillstream.plans import catalogue

    df = catalogue.QUERIES["message_contract"](spark, "/root/testdata/sf0.001")
    told = df._jdf.queryExecution().executedPlan().toString()
    assert told.lower().count("parsejson") == 2  # the record, and the payload that it is made of
    assert "Filter (" not in told
