"""Canonical JSON, payload caps, and validation of loosely typed replies by Variant paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAYLOAD_BYTES = 256 * 1024


def canonical(**fields: Column) -> Column:
    """Keys in order, no spaces, nulls kept."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})


def capped(payload: Column, most: int = PAYLOAD_BYTES) -> Column:
    """The payload, or a note of its size if it has more bytes than `most`."""
    size = F.octet_length(payload)
    return F.when(size > most, F.concat(F.lit('{"original_size_bytes":'), size.cast("string"), F.lit(',"truncated":true}'))).otherwise(payload)


def validated(reply: Column) -> Column:
    """struct<error, text_clean, summary, topics, entities, language> of a reply that should be a JSON object.

    text_clean must be there and not empty.  A single topic makes a list, an empty one makes none; entities that are no
    list make none, those without a value go, confidences are numbers within [0, 1] or null.
    """
    v = F.try_parse_json(reply)
    text = F.try_variant_get(v, "$.text_clean", "string")
    many = F.try_variant_get(v, "$.topics", "array<string>")
    single = F.try_variant_get(v, "$.topics", "string")
    topics = F.coalesce(F.filter(many, lambda x: x.isNotNull()), F.when(F.coalesce(single, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(single)))
    entity = lambda e: F.struct(
        F.coalesce(F.try_variant_get(e, "$.type", "string"), F.lit("unknown")).alias("type"),
        F.try_variant_get(e, "$.value", "string").alias("value"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_variant_get(e, "$.confidence", "string").try_cast("double"))).alias("confidence"),
    )
    clamp = lambda e: F.struct(e.getField("type").alias("type"), e.getField("value").alias("value"), F.when(e.getField("confidence").isNotNull(), e.getField("confidence")).alias("confidence"))
    raw = F.coalesce(F.try_variant_get(v, "$.entities", "array<variant>"), F.array().cast("array<variant>"))
    kept = F.filter(F.transform(raw, entity), lambda e: F.coalesce(e.getField("value"), F.lit("")) != "")
    return F.struct(
        F.when(F.coalesce(text, F.lit("")) == "", F.lit("text_clean missing")).alias("error"),
        text.alias("text_clean"),
        F.try_variant_get(v, "$.summary", "string").alias("summary"),
        topics.alias("topics"),
        F.transform(kept, clamp).alias("entities"),
        F.coalesce(F.try_variant_get(v, "$.language", "string"), F.lit("unknown")).alias("language"),
    )
