"""Contracts of records: a table of named rules, and the names of those that a row breaks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Form of a message reference (fixed value).
REF = r"^tg:[^:]+:(post|comment):[^:]+$"


def required(*columns: str) -> dict[str, Column]:
    return {f"{c}_missing": F.col(c).isNotNull() for c in columns}


def in_range(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return score.isNull() | score.between(low, high)


def anchors_of_cluster(kind: Column, anchors: Column) -> Column:
    """A cluster has two anchors or more, each with a score; other kinds have one or more."""
    scored = F.forall(anchors, lambda a: a.getField("score").isNotNull())
    return F.when(kind == "cluster", (F.size(anchors) >= 2) & scored).otherwise(F.size(anchors) >= 1)


def message_rules() -> dict[str, Column]:
    return required("id", "channel_id", "date", "text") | {"source_ref_form": F.col("source_ref").rlike(REF), "message_type_known": F.col("message_type").isin("post", "comment")}


def card_rules() -> dict[str, Column]:
    """Rules of a topic card with anchors array<struct<anchor_ref, score>>."""
    return required("topic_id") | {
        "type_known": F.col("type").isin("singleton", "cluster"),
        "anchors_of_type": anchors_of_cluster(F.col("type"), F.col("anchors")),
        "anchor_ref_form": F.forall("anchors", lambda a: a.getField("anchor_ref").rlike(REF)),
        "score_range": F.forall("anchors", lambda a: in_range(a.getField("score"))),
    }


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """df with violations, the names of the rules that do not hold, in order; a rule that is null does not hold."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))
