"""Hand-offs between agents as the fold of a log of status updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(events: DataFrame) -> DataFrame:
    """The state of each hand-off from its events (id, seq, status, at, result, error, ms).

    The last event overwrites result, error and time even with null; accepted_at is the time of the last acceptance,
    completed_at that of the last event that ends it.  Equal seq: the later event, then the greater status.
    """
    order = F.struct("seq", "at", "status")
    last = F.max_by(F.struct("status", "result", "error", "ms"), order)
    at = lambda *states: F.max_by("at", F.when(F.col("status").isin(*states), order))
    return events.groupBy("id").agg(last.alias("l"), at("accepted").alias("accepted_at"), at("completed", "failed", "rejected").alias("completed_at")).select("id", "l.*", "accepted_at", "completed_at")
