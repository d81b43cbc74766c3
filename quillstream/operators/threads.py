"""Comments of threads above their cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def comments_above(comments: DataFrame, cursors: DataFrame, limit: int | None = None) -> DataFrame:
    """The comments (thread_id, id, ...) above the cursor (thread_id, last_comment) of their thread, with `place`, their order in it.

    A thread with a cursor is read on from it, the oldest comment first; one without is read from the newest.  limit: comments of a
    thread at most; the scan of a thread ends there, before comments are shuffled where Spark can tell.  A null thread is one like others.
    """
    c = cursors.select(F.col("thread_id").alias("__thread"), F.col("last_comment").alias("__last"))
    own = comments.join(c, comments["thread_id"].eqNullSafe(c["__thread"]), "left").where(F.col("__last").isNull() | (F.col("id") > F.col("__last")))
    order = F.when(F.col("__last").isNull(), -F.col("id")).otherwise(F.col("id"))
    ranked = own.withColumn("place", F.row_number().over(Window.partitionBy("thread_id").orderBy(order)))
    return (ranked.where(F.col("place") <= limit) if limit else ranked).drop("__thread", "__last")
