"""The daily rollup of tasks, kept up to date batch by batch.

What a batch adds to a day is written as partial sums, in a partition of the day and the batch.  A batch that is run again
writes its partitions anew, so nothing counts twice, and a late task only adds a partition to its day.  Partials merge in any order, whatever
the batches were; reading some days reads their partitions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstream.functions import text

KEYS = ["agent_name", "day", "task_type"]
PARTIAL = "agent_name string, task_type string, tasks long, ok long, failed long, total_ms long, min_ms long, max_ms long, day date, batch long"


def partials(tasks: DataFrame) -> DataFrame:
    """Sums of tasks (agent_name, task_type, success, ms, created_at) by agent, day and type that can be merged.

    success null counts as neither; ms null counts as a task without time; created_at null is a day of its own, null.
    """
    own = tasks.groupBy("agent_name", F.to_date("created_at").alias("day"), "task_type")
    return own.agg(F.count("*").alias("tasks"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.sum("ms").alias("total_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


def merged(parts: DataFrame) -> DataFrame:
    """The rollup from partials, with the mean time and the share of successes."""
    sums = [F.sum(c).alias(c) for c in ("tasks", "ok", "failed", "total_ms")]
    out = parts.groupBy(*KEYS).agg(*sums, F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"))
    return out.withColumn("mean_ms", F.round(text.ratio(F.col("total_ms"), F.col("tasks")), 6)).withColumn("success_rate", F.round(text.ratio(F.col("ok"), F.col("tasks")), 6))


def add_batch(tasks: DataFrame, path: str, batch: int) -> None:
    out = partials(tasks).withColumn("batch", F.lit(batch).cast("long"))
    out.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def read(spark: SparkSession, path: str, days: Column | None = None, agent: str | None = None) -> DataFrame:
    """The rollup of the days for which the condition on `day` holds and of one agent, or of all."""
    parts = spark.read.schema(PARTIAL).parquet(path)
    parts = parts if days is None else parts.where(days)
    return merged(parts if agent is None else parts.where(F.col("agent_name") == agent))


def maintain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the partials below path up to date with a stream of tasks, until all that is available has been read."""
    return stream.writeStream.foreachBatch(lambda batch, n: add_batch(batch, path, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
