"""Incremental ingestion and rollups with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillstream.operators import tables


def ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append what is new in the folder `source` to the keyed table `target`, each key once; null is a key like others.

    The checkpoint, which is the cursor, is committed after the rows are; a batch that is run again finds its keys there.
    State does not grow with the stream: keys are compared with the slots of the table that they belong to.
    """
    def write(batch: DataFrame, _: int) -> None:
        tables.add(spark, target, batch, [key], [F.col(f"`{c}`") for c in schema.names if c != key] or [F.lit(0)], schema)

    # the first run makes the table, without rows; a table that cannot be read later is an error, not a missing one
    tables.create(spark, target, schema)
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_rollup(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Tasks by agent, day and type with a watermark; append mode emits a day once it is closed."""
    return stream.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("day"), "agent_name", "task_type").agg(F.count("*").alias("tasks"), F.count_if("success").alias("ok"), F.sum("ms").alias("ms"))
