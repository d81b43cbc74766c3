"""Comments of threads, each once: a cursor for every thread, kept as keyed state of a stream.

A thread's cursor is the greatest comment that was seen.  A batch yields its comments above the cursor, whatever their order in the
batch, and moves it.  When event time has passed a thread's last comment by `quiet`, a timer says so once, and the thread need
not be asked again soon.  A source whose comments are disabled is flagged, and what comes from it later is not stored.
The state's checkpoint is what a restart goes on from.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: What an error says where a source has no comments (fixed value).
DISABLED = "comments are disabled"
IN = "source_id string, thread_id long, comment_id long, at timestamp, text string, error string"
_KINDS = {"source_id": T.StringType(), "thread_id": T.LongType(), "kind": T.StringType(), "comment_id": T.LongType(), "at": T.TimestampType(), "text": T.StringType()}
OUT = T.StructType([T.StructField(n, k) for n, k in _KINDS.items()])
#: The last comment of a thread, and when its timer is due, in milliseconds.
LAST = T.StructType([T.StructField("comment_id", T.LongType()), T.StructField("due", T.LongType())])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ThreadCursor(StatefulProcessor):
    """Rows of kind comment, disabled (of the source) and quiet (with the last comment)."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cursor, due = self.last.get() or (None, None)
        fresh, latest = set(), 0
        for r in rows:
            if r.error is not None:
                if DISABLED in r.error.lower():
                    yield Row(source_id=key[0], thread_id=key[1], kind="disabled", comment_id=None, at=r.at, text=None)
            elif r.comment_id is not None and r.comment_id not in fresh and (cursor is None or r.comment_id > cursor):
                fresh.add(r.comment_id)
                latest = max(latest, int(r.at.timestamp() * 1000) if r.at else 0)
                yield Row(source_id=key[0], thread_id=key[1], kind="comment", comment_id=r.comment_id, at=r.at, text=r.text)
        if fresh:
            if due:
                self.handle.deleteTimer(due)
            # a timer must lie ahead of what event time has reached
            due = max(latest + self.quiet_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(due)
            self.last.update((max(fresh), due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        cursor, _ = self.last.get() or (None, None)
        if cursor is not None:
            self.last.update((cursor, None))
        yield Row(source_id=key[0], thread_id=key[1], kind="quiet", comment_id=cursor, at=None, text=None)

    def close(self) -> None:
        pass


def fresh_comments(stream: DataFrame, quiet: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The rows that a stream of comments and errors (IN) yields; see ThreadCursor.

    Comments without a number are left out; a null source or thread is a key like others.  `quiet` and `late` are times such as '1 day'.
    """
    spark = stream.sparkSession
    quiet_ms = spark.sql(f"SELECT cast(unix_millis(timestamp_millis(0) + INTERVAL {quiet}) AS long)").first()[0]
    keyed = stream.withWatermark("at", late).groupBy("source_id", "thread_id")
    return keyed.transformWithState(statefulProcessor=ThreadCursor(quiet_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def collect_comments(spark: SparkSession, source: str, path: str, checkpoint: str, quiet: str = "1 day", late: str = "1 hour", files: int | None = None) -> StreamingQuery:
    """Store the fresh comments of the folder `source` below path, and beside them the flagged sources and quiet threads.

    A batch has a partition of its own and writes it anew when it is run again.  Comments of a source that an earlier batch flagged are not
    stored; those of the batch that brings the flag are.
    """
    root = path.rstrip("/")
    spark.createDataFrame([], T.StructType([*OUT, T.StructField("batch", T.LongType())])).write.mode("append").partitionBy("kind", "batch").parquet(root)

    def write(batch: DataFrame, n: int) -> None:
        flagged = read(spark, root, "disabled").where(F.col("batch") < n).select(F.col("source_id").alias("__flagged")).distinct()
        kept = batch.join(flagged, F.col("source_id").eqNullSafe(F.col("__flagged")), "left_anti").withColumn("batch", F.lit(n).cast("long"))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch").parquet(root)

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    reader = spark.readStream.schema(IN)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    return fresh_comments(stream, quiet, late).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Stored rows of one kind: comment, disabled or quiet."""
    schema = T.StructType([*OUT, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(path).where(F.col("kind") == kind)


def cursors(spark: SparkSession, path: str) -> DataFrame:
    """source_id, thread_id, last_comment, comments of every thread that has any."""
    return read(spark, path, "comment").groupBy("source_id", "thread_id").agg(F.max("comment_id").alias("last_comment"), F.count("*").alias("comments"))
