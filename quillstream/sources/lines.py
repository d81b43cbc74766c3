"""Lines of text files with their physical numbers, however the files are split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0, empty lines count) and value of every line of the files at path.

    Splits are counted, the counts summed up in the order of their places in a file, and a line's number is the sum before
    its split and its place within it.  Lines are not shuffled.  A file without lines has no rows.
    """
    text = spark.read.text(path)
    rows = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("__n"))
    # a split is read by one task in order, so its numbers have no gaps
    splits = rows.groupBy("file", "block").agg(F.min("__n").alias("__first"), F.count("*").alias("n"))
    before = F.sum("n").over(_in_file()) - F.col("n")
    splits = splits.select(F.col("file").alias("__file"), F.col("block").alias("__block"), "__first", before.alias("__before"))
    joined = rows.join(splits, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    return joined.select("file", (F.col("__before") + F.col("__n") - F.col("__first")).alias("line"), "value")


def _in_file():
    from pyspark.sql import Window

    return Window.partitionBy("file").orderBy("block")


def first_lines(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """file, line, value of those of the first `limit` lines of each file that are not blank; limit counts blank lines, too."""
    return numbered(spark, path).where((F.col("line") < limit) & (F.trim(F.translate("value", "\t\r\v\f", "    ")) != ""))


def first_records(spark: SparkSession, path: str, schema: T.StructType | str, limit: int = 20) -> DataFrame:
    """The first lines as records of the schema; a line that is no JSON is an error, as it is where a file is read as a whole."""
    rows = first_lines(spark, path, limit).withColumn("record", F.from_json("value", schema, {"mode": "FAILFAST"}))
    return rows.select("file", "line", "record.*")
