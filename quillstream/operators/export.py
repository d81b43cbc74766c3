"""Writers of the pipeline's artefacts."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ndjson(df: DataFrame, key: str) -> DataFrame:
    """One canonical JSON object for each row in the order of key, as the only column `value`."""
    return df.sort(key).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_ndjson(df: DataFrame, key: str, path: str, compression: str = "none") -> None:
    ndjson(df, key).write.option("compression", compression).text(path)


def agent_lines(docs: DataFrame) -> DataFrame:
    """docs with value: the eight fields that agents export, as a JSON object in this order; null stands for a field that a document lacks.

    id falls back on source_ref, also where it is empty; lists and metadata are empty, text is '' and language `unknown` by default.
    """
    own = {f.name: f.dataType for f in docs.schema}
    or_empty = lambda c, empty: F.coalesce(F.col(c), empty.cast(own[c]))
    fields = [F.coalesce(F.nullif(F.col("id"), F.lit("")), "source_ref").alias("id"), F.col("source_ref"), F.coalesce("text_clean", F.lit("")).alias("text"), F.col("summary"), or_empty("topics", F.array()).alias("topics"), or_empty("entities", F.array()).alias("entities"), F.coalesce("language", F.lit("unknown")).alias("language"), or_empty("metadata", F.create_map()).alias("metadata")]
    return docs.withColumn("value", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def catalogue(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All rows, which are few (topics), as one JSON array in the order of key."""
    return df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(key, *[c for c in columns if c != key])))).alias("value"))


def detail_name(topic_id: Column) -> Column:
    return F.concat(F.lit("topic_"), F.translate(topic_id, ":", "_"), F.lit(".json"))


def verified(pairs: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """name, n_source, n_target and equal for each pair of a table and its copy."""
    counts = [t.select(F.lit(name).alias("name"), F.lit(side).alias("side")) for name, both in pairs.items() for side, t in enumerate(both)]
    one = reduce(DataFrame.unionAll, counts).groupBy("name").agg(F.count_if(F.col("side") == 0).alias("n_source"), F.count_if(F.col("side") == 1).alias("n_target"))
    return one.withColumn("equal", F.col("n_source") == F.col("n_target"))


def archive(df: DataFrame, path: str) -> None:
    """Gzipped NDJSON; nothing if there are no rows."""
    if not df.isEmpty():
        df.write.option("compression", "gzip").json(path)


def archive_name(prefix: str, at: datetime) -> str:
    """The name of an archive that is made at this time, which is that of UTC."""
    return f"{prefix}_{at:%Y%m%d_%H%M%S}.ndjson.gz"


def archive_all(tables: Mapping[str, DataFrame], folder: str, at: datetime) -> dict[str, str | None]:
    """Archive each table under its name and the time, in a folder of files; None for a table without rows."""
    made: dict[str, str | None] = {}
    for prefix, df in tables.items():
        path = f"{folder.rstrip('/')}/{archive_name(prefix, at)}"
        empty = df.isEmpty()
        if not empty:
            archive(df, path)
        made[prefix] = None if empty else path
    return made


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """filename, files, size_bytes and created_at of each archive of a folder, the last name first; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"/([^/]+\.ndjson\.gz)/[^/]+$", 1)
    own = files.select(name.alias("filename"), "length", "modificationTime").where("filename <> ''")
    return own.groupBy("filename").agg(F.count("*").alias("files"), F.sum("length").alias("size_bytes"), F.max("modificationTime").alias("created_at")).orderBy(F.desc("filename"))


def read_archive(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)
