"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.session import shared_folder

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Rows of a key beyond which it is dealt to several tasks; the most keys that can be so hot.
PART_ROWS, MOST_HOT = 1 << 12, 50_000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: cuts lineage, survives lost executors.

    The folder's lifetime is the cluster's concern; each call writes to a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillstream/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the files of shuffles that no plan refers to: it does once the driver's garbage is collected."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def hot_keys(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """keys and __parts, the number of tasks, of each key with very many rows; counts has a row for each key, with n rows.

    A key is hot if it has more than PART_ROWS rows and more than the MOST_HOT-th part of all, so fewer than MOST_HOT are.
    """
    rows = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    part = max(PART_ROWS, rows // MOST_HOT)
    return counts.where(F.col(n) > part).select(*keys, F.ceil(F.col(n) / part).cast("int").alias("__parts"))


def split_join(rows: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """rows joined with one, which has a row for each value of keys; a hot key is split by the hash of columns `by`.

    hot is what hot_keys gives.  The row of a hot key in one is copied to each of its tasks, fewer than 2 * MOST_HOT copies in all.
    """
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("__part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("__parts")
    right = one.join(F.broadcast(hot), keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right.hint("merge"), [*keys, "__part"], how).drop("__part")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, although body may use it inside further lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_draw(*parts: Column) -> Column:
    """A uniform draw in (0, 1) from the MD5 of the parts joined by ':'; 48 bits, equal on every engine."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
