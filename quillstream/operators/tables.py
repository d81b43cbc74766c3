"""Keyed tables on Parquet, in slots: rows are replaced by key, and only files of the slots that a change touches are written anew.

A row's slot is the hash of its key.  Changes are written with dynamic partition overwrite, so that a slot has either its
old rows or its new ones.  One writer at a time.  A key that is looked up is a slot and a filter that the scan gets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slots of a table; the name of the column is no name that callers use.
SLOTS, SLOT = 64, "__slot"


def slot_of(columns: list[Column]) -> Column:
    """Null is a key like others."""
    return F.pmod(F.xxhash64(*columns, *[c.isNull() for c in columns]), F.lit(SLOTS)).cast("int")


def same_key(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, [p.eqNullSafe(q) for p, q in zip(a, b, strict=True)])


def _schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema, T.StructField(SLOT, T.IntegerType())])


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a table; it must have been made by create or put."""
    return spark.read.schema(_schema(schema)).parquet(path).drop(SLOT)


def create(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Make the table without rows if there is none; a table that is there stays as it is."""
    spark.createDataFrame([], _schema(schema)).write.mode("append").partitionBy(SLOT).parquet(path)


def _keys(keys: list[str]) -> list[Column]:
    return [F.col(f"`{k}`") for k in keys]


def _store(df: DataFrame, path: str) -> None:
    # a task for each slot, so that a slot has one file
    df.repartition(F.col(SLOT)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SLOT).parquet(path)


def put(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[Column], schema: T.StructType | None = None) -> None:
    """Rows of new take the place of all rows of their keys; of new rows with one key the last by `order` counts.

    A current bundle has null for both ends of its range, which is a key like others, so one call replaces current bundles
    and snapshots alike.  Slots without new rows are neither read nor written.
    """
    schema = schema or new.schema
    create(spark, path, schema)
    own = new.select(*schema.names).withColumn(SLOT, slot_of(_keys(keys)))
    last = Window.partitionBy(SLOT, *_keys(keys)).orderBy(*order)
    own = own.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    touched = [r[0] for r in own.select(SLOT).distinct().collect()]  # SLOTS numbers at most
    old = spark.read.schema(_schema(schema)).parquet(path).where(F.col(SLOT).isin(touched))
    gone = own.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)])
    kept = old.join(gone, same_key(_keys(keys), [F.col(f"__k{i}") for i in range(len(keys))]), "left_anti")
    _store(kept.unionByName(own), path)


def add(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[Column], schema: T.StructType | None = None) -> None:
    """Append the rows of new whose keys the table lacks, of equal keys the first by `order`; only the slots of new are read."""
    schema = schema or new.schema
    create(spark, path, schema)
    own = new.select(*schema.names).withColumn(SLOT, slot_of(_keys(keys)))
    own = own.withColumn("__n", F.row_number().over(Window.partitionBy(SLOT, *_keys(keys)).orderBy(*order))).where("__n = 1").drop("__n")
    touched = [r[0] for r in own.select(SLOT).distinct().collect()]  # SLOTS numbers at most
    old = spark.read.schema(_schema(schema)).parquet(path).where(F.col(SLOT).isin(touched)).select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)])
    fresh = own.join(old, same_key(_keys(keys), [F.col(f"__k{i}") for i in range(len(keys))]), "left_anti")
    fresh.repartition(F.col(SLOT)).write.mode("append").partitionBy(SLOT).parquet(path)


def remove(spark: SparkSession, path: str, schema: T.StructType, gone: DataFrame, keys: list[str]) -> None:
    """Delete the rows of keys in gone; a slot that loses all its rows keeps a file without rows."""
    own = gone.select(*_keys(keys)).distinct().withColumn(SLOT, slot_of(_keys(keys)))
    touched = [r[0] for r in own.select(SLOT).distinct().collect()]  # SLOTS numbers at most
    at = spark.read.schema(_schema(schema)).parquet(path).where(F.col(SLOT).isin(touched))
    theirs = own.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)])
    flag = at.join(theirs.withColumn("__gone", F.lit(True)), same_key(_keys(keys), [F.col(f"__k{i}") for i in range(len(keys))]), "left")
    # a slot is overwritten only if something is written to it: slots that would be empty are written as files of their own
    left = flag.where("__gone is null").drop("__gone", *[f"__k{i}" for i in range(len(keys))])
    have = {r[0] for r in left.select(SLOT).distinct().collect()}
    _store(left, path)
    for slot in set(touched) - have:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{SLOT}={slot}")


def find(spark: SparkSession, path: str, schema: T.StructType, **key: object) -> DataFrame:
    """The rows of one key; the slot prunes files, and each part of the key is a filter of the scan."""
    kinds = {f.name: f.dataType for f in schema}
    values = [F.lit(v).cast(kinds[k]) for k, v in key.items()]
    slot = spark.range(1).select(slot_of(values)).first()[0]
    rows = spark.read.schema(_schema(schema)).parquet(path).where(F.col(SLOT) == slot)
    for k, v in key.items():
        rows = rows.where(F.col(f"`{k}`").isNull() if v is None else F.col(f"`{k}`") == F.lit(v).cast(kinds[k]))
    return rows.drop(SLOT)
