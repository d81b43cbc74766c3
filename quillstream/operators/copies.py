"""Copies of tables, verified by hash trees.

A row's leaf is the hash of its key, cut to BITS bits.  A leaf has the number of its rows and two sums of their hashes that do not
depend on their order; a node has the sums of its children.  A tree takes one pass over its table, in which map tasks
combine rows by leaf, has fewer than 2**(BITS + 1) rows and is written beside the copy, so that a copy is verified later
without its source being read.  Two trees are compared from the root down, a level only below nodes that differ; rows are compared,
with their names, only in leaves that differ.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a leaf and of the step from a level to the next one: 65,536 leaves, a node has 16 children.
BITS, STEP = 16, 4
LEVELS = range(0, BITS + 1, STEP)
TREE = "level int, node long, n long, total decimal(38,0), mixed long"


def _comparable(name: str, kind: T.DataType) -> Column:
    """Maps have no order of their own and cannot be hashed."""
    return F.array_sort(F.map_entries(F.col(f"`{name}`"))) if isinstance(kind, T.MapType) else F.col(f"`{name}`")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns by name; which ones are null is part of it."""
    own = [_comparable(f.name, f.dataType) for f in sorted(df.schema, key=lambda f: f.name)]
    return F.xxhash64(*own, *[c.isNull() for c in own])


def leaf(keys: list[str]) -> Column:
    own = [F.col(f"`{k}`") for k in keys]
    return F.pmod(F.xxhash64(*own, *[c.isNull() for c in own]), F.lit(1 << BITS))


def tree(df: DataFrame, keys: list[str]) -> DataFrame:
    """level, node, n, total, mixed of every node that has rows; an empty table has none."""
    rows = df.select(leaf(keys).alias("leaf"), row_hash(df).alias("h"))
    leaves = rows.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("total"), F.bit_xor("h").alias("mixed"))
    levels = leaves.withColumn("level", F.explode(F.array(*[F.lit(x) for x in LEVELS])))
    nodes = levels.groupBy("level", F.floor(F.col("leaf") / F.pow(F.lit(2.0), BITS - F.col("level"))).alias("node"))
    return nodes.agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("mixed").alias("mixed"))


def differing(one: DataFrame, other: DataFrame) -> list[list[int]]:
    """For each level the nodes that differ; none below a node that is the same.  At most 2**BITS numbers reach the driver."""
    found: list[list[int]] = []
    for level in LEVELS:
        sides = [t.where(F.col("level") == level) for t in (one, other)]
        if found:
            if not found[-1]:
                break
            sides = [t.where(F.floor(F.col("node") / (1 << STEP)).isin(found[-1])) for t in sides]
        a, b = (t.select("node", F.struct("n", "total", "mixed").alias(name)) for t, name in zip(sides, "ab", strict=True))
        found.append(sorted(r[0] for r in a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node").collect()))
    return found


def differences(source: DataFrame, target: DataFrame, keys: list[str], trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """keys, status and columns: a row for each key that the tables do not share alike.

    status: missing (not in the target), extra (not in the source), changed; columns: those that differ, by name, where both have one
    row of the key.  A key with repeated rows is changed if the numbers or contents of its rows differ.  Null is a key like others.
    trees: those of the tables, if they have been made.
    """
    one, other = trees or (tree(source, keys), tree(target, keys))
    found = differing(one, other)
    leaves = found[-1] if len(found) == len(LEVELS) else []
    spark = source.sparkSession
    at = F.broadcast(spark.createDataFrame([(x,) for x in leaves], "__leaf long"))  # 2**BITS numbers at most
    content = [c for c in sorted(source.columns) if c not in keys]
    kinds = {f.name: f.dataType for f in source.schema}

    def side(df: DataFrame, name: str) -> DataFrame:
        own = df.withColumn("__leaf", leaf(keys)).withColumn("__h", row_hash(df)).join(at, "__leaf", "left_semi")
        each = [F.first(F.xxhash64(_comparable(c, kinds[c]), F.col(f"`{c}`").isNull())).alias(c) for c in content]
        return own.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.struct(F.count("*").alias("n"), F.sum(F.col("__h").cast("decimal(20,0)")).alias("total"), F.bit_xor("__h").alias("mixed")).alias(f"{name}_all"), F.struct(F.lit(0).alias("__"), *each).alias(f"{name}_each"))

    a, b = side(source, "a"), side(target, "b").withColumnsRenamed({k: f"__b_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__b_{k}`")) for k in keys])
    both = a.join(b, same, "full_outer").where(~F.col("a_all").eqNullSafe(F.col("b_all")))
    status = F.when(F.col("b_all").isNull(), "missing").when(F.col("a_all").isNull(), "extra").otherwise("changed")
    named = [F.when(F.col("a_each").getField(c) != F.col("b_each").getField(c), F.lit(c)) for c in content]
    single = (F.col("a_all.n") == 1) & (F.col("b_all.n") == 1)
    columns = F.when((status == "changed") & single, F.array_compact(F.array(*named).cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    key = [F.when(F.col("a_all").isNull(), F.col(f"`__b_{k}`")).otherwise(F.col(f"`{k}`")).alias(k) for k in keys]
    return both.select(*key, status.alias("status"), columns.alias("columns"))


def copy(source: DataFrame, path: str, keys: list[str]) -> str:
    """Write source as Parquet below path, with the tree of what was read beside it; returns the folder, which has rows and tree."""
    at = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    source.write.parquet(f"{at}/rows")
    tree(source, keys).coalesce(1).write.parquet(f"{at}/tree")
    return at


def opened(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """(rows, tree) of a copy."""
    return spark.read.parquet(f"{at}/rows"), spark.read.schema(TREE).parquet(f"{at}/tree")


def migrate(spark: SparkSession, tables: Mapping[str, tuple[DataFrame, list[str]]], path: str, dry_run: bool = False) -> DataFrame:
    """name, n_source, n_target, leaves and equal for each table (rows, keys), and a row `total`.

    Each table is copied and its copy read again: leaves is the number of those in which the copy differs from the source, and equal says
    that none does.  A dry run counts and writes nothing; its n_target is what would be copied.  The total is equal if all tables are.
    """
    rows = []
    for name, (source, keys) in tables.items():
        if dry_run:
            n = source.count()
            rows.append((name, n, n, 0, True))
            continue
        at = copy(source, f"{path.rstrip('/')}/{name}", keys)
        target, made = opened(spark, at)
        again = tree(target, keys)
        found = differing(made, again)
        bad = len(found[-1]) if len(found) == len(LEVELS) else 0
        count = lambda t: (t.where("level = 0").agg(F.sum("n")).first()[0] or 0)
        rows.append((name, count(made), count(again), bad, bad == 0))
    each = spark.createDataFrame(rows, "name string, n_source long, n_target long, leaves long, equal boolean")
    return each.unionByName(each.agg(F.lit("total").alias("name"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_source", "n_target", "leaves")], F.coalesce(F.bool_and("equal"), F.lit(True)).alias("equal")))
