"""Keyed tables over Parquet: set-based forms of insert-if-absent, upsert, replace, delete and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_if_absent(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """The rows of new to append: the first for each key that old lacks; null is a key like others."""
    first = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
    have = old.select(F.col(key).alias("__have"))
    return first.join(have, F.col(key).eqNullSafe(F.col("__have")), "left_anti")


def conflicts(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Rows of new whose key old has with other content."""
    o = old.select(key, *[F.col(c).alias(f"old_{c}") for c in content])
    differs = ~F.lit(True)
    for c in content:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return new.join(o, key).where(differs)


def conflict_log(old: DataFrame, new: DataFrame, key: str, content: list[str], observed_at: Column, payload: Column) -> DataFrame:
    """A row for each row of new whose key old has with other content: key, observed_at, reason, new_payload_json and new_<content>.

    reason names the columns that differ; payload is a JSON text of a row of new, null for none.  What old has is not touched.
    """
    o = old.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__old_{c}") for c in content])
    both = new.withColumn("__payload", payload).join(o, F.col(key) == F.col("__key"))
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__old_{c}")), F.lit(c)) for c in content]))
    out = both.withColumn("__differ", differ).where(F.size("__differ") > 0)
    return out.select(key, observed_at.alias("observed_at"), F.concat(F.lit("changed: "), F.array_join("__differ", ", ")).alias("reason"), F.nullif(F.col("__payload"), F.lit("{}")).alias("new_payload_json"), *[F.col(c).alias(f"new_{c}") for c in content])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str, preserve: list[str] = ()) -> DataFrame:
    """The latest row for each key (null-safe); columns in preserve keep the value of the earliest row.

    A null version is the earliest; of equal versions a new row is later than an old one, then the greater row.
    """
    both = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    row = [c for c in old.columns if c not in keys]
    order = F.struct(F.col(version).isNotNull(), version, "__side", *row)
    latest = F.max_by(F.struct(*row), order).alias("__l")
    kept = [F.min_by(c, order).alias(f"__{c}") for c in preserve]
    rows = both.groupBy(*keys).agg(latest, *kept)
    return rows.select(*[F.col(f"__{c}").alias(c) if c in preserve else F.col(c) if c in keys else F.col(f"__l.{c}").alias(c) for c in old.columns])


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def split_expired(table: DataFrame, expired: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, expired) by one predicate, so that what is archived is what is deleted; null does not expire."""
    gone = F.coalesce(expired, F.lit(False))
    return table.where(~gone), table.where(gone)
