"""Copies and hash trees: what differs is named, and rows are read only where it does."""

import glob

import pytest
from pyspark.sql import functions as F

from quillstream.operators import copies
from quillstream.session import shared_folder

KIND = "id long, part string, v double, tags array<string>, m map<string,int>"


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(3000).selectExpr("id", "concat('p', id % 3) AS part", "CASE WHEN id % 5 > 0 THEN id / 7D END AS v", "array(cast(id AS string)) AS tags", "map('a', cast(id AS int), 'b', 1) AS m")
    return made.unionByName(spark.createDataFrame([(None, "p", 1.0, None, None), (7, None, None, [], {})], KIND)).persist()


def named(df, keys):
    return {tuple(r[k] for k in keys): (r.status, r["columns"]) for r in df.collect()}


def test_equal_tables_have_equal_trees(rows):
    other = rows.repartition(5).withColumn("m", F.map_from_entries(F.reverse(F.map_entries("m"))))
    assert copies.differing(copies.tree(rows, ["id"]), copies.tree(other, ["id"])) == [[]]
    assert copies.differences(rows, other, ["id", "part"]).count() == 0


def test_what_differs_is_named(spark, rows):
    changed = rows.where("id is null or id <> 11").withColumn("v", F.when(F.col("id") == 20, None).when(F.col("id") == 21, 5.0).otherwise(F.col("v"))).withColumn("tags", F.when(F.col("id") == 21, None).otherwise(F.col("tags")))
    other = changed.unionByName(spark.createDataFrame([(9000, "x", 0.0, None, None), (None, None, 2.0, [], None)], KIND))
    got = named(copies.differences(rows, other, ["id", "part"]), ["id", "part"])
    assert got == {(11, "p2"): ("missing", []), (21, "p0"): ("changed", ["tags", "v"]), (9000, "x"): ("extra", []), (None, None): ("extra", [])}
    other = changed.withColumn("m", F.when(F.col("id") == 30, F.map_from_arrays(F.array(F.lit("a")), F.array(F.lit(0)))).otherwise(F.col("m")))
    got = named(copies.differences(rows, other, ["id", "part"]), ["id", "part"])
    assert got[30, "p0"] == ("changed", ["m"]) and len(got) == 3


def test_repeated_rows_and_moved_nulls(spark):
    a = spark.createDataFrame([(1, "x", None), (1, "x", None), (2, None, "y"), (3, "a", "b"), (3, "c", "d")], "k int, a string, b string")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, "a", "d"), (3, "c", "b")], "k int, a string, b string")
    assert named(copies.differences(a, b, ["k"]), ["k"]) == {(1,): ("changed", []), (2,): ("changed", ["a", "b"]), (3,): ("changed", [])}


def test_trees_are_descended_only_where_they_differ(spark, rows):
    one, other = copies.tree(rows, ["id"]), copies.tree(rows.where("id is null or id not in (5, 6)"), ["id"])
    found = copies.differing(one, other)
    assert [len(x) for x in found][0] == 1 and len(found) == len(copies.LEVELS) and all(len(x) <= 2 for x in found)
    assert all({n >> copies.STEP for n in low} == set(high) for high, low in zip(found, found[1:]))
    top = one.where("level = 0").first()
    assert top.n == 3002 and one.where("level = 16").agg(F.sum("n"), F.sum("total"), F.bit_xor("mixed")).first()[:] == (top.n, top.total, top.mixed)


def test_empty_tables(spark, rows):
    none = rows.where("id < 0")
    assert copies.tree(none, ["id"]).count() == 0 and copies.differing(copies.tree(none, ["id"]), copies.tree(none, ["id"])) == [[]]
    assert copies.differences(none, rows, ["id", "part"]).where("status = 'extra'").count() == 3002


def test_a_copy_is_written_and_verified(spark, rows, tmp_path):
    tables = {"rows": (rows, ["id", "part"]), "none": (rows.where("id < 0"), ["id"])}
    got = {r.name: tuple(r)[1:] for r in copies.migrate(spark, tables, str(tmp_path), dry_run=True).collect()}
    assert got == {"rows": (3002, 3002, 0, True), "none": (0, 0, 0, True), "total": (3002, 3002, 0, True)} and not glob.glob(f"{tmp_path}/*")
    assert {r.name: tuple(r)[1:] for r in copies.migrate(spark, tables, str(tmp_path)).collect()} == got
    at = glob.glob(f"{tmp_path}/rows/*")[0]
    back, made = copies.opened(spark, at)
    assert copies.differences(rows, back, ["id", "part"]).count() == 0
    # a copy that loses a file later is found out by the tree beside it, without the source
    import os

    lost = sorted(glob.glob(f"{at}/rows/part*"))[0]
    n = spark.read.parquet(lost).count()
    os.remove(lost)
    again = copies.tree(spark.read.parquet(f"{at}/rows"), ["id", "part"])
    assert n and copies.differing(made, again)[0] == [0] and len(copies.differing(made, again)[-1]) <= n


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark)).rstrip("/")
