"""Keyed tables in slots, cursors of threads, the maintained rollup, and runs that fail."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from quillstream.operators import tables
from quillstream.plans import lookups
from quillstream.sources import logical
from quillstream.streaming import cursors, rollup, supervise

D = "/root/testdata/sf0.001"
BUNDLE = "topic_id string, time_from timestamp, time_to timestamp, items array<string>, version int"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/part*")}


def bundles(spark, rows):
    day = lambda n: n and datetime.datetime(2024, 1, n)
    return spark.createDataFrame([(t, day(a), day(b), [x], v) for t, a, b, x, v in rows], BUNDLE)


def test_replacing_one_topic_leaves_other_files_alone(spark, tmp_path):
    path = f"{tmp_path}/bundles"
    key, order = ["topic_id", "time_from", "time_to"], [F.desc("version")]
    first = [(f"t{i}", None, None, "old", 5) for i in range(200)] + [("t7", 1, 2, "snapshot", 5), ("t7", 2, 3, "snapshot", 5), (None, None, None, "none", 1)]
    tables.put(spark, path, bundles(spark, first), key, order)
    before = files(path)
    assert 20 < len(before) <= tables.SLOTS
    # the current one is replaced whatever its version, of two new ones the later counts; snapshots go by their range
    tables.put(spark, path, bundles(spark, [("t7", None, None, "new", 1), ("t7", None, None, "newer", 2), ("t7", 1, 2, "again", 1), (None, None, None, "some", 1)]), key, order)
    after = files(path)
    changed = {f.rsplit("/", 2)[1] for f, _ in set(before.items()) ^ set(after.items())}
    assert 1 <= len(changed) <= 3 and len(after) == len(before)
    rows = tables.read(spark, path, bundles(spark, first).schema).collect()
    got = {(r.topic_id, r.time_from and r.time_from.day): r["items"][0] for r in rows}
    assert len(rows) == 203 and got["t7", None] == "newer" and got["t7", 1] == "again" and got["t7", 2] == "snapshot" and got[None, None] == "some" and got["t8", None] == "old"


def test_removed_keys_and_a_slot_that_becomes_empty(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.range(20).selectExpr("cast(id AS string) AS k", "id AS v")
    tables.put(spark, path, df, ["k"], [F.col("v")])
    tables.remove(spark, path, df.schema, df.where("v < 15"), ["k"])
    assert sorted(r.v for r in tables.read(spark, path, df.schema).collect()) == [15, 16, 17, 18, 19]
    tables.remove(spark, path, df.schema, df, ["k"])
    assert tables.read(spark, path, df.schema).count() == 0


def test_a_key_is_found_by_slot_and_filter(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.range(500).selectExpr("concat('k', id) AS k", "id AS v")
    tables.put(spark, path, df, ["k"], [F.col("v")])
    found = tables.find(spark, path, df.schema, k="k77")
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert [r.v for r in found.collect()] == [77] and "EqualTo(k,k77)" in plan and "PartitionFilters: [isnotnull(__slot" in plan.replace("\n", "")
    assert tables.find(spark, path, df.schema, k=None).count() == 0


def test_added_keys(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v int")
    for _ in range(2):
        tables.add(spark, path, df, ["k"], [F.col("v")])
    assert sorted((r.k or "", r.v) for r in tables.read(spark, path, df.schema).collect()) == [("", 3), ("a", 1)]


def test_every_lookup_reaches_its_scan(spark):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    want = {"raw": ["EqualTo(source,src10)", "EqualTo(doc_id,10)"], "processed": ["EqualTo(source,src10)", "EqualTo(doc_id,10)"], "card": ["EqualTo(source,src3)"], "bundle": ["EqualTo(source,src3)"], "source": ["EqualTo(n_nationkey,5)"], "job": ["EqualTo(o_orderkey,7)"], "agent": ["EqualTo(s_suppkey,3)"], "task": ["EqualTo(event_id,11)"], "handoff": ["EqualTo(o_orderkey,32)"]}
    parts = lookups.looked_up(spark, D)
    assert [p[0] for p in parts] == list(want)
    for store, rows, _, _ in parts:
        plan = rows._jdf.queryExecution().explainString(mode)
        pushed = "".join(line for line in plan.splitlines() if line.startswith("PushedFilters"))
        assert all(w in pushed for w in want[store]), (store, pushed)


@pytest.mark.parametrize("cuts", [[0, 1000], [0, 1, 400, 1000], [0, 250, 500, 750, 1000]])
def test_rollup_is_the_same_for_every_split(spark, tmp_path, cuts):
    path = f"{tmp_path}/r"
    tasks = logical.tasks(spark, D).withColumn("success", F.when(F.col("id") % 23 != 0, F.col("success"))).persist()
    want = sorted(map(str, rollup.merged(rollup.partials(tasks)).collect()))
    part = F.pmod(F.xxhash64("id"), F.lit(1000))
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        rollup.add_batch(tasks.where((part >= a) & (part < b)), path, n)
    rollup.add_batch(tasks.where((part >= cuts[0]) & (part < cuts[1])), path, 0)  # a batch that is run again
    assert sorted(map(str, rollup.read(spark, path).collect())) == want
    one = rollup.read(spark, path, F.col("day") == F.lit("2024-01-05").cast("date"), "agent_3")
    assert sorted(map(str, one.collect())) == [w for w in want if "agent_3" in w and "date(2024, 1, 5)" in w]
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString()


def test_rollup_follows_a_stream_and_reopens_days(spark, tmp_path):
    src, path, cp = (f"{tmp_path}/{x}" for x in ("src", "out", "cp"))
    tasks = logical.tasks(spark, D).select("id", "agent_name", "task_type", "success", "ms", "created_at")
    for late in (False, True):  # the second batch has earlier days than the first
        tasks.where((F.col("created_at") < F.lit("2024-01-10").cast("timestamp_ntz")) == F.lit(late)).write.mode("append").parquet(src)
        rollup.maintain(spark.readStream.schema(tasks.schema).parquet(src), path, cp).awaitTermination()
    assert sorted(map(str, rollup.read(spark, path).collect())) == sorted(map(str, rollup.merged(rollup.partials(tasks)).collect()))


def test_thread_cursors(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{x}" for x in ("src", "out", "cp"))
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)

    def batch(*rows):
        spark.createDataFrame([(s, t, c, at(h), f"c{c}", e) for s, t, c, h, e in rows], cursors.IN).coalesce(1).write.mode("append").parquet(src)
        cursors.collect_comments(spark, src, out, cp, quiet="10 hours").awaitTermination()

    def stored(kind="comment"):
        rows = [(r.source_id, r.thread_id, r.comment_id) for r in cursors.read(spark, out, kind).collect()]
        return sorted(rows, key=lambda r: (r[0], r[1] or 0, r[2] or 0))

    batch(("a", 1, 5, 1, None), ("a", 1, 3, 0, None), ("a", 1, 5, 1, None), ("b", 1, 7, 1, None), ("a", None, 1, 1, None), ("a", 1, None, 1, None))
    first = [("a", 1, 3), ("a", 1, 5), ("b", 1, 7)]
    assert [x for x in stored() if x[1] is not None] == first and len(stored()) == 4
    # late, repeated and new ones after a restart from the checkpoint; other errors are no flag
    batch(("a", 1, 4, 2, None), ("a", 1, 5, 2, None), ("a", 1, 9, 3, None), ("b", 2, 1, 3, None), ("b", 1, None, 3, "Comments are DISABLED here"), ("a", 2, None, 3, "timeout"))
    assert [x for x in stored() if x[1] is not None] == sorted([*first, ("a", 1, 9), ("b", 2, 1)]) and stored("disabled") == [("b", 1, None)]
    # a flagged source is not stored from the next batch on, others are
    batch(("b", 2, 2, 4, None), ("a", 2, 2, 40, None))
    assert ("a", 2, 2) in stored() and ("b", 2, 2) not in stored()
    # event time has passed what was quiet for ten hours: once for each thread
    batch(("a", 3, 1, 41, None))
    batch(("a", 3, 2, 42, None))
    assert [x for x in stored("quiet") if x[1] is not None] == [("a", 1, 9)]  # b is flagged
    assert {(r.source_id, r.thread_id): (r.last_comment, r.comments) for r in cursors.cursors(spark, out).collect()}["a", 1] == (9, 3)


def _stream(spark, tmp_path, fail):
    """A stream whose first runs raise what `fail` lists."""
    df = spark.range(6)
    df.write.mode("overwrite").parquet(f"{tmp_path}/src")

    def write(batch, _):
        if fail:
            raise RuntimeError(fail.pop(0))
        batch.write.mode("append").parquet(f"{tmp_path}/out")

    return lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/src").writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()


def test_a_source_that_fails_twice(spark, tmp_path):
    slept = []
    done = supervise.supervise(spark, _stream(spark, tmp_path, ["Connection reset", "Read timeout"]), base=2.0, sleep=slept.append)
    assert done.status == "active" and done.last_error is None and done.rows == 6
    assert [(n, again) for n, _, again in done.attempts] == [(1, True), (2, True)] and "Connection reset" in done.attempts[0][1]
    assert 2.0 <= slept[0] <= 2.6 and 4.0 <= slept[1] <= 5.2
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def test_a_source_that_fails_for_good(spark, tmp_path):
    slept = []
    done = supervise.supervise(spark, _stream(spark, tmp_path, ["chat access denied", "x"]), sleep=slept.append)
    assert done.status == "error" and len(done.attempts) == 1 and not done.attempts[0][2] and "access denied" in done.last_error and not slept
    done = supervise.supervise(spark, _stream(spark, tmp_path / "b", ["flood"] * 9), attempts=3, sleep=slept.append)
    assert done.status == "error" and [a[2] for a in done.attempts] == [True] * 3 and len(slept) == 2
