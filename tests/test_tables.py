"""Keyed tables, exports, contracts, streaming and stages on literal rows."""

import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillstream.functions import ids, json_ops, text
from quillstream.operators import contracts, export, handoffs, keyed
from quillstream.streaming import ingest


def test_insert_takes_a_null_key_once(spark):
    old = spark.createDataFrame([("a",), (None,)], "k string")
    new = spark.createDataFrame([("a", 1), (None, 2), ("b", 4), ("b", 3)], "k string, v int")
    assert [tuple(r) for r in keyed.insert_if_absent(old, new, "k", F.col("v")).collect()] == [("b", 3)]


def test_upsert_orders_null_versions_and_ties(spark):
    schema = "k string, v string, version int"
    old = spark.createDataFrame([("a", "old", 1), ("b", "old", None), ("c", "old", None), (None, "old", 1)], schema)
    new = spark.createDataFrame([("a", "new", 1), ("b", "new", 1), ("c", "x", None), ("c", "y", None), (None, "new", 0)], schema)
    got = {r.k: (r.v, r.version) for r in keyed.upsert(old, new, ["k"], "version").collect()}
    assert got == {"a": ("new", 1), "b": ("new", 1), "c": ("y", None), None: ("old", 1)}
    first = {r.k: r.v for r in keyed.upsert(old, new, ["k"], "version", ["v"]).collect()}
    assert first == {"a": "old", "b": "old", "c": "old", None: "new"}


def test_handoff_fold_overwrites_with_null(spark):
    rows = [("h", 1, "accepted", 1, "r", None, 5), ("h", 2, "failed", 2, None, "boom", None), ("p", 1, "pending", 1, None, None, None)]
    got = {r.id: tuple(r)[1:] for r in handoffs.fold(spark.createDataFrame(rows, "id string, seq int, status string, at long, result string, error string, ms long")).collect()}
    assert got == {"h": ("failed", None, "boom", None, 1, 2), "p": ("pending", None, None, None, None, None)}


def test_contracts(spark):
    a = lambda *scores: [(f"tg:c:post:{i}", s) for i, s in enumerate(scores)]
    rows = [("1", "cluster", a(0.5)), ("2", "cluster", a(0.5, None)), ("3", "cluster", a(0.5, 1.0)), ("4", "singleton", a(None)), ("5", "singleton", []), (None, "other", a(1.5)), ("7", "singleton", [("tg:a:b:post:1", None)]), ("8", "singleton", None)]
    df = spark.createDataFrame(rows, "topic_id string, type string, anchors array<struct<anchor_ref: string, score: double>>")
    got = {r.topic_id: r.violations for r in contracts.violations(df, contracts.card_rules()).collect()}
    assert got == {"1": ["anchors_of_type"], "2": ["anchors_of_type"], "3": [], "4": [], "5": ["anchors_of_type"], None: ["topic_id_missing", "type_known", "score_range"], "7": ["anchor_ref_form"], "8": ["anchors_of_type", "anchor_ref_form", "score_range"]}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", "x")], "id string, tag string")
    export.write_ndjson(df.coalesce(1), "id", f"{tmp_path}/n")
    assert [json.loads(x) for f in sorted(Path(f"{tmp_path}/n").glob("part*")) for x in f.read_text().splitlines()] == [{"id": "a", "tag": "x"}, {"id": "b", "tag": None}]
    export.archive(df.where("id = 'a'"), f"{tmp_path}/z")
    assert [json.loads(x) for f in Path(f"{tmp_path}/z").glob("part*.gz") for x in gzip.open(f, "rt")] == [{"id": "a", "tag": "x"}]
    export.archive(df.where("id = 'q'"), f"{tmp_path}/none")
    assert not Path(f"{tmp_path}/none").exists()
    assert json.loads(export.catalogue(df, "id", ["tag"]).first().value) == [{"id": "a", "tag": "x"}, {"id": "b"}]
    assert export.verified({"t": (df, df.limit(1))}).first().asDict() == {"name": "t", "n_source": 2, "n_target": 1, "equal": False}


def test_ingest_does_not_take_a_read_error_for_a_missing_table(spark, tmp_path):
    src, dst, cp = (str(tmp_path / x) for x in ("src", "dst", "cp"))
    df = spark.range(3).selectExpr("cast(id AS string) AS ref")
    df.write.parquet(src)
    ingest.ingest(spark, src, df.schema, dst, cp, "ref").awaitTermination()
    for f in Path(dst).glob("*/part*"):
        f.write_bytes(b"broken")
    for f in Path(dst).glob("*/.part*"):
        f.unlink()
    df.write.mode("append").parquet(src)
    with pytest.raises(Exception):  # noqa: B017
        ingest.ingest(spark, src, df.schema, dst, cp, "ref").awaitTermination()


def test_daily_rollup_closes_days(spark, tmp_path):
    schema = "agent_name string, task_type string, success boolean, ms long, created_at timestamp"
    rows = [("a", "t", True, 5, "2024-01-01 10:00:00"), ("a", "t", False, 7, "2024-01-01 23:00:00"), ("a", "t", True, 1, "2024-01-05 00:00:00")]
    df = spark.createDataFrame(rows, "agent_name string, task_type string, success boolean, ms long, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    df.write.parquet(f"{tmp_path}/s")
    q = ingest.daily_rollup(spark.readStream.schema(schema).parquet(f"{tmp_path}/s")).writeStream.format("memory").queryName("rolled").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.tasks, r.ok, r.ms) for r in spark.table("rolled").collect()] == [(2, 1, 12)]


@pytest.mark.parametrize("kind,body,want", [("url", "see https://a.b/c?d=1, and http://x", ["https://a.b/c?d=1,", "http://x"]), ("phone", "+7 (912) 345-67-89 +79123456789 +1 912", ["+7 (912) 345-67-89", "+79123456789"]), ("name_ru", "Иван Петров и Анна Мария Сидорова. Ян Ли", ["Иван Петров", "Анна Мария Сидорова"]), ("date", "1.2.2024 12/31/99 1.2", ["1.2.2024", "12/31/99"]), ("email", "я@почта.рф x", ["я@почта.рф"])])
def test_entities(spark, kind, body, want):
    assert spark.range(1).select(text.entities_of(F.lit(body), kind).alias("e")).first().e == want


@pytest.mark.parametrize("channel,username,url", [("any", "mychannel", "https://t.me/mychannel/123"), ("-1001234567890", None, "https://t.me/c/1234567890/123"), ("publicchannel", None, "https://t.me/publicchannel/123"), ("My_Channel_2024", None, "https://t.me/My_Channel_2024/123"), ("abc", None, None), ("-55", None, None), ("a.b.c.d", None, None)])
def test_message_url(spark, channel, username, url):
    lit = lambda x: F.lit(x).cast("string")
    assert spark.range(1).select(ids.message_url(lit(channel), lit(username), F.lit("123")).alias("u")).first().u == url


def test_canonical_json_sorts_keys_and_keeps_nulls(spark):
    r = spark.sql("SELECT 'я' AS b, cast(null AS int) AS a").select(json_ops.canonical(b=F.col("b"), a=F.col("a")).alias("j")).first()
    assert r.j == '{"a":null,"b":"я"}'


def test_times(spark):
    r = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05.678' AS t, timestamp_ntz'2024-01-02 03:04:04' AS u")
    got = r.select(text.iso(F.col("t")).alias("i"), text.parse_iso(F.lit("2024-01-02T03:04:05Z")).cast("string").alias("p"), text.parse_iso(F.lit("no")).alias("n"), text.duration_ms(F.col("u"), F.col("t")).alias("d")).first()
    assert tuple(got) == ("2024-01-02T03:04:05", "2024-01-02 03:04:05", None, 1678)
