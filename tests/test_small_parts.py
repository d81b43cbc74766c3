"""Lines with physical numbers, templates, scans of comments, archives."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillstream.functions import templates
from quillstream.operators import export, keyed, normalise, scoring, threads
from quillstream.plans import artefacts
from quillstream.sources import lines


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_line_numbers_of_files_in_many_splits(spark, tmp_path, small_splits):
    bodies = {"a.txt": "".join(f"line {i} {'é' * (i % 50)}\n" + "\n" * (i % 3) for i in range(900)), "b.txt": "no end", "c.txt": "", "d.txt": "\n\n \nx\n"}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    df = lines.numbered(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 8
    got = sorted((r.file.rpartition("/")[2], r.line, r.value) for r in df.collect())
    want = sorted((name, i, v) for name, body in bodies.items() for i, v in enumerate(body.removesuffix("\n").split("\n") if body else []))
    assert got == want
    got = sorted((r.file.rpartition("/")[2], r.line, r.value) for r in lines.first_lines(spark, str(tmp_path), 10).collect())
    assert got == [x for x in want if x[1] < 10 and x[2].strip()]


def test_first_records(spark, tmp_path):
    (tmp_path / "x").write_text('{"a": 1}\n\n{"a": 2}\nnot json\n')
    assert [tuple(r)[1:] for r in lines.first_records(spark, str(tmp_path), "a int", 3).orderBy("line").collect()] == [(0, 1), (2, 2)]
    with pytest.raises(Exception):  # noqa: B017
        lines.first_records(spark, str(tmp_path), "a int", 4).collect()


def test_templates(spark):
    df = spark.createDataFrame([("x{y}", 0.125, None), (None, None, 5)], "text string, score double, n int")
    fields = {c: F.col(c) for c in df.columns}
    show = lambda t, absent=None: [r[0] for r in df.select(templates.rendered(t, fields, absent)).collect()]
    assert show("a {{}} {text}|{score:.2f}|{n}", "N/A") == ["a {} x{y}|0.13|N/A", "a {} N/A|N/A|5"]
    assert show("{text}{text}") == ["x{y}x{y}", None] and show("{none} é", "-") == ["- é", "- é"] and show("") == ["", ""]
    assert templates.fields_of("{a} {b:.1f} {a} {{c}}") == ["a", "b"]
    with pytest.raises(KeyError):
        templates.rendered("{none}", fields)
    for bad in ("{text!r}", "{text:>9}", "{text.x}", "{", "}", "{}"):
        with pytest.raises(ValueError):
            templates.rendered(bad, fields)


def test_comments_above_cursors(spark):
    comments = spark.createDataFrame([(1, i) for i in (3, 4, 9, 12)] + [(2, i) for i in (5, 6, 7)] + [(None, 1), (3, 2)], "thread_id int, id int")
    cursors = spark.createDataFrame([(1, 3), (3, 2), (9, 9)], "thread_id int, last_comment int")
    rows = lambda n: sorted((r.thread_id or 0, r.id, r.place) for r in threads.comments_above(comments, cursors, n).collect())
    assert rows(None) == [(0, 1, 1), (1, 4, 1), (1, 9, 2), (1, 12, 3), (2, 5, 3), (2, 6, 2), (2, 7, 1)]
    assert rows(2) == [(0, 1, 1), (1, 4, 1), (1, 9, 2), (2, 6, 2), (2, 7, 1)]
    plan = threads.comments_above(comments, cursors, 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_archives(spark, tmp_path):
    at = datetime(2024, 1, 2, 3, 4, 5)
    df = spark.range(5).withColumn("t", F.lit("я"))
    made = export.archive_all({"tasks": df, "none": df.where("id < 0")}, str(tmp_path), at)
    export.archive_all({"tasks": df.limit(2)}, str(tmp_path), datetime(2025, 1, 1))
    assert made == {"tasks": f"{tmp_path}/tasks_20240102_030405.ndjson.gz", "none": None}
    got = export.archives(spark, str(tmp_path)).collect()
    assert [r.filename for r in got] == ["tasks_20250101_000000.ndjson.gz", "tasks_20240102_030405.ndjson.gz"] and all(r.size_bytes > 0 and r.created_at for r in got)
    assert sorted(tuple(r) for r in export.read_archive(spark, made["tasks"], df.schema).collect()) == [(i, "я") for i in range(5)]
    plan = export.archives(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan.replace("...", "") or "content" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_conflicts_are_logged_with_what_is_new(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", None, 2), ("c", "z", 3)], "ref string, text string, date int")
    new = spark.createDataFrame([("a", "x", 1), ("b", "y", 5), ("c", None, 3), ("d", "n", 4)], "ref string, text string, date int")
    got = {tuple(r) for r in keyed.conflict_log(old, new, "ref", ["text", "date"], F.lit(9), F.to_json(F.struct("text"))).collect()}
    assert got == {("b", 9, "changed: text, date", '{"text":"y"}', "y", 5), ("c", 9, "changed: text", None, None, 3)}


def test_messages_of_a_source(spark):
    rows = [("@@ch", "post", 5, "t", "m", None, 3, None), ("ch", "comment", 6, "", "m", None, 3, "5"), ("ch", "comment", 7, None, None, None, 0, "5"), ("ch", "comment", 8, None, None, None, None, None), ("a:b", "post", 9, "t", None, None, None, None), ("ch", "story", 10, "t", None, None, None, None)]
    df = spark.createDataFrame(rows, "channel string, kind string, id long, text string, message string, date timestamp_ntz, reply_to long, thread string")
    got = [(r.source_ref, r.text, r.thread_id, r.parent_message_id) for r in normalise.messages(df, F.lit("2024-01-01").cast("timestamp_ntz")).collect()]
    assert got == [("tg:ch:post:5", "t", "5", None), ("tg:ch:comment:6", "m", "5", "3"), ("tg:ch:comment:7", "", "5", "5"), ("tg:ch:comment:8", "", "8", "8"), (None, "t", "9", None), (None, "t", "10", None)]


def test_scorers_run_in_as_many_tasks_as_asked_for(spark):
    docs = spark.range(40).selectExpr("cast(id AS string) AS source_ref", "'x' AS text")
    for n in (1, 3):
        scored = scoring.apply(docs, str.upper, parallelism=n)
        assert scored.rdd.getNumPartitions() == n and scored.where("reply = 'X' and attempts = 1").count() == 40


def test_the_lines_of_a_detail_are_its_file(spark):
    rows = artefacts.details_in_full(spark, "/root/testdata/sf0.001").orderBy("topic_id", "part", "line").collect()
    files = {}
    for r in rows:
        files[r.file] = files.get(r.file, "") + r.value
    assert len(files) > 3
    for name, text in files.items():
        made = json.loads(text)
        assert set(made) == {"export_version", "exported_at", "resolved_sources", "topic_bundle", "topic_card"}
        card, bundle, found = made["topic_card"], made["topic_bundle"], made["resolved_sources"]
        assert name == f"topic_{card['id'].replace(':', '_')}.json" and card["id"] == bundle["topic_id"] == "topic:" + card["anchors"][0]["anchor_ref"]
        refs = {a["anchor_ref"] for a in card["anchors"]} | {i["source_ref"] for i in bundle["items"]}
        assert refs == {s["source_ref"] for s in found} and len(found) == len(bundle["items"])
        assert all(s["role"] == "anchor" for s in found[: len(card["anchors"])]) and "topic_card" in text and card["metadata"]["algorithm"] == "llm_clustering"
