"""Every query of the pipeline and its analytics against DuckDB on the smallest tables, and plan shapes."""

import duckdb
import pytest

from quillstream.functions import ids, text
from quillstream.plans import catalogue
from quillstream.sources import logical

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def rows(values, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, D)
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.collect(), df.columns) == rows(rel.fetchall(), rel.columns)


def test_urls_of_numbers_that_begin_with_100(spark, tmp_path):
    """The numbers of groups and channels meet at ids that the smallest tables do not have."""
    numbers = [0, 5, 7, 15, 100, 1000, 1001, 1003, 1005, 1015, 10_003, 10_045, 100_005, 1_005_005, 10_000_005]
    made = [(n, "x", "en", "src3", 1) for n in numbers]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(catalogue.QUERIES["telegram_urls"](spark, str(tmp_path)).collect())
    own = duckdb.connect()
    own.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(own.sql(catalogue.ORACLES["telegram_urls"]).fetchall())
    assert got[1005] is None and got[1000] == "https://t.me/c/1000/1000" and got[1001] == "https://t.me/en/1001"


def test_clusters_have_all_their_members(spark):
    clusters = {r.topic: r for r in catalogue.QUERIES["keyword_clusters"](spark, D).collect()}
    members = {}
    for r in catalogue.QUERIES["keyword_cluster_members"](spark, D).collect():
        assert r.n == clusters[r.topic].n
        members.setdefault(r.topic, set()).add(r.source_ref)
    assert {t: (len(m), min(m)) for t, m in members.items()} == {t: (r.n, r.first_ref) for t, r in clusters.items()}


def test_topic_as_entry(spark):
    from quillstream.operators import topics

    card = spark.sql("SELECT 'topic:r' AS topic_id, 'T' AS title, 's' AS summary, array('a', 'b') AS scope_in, array('c') AS scope_out, cast(null AS array<string>) AS tags, timestamp_ntz'2024-01-02 00:00:00' AS updated_at")
    r = topics.kb_entries(card).first()
    assert (r.kb_id, r.title, r.content, r.topics, r.tags) == ("kb:topic:topic:r", "T", "s\n\n**Scope In:** a, b\n**Scope Out:** c", ["topic:r"], [])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_text_functions(spark):
    assert "Python" not in plan(catalogue.QUERIES["kb_entries"](spark, D))


def test_a_filter_on_topics_cleans_texts_once(spark):
    """Once where rows are filtered and once for those that stay, not for every keyword."""
    df = catalogue.QUERIES["kb_filtered"](spark, D)
    assert plan(df).count("regexp_replace(") <= 2
    many = spark.createDataFrame([("latest news",), (None,), ("",)], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in many.select(text.keyword_topics(F.col("t"))).collect()] == [["laboratory", "news"], [], []]


def test_scan_is_pruned_and_filtered(spark):
    p = plan(catalogue.QUERIES["handoffs_by_agent"](spark, D))
    assert "o_comment" not in p
    assert "PushedFilters: [" in plan(logical.raw_messages(spark, D).where("channel_id = 'src3'").select("id"))


def test_literals(spark):
    df = spark.createDataFrame([(" a  b\n\n c ", "#тег_1 @имя x@почта.рф", "latest news", "-1001234567890")], "a string, b string, c string, d string")
    from pyspark.sql import functions as F

    r = df.select(text.clean_text(F.col("a")).alias("clean"), text.entities_of(F.col("b"), "hashtag").alias("tags"), text.entities_of(F.col("b"), "mention").alias("who"), text.keyword_topics(F.col("c")).alias("topics"), ids.message_url(F.col("d"), F.lit(None).cast("string"), F.lit("123")).alias("url"), text.language(F.lit("яя zz")).alias("lang"), text.language(F.lit("12")).alias("none")).first()
    assert (r.clean, r.tags, r.who, r.topics, r.url, r.lang, r.none) == ("a b c", ["#тег_1"], ["@имя", "@почта"], ["laboratory", "news"], "https://t.me/c/1234567890/123", "en", "unknown")


def test_stream_ingest_is_idempotent(spark, tmp_path):
    from quillstream.streaming.ingest import ingest

    src, dst, cp = (str(tmp_path / x) for x in ("src", "dst", "cp"))
    df = spark.range(10).selectExpr("cast(id AS string) AS ref")
    df.write.parquet(src)
    for _ in range(2):
        ingest(spark, src, df.schema, dst, cp, "ref").awaitTermination()
        df.write.mode("append").parquet(src)  # the same keys again
    ingest(spark, src, df.schema, dst, cp, "ref").awaitTermination()
    assert spark.read.parquet(dst).count() == 10


def test_scorer_isolates_failures(spark):
    from quillstream.operators import scoring

    def scorer(x):
        if x == "bad":
            raise ValueError(x)
        return x.upper()

    done, dead = scoring.split(scoring.apply(spark.createDataFrame([("1", "ok"), ("2", "bad")], "source_ref string, text string"), scorer))
    assert [tuple(r) for r in done.collect()] == [("1", "OK", None, 1)]
    assert [(r.source_ref, r.attempts) for r in dead.collect()] == [("2", 3)]
