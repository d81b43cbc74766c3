"""Resolution of not-modified revisits in web archives.

A revisit says that a page was what it had been: it has headers but no payload.  It is resolved by an as-of join: the latest
earlier full response of the same canonical URL, if their validators agree; the headers that such an answer may change
are merged into the stored ones.

The join is a window over (canonical URL, slice of time); the last response before a slice comes from a second window over
one row for each slice, so a URL with very many captures is spread over its slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm.common import table

#: Headers that describe the payload or the connection of the stored response, which a revisit must not change (fixed values).
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-location", "content-range", "content-type", "keep-alive", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that only track where a visitor came from (fixed values).
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"
SLICE_SECONDS = 1 << 16


def canonical(url: Column) -> Column:
    """Lower-case host without scheme, user, www and default port; path without closing slash; sorted query without tracking."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(?:80|443)$", "")
    rest = F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(rest, r"/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(rf"^{TRACKING}(?:=|$)"))
    sorted_query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(sorted_query != "", F.concat(F.lit("?"), sorted_query)).otherwise(F.lit("")))


def validators_agree(revisit: Column, response: Column) -> Column:
    """By the strongest validator that both have: ETag (weak comparison), Last-Modified, payload digest; none: no."""
    tag = lambda c: F.regexp_replace(F.try_element_at(c.getField("headers"), F.lit("etag")), "^W/", "")
    modified = lambda c: F.try_element_at(c.getField("headers"), F.lit("last-modified"))
    return F.coalesce(tag(revisit) == tag(response), modified(revisit) == modified(response), revisit.getField("digest") == response.getField("digest"), F.lit(False))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers with those of the revisit that it may change; names are lower-case."""
    changes = F.map_filter(F.coalesce(update, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*KEPT_HEADERS))
    rest = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(changes, k))
    return F.map_concat(rest, changes)


def resolve(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """record_id, canonical, outcome, response_id, digest, headers for each revisit of records.

    records: record_id, url, ts (seconds), revisit (boolean), headers (map, lower-case names), digest.  outcome: resolved;
    mismatch (the latest earlier response's validators differ); no_response.  Earlier: a smaller ts; of responses with
    equal ts the one with the largest record_id counts.  A null url or ts leaves a revisit without response and a
    response unused; revisit null: a response.  Repeated revisits get a row each.  Empty table: no rows.  Other columns are ignored.
    """
    r = records.select("record_id", "url", "ts", F.coalesce("revisit", F.lit(False)).alias("revisit"), "headers", "digest")
    r = r.withColumn("canonical", canonical(F.col("url"))).withColumn("slice", F.floor(F.col("ts") / slice_seconds))
    me = F.struct("record_id", "headers", "digest")
    known = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    full = ~F.col("revisit") & known
    # records of no known URL or time have no response and would all meet in one task: each gets a place of its own
    r = r.withColumn("place", F.when(known, F.col("canonical")).otherwise(F.concat_ws(" ", F.lit("?"), "record_id", "url", "ts")))
    r = r.withColumn("me", me).withColumn("stored", F.when(full, F.struct("ts", "record_id", "headers", "digest").alias("s")))
    lasts = r.where("stored is not null").groupBy("canonical", "slice").agg(F.max_by("stored", F.struct("ts", "record_id")).alias("last"))
    spans = r.where(F.col("revisit") & known).select("canonical", "slice").distinct().join(lasts, ["canonical", "slice"], "full")
    carry = spans.withColumn("before", F.last("last", ignorenulls=True).over(Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    carry = carry.select(F.col("canonical").alias("c_url"), F.col("slice").alias("c_slice"), "before")
    # responses after revisits of the same second: a response must be earlier; of equal seconds the largest id comes last
    within = Window.partitionBy("place", "slice").orderBy("ts", F.col("revisit").desc(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    own = r.withColumn("near", F.last("stored", ignorenulls=True).over(within)).where("revisit")
    joined = own.join(carry, (F.col("place") == F.col("c_url")) & (F.col("slice") == F.col("c_slice")), "left")
    joined = joined.withColumn("response", F.when(known, F.coalesce("near", "before")))
    agree = validators_agree(F.col("me"), F.col("response"))
    found = F.col("response").isNotNull()
    return joined.select(
        "record_id",
        "canonical",
        F.when(~found, "no_response").when(agree, "resolved").otherwise("mismatch").alias("outcome"),
        F.when(found & agree, F.col("response.record_id")).alias("response_id"),
        F.when(found & agree, F.col("response.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(found & agree, merged_headers(F.col("response.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Records made of the page table: a response for each page, and a revisit of another spelling of its URL.

    The response of page p is captured at second 10 p, the revisit at 10 p + 1000003, or at 10 p - 5 for every seventh
    page; the ETag is the page's digest, and every fifth revisit has none but a Last-Modified that the response lacks.
    """
    p = F.col("page_id")
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    base = pages.select("page_id", "url", digest.alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("bytes"))
    response = base.select((p * 2).alias("record_id"), "url", (p * 10).alias("ts"), F.lit(False).alias("revisit"), F.create_map(F.lit("etag"), F.concat(F.lit("W/"), "digest"), F.lit("content-length"), F.col("bytes"), F.lit("date"), (p * 10).cast("string")).alias("headers"), "digest")
    late = F.when(p % 7 == 0, p * 10 - 5).otherwise(p * 10 + 1000003)
    tag = F.when(p % 5 == 0, F.create_map(F.lit("last-modified"), F.lit("x"), F.lit("content-length"), F.lit("0"), F.lit("date"), late.cast("string"))).otherwise(F.create_map(F.lit("etag"), F.col("digest"), F.lit("content-length"), F.lit("0"), F.lit("date"), late.cast("string")))
    revisit = base.select((p * 2 + 1).alias("record_id"), F.concat("url", F.when(p % 2 == 0, F.lit("#again")).otherwise(F.lit(""))).alias("url"), late.alias("ts"), F.lit(True).alias("revisit"), tag.alias("headers"), F.when(p % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("digest")).alias("digest"))
    return response.unionByName(revisit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(captures(table(spark, sf_dir, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.getField("key"), F.lit("="), e.getField("value"))))
    return out.select("record_id", "canonical", "outcome", "response_id", "digest", F.array_join(entries, ";").alias("headers"))


ORACLE = r"""
WITH p AS (
  SELECT page_id AS p, url, sha1(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS bytes,
         CASE WHEN page_id % 7 = 0 THEN page_id * 10 - 5 ELSE page_id * 10 + 1000003 END AS late,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?', '') AS bare
  FROM pages),
k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(?:80|443)$', '')
             || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS page_url,
             array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'),
               lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)'))), '&') AS q FROM p),
c AS (SELECT *, page_url || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM k),
j AS (SELECT v.p, v.late, v.canonical, v.digest AS own, r.p AS rp, r.digest AS stored, r.bytes,
             row_number() OVER (PARTITION BY v.p ORDER BY r.p DESC) AS rn
      FROM c v LEFT JOIN c r ON v.canonical = r.canonical AND r.p * 10 < v.late),
o AS (SELECT *, CASE WHEN rp IS NULL THEN 'no_response' WHEN p % 5 <> 0 AND own = stored THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j WHERE rn = 1)
SELECT p * 2 + 1 AS record_id, canonical, outcome,
       CASE WHEN outcome = 'resolved' THEN rp * 2 END AS response_id,
       CASE WHEN p % 5 <> 0 THEN own END AS digest,
       CASE WHEN outcome = 'resolved' THEN 'content-length=' || bytes || ';date=' || late || ';etag=' || own
            WHEN p % 5 = 0 THEN 'content-length=0;date=' || late || ';last-modified=x'
            ELSE 'content-length=0;date=' || late || ';etag=' || own END AS headers
FROM o
"""
