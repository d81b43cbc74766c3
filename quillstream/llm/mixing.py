"""Mixing sources to target weights with hash-threshold histograms.

Budgets are met by nested thresholds on a hash of the document id: words are summed by source and hash bucket, the
bucket in which a source's budget runs out is found, and only that bucket is split further.  No document is sorted and
no document travels: what is shuffled are histograms of `sources x buckets` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm.common import WORD, materialize, table

#: Bits of the document hash that each round of refinement looks at; three rounds use 30 bits.
BITS, ROUNDS = 10, 3


def _draw(doc_id: Column) -> Column:
    """The first 30 bits of the MD5 of the id."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32 - BITS * ROUNDS)


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_repeats: int, cycle: int) -> DataFrame:
    """source, source_size, weight, target from (source, source_size).

    Sources by code point, null last, weigh 1..cycle, repeating.  All words are shared by weight; a source stops at
    max_repeats times its own size and the excess goes to the others by weight.  That is water-filling: with the sources
    in the order of cap / weight, those before the first one that the remaining level does not fill get their cap; levels fall
    from there on, so it is the highest of them.
    """
    # one row for each source: the global windows are over that small table, not over documents
    ranked = sizes.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1).cast("long")).withColumn("cap", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = ranked.withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    final = filled.withColumn("water", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    return final.select("source", "source_size", "weight", F.when(F.col("water").isNull() | (F.col("cap") <= F.col("water") * F.col("weight")), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def thresholds(docs: DataFrame, max_repeats: int = 3, cycle: int = 3) -> DataFrame:
    """A row for each source of docs: source, source_size, weight, target, whole, prefix, left.

    Every document of the source is taken `whole` times, and once more if its hash lies below prefix; left is what is then
    missing in the target.
    """
    narrow = docs.select("doc_id", "source", _size().alias("size")).withColumn("draw", _draw(F.col("doc_id")))
    # the finest histogram is as long as the table at most and is all that the rounds look at
    narrow = materialize(narrow.groupBy("source", "draw").agg(F.sum("size").alias("size")), "mix-sizes")
    goal = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeats, cycle)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    state = materialize(goal.select("*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix")), "mix-goal")
    for k in range(ROUNDS):
        state = materialize(_refine(narrow, state, k), f"mix-round{k}")
    return state


def take(docs: DataFrame, state: DataFrame) -> DataFrame:
    """docs with size, source_size, target, copies and taken, by the thresholds of its sources."""
    made = ("size", "source_size", "target", "copies", "taken")
    d = docs.drop(*[c for c in docs.columns if c.lower() in made]).alias("d")
    s = state.select("source", "source_size", "target", "whole", "prefix").alias("s")
    joined = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source")))
    copies = F.col("s.whole") + (_draw(F.col("d.doc_id")) < F.col("s.prefix")).cast("long")
    out = joined.select("d.*", _size().alias("size"), "s.source_size", "s.target", copies.alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, max_repeats: int = 3, cycle: int = 3) -> DataFrame:
    """docs with size, source_size, target, copies and taken for every row.

    Each document is taken floor(target / source_size) times, and once more if its hash lies below the source's
    threshold: the one at which the words below it come nearest to what is left of the target.
    Null text: size 0.  Null source: a source of its own, last.  Rows with equal ids share a hash and so a decision.
    Empty table: no rows.  A source without words: target 0, taken 0.  Columns named like a result are replaced.
    """
    return take(docs, thresholds(docs, max_repeats, cycle))


def sample(docs: DataFrame, max_repeats: int = 3, cycle: int = 3) -> DataFrame:
    """The rows of docs as often as the mix takes them, max_repeats times at most; every column stays as it is.

    Null text, null source, repeated rows and empty tables as in mix; a document without words may be left out or repeated like others.
    """
    state = thresholds(docs, max_repeats, cycle).select(F.col("source").alias("__source"), F.col("whole").alias("__whole"), F.col("prefix").alias("__prefix"))
    joined = docs.join(state, docs["source"].eqNullSafe(state["__source"]))
    copies = F.least(F.col("__whole") + (_draw(docs["doc_id"]) < F.col("__prefix")).cast("long"), F.lit(max_repeats))
    taken = joined.withColumn("__copies", copies).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[docs[c] for c in docs.columns])


def _refine(narrow: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """One round: split the boundary bucket of each source into 2**BITS, find where the budget runs out in it."""
    shift = BITS * (ROUNDS - 1 - k)
    s = state.select(F.col("source").alias("s_source"), "prefix", "left")
    inside = narrow.join(s, narrow.source.eqNullSafe(s.s_source)).where(F.shiftright("draw", shift + BITS) == F.col("prefix"))
    histogram = inside.groupBy("source", "left", F.shiftright("draw", shift).alias("bucket")).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bucket")
    full = histogram.withColumn("sum", F.sum("words").over(running)).where(F.col("sum") <= F.col("left"))
    # the boundary bucket is the first one with words that does not fit any more
    over = histogram.withColumn("sum", F.sum("words").over(running)).where(F.col("sum") > F.col("left")).groupBy("source").agg(F.min("bucket").alias("edge"), F.min("sum").alias("reached"))
    used = full.groupBy("source").agg(F.max("sum").alias("used"))
    t, o, u = state.alias("t"), over.alias("o"), used.alias("u")
    out = t.join(o, F.col("t.source").eqNullSafe(F.col("o.source")), "left").join(u, F.col("t.source").eqNullSafe(F.col("u.source")), "left")
    # without an edge everything fits: the threshold is the end of the bucket that was split
    edge = F.coalesce(F.col("o.edge"), F.shiftleft(F.col("t.prefix") + 1, BITS))
    if k == ROUNDS - 1:  # nothing is left to split: the bucket goes in if that comes nearer to the target
        edge = edge + (F.coalesce(F.col("o.reached") - F.col("t.left") < F.col("t.left") - F.coalesce(F.col("u.used"), F.lit(0)), F.lit(False))).cast("long")
    return out.select("t.source", "t.source_size", "t.weight", "t.target", "t.whole", (F.col("t.left") - F.coalesce(F.col("u.used"), F.lit(0))).alias("left"), edge.cast("long").alias("prefix"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) >> 2 AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS DOUBLE)
               / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
      FROM r WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, max(CASE WHEN cap > level * weight THEN level END) OVER () AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN water IS NULL OR cap <= water * weight THEN CAST(cap AS DOUBLE) ELSE water * weight END AS target FROM f),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, u.source_size, u.target, u.whole,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw RANGE UNBOUNDED PRECEDING) AS below,
             sum(d.size) OVER (PARTITION BY d.source, d.draw) AS own, target - whole * source_size AS rest
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN below <= rest OR (below - own <= rest AND below - rest < rest - (below - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
