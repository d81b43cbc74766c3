"""Benchmark decontamination: short test items inside long documents by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles; partition k holds those of [2**k, 2**(k+1)).  For each partition a
document is cut into windows of 2**(k+1) shingles, so that the sets compared are of like size however long the document
is, and a window is looked up by each of its HASHES minima on its own (bands of one row).  If a document holds at
least 80 % of an item's shingles, in one place or scattered, the Jaccard similarities of its windows with the item sum to
about a quarter or more, and all 64 minima miss with a probability below exp(-16).  Minima of items are rows that the windows'
minima are joined with.  Each candidate is then verified by the exact share of the item's shingles that the document has, by another join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm import anchors
from quillstream.llm.common import hot_keys, materialize, split_join, table
from quillstream.llm.repeats import keyed

WORDS, PERCENT, HASHES = 5, 80, 64
#: Most bits of a bitmap (32 MB, whatever the benchmark), and those of a row of it.
MOST_BITS, ROW = 1 << 28, 1 << 15

_RNG = np.random.Generator(np.random.PCG64(77))
_A = _RNG.integers(1 << 30, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(raw: np.ndarray, edge: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of texts, in order, and where each text's begin; fewer words make one shingle, no words none."""
    own = _LOWER[raw]
    start, end, owner = anchors.words(own, edge)
    hashes = anchors.word_hashes(own, start, end)
    inner = np.searchsorted(owner, np.arange(len(edge)))
    n = max(0, len(hashes) - words + 1)
    out = np.full(n, words, dtype=np.uint64)
    for j in range(words):
        out = anchors.mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n + j])
    keep = owner[:n] == owner[len(owner) - n :]
    out, of = out[keep], owner[:n][keep]
    length = np.diff(inner)
    short = np.flatnonzero((length > 0) & (length < words))
    if len(short):
        whole = length[short].astype(np.uint64)
        for j in range(words - 1):
            more = np.flatnonzero(length[short] > j)
            whole[more] = anchors.mix(whole[more] * np.uint64(0x9E3779B97F4A7C15) + hashes[inner[short[more]] + j])
        out, of = np.concatenate((out, whole)), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, np.searchsorted(of, np.arange(len(edge)))


def minima(values: np.ndarray, cuts: np.ndarray) -> Iterator[np.ndarray]:
    """For each hash function, its minimum over each window; windows begin at cuts."""
    low = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    for a, b in zip(_A, _B, strict=True):
        h = (low ^ b) * a
        h ^= h >> np.uint32(15)
        yield np.minimum.reduceat(h, cuts)


def windows(values: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first shingle) of each window of size partition k; texts begin at `at`."""
    width = 2 << k
    count = -(-np.diff(at) // width)
    owner = np.repeat(np.arange(len(count)), count)
    return owner, at[owner] + (np.arange(len(owner)) - (np.cumsum(count) - count)[owner]) * width


def keys(k: int, h: int, m: np.ndarray) -> np.ndarray:
    """The numbers of minima m of hash function h in size partition k."""
    return m.astype(np.int64) | (k << 40 | h << 32)


def slots(values: np.ndarray, bits: int) -> np.ndarray:
    return (anchors.mix(values.view(np.uint64)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def chunks(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingles, where each row's begin) for rows of about anchors.BLOCK bytes."""
    raw, edge = anchors.utf8(batch.column("text"))
    lo = 0
    while lo < len(edge) - 1:
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + anchors.BLOCK, side="right")) - 1)
        values, at = shingles(raw[edge[lo] : edge[hi]], edge[lo : hi + 1] - edge[lo], words)
        yield lo, values, np.append(at[: hi - lo], len(values))
        lo = hi


def indexed(texts: DataFrame, words: int) -> DataFrame:
    """item, size, own (its distinct shingles, packed) and keys (its HASHES minima) of each text (item, text) with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for lo, values, at in chunks(batch, words):
                for i in np.flatnonzero(np.diff(at)).tolist():
                    own = np.unique(values[at[i] : at[i + 1]])
                    k = len(own).bit_length() - 1
                    least = np.concatenate([keys(k, h, m) for h, m in enumerate(minima(own, np.zeros(1, dtype=np.int64)))])
                    rows.append((lo + i, len(own), own.tobytes(), least))
            if rows:
                item = batch.column("item").take(pa.array([r[0] for r in rows]))
                yield pa.RecordBatch.from_arrays([item, pa.array([r[1] for r in rows], type=pa.int64()), pa.array([r[2] for r in rows], type=pa.binary()), pa.array([r[3] for r in rows], type=pa.list_(pa.int64()))], names=["item", "size", "own", "keys"])

    return texts.select("item", "text").mapInArrow(run, "item long, size long, own binary, keys array<long>")


def unpacked(items: DataFrame) -> DataFrame:
    """item, size, shingle: a row for each shingle of items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, dtype=np.int64) for x in batch.column("own").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("doc_id", "th", "item", "size")], pa.array(np.concatenate(own))], names=schema.names)

    schema = T.StructType([*[items.schema[c] for c in ("doc_id", "th", "item", "size")], T.StructField("shingle", T.LongType())])
    return items.select("doc_id", "th", "item", "size", "own").mapInArrow(run, schema)


def bitmap(numbers: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of a column `number`: 2**28 bits at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots(batch.column("number").to_numpy(zero_copy_only=False), bits)))], names=["slot"])

    at = numbers.mapInArrow(run, "slot long").select(F.floor(F.col("slot") / ROW).cast("int").alias("row"), (F.col("slot") % ROW).alias("bit"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    size = min(ROW, bits) // 8
    for row, part in at.groupBy("row").agg(F.bitmap_construct_agg("bit")).toLocalIterator():  # bits / ROW rows, a bit each time a number
        out[row * size : (row + 1) * size] |= np.frombuffer(part, dtype=np.uint8)[:size]
    return out


def fitting(entries: int) -> int:
    """Bits of a bitmap for so many numbers: 64 for each, between 2**16 and MOST_BITS."""
    return min(MOST_BITS, max(1 << 16, 1 << (64 * entries - 1).bit_length()))


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, th, item_id, item_shingles, shared, containment: a row for each item that a document holds.

    Shingles: `words` words, A-Z in lower case; fewer words make one shingle, which only an equal sequence has.  Held:
    100 * shared >= percent * item_shingles.  Texts without words hold nothing, items without words are held by nothing.  Equal ids and repeated rows get a row each.  Empty tables: no rows.
    Other columns are ignored.  Items are never gathered: tasks get two bitmaps, of minima and of shingles, of MOST_BITS at most, which only
    say what cannot be in an item.
    """
    spark = docs.sparkSession
    named = benchmark.where("text is not null").select("item_id", F.xxhash64("text").alias("item"), "text")
    items = materialize(indexed(named.select("item", "text").distinct(), words), "leaks-items")
    entries, total = items.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    sizes = sorted(r[0] for r in items.select(F.floor(F.log2("size")).cast("int")).distinct().collect())  # one for each power of two
    key_bits, shingle_bits = fitting(entries), fitting(total)
    minimum_map = spark.sparkContext.broadcast(bitmap(items.select(F.explode("keys").alias("number")), key_bits))
    none = items.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("th"), "item", "size", "own")
    shingle_map = spark.sparkContext.broadcast(bitmap(unpacked(none).select(F.col("shingle").alias("number")), shingle_bits))
    own = keyed(docs)
    at = T.StructType([docs.schema["doc_id"], T.StructField("th", T.LongType()), T.StructField("number", T.LongType())])

    def may_be(known: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
        s = slots(values, bits)
        return (known[s >> 3] >> (s & 7)) & 1 > 0

    def told(batch: pa.RecordBatch, rows: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        of = pa.array(rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("th").take(of), pa.array(numbers)], names=at.names)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The minima of windows that an item may have."""
        known = minimum_map.value
        for batch in batches:
            for lo, values, begin in chunks(batch, words):
                found = []
                for k in sizes if len(values) else ():
                    owner, cuts = windows(values, begin, k)
                    for h, m in enumerate(minima(values, cuts)):
                        own_keys = keys(k, h, m)
                        hit = np.flatnonzero(may_be(known, key_bits, own_keys))
                        if len(hit):
                            found.append(np.stack((owner[hit], own_keys[hit]), axis=1))
                if found:
                    rows = np.unique(np.concatenate(found), axis=0)
                    yield told(batch, lo + rows[:, 0], rows[:, 1])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct shingles of texts that an item may have."""
        known = shingle_map.value
        for batch in batches:
            for lo, values, begin in chunks(batch, words):
                hit = np.flatnonzero(may_be(known, shingle_bits, values.view(np.int64)))
                if len(hit):
                    rows = np.unique(np.stack((np.searchsorted(begin, hit, side="right") - 1, values.view(np.int64)[hit]), axis=1), axis=0)
                    yield told(batch, lo + rows[:, 0], rows[:, 1])

    near = materialize(own.mapInArrow(least, at), "leaks-minima")
    of_key = items.select(F.explode("keys").alias("number"), "item").groupBy("number").agg(F.collect_set("item").alias("items"))
    hot = hot_keys(near.groupBy("number").agg(F.count("*").alias("__n")), ["number"], "__n")
    pairs = split_join(near, of_key, ["number"], hot, ["doc_id", "th"]).select("doc_id", "th", F.explode("items").alias("item")).distinct()
    pairs = materialize(pairs, "leaks-pairs")
    hot = hot_keys(pairs.groupBy("item").agg(F.count("*").alias("__n")), ["item"], "__n")
    asked = unpacked(split_join(pairs, items.select("item", "size", "own"), ["item"], hot, ["doc_id", "th"])).withColumnRenamed("shingle", "number").alias("a")
    texts = own.join(pairs.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct(), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left_semi")
    # each of a document's repeated rows has its shingles once
    there = texts.mapInArrow(held, at).groupBy("doc_id", "th", "number").agg(F.count("*").alias("copies")).alias("t")
    same = F.col("a.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("a.th") == F.col("t.th")) & (F.col("a.number") == F.col("t.number"))
    found = asked.join(there, same).groupBy("a.doc_id", "a.th", "a.item").agg(F.first("a.size").alias("item_shingles"), F.count("*").alias("shared"), F.first("t.copies").alias("copies"))
    found = found.where(F.col("shared") * 100 >= F.col("item_shingles") * percent).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    found = found.join(named.drop("text"), "item")
    return found.select("doc_id", "th", "item_id", "item_shingles", "shared", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that hold no item."""
    held = leaks(docs, benchmark, words, percent).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    return docs.join(held, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__th")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "item_shingles", "shared", F.round("containment", 6).alias("containment"))


ORACLE = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS item_shingles FROM g GROUP BY item_id),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
h AS (SELECT doc_id, item_id, count(*) AS shared FROM s JOIN g USING (gram) GROUP BY ALL)
SELECT doc_id, item_id, item_shingles, shared, round(shared / item_shingles, 6) AS containment
FROM h JOIN n USING (item_id) WHERE 100 * shared >= 80 * item_shingles
"""
