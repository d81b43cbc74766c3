"""Line dedup by an exact set-similarity join.

The tokens of a line are its distinct words, rarest first; rarity is the frequency of the word's slot in a table of fixed
size, which any number of documents fits.  Lines of equal word sequences form a class.  Two sets with a Jaccard similarity
of t or more share one of their first `n - ceil(t n) + 1` tokens, so these are the keys of the join:

1. A survey of the texts writes the class of each line and counts slots.
2. Python tasks deal (token, class, size, place, bitmap) keys to token buckets as packed columns.  In a bucket, pairs of one
   token are cut by size, by place and by bitmap: at the first token in common, whatever two sets share lies from there
   on in both.  What goes on are not the pairs but the classes that have any, with the tokens at which they do.
3. Token sets of those classes alone are fetched.  A class needs just one earlier class that it resembles, so each asks
   first at one token, in its own chunk of it; what finds nothing there asks at all its tokens, in all chunks.
4. A line goes if its class, or one that resembles it, occurs earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm import anchors
from quillstream.llm.common import materialize, table
from quillstream.llm.repeats import keyed, same_doc

PERCENT = 80
#: Bits of a slot of the frequency table, and slices in which tasks add up to it.
SLOT_BITS, SLICES = 18, 16
SLOTS, REST = 1 << SLOT_BITS, np.uint64((1 << (64 - SLOT_BITS)) - 1)
#: Words in a slot from which its tokens are split by the size of the line as well.
HOT = 1 << 20
#: Pairs that are looked at at once, classes in a verifying group, and about so many rows of keys for a bucket.
PAIRS, CHUNK, BUCKET_ROWS = 1 << 20, 1024, 100_000
#: Neighbours by size with which a key is compared before all others are.
NEAR = 4


def lines(raw: np.ndarray, edge: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of lines that have a word: text, line, where the line's words begin (and the last one's end), words, class.

    A word is a 64-bit hash, and so is the class, of the sequence of words.
    """
    lo = 0
    while lo < len(edge) - 1:
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + anchors.BLOCK, side="right")) - 1)
        own, at = raw[edge[lo] : edge[hi]], edge[lo : hi + 1] - edge[lo]
        start, end, owner = anchors.words(own, at)
        if len(start):
            hashes = anchors.word_hashes(own, start, end)
            breaks = np.flatnonzero(own == 10)
            line = np.searchsorted(breaks, start) - np.searchsorted(breaks, at[:-1])[owner]
            cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (line[1:] != line[:-1]))))
            bounds = np.append(cut, len(hashes))
            sums = anchors.prefix_sums(hashes, "segment")
            yield lo + owner[cut], line[cut], bounds, hashes, anchors.ranges_hash(sums, bounds[:-1], bounds[1:], "segment").view(np.int64)
        lo = hi


def distinct(bounds: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each line, and where each line's begin."""
    n = len(bounds) - 1
    line = np.repeat(np.arange(n, dtype=np.uint16 if n <= 1 << 16 else np.int64), np.diff(bounds))
    order = np.argsort(values)
    order = order[np.argsort(line[order], kind="stable")]
    values, line = values[order], line[order]
    first = np.concatenate(([True], (values[1:] != values[:-1]) | (line[1:] != line[:-1])))
    values, line = values[first], line[first]
    return np.searchsorted(line, np.arange(n + 1)), values


def slot(tokens: np.ndarray) -> np.ndarray:
    """The first bits of a token."""
    return (tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _survey(docs: DataFrame) -> DataFrame:
    """doc_id, th, line, its class q and words n for each line with a word; then the task's counts of slots, a row a slice k."""
    fields = [docs.schema["doc_id"], T.StructField("th", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("q", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("sums", T.BinaryType())]
    schema, kinds = T.StructType(fields), (pa.int32(), pa.int64(), pa.int32())
    width = SLOTS // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SLOTS, dtype=np.int64)
        ids = None
        for batch in batches:
            ids = batch.column("doc_id").type
            for text, line, bounds, words, q in lines(*anchors.utf8(batch.column("text"))):
                sums += np.bincount(slot(words), minlength=SLOTS)
                row = pa.array(text)
                own = [pa.array(x).cast(t) for x, t in zip((line, q, np.diff(bounds)), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("th").take(row), *own, pa.nulls(len(row), pa.int32()), pa.nulls(len(row), pa.binary())], names=schema.names)
        if ids is not None:
            counts = pa.array([sums[k * width : (k + 1) * width].tobytes() for k in range(SLICES)])
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, ids), pa.nulls(SLICES, pa.int64()), *(pa.nulls(SLICES, t) for t in kinds), pa.array(range(SLICES), pa.int32()), counts], names=schema.names)

    return docs.mapInArrow(run, schema)


def _frequencies(survey: DataFrame) -> np.ndarray:
    """Words of each slot: SLOTS numbers, however long the table is."""
    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, dtype=np.int64) for x in group["sums"]], axis=0)
        return pd.DataFrame({"k": [int(group["k"].iloc[0])], "sums": [total.tobytes()]})

    width, out = SLOTS // SLICES, np.zeros(SLOTS, dtype=np.int64)
    for k, sums in survey.where("k is not null").select("k", "sums").groupBy("k").applyInPandas(add, "k int, sums binary").collect():
        out[k * width : (k + 1) * width] = np.frombuffer(sums, dtype=np.int64)
    return out


#: The packed columns of a key: a short name of its token, the line's class, size, the token's place, a bitmap of two words.
KEY = (("tag", np.uint32), ("q", np.int64), ("n", np.int32), ("place", np.int32), ("low", np.uint64), ("high", np.uint64))


def bitmaps(bounds: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each line, as two words: bit `token % 128` of every token."""
    bit = np.left_shift(np.uint64(1), tokens & np.uint64(63))
    upper = (tokens & np.uint64(64)).astype(bool)
    return np.bitwise_or.reduceat(np.where(upper, np.uint64(0), bit), bounds[:-1]), np.bitwise_or.reduceat(np.where(upper, bit, np.uint64(0)), bounds[:-1])


def prefix(bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each line's prefix, and the line of each."""
    n = np.diff(bounds)
    length = n - (percent * n + 99) // 100 + 1
    line = np.repeat(np.arange(len(n)), length)
    return bounds[:-1][line] + np.arange(len(line)) - np.repeat(np.cumsum(length) - length, length), line


def _keys(docs: DataFrame, table, percent: int, buckets: int) -> DataFrame:
    """(bucket, packed keys): the prefix of every line of the texts, each class once in a batch."""
    limit = HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = table.value
        rank = np.empty(SLOTS, dtype=np.uint64)
        rank[np.argsort(frequency, kind="stable")] = np.arange(SLOTS, dtype=np.uint64)
        for batch in batches:
            parts = []
            for _, _, bounds, words, q in lines(*anchors.utf8(batch.column("text"))):
                # the rank of the slot before the rest of the token: rarest first, and still one number for each token
                bounds, tokens = distinct(bounds, rank[slot(words)] << np.uint64(64 - SLOT_BITS) | (words & REST))
                at, line = prefix(bounds, percent)
                parts.append((tokens[at], q[line], np.diff(bounds)[line], at - bounds[:-1][line], *(x[line] for x in bitmaps(bounds, tokens))))
            if not parts:
                continue
            token, q, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, once = np.unique(anchors.mix(token) ^ q.view(np.uint64), return_index=True)  # a line that the batch has again
            token, q, *rest = (x[once] for x in (token, q, *rest))
            n = rest[0]
            # sizes of resembling lines are in the same band or in neighbours, so a hot token may be split by them
            hot = np.sort(frequency)[slot(token)] > limit
            band = np.where(hot, 1 + np.floor(np.log(n) / np.log(100 / percent) + 1e-9).astype(np.int64), 0)
            again = np.flatnonzero(hot)
            band = np.concatenate((band, band[again] + 1)).astype(np.uint64)
            token, q, *rest = (np.concatenate((x, x[again])) for x in (token, q, *rest))
            name = anchors.mix(token + band * np.uint64(0x9E3779B97F4A7C15))
            bucket = (name % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((rest[0], bucket))
            bucket = bucket[order]
            columns = {c: x[order].astype(t) for (c, t), x in zip(KEY, (name >> np.uint64(32), q, *rest), strict=True)}
            own, at = np.unique(bucket, return_index=True)
            at = np.append(at, len(bucket))
            yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], type=pa.binary()) for x in columns.values())], names=["bucket", *columns])

    return docs.select("text").mapInArrow(run, "bucket long, " + ", ".join(f"{c} binary" for c, _ in KEY))


def meeting(tag: np.ndarray, q: np.ndarray, n: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(tag, q) of those keys that have a partner which size, place and bitmap leave."""
    order = np.lexsort((place, q, n, tag))
    tag, q, n, place, low, high = (x[order] for x in (tag, q, n.astype(np.int64), place.astype(np.int64), low, high))
    first = np.concatenate(([True], (tag[1:] != tag[:-1]) | (q[1:] != q[:-1])))
    tag, q, n, place, low, high = (x[first] for x in (tag, q, n, place, low, high))
    good = np.zeros(len(tag), dtype=bool)

    def look(i: np.ndarray, j: np.ndarray) -> None:
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        keep = np.minimum(n[i] - place[i], n[j] - place[j]) >= need
        i, j, need = i[keep], j[keep], need[keep]
        only = lambda i, j: np.bitwise_count(low[i] & ~low[j]).astype(np.int64) + np.bitwise_count(high[i] & ~high[j])
        keep = np.minimum(n[i] - only(i, j), n[j] - only(j, i)) >= need
        good[i[keep]] = True
        good[j[keep]] = True

    # the partners of a key are a run around it, by size
    number = np.cumsum(np.concatenate(([0], tag[1:] != tag[:-1])))
    stride = int(n.max(initial=0)) * 100 // percent + 2
    scale = number * stride + n
    until = np.searchsorted(scale, number * stride + n * 100 // percent, side="right")
    since = np.searchsorted(scale, number * stride + -(-n * percent // 100), side="left")
    at = np.arange(len(tag))
    for k in range(1, NEAR + 1):
        i = at[at + k < until]
        look(i, i + k)
    rest = np.flatnonzero(~good & (until - since > 1))
    sums = np.concatenate(([0], np.cumsum((until - since)[rest])))
    a = 0
    while a < len(rest):
        b = max(a + 1, int(np.searchsorted(sums, sums[a] + PAIRS, side="right")) - 1)
        count = (until - since)[rest[a:b]]
        i = np.repeat(rest[a:b], count)
        j = np.repeat(since[rest[a:b]], count) + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        look(i[i != j], j[i != j])
        a = b
    return tag[good], q[good]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


def late(sets: list[np.ndarray], asks: list[bool], percent: int) -> list[int]:
    """Those sets that ask and resemble an earlier one; those that have resembled none are tried first."""
    size = np.array([len(s) for s in sets])
    bits = np.array([np.bitwise_or.reduce(np.left_shift(np.uint64(1), s & np.uint64(63))) for s in sets])
    alone, out = np.zeros(len(sets), dtype=bool), []
    for k, ask in enumerate(asks):
        found = False
        if ask and k:
            need = -(-percent * (size[:k] + size[k]) // (100 + percent))
            fits = np.flatnonzero(np.minimum(size[:k] - np.bitwise_count(bits[:k] & ~bits[k]), size[k] - np.bitwise_count(bits[k] & ~bits[:k])) >= need)
            found = any(similar(sets[i], sets[k], percent) for i in fits[np.argsort(~alone[fits], kind="stable")])
        if found:
            out.append(k)
        else:
            alone[k] = True
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (token, chunk, chunks, ...) with a group (g1, g2): a chunk of a hot token, or about CHUNK rows of others."""
    hot = F.col("chunks") > 1
    g1 = F.when(hot, F.col("token")).otherwise(F.pmod(F.xxhash64("token"), F.lit(rows.count() // CHUNK + 64)))
    return rows.select("*", g1.alias("g1"), F.when(hot, F.col("chunk")).otherwise(F.lit(-1)).alias("g2"))


def _possible(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those rows (token, chunk, chunks, q, asks) that ask and may resemble an earlier one of their chunk, or are such an
    earlier one, by size and bitmap alone."""
    fields = ["token", "chunk", "chunks", "q", "asks"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["token", "doc_id", "th", "line"], na_position="first")
        token, asks = group["token"].to_numpy(), group["asks"].to_numpy(dtype=bool)
        n, low, high = (group[c].to_numpy(dtype=np.int64) for c in ("n", "low", "high"))
        begin = np.searchsorted(token, token)
        good, keep = np.zeros(len(group), dtype=bool), np.zeros(len(group), dtype=bool)
        for k in np.flatnonzero(asks & (begin < np.arange(len(group)))):
            before = slice(begin[k], k)
            only = lambda a, b: np.bitwise_count((low[a] & ~low[b]).view(np.uint64)).astype(np.int64) + np.bitwise_count((high[a] & ~high[b]).view(np.uint64))
            need = -(-percent * (n[before] + n[k]) // (100 + percent))
            fits = begin[k] + np.flatnonzero(np.minimum(n[before] - only(before, k), n[k] - only(k, before)) >= need)
            good[k] = keep[k] = len(fits) > 0
            keep[fits] = True
        return group.assign(asks=good).loc[keep, fields]

    small = sets.select("q", "doc_id", "th", "line", "n", "low", "high")
    return _dealt(rows).join(small, "q").groupBy("g1", "g2").applyInPandas(run, rows.select(*fields).schema)


def _verified(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The q of those rows (token, chunk, chunks, q, asks) that resemble an earlier one of their token and chunk."""
    joined = _dealt(rows).select("token", "q", "asks", "g1", "g2").join(sets.drop("n", "low", "high"), "q")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "th", "line"], na_position="first")
        found: set[int] = set()
        for _, part in group.groupby("token", sort=False):
            q = part["q"].tolist()
            own = [np.frombuffer(s, dtype=np.uint64) for s in part["tokens"]]
            found.update(q[k] for k in late(own, [a and x not in found for a, x in zip(part["asks"], q, strict=True)], percent))
        return pd.DataFrame({"q": np.array(sorted(found), dtype=np.int64)})

    return joined.groupBy("g1", "g2").applyInPandas(run, "q long").distinct()


def _resembling(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The q of all rows (token, q) that resemble one of an earlier first line which they meet."""
    where = F.struct("doc_id", "th", "line")
    dated = rows.join(sets.select("q", where.alias("first")), "q")
    count = dated.groupBy("token").agg(F.count("*").alias("c"), F.min("first").alias("earliest"))
    dated = dated.join(count, "token").withColumn("chunks", F.ceil(F.col("c") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int"))
    known = materialize(dated.select("token", "q", "c", "chunks", "chunk", (F.col("first") > F.col("earliest")).alias("asks")), "line-meetings")
    home = known.where("asks").groupBy("q").agg(F.max_by("token", F.struct("c", "token")).alias("token"))
    place = known.join(home.withColumn("home", F.lit(True)), ["q", "token"], "left").withColumn("asks", F.coalesce("home", F.lit(False)))
    asked = place.where("asks").select("token", "chunk").distinct()
    quick = materialize(_verified(place.join(asked, ["token", "chunk"]).select("token", "chunk", "chunks", "q", "asks"), sets, percent), "line-quick")
    # in the second round rows stay in their chunk, and those that ask go to all chunks of each token but one seen before
    again = known.where("asks").join(quick, "q", "left_anti").join(home.withColumnRenamed("token", "home"), "q").where("token <> home or chunks > 1")
    asks = again.select("token", "q", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("chunk").alias("own"))
    stored = known.select("token", "chunk", "chunks", "q").join(asks.select("token").distinct(), "token")
    both = stored.withColumn("asks", F.lit(False)).unionByName(asks.select("token", "chunk", "chunks", "q").withColumn("asks", F.lit(True)))
    merged = materialize(both.groupBy("token", "chunk", "chunks", "q").agg(F.max("asks").alias("asks")), "line-rest")
    return quick.unionByName(_verified(materialize(_possible(merged, sets, percent), "line-close"), sets, percent)).distinct()


def remove(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines, n_removed and kept (the lines kept, joined by newlines) for every row of docs.

    Lines are split at newlines; one without words is never removed.  A line goes if the Jaccard similarity of its set of
    words with that of an earlier line is percent or more: earlier in the same document, or in one before (by doc_id, null
    first, then by the hash of the text).  Lines are judged on the input.  Null text: empty.  Rows with equal doc_id and text are one
    document and get one result, once for each row.  Empty table: no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    own = keyed(docs)
    where = F.struct("doc_id", "th", "line")
    survey = materialize(_survey(own), "line-survey")
    counted = survey.where("k is null")
    classes = counted.groupBy("q").agg(F.min(where).alias("first"), F.max(where).alias("last"))
    # words bound distinct words, so this is an upper bound of the rows of keys
    total = counted.agg(F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1), F.lit(0))).first()[0]
    frequency = spark.sparkContext.broadcast(_frequencies(survey))
    keys = _keys(own, frequency, percent, total // BUCKET_ROWS + 1)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        tag, q = meeting(*(np.frombuffer(b"".join(group[c]), dtype=t) for c, t in KEY), percent)
        return pd.DataFrame({"token": int(group["bucket"].iloc[0]) << 32 | tag.astype(np.int64), "q": q})

    rows = materialize(keys.groupBy("bucket").applyInPandas(meet, "token long, q long"), "line-rows")
    wanted = rows.select("q").distinct().join(classes.select("q", "first"), "q").select("q", "first.*")
    sets = materialize(_fetch(wanted, own), "line-sets")
    found = _resembling(rows, sets, percent).withColumn("late", F.lit(True))
    # the classes of which a line goes: those that resemble an earlier one, whole, and those that occur again, but for the first
    verdict = classes.join(found, "q", "left").where("late or first <> last").select("q", F.when(F.col("late").isNull(), F.col("first")).alias("keep"))
    gone = counted.select("doc_id", "th", "line", "q").join(verdict, "q").where(F.col("keep").isNull() | ~where.eqNullSafe(F.col("keep")))
    by = gone.groupBy("doc_id", "th").agg(F.collect_set("line").alias("gone")).alias("s")
    joined = own.alias("d").join(by, same_doc("d", "s"), "left").select("d.doc_id", "d.text", "s.gone")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                own, drop = text.split("\n"), set(gone or ())
                out.append((len(own), len(drop), "\n".join(x for i, x in enumerate(own) if i not in drop) if drop else text))
            n, m, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, type=pa.int64()), pa.array(m, type=pa.int64()), pa.array(kept, type=pa.string())], names=schema.names)

    return joined.mapInArrow(cut, schema)


def _fetch(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """q, doc_id, th, line, n, bitmap (low, high) and tokens (packed hashes) of the classes wanted (q, doc_id, th, line)."""
    by = wanted.groupBy("doc_id", "th").agg(F.collect_set("line").alias("lines")).alias("w")  # no more than the text has
    joined = docs.alias("d").join(by, same_doc("d", "w")).select("d.doc_id", "d.th", "d.text", "w.lines")
    schema = T.StructType([T.StructField("q", T.LongType()), docs.schema["doc_id"], T.StructField("th", T.LongType()), T.StructField("line", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("n", "low", "high")), T.StructField("tokens", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, text = [], [], []
            for k, (whole, own) in enumerate(zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True)):
                every = whole.split("\n")
                row += [k] * len(own)
                place += own
                text += [every[i] for i in own]
            row, place = np.array(row, dtype=np.int64), np.array(place, dtype=np.int32)
            for at, _, bounds, words, q in lines(*anchors.utf8(pa.array(text, type=pa.large_string()))):
                bounds, tokens = distinct(bounds, words)
                own = pa.array(row[at])
                packed = [tokens[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(q), batch.column("doc_id").take(own), batch.column("th").take(own), pa.array(place[at]), pa.array(np.diff(bounds)), *(pa.array(x.view(np.int64)) for x in bitmaps(bounds, tokens)), pa.array(packed, type=pa.binary())], names=schema.names)

    return joined.mapInArrow(run, schema).dropDuplicates(["q"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
