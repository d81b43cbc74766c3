"""The part that the two exact removers of repeated text share: finding segments that occur again, and applying spans.

1. Documents are cut into segments (see anchors).  Anchors that occur twice or more are counted; the count is combined in
   the map tasks, so a passage that every document holds is one row for each task.
2. Segments with such an anchor are the hits, the only rows that go further.  A hot anchor is dealt to several tasks.  Hits of equal content are collapsed
   to the first one and their number.
3. Segments of equal anchor but unequal content (the edges of passages) share some windows perhaps; the operator's own
   search compares them.  Their text is cut out of the documents by a join.
4. The spans found are merged for each document and applied by another pass over the documents.

A document is a distinct pair (doc_id, text): repeated rows count once and get the same result.  Documents are ordered by
doc_id, null first, then by the hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm import anchors, common
from quillstream.llm.common import hot_keys, materialize, split_join

#: Bytes of segments that one search task takes at most, about; and segments of one anchor before it is cut into chunks.
SHARD_BYTES, CHUNK = 1 << 19, 4096


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and text, which is never null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))


def same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _pieces(raw: np.ndarray, edge: np.ndarray, unit: str, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, hashed elements, where each document begins among them, byte of each element in its document, byte
    after it); a document which a piece takes up in its midst begins before the piece, at a negative place."""
    if unit == "bytes":
        for lo, hi, a, b in anchors.blocks(edge, width):
            origin = edge[lo : hi + 1] - a
            at = np.arange(b - a) - np.repeat(origin[:-1], np.diff(np.clip(origin, 0, b - a)))
            yield lo, anchors.BYTE[raw[a:b]], origin, at, at + 1
        return
    lo = 0
    while lo < len(edge) - 1:  # whole documents, about BLOCK bytes of them
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + anchors.BLOCK, side="right")) - 1)
        own = raw[edge[lo] : edge[hi]]
        start, end, owner = anchors.words(own, edge[lo : hi + 1] - edge[lo])
        hashes = anchors.word_hashes(own, start, end)
        inner = np.searchsorted(owner, np.arange(hi - lo + 1))
        base = (edge[lo : hi + 1] - edge[lo])[owner]
        for p, q, c, d in anchors.blocks(inner, width):
            yield lo + p, hashes[c:d], inner[p : q + 1] - c, (start - base)[c:d], (end - base)[c:d]
        lo = hi


def segments(docs: DataFrame, unit: str, width: int, gram: int, owners: bool) -> DataFrame:
    """anchor, content and, with owners, doc_id, th, start, windows, b0, b1 of each segment of keyed docs.

    start and windows count elements from the start of the document, b0 and b1 are its bytes.
    """
    fields = [T.StructField("anchor", T.LongType()), T.StructField("content", T.LongType())]
    if owners:
        fields += [docs.schema["doc_id"], T.StructField("th", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("start", "windows", "b0", "b1"))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, edge = anchors.utf8(batch.column("text"))
            for lo, values, origin, first, last in _pieces(raw, edge, unit, width):
                own, at, windows, anchor, content = anchors.segments(values, np.clip(origin, 0, len(values)), width, gram)
                if not len(at):
                    continue
                out = [pa.array(anchor), pa.array(content)]
                if owners:
                    row = pa.array(own + lo)
                    out += [batch.column("doc_id").take(row), batch.column("th").take(row), pa.array(at - origin[own]), pa.array(windows), pa.array(first[at]), pa.array(last[at + windows + width - 2])]
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return docs.mapInArrow(cut, T.StructType(fields))


def hits(docs: DataFrame, unit: str, width: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The segments whose anchor occurs again, with mixed: whether the anchor has unequal contents; and the hot contents."""
    again = segments(docs, unit, width, gram, False).groupBy("anchor").agg(F.count("*").alias("n"), (F.min("content") != F.max("content")).alias("mixed")).where("n > 1")
    again = materialize(again, f"anchors-{unit}")
    hot = hot_keys(again, ["anchor"], "n")
    known = again.select("anchor", "mixed", (F.col("n") > common.PART_ROWS).alias("often"))
    found = materialize(split_join(segments(docs, unit, width, gram, True), known, ["anchor"], hot, ["doc_id", "th", "start"]), f"hits-{unit}")
    # a hot content has a hot anchor
    contents = found.where("often").groupBy("anchor", "content").count()
    return found.drop("often"), hot_keys(contents, ["anchor", "content"], "count")


def firsts(found: DataFrame) -> DataFrame:
    """One row for each content: its first occurrence, and n: 1, or 2 if it occurs more often (repeated rows are one)."""
    order = F.struct("doc_id", "th", "start", "windows", "b0", "b1")
    out = found.groupBy("anchor", "content").agg(F.min(order).alias("f"), F.when(F.min(order) == F.max(order), 1).otherwise(2).alias("n"), F.first("mixed").alias("mixed"))
    return out.select("anchor", "content", "n", "mixed", "f.*")


def cells(mixed: DataFrame) -> DataFrame:
    """mixed with a group (g1, g2), a side and the text of each segment still to be joined: the tasks of the search.

    Anchors with up to CHUNK contents are dealt to groups of about SHARD_BYTES.  Those of a hotter anchor are cut into
    chunks, and there is a group for each pair of chunks.
    """
    total = mixed.agg(F.coalesce(F.sum(F.col("b1") - F.col("b0")), F.lit(0))).first()[0]
    shards = total // SHARD_BYTES + 1
    count = mixed.groupBy("anchor").count()
    many = count.where(F.col("count") > CHUNK).select("anchor", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    spread = split_join(mixed, many, ["anchor"], hot_keys(count, ["anchor"], "count"), ["content"], "left").withColumn("side", F.coalesce(F.pmod(F.xxhash64("content"), F.col("chunks")).cast("int"), F.lit(0)))
    spread = spread.withColumn("other", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
    a, b = F.least("side", "other"), F.greatest("side", "other")
    g1 = F.when(F.col("chunks").isNull(), F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(F.col("anchor"))
    return spread.select("*", g1.alias("g1"), F.coalesce((a * F.col("chunks") + b).cast("long"), F.lit(-1)).alias("g2")).drop("chunks", "other")


def with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with piece, the bytes [b0, b1) of their document; once for each of its repeated rows."""
    joined = docs.alias("d").join(rows.alias("r"), same_doc("d", "r"))
    piece = F.substring(F.col("d.text").cast("binary"), (F.col("r.b0") + 1).cast("int"), (F.col("r.b1") - F.col("r.b0")).cast("int"))
    return joined.select("r.*", piece.alias("piece"))


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def span_schema(docs: DataFrame) -> T.StructType:
    return T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("th", "s", "e"))])


def apply_spans(docs: DataFrame, spans: DataFrame, result: Callable[[bytes, list[tuple[int, int]]], tuple], fields: list[T.StructField]) -> DataFrame:
    """doc_id and result(text, merged spans) of every row of keyed docs; spans of a document are as many as it has segments."""
    merged = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")).alias("s")
    joined = docs.alias("d").join(merged, same_doc("d", "s"), "left").select("d.doc_id", "d.text", "s.spans")
    schema = T.StructType([docs.schema["doc_id"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, edge = anchors.utf8(batch.column("text"))
            rows = []
            for i, own in enumerate(batch.column("spans")):
                spans: list[tuple[int, int]] = []
                for s, e in sorted((x["s"], x["e"]) for x in own.as_py() or ()):
                    if spans and s <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
                    else:
                        spans.append((s, e))
                rows.append(result(raw[edge[i] : edge[i + 1]].tobytes(), spans))
            made = [pa.array([r[k] for r in rows], type=pa.string() if isinstance(f.dataType, T.StringType) else pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64()) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=schema.names)

    return joined.mapInArrow(run, schema)
