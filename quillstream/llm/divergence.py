"""How far the sources of a language differ in the words that they use.

Terms are counted by (language, source) in the tasks that read the texts and summed by Spark.  The terms that a language
keeps are dealt to chunks by their hash.  Within a chunk its terms are a sorted array, a term's id is its place there
(searchsorted) and a bincount by id makes one dense vector for each group.  Ids have the order of the terms' UTF-8 bytes, so
that ties are broken by id.  Chunks give sums for pairs of sources and their own best terms; both are put together at the end.

All arithmetic is on integers.  Counts of a group are exact below 2**53.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import anchors
from quillstream.llm.common import materialize, table

MIN_DOCS, TOP, SMOOTH, UNIT = 10, 10, 2, 1_000_000_000
#: Entries that a task counts before it passes them on; rows, cells and cell pairs of a chunk.
ENTRIES, ROWS, CELLS, WORK = 1 << 19, 1 << 16, 1 << 22, 1 << 32
#: Bytes of a text that are split at once.
SLICE = 1 << 22

#: A-Z to lower case; other letters and all bytes of characters beyond ASCII stay; the rest separates terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(raw: bytes, table: bytes, size: int = SLICE) -> Iterator[bytes]:
    """raw, translated, in slices of about `size` bytes that are cut at a space."""
    at = 0
    while at < len(raw):
        part = raw[at : at + size].translate(table)
        end = at + size
        while end < len(raw) and not part.endswith(b" "):
            more = raw[end : end + size].translate(table)
            cut = more.find(b" ") + 1 or len(more)
            part, end = part + more[:cut], end + cut
        yield part
        at = end


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of what this task reads, a few rows for each term; an empty term for each group."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    have = 0

    def drain() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            size = len(n) + 1
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array([source] * size), pa.array([b"", *n], type=pa.binary()), pa.array([0, *n.values()], type=pa.int64()), pa.array([0, *(docs[t] for t in n)], type=pa.int64())], names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch in batches:
        raw, edge = anchors.utf8(batch.column("text"))
        for k, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            n, docs = groups.setdefault(key, (Counter(), Counter()))
            before, seen = len(n), set()
            for part in pieces(raw[edge[k] : edge[k + 1]].tobytes(), _TERMS):
                terms = part.split()
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            have += len(n) - before
            if have > ENTRIES:
                yield from drain()
                have = 0
    yield from drain()


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (counts + SMOOTH) / (total + SMOOTH * terms)), in three steps of three digits each."""
    below = total + SMOOTH * terms
    rest, out = counts + SMOOTH, np.zeros(np.broadcast_shapes(counts.shape, total.shape), dtype=np.int64)
    whole, rest = rest // below, rest % below
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return 1 + whole * UNIT + out


def compare(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """lang, source, part, item, value of one chunk: sums over its terms for pairs, its best terms for terms."""
    out: dict[str, list] = {"lang": [], "source": [], "part": [], "item": [], "value": []}

    def add(lang: str, source: str, part: str, items: list[bytes], values: list[int]) -> None:
        for name, x in zip(out, ([lang] * len(items), [source] * len(items), [part] * len(items), items, values), strict=True):
            out[name] += x

    rows: dict[str, list[int]] = {}
    for i, lang in enumerate(counts.column("lang").to_pylist()):
        rows.setdefault(lang, []).append(i)
    members: dict[str, list[tuple]] = {}
    first = False
    for g in groups.to_pylist():
        members.setdefault(g["lang"], []).append((g["source"].encode(), g["source"], g["total"], g["lang_total"], g["terms"]))
        first = g["chunk"] == 0
    for lang, own in members.items():
        own.sort()
        names = np.array([m[0] for m in own], dtype=object)
        if lang not in rows:
            if first:  # a language that keeps no term has its pairs all the same
                for i, m in enumerate(own):
                    others = [x[0] for j, x in enumerate(own) if j != i]
                    add(lang, m[1], "pair", others, [0] * len(others))
            continue
        mine = counts.take(pa.array(rows[lang]))
        term = np.array(mine.column("term").to_pylist(), dtype=object)
        kept = np.array(sorted(set(term)), dtype=object)
        ids = np.searchsorted(kept, term)
        of = np.searchsorted(names, np.array([s.encode() for s in mine.column("source").to_pylist()], dtype=object))
        n = mine.column("n").to_numpy()
        order = np.argsort(of, kind="stable")
        edge = np.searchsorted(of[order], np.arange(len(own) + 1))
        dense = np.empty((len(own), len(kept)), dtype=np.int64)
        for i in range(len(own)):
            at = order[edge[i] : edge[i + 1]]
            dense[i] = np.bincount(ids[at], weights=n[at], minlength=len(kept))
        p = shares(dense, np.array([[m[2]] for m in own], dtype=np.int64), own[0][4])
        q = shares(dense.sum(axis=0), np.array([own[0][3]], dtype=np.int64), own[0][4])
        step = max(1, CELLS // len(kept))
        for i, m in enumerate(own):
            for a in range(i + 1, len(own), step):
                b = min(len(own), a + step)
                apart = p[a:b] - p[i]
                sums = (apart * apart // (p[a:b] + p[i])).sum(axis=1).tolist()
                add(lang, m[1], "pair", [x[0] for x in own[a:b]], sums)
                for x, value in zip(own[a:b], sums, strict=True):
                    add(lang, x[1], "pair", [m[0]], [value])
            more = np.flatnonzero((dense[i] > 0) & (p[i] > q))
            apart = p[i][more] - q[more]
            f = apart * apart // (p[i][more] + q[more])
            best = np.argsort(-f, kind="stable")[:TOP]
            add(lang, m[1], "term", kept[more[best]].tolist(), f[best].tolist())
    kinds = {"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.binary(), "value": pa.int64()}
    return pa.table({k: pa.array(v, type=kinds[k]) for k, v in out.items()})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    part `pair`: every other source of the language by its divergence; part `term`: the terms that stand out most in the
    source, `top` of them (TOP at most).  Null lang, source and text are read as ''.  Repeated rows count as documents of
    their own.  Ties go to the item that comes first in UTF-8 order.  A language that keeps no term has pairs of value 0 and
    no terms; an only source has no pairs.  Texts of any length are split in slices.  Empty table: no rows.  Other columns are ignored.
    """
    read = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = read.mapInArrow(count_terms, "lang string, source string, term binary, n long, docs long")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a term has a row for each source of its language at most
    in_docs = F.sum("docs").over(Window.partitionBy("lang", "term"))
    marker = F.col("term") == F.lit(b"")
    kept = materialize(counts.withColumn("in_docs", in_docs).where((F.col("in_docs") >= min_docs) | marker).select("lang", "source", "term", "n"), "divergence-kept")
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.when(marker, 0).otherwise(1)).cast("long").alias("terms"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    size = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang")
    of = size.agg(F.sum("terms"), F.sum(F.col("terms") * F.col("sources")), F.sum(F.col("terms") * F.col("sources") * F.col("sources").cast("double"))).first()
    rows = kept.count()
    chunks = 1 + int(max(rows / ROWS, (of[1] or 0) / CELLS, (of[2] or 0) / WORK))
    left = kept.where(~marker).withColumn("chunk", F.pmod(F.xxhash64("lang", "term"), F.lit(chunks)).cast("int"))
    right = groups.join(langs, "lang").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = right.toDF(*right.columns)  # columns of their own: both sides come from `kept`
    parts = left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(compare, "lang string, source string, part string, item binary, value long")
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= min(top, TOP))).withColumn("item", F.col("item").cast("string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v.v) AS p
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
l AS (SELECT lang, sum(n)::HUGEINT AS total FROM c GROUP BY lang),
q AS (SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.n)::HUGEINT + 2)) // (any_value(l.total) + 2 * any_value(v.v)) AS q FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY c.lang, c.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
