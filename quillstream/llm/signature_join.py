"""N-gram Jaccard join with signature trees.

Texts with equal shingle sets form a class, of which one member is compared.  Two linked sets share one of the first
`n - ceil(t n) + 1` of their shingles in the order of hashes, so only classes that meet at such a token are compared.  At
the first token that both have, all that they share lies behind it, so its place bounds the size of a partner:

1. Meeting.  The tokens of each class are dealt out once; those without a neighbour of like size at the token go.
2. Contraction.  Each class goes to the group of its first token that is left.  Trees over bitmaps leave those that could be
   linked there, only the texts of these are fetched, and a second tree finds pairs, which are verified and merged at
   once, so a group of g near copies takes about g links, not g * g / 2.  A second round does the same with one class of
   each merged set, which joins what was cut into chunks.
3. The rest.  Tokens at which classes meet that are not merged yet: all pairs of these that the trees leave are verified.

The leaves of a tree are sets, ordered so that near copies are neighbours; a node holds the OR of the bitmaps below, the
range of sizes and the largest number of shingles that share a bit with others of their set.  Two nodes share at most
`popcount(and) + excess` shingles, and a pair whose sizes need more is pruned with all that is below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm import anchors
from quillstream.llm.common import hot_keys, materialize, split_join, table
from quillstream.llm.components import components
from quillstream.llm.repeats import keyed, same_doc

WORDS, PERCENT = 3, 90
#: Sets in one tree with texts, and with bitmaps alone; children of a node; bytes of text that one task takes, about.
CHUNK, BITMAP_CHUNK, FANOUT, SHARD_BYTES = 512, 2048, 8, 4 << 20
#: Bytes of a chunk, about, whatever its rows.
CHUNK_BYTES = 32 << 20
#: Tokens of a set by which a pair is recognised that met before.
LEAST = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(raw: np.ndarray, edge: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    lo = 0
    while lo < len(edge) - 1:
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + anchors.BLOCK, side="right")) - 1)
        own = _LOWER[raw[edge[lo] : edge[hi]]]
        start, end, owner = anchors.words(own, edge[lo : hi + 1] - edge[lo])
        hashes = anchors.word_hashes(own, start, end)
        inner = np.searchsorted(owner, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            values = hashes[inner[i] : inner[i + 1]]
            k = min(words, len(values))
            if not k:
                yield values
                continue
            out = np.full(len(values) - k + 1, k, dtype=np.uint64)
            for j in range(k):
                out = anchors.mix(out * np.uint64(0x9E3779B97F4A7C15) + values[j : len(values) - k + 1 + j])
            yield np.unique(out)
        lo = hi


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def largest_partner(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The size up to which a set may be linked with one of n whose first shingle in common has this place (from 0)."""
    return ((100 + percent) * (n - place) - percent * n) // percent


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


def bits_for(n: int) -> int:
    """Bits of the bitmap of a set: a power of two, at least twice its size, so that unequal sets differ in many bits."""
    return max(64, 2 << (n - 1).bit_length()) if n else 64


def bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, dtype=np.uint8)
    at = ((values * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
    return out.view(np.uint64)


def fold(maps: np.ndarray) -> np.ndarray:
    """Bitmaps of half the bits: the place of a bit is cut by its highest digit."""
    half = maps.shape[1] // 2
    return maps[:, :half] | maps[:, half:]


class SignatureTree:
    """Levels from the leaves up; each has the OR of its bitmaps, the range of sizes and the largest excess."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        order = np.lexsort((np.bitwise_count(maps[:, : maps.shape[1] // 4 or 1]).sum(axis=1), sizes))
        self.order = order
        maps, sizes = maps[order], sizes[order]
        excess = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > 1:
            m, low, high, over = self.levels[-1]
            cut = np.arange(0, len(m), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(over, cut)))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        maps, low, high, over = self.levels[level]
        p = self.percent
        keep = (100 * high[a] >= p * low[b]) & (100 * high[b] >= p * low[a])
        keep = np.flatnonzero(keep)
        step = max(1, (1 << 18) // maps.shape[1])
        for i in range(0, len(keep), step):
            k = keep[i : i + step]
            x, y = a[k], b[k]
            most = np.bitwise_count(maps[x] & maps[y]).sum(axis=1).astype(np.int64) + np.minimum(over[x], over[y])
            most = np.minimum(most, np.minimum(high[x], high[y]))
            keep[i : i + step] = np.where((100 + p) * most >= p * (low[x] + low[y]), k, -1)
        return keep[keep >= 0]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets that the bounds leave, by dual traversal from the root."""
        top = len(self.levels) - 1
        a = b = np.zeros(1, dtype=np.int64)
        for level in range(top, 0, -1):
            n = len(self.levels[level - 1][0])
            child = np.arange(FANOUT)
            x = (a[:, None, None] * FANOUT + child[None, :, None] + np.zeros((1, 1, FANOUT), dtype=np.int64)).ravel()
            y = (b[:, None, None] * FANOUT + child[None, None, :] + np.zeros((1, FANOUT, 1), dtype=np.int64)).ravel()
            keep = (x < n) & (y < n) & ((x < y) if level == 1 else (x <= y))
            a, b = x[keep], y[keep]
            k = self._possible(level - 1, a, b)
            a, b = a[k], b[k]
        if top == 0:
            a = b = a[:0]
        return self.order[a], self.order[b]


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def merge(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def merged(sets: list[np.ndarray], merged_already: np.ndarray, percent: int) -> list[int]:
    """The root of each set; sets with equal numbers in merged_already belong together from the start."""
    forest = Forest(len(sets))
    first: dict[int, int] = {}
    for i, m in enumerate(merged_already):
        forest.merge(first.setdefault(m, i), i)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    bits = bits_for(int(sizes.max()))
    tree = SignatureTree(np.stack([bitmap(s, bits) for s in sets]), sizes, percent)
    for a, b in zip(*(x.tolist() for x in tree.pairs()), strict=True):
        if forest.root(a) != forest.root(b) and linked(sets[a], sets[b], percent):
            forest.merge(a, b)
    return [forest.root(i) for i in range(len(sets))]


def _describe(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, th, n, h1, class (two hashes; null for the empty set) and bitmap of the shingle set of each keyed document."""
    fields = [docs.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in ("th", "n", "h1")), *(T.StructField(x, T.BinaryType()) for x in ("cid", "map"))]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, cids, maps = [], [], [], []
            for s in shingle_sets(*anchors.utf8(batch.column("text")), words):
                cid = _digest(s)
                n.append(len(s))
                h1.append(int.from_bytes(cid[:8], "little", signed=True))
                cids.append(cid if len(s) else None)
                maps.append(bitmap(s, bits_for(len(s))).tobytes())
            columns = [pa.array(n, type=pa.int64()), pa.array(h1, type=pa.int64()), pa.array(cids, type=pa.binary()), pa.array(maps, type=pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *columns], names=schema.names)

    return docs.mapInArrow(run, schema)


def _digest(values: np.ndarray) -> bytes:
    """Two hashes of a set, of eight bytes each."""
    return values.sum(dtype=np.uint64).tobytes() + anchors.mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).tobytes()


def _tokens(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """token, h1, n and the largest partner's size there, for the prefix of each set of keyed documents, once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # at most one entry for each row of the task
        for batch in batches:
            parts, rows = [], []
            for s in shingle_sets(*anchors.utf8(batch.column("text")), words):
                cid = _digest(s)
                if len(s) and cid not in seen:
                    seen.add(cid)
                    parts.append((s[: prefix_length(len(s), percent)] >> np.uint64(1)).view(np.int64))
                    rows.append((int.from_bytes(cid[:8], "little", signed=True), len(s)))
            if not rows:
                continue
            h1, n = (np.repeat(np.array(x, dtype=np.int64), [len(p) for p in parts]) for x in zip(*rows, strict=True))
            place = np.concatenate([np.arange(len(p)) for p in parts])
            out = [pa.array(x) for x in (np.concatenate(parts), h1, n, largest_partner(n, place, percent))]
            table = pa.RecordBatch.from_arrays(out, names=["token", "h1", "n", "top"])
            for at in range(0, len(table), 100_000):
                yield table.slice(at, 100_000)

    return docs.mapInArrow(run, "token long, h1 long, n long, top long")


def _meetings(tokens: DataFrame) -> DataFrame:
    """Those rows of tokens that have another class of like size at their token, each once.

    Some smaller set at the token must reach up to this one, or this one up to the next larger.  One shuffle by token
    serves both windows.
    """
    by_size = Window.partitionBy("token").orderBy("n", "h1")
    once = tokens.withColumn("again", F.lag("h1").over(by_size).eqNullSafe(F.col("h1"))).where("not again").drop("again")
    reached = F.max("top").over(by_size.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("n")
    near = F.coalesce(reached, F.lit(False)) | F.coalesce(F.lead("n").over(by_size) <= F.col("top"), F.lit(False))
    return once.withColumn("near", near).where("near").drop("near")


def _deal(rows: DataFrame, chunk: int, pairs: bool, each: float) -> DataFrame:
    """rows (token, cid, n, ...) with a group (g1, g2) and a cell in it: one cell for a token, or several for a hot one.

    each: the bytes of a row for each shingle.  A token of more than `chunk` rows or CHUNK_BYTES is cut into chunks; with pairs each pair
    of chunks has a cell, else each chunk.  So a group has two chunks at most, or a row that is larger than a chunk.
    """
    weight = int(rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * each)
    count = rows.groupBy("token").agg(F.count("*").alias("count"), F.sum("n").alias("__n")).where(F.col("count") > 1)
    hot = hot_keys(count, ["token"], "count")
    shards = F.lit(max(64, weight // SHARD_BYTES))
    sized = split_join(rows, count, ["token"], hot, ["cid"]).withColumn("chunks", F.greatest(F.ceil(F.col("count") / chunk), F.ceil(F.col("__n") * each / CHUNK_BYTES)).cast("int"))
    sized = sized.withColumn("side", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    if pairs:
        sized = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        cell = F.least("side", "other").cast("long") * F.col("chunks") + F.greatest("side", "other")
    else:
        cell = F.col("side").cast("long")
    several = F.col("chunks") > 1
    g1 = F.when(several, F.col("token")).otherwise(F.pmod(F.xxhash64("token"), shards))
    return sized.select(*rows.columns, g1.alias("g1"), F.when(several, cell).otherwise(F.lit(-1)).alias("g2"))


def _merge(rows: DataFrame, texts: DataFrame, words: int, percent: int, pairs: bool) -> DataFrame:
    """(a, b) edges between numbers `comp` of rows (token, cid, comp, n) whose sets are linked."""
    joined = _deal(rows, CHUNK, pairs, 7.0).join(texts, "cid").select("g1", "g2", "token", "cid", "comp", "text")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[bytes, bytes]] = []
        for _, part in group.groupby("token", sort=False):
            comps, number = part["comp"].tolist(), pd.factorize(part["comp"])[0]
            if number.max() == 0:
                continue
            raw = [x.encode() for x in part["text"]]
            edge = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
            sets = list(shingle_sets(np.frombuffer(b"".join(raw), dtype=np.uint8), edge, words))
            out += [(comps[i], comps[r]) for i, r in enumerate(merged(sets, number, percent)) if comps[i] != comps[r]]
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype=object)

    return joined.groupBy("g1", "g2").applyInPandas(run, "a binary, b binary")


def met_before(token: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b, pair by pair, share one of their least tokens before the one that they meet at here."""
    out = np.zeros(len(a), dtype=bool)
    for k in range(0, len(a), 1 << 14):
        i, j = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
        x = np.where(low[i] < token[i][:, None], low[i], -1)
        out[k : k + (1 << 14)] = ((x[:, :, None] == low[j][:, None, :]) & (x[:, :, None] >= 0)).any(axis=(1, 2))
    return out


def survivors(token: np.ndarray, comp: np.ndarray, sizes: np.ndarray, top: np.ndarray, maps: list[bytes], low: np.ndarray, percent: int) -> np.ndarray:
    """Which rows could be linked with one of their token and of another comp, by sizes, places and bitmaps.

    top: the largest size of a partner that each row may have if the token is the first one in common.
    low: the LEAST smallest tokens of each row's set, none negative; a pair counts only at the first of them that both have.

    Tokens with many rows get a tree each; the pairs of the others are bounded all at once.
    """
    bits = np.array([8 * len(m) for m in maps])
    good = np.zeros(len(token), dtype=bool)
    order = np.argsort(token, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], token[order][1:] != token[order][:-1])))
    count = np.diff(np.append(cut, len(order)))
    few = np.repeat((count > 1) & (count <= 2 * FANOUT), count)
    ends = np.repeat(cut + count, count)
    at = np.flatnonzero(few)
    todo = ends[at] - at - 1
    a = np.repeat(at, todo)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(todo) - todo, todo)
    a, b = order[a], order[b]
    fits = (comp[a] != comp[b]) & (top[a] >= sizes[b]) & (top[b] >= sizes[a])
    a, b = a[fits], b[fits]
    both = np.minimum(bits[a], bits[b])
    large = [order[c : c + n] for c, n in zip(cut[count > 2 * FANOUT], count[count > 2 * FANOUT], strict=True)]
    for width in np.unique(bits):  # bitmaps of linked sets are of equal width or one is twice the other
        pairs = np.flatnonzero(both == width)
        trees = [own[(bits[own] == width) | (bits[own] == 2 * width)] for own in large]
        used = np.unique(np.concatenate([a[pairs], b[pairs], *trees]))
        if not len(used):
            continue
        row = np.full(len(token), -1)
        row[used] = np.arange(len(used))
        stacked = np.empty((len(used), width // 64), dtype=np.uint64)
        for k, i in enumerate(used):
            m = np.frombuffer(maps[i], dtype=np.uint64)
            stacked[k] = m if len(m) == width // 64 else fold(m[None, :])[0]
        excess = sizes[used] - np.bitwise_count(stacked).sum(axis=1)
        step = max(1, (1 << 18) // stacked.shape[1])
        for k in range(0, len(pairs), step):
            i, j = a[pairs[k : k + step]], b[pairs[k : k + step]]
            x, y = row[i], row[j]
            most = np.bitwise_count(stacked[x] & stacked[y]).sum(axis=1) + np.minimum(excess[x], excess[y])
            keep = (100 + percent) * most >= percent * (sizes[i] + sizes[j])
            i, j = i[keep], j[keep]
            fresh = ~met_before(token, low, i, j)
            good[i[fresh]] = True
            good[j[fresh]] = True
        for own in trees:
            if len(own) > 1:
                x, y = SignatureTree(stacked[row[own]], sizes[own], percent).pairs()
                i, j = own[x], own[y]
                apart = (comp[i] != comp[j]) & (top[i] >= sizes[j]) & (top[j] >= sizes[i])
                i, j = i[apart], j[apart]
                fresh = ~met_before(token, low, i, j)
                good[i[fresh]] = True
                good[j[fresh]] = True
    return good


def _possible(rows: DataFrame, maps: DataFrame, percent: int, once: bool) -> DataFrame:
    """(token, cid) of those rows (token, cid, comp, n, top) whose bitmap could be linked with that of one of another comp.

    once: a pair counts only at the first token that both have, if that is one of the LEAST first of either.
    """
    least = rows.groupBy("cid").agg(F.slice(F.array_sort(F.collect_set("token")), 1, LEAST).alias("low"))  # of one prefix
    maps = maps.join(least, "cid") if once else maps.withColumn("low", F.array().cast("array<long>"))
    dealt = _deal(rows.select("token", "cid", "comp", "n", "top"), BITMAP_CHUNK, True, 0.5).join(maps, "cid").select("g1", "g2", "token", "cid", "comp", "n", "top", "map", "low")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        low = np.full((len(group), LEAST), -1, dtype=np.int64)
        for k, own in enumerate(group["low"]):
            low[k, : len(own)] = own
        good = survivors(group["token"].to_numpy(), pd.factorize(group["comp"])[0], group["n"].to_numpy(dtype=np.int64), group["top"].to_numpy(dtype=np.int64), list(group["map"]), low, percent)
        return group.loc[good, ["token", "cid"]]

    return dealt.groupBy("g1", "g2").applyInPandas(run, "token long, cid binary").distinct()


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rounds: int = 2) -> DataFrame:
    """doc_id, th, n_shingles, component_id and root (of the component, null for the empty set) for every row of docs.

    The set of a text: its distinct shingles of `words` words, A-Z in lower case; fewer words make one shingle; null or no
    words: the empty set, linked with nothing.  Two documents are linked if 100 * intersection >= percent * union.
    component_id: the least doc_id (null only if all are) that links lead to; th: the hash of the text.  Rows with equal
    texts are linked, so repeated rows and equal ids need no rule.  Empty table: no rows.  Other columns are ignored.
    """
    own = keyed(docs)
    described = materialize(_describe(own, words), "sets")
    # one member of each class stands for it
    one = described.where("n > 0").groupBy("cid").agg(F.first("h1").alias("h1"), F.min(F.struct("doc_id", "th", "map")).alias("d")).select("cid", "h1", "d.*")
    classes = described.where("n > 0").select("h1", "cid").distinct()
    met = materialize(_meetings(_tokens(own, words, percent)).join(classes, "h1").drop("h1"), "met")

    def texts_of(rows: DataFrame) -> DataFrame:
        wanted = rows.select("cid").distinct().join(one.drop("map", "h1"), "cid").alias("w")
        return materialize(own.alias("d").join(wanted, same_doc("d", "w")).select("w.cid", "d.text").dropDuplicates(["cid"]), "texts")

    def first_token(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cid").agg(F.min(F.struct("token", "n", "top")).alias("h")).select("cid", "h.*", F.col("cid").alias("comp"))

    home = materialize(first_token(met), "home")
    home = materialize(home.join(_possible(home, one.select("cid", "map"), percent, False), ["token", "cid"]), "close")
    texts = texts_of(home)
    comp = None
    for _ in range(rounds):
        if comp is not None:  # the first round has all classes, the next one those that stand for several
            home = materialize(first_token(met.join(comp.select(F.col("comp").alias("cid")).distinct(), "cid", "left_semi")), "home")
        edges = _merge(home, texts, words, percent, False)
        step = materialize(edges.groupBy("a").agg(F.min("b").alias("b")), "step")  # stars: each class is in one group
        if comp is not None:
            moved = comp.join(step, comp.comp == step.a, "left").select("cid", F.coalesce("b", "comp").alias("comp"))
            comp = materialize(moved.union(step.join(comp, step.a == comp.cid, "left_anti")), "comp")
        else:
            comp = step.toDF("cid", "comp")
    rows = met.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    apart = rows.groupBy("token").agg((F.min("comp") != F.max("comp")).alias("apart")).where("apart").select("token")
    hot = hot_keys(met.groupBy("token").count(), ["token"], "count")
    left = materialize(split_join(rows, apart, ["token"], hot, ["cid"]), "left")
    left = materialize(left.join(_possible(left, one.select("cid", "map"), percent, True), ["token", "cid"]), "left")
    texts = texts_of(left)
    late = components(_merge(left, texts, words, percent, True))
    final = rows.select("cid", "comp").distinct().join(late, F.col("comp") == late.node, "left").select("cid", F.coalesce("root", "comp").alias("root"))
    # texts without words have no class and take no part in the joins, where they would all be one key
    named = described.where("n > 0").drop("map", "h1").join(final, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(least, "root").select("doc_id", "th", "root", F.col("n").alias("n_shingles"), "component_id")
    empty = described.where("n = 0").select("doc_id", "th", F.lit(None).cast(linked.schema["root"].dataType).alias("root"), F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty)


def distinct(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the least by (doc_id, hash of the text); repeated rows of it go.

    Documents without words are kept.
    """
    found = link(docs, words, percent)
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("f")).select("f.*")
    kept = first.unionByName(found.where("root is null").select("doc_id", "th").distinct()).alias("k")
    d = docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit("")))).alias("d")
    joined = d.join(kept, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.__th") == F.col("k.th")), "left_semi")
    return joined.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__th").orderBy("__th"))).where("__n = 1").drop("__n", "__th")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
