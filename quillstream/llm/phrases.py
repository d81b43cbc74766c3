"""Collocations: phrases whose words stand together more often than their parts would by chance.

Grams of 1 to MAX_WORDS words are exploded into rows (lang, gram, n) and summed by Spark, level by level: words, pairs, then
all longer ones.  A gram is exploded only if every word and pair in it may occur often enough, as neither a candidate nor a
part of one can hold a rarer one.  What may is a bitmap of hashes of fixed size: it lets some rare ones through and
loses none, whatever the size of the vocabulary; exact counts decide afterwards.  Then candidates join the counts of their
first and last parts, scores are integers of Decimal, candidates that a longer one explains are removed by an anti-join with the
candidates' extensions by one word, and a window ranks what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import anchors
from quillstream.llm.common import hot_keys, materialize, split_join, table
from quillstream.llm.divergence import pieces

MIN_COUNT, MAX_WORDS, FIRST = 100, 5, 2000
#: Bits of the bitmap (8 MB, whatever the corpus) and those of a row of it.
BITS, ROW = 1 << 26, 1 << 15
#: Words that are counted at once; entries that a task holds before it passes them on; grams that it passes on at once.
TOKENS, ENTRIES, ROWS = 1 << 19, 1 << 20, 1 << 16
#: Tasks that a language's phrases are ranked in at first.
SALTS = 64
_FIRST = np.uint64(0x9E3779B97F4A7C15)

#: A-Z to lower case, tabs to spaces, what ends a piece to a full stop, which is no word.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else 0x20 if b == 9 else 0x2E if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def slices(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, with full stops where a piece ends."""
    for part in pieces(raw, _WORDS):
        yield part.replace(b".", b" . ").split()


def hashed(lang: str, gram: bytes) -> int:
    """As xxhash64 of lang, a zero and the gram in Spark, which starts from 42."""
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + gram, seed=42)


def pair_slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The bits of pairs of words, from the words' hashes."""
    return (anchors.mix(first * _FIRST ^ second) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def collected(slots: DataFrame) -> np.ndarray:
    """The bitmap of a column `slot`; BITS bits in the driver."""
    own = slots.select(F.floor(F.col("slot") / ROW).cast("int").alias("row"), (F.col("slot") % ROW).alias("bit"))
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for row, part in own.groupBy("row").agg(F.bitmap_construct_agg("bit")).collect():  # BITS / ROW rows at most
        out[row * ROW // 8 : (row + 1) * ROW // 8] |= np.frombuffer(part, dtype=np.uint8)
    return out


def word_bits(grams: DataFrame) -> np.ndarray:
    """The bitmap of words (lang, gram)."""
    key = F.xxhash64(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), "gram"))
    return collected(grams.select(F.pmod(key, F.lit(BITS)).alias("slot")))


def pair_bits(grams: DataFrame) -> np.ndarray:
    """The bitmap of pairs (lang, gram)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(lang, *gram.split(b" ")) for lang, gram in zip(batch.column("lang").to_pylist(), batch.column("gram").to_pylist(), strict=True)]
            first, second = (np.array([hashed(x[0], x[k]) for x in pairs], dtype=np.uint64) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(pair_slots(first, second))], names=["slot"])

    return collected(grams.select("lang", "gram").mapInArrow(run, "slot long"))


def marked(bitmap: np.ndarray, slots: np.ndarray | int) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7)) & 1 > 0


class Words(dict):
    """Numbers, from 1, of the words of a language that a bitmap has; 0 for all others and for full stops."""

    def __init__(self, lang: str, bitmap: np.ndarray | None):
        super().__init__({b".": 0})
        self.lang, self.bitmap = lang, bitmap
        self.names, self.hashes = [b""], [0]

    def __missing__(self, word: bytes) -> int:
        n, h = 0, hashed(self.lang, word)
        if self.bitmap is None or marked(self.bitmap, h % BITS):
            n = len(self.names)
            self.names.append(word)
            self.hashes.append(h)
        self[word] = n
        return n


class Counter:
    """Counts of the grams of one language, of `low` to `high` words: words by number, pairs by two numbers, longer ones as text."""

    def __init__(self, lang: str, low: int, high: int, words: np.ndarray | None, pairs: np.ndarray | None):
        self.low, self.high, self.pairs = low, high, pairs
        self.words = Words(lang, words)
        self.hashes = np.zeros(1, dtype=np.uint64)
        self.counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.longer: dict[bytes, int] = {}

    def __len__(self) -> int:
        """What it takes up, in entries of a table of words; a pair takes an eighth of that."""
        return len(self.words) + len(self.longer) + sum(len(k) for k, _ in self.counts.values()) // 8

    def _count(self, width: int, keys: np.ndarray) -> None:
        there, n = np.unique(keys, return_counts=True)
        if width in self.counts:
            old, m = self.counts[width]
            both, back = np.unique(np.concatenate((old, there)), return_inverse=True)
            total = np.zeros(len(both), dtype=np.int64)
            np.add.at(total, back, np.concatenate((m, n)))
            there, n = both, total
        self.counts[width] = there, n

    def add(self, tokens: list[bytes], fresh: int) -> None:
        """tokens: consecutive words; only grams that end at place `fresh` or later count."""
        ids = np.fromiter(map(self.words.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if self.low == 1:
            own = ids[fresh:]
            self._count(1, own[own > 0])
        if self.high == 1 or len(ids) < 2:
            return
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        if self.pairs is not None:
            if len(self.hashes) < len(self.words.names):
                self.hashes = np.array(self.words.hashes, dtype=np.uint64)
            at = at[marked(self.pairs, pair_slots(self.hashes[ids[at]], self.hashes[ids[at + 1]]))]
        key = (ids[at] << 32) + ids[at + 1]
        if self.low <= 2:
            self._count(2, key[at + 1 >= fresh])
        if self.high == 2:
            return
        # a gram's number stands at the place of its first word; the next longer one needs the pair at its end, too
        there, back = np.unique(key, return_inverse=True)
        names = self.words.names
        text = [names[k >> 32] + b" " + names[k & 0xFFFFFFFF] for k in there.tolist()]
        linked = np.zeros(len(ids), dtype=bool)
        linked[at] = True
        number = back
        for width in range(3, self.high + 1):
            more = np.flatnonzero((at + width - 2 < len(ids)) & linked[np.minimum(at + width - 2, len(ids) - 1)])
            at, number = at[more], number[more]
            if not len(at):
                return
            there, number = np.unique((number << 32) + ids[at + width - 1], return_inverse=True)
            text = [text[k >> 32] + b" " + names[k & 0xFFFFFFFF] for k in there.tolist()]
            if width >= self.low:
                n = np.bincount(number[at + width - 1 >= fresh], minlength=len(text))
                for k in np.flatnonzero(n).tolist():
                    self.longer[text[k]] = self.longer.get(text[k], 0) + int(n[k])

    def rows(self) -> Iterator[tuple[list[bytes], list[int]]]:
        """The grams and their counts, some at a time."""
        names = self.words.names
        for width, (keys, n) in self.counts.items():
            for i in range(0, len(keys), ROWS):
                own = keys[i : i + ROWS].tolist()
                yield [names[k] if width == 1 else names[k >> 32] + b" " + names[k & 0xFFFFFFFF] for k in own], n[i : i + ROWS].tolist()
        if self.longer:
            yield list(self.longer), list(self.longer.values())


def count_grams(batches: Iterator[pa.RecordBatch], low: int, high: int, words: np.ndarray | None, pairs: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """lang, gram, n: grams of `low` to `high` words of what this task reads, a few rows for each."""
    own: dict[str, Counter] = {}

    def drain() -> Iterator[pa.RecordBatch]:
        for lang, counter in own.items():
            for grams, n in counter.rows():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), type=pa.string()), pa.array(grams, type=pa.binary()), pa.array(n, type=pa.int64())], names=["lang", "gram", "n"])
        own.clear()

    def take(lang: str, tokens: list[bytes], fresh: int) -> None:
        if lang not in own:
            own[lang] = Counter(lang, low, high, words, pairs)
        own[lang].add(tokens, fresh)

    def full() -> bool:
        return sum(map(len, own.values())) > ENTRIES

    for batch in batches:
        raw, edge = anchors.utf8(batch.column("text"))
        waiting: dict[str, list[bytes]] = {}
        for k, lang in enumerate(batch.column("lang").to_pylist()):
            tokens, cut = waiting.setdefault(lang, []), 0
            for part in slices(raw[edge[k] : edge[k + 1]].tobytes()):
                tokens += part
                if len(tokens) > TOKENS:
                    take(lang, tokens, cut)
                    if full():
                        yield from drain()
                    tokens[:] = tokens[max(0, len(tokens) - high + 1) :]  # grams that run on into the next slice
                    cut = len(tokens)
            tokens.append(b".")
            if cut:
                take(lang, tokens, cut)
                tokens.clear()
        for lang, tokens in waiting.items():
            take(lang, tokens, 0)
        if full():
            yield from drain()
    yield from drain()


def frequent(docs: DataFrame, low: int, high: int, least: int, words: np.ndarray | None = None, pairs: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """(grams of at least `least` occurrences, all that were exploded): lang, gram, n."""
    context = docs.sparkSession.sparkContext
    shared = [None if x is None else context.broadcast(x) for x in (words, pairs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count_grams(batches, low, high, *[x and x.value for x in shared])

    read = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    every = read.mapInArrow(run, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return every.where(F.col("n") >= least), every


def mine(docs: DataFrame, least: int = MIN_COUNT, max_words: int = MAX_WORDS, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of 2 to max_words words of each language.

    a: occurrences, at least `least`; l and r: those of the two parts at the cut that scores least, of equals the first; n: words of
    the language; score: floor(1000 * a * n / (l * r)), exact to 38 digits.  A phrase inside a longer one that occurs as often is
    left out.  Ties go to the more frequent phrase, then to the first in UTF-8 order.  Null lang is `und`, null text empty;
    repeated rows count as often as they occur.  Texts of any length are read in slices.  A language without a candidate has no rows, nor has an empty table.  Other columns are ignored.
    """
    _, all_words = frequent(docs, 1, 1, 1)
    all_words = materialize(all_words, "phrases-words")
    total = all_words.groupBy("lang").agg(F.sum("n").alias("words"))
    often = F.col("n") >= least
    words = word_bits(all_words.where(often))
    two = materialize(frequent(docs, 2, 2, least, words)[0], "phrases-pairs")
    pairs = pair_bits(two)
    grams = all_words.where(often).unionByName(two)
    if max_words > 2:
        more = materialize(frequent(docs, 3, max_words, least, words, pairs)[0], "phrases-more")
        grams = grams.unionByName(more)
    # a full stop never is a word, and a space parts two words
    of = F.split(F.col("gram").cast("string"), " ", -1)
    grams = grams.withColumn("w", of).withColumn("k", F.size("w"))
    candidates = grams.where("k > 1")
    cuts = candidates.select("lang", "gram", "w", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k")
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ").cast("binary")
    cuts = cuts.select("lang", "gram", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    known = grams.select("lang", "gram", "n")
    for side, name in (("head", "l"), ("tail", "r")):
        hot = hot_keys(cuts.groupBy("lang", side).agg(F.count("*").alias("__n")), ["lang", side], "__n")
        cuts = split_join(cuts, known.withColumnsRenamed({"gram": side, "n": name}), ["lang", side], hot, ["gram", "cut"])
    hot = hot_keys(cuts.groupBy("lang").agg(F.count("*").alias("__n")), ["lang"], "__n")
    cuts = split_join(cuts, total.withColumnRenamed("words", "n"), ["lang"], hot, ["gram", "cut"])
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact("a") * F.col("n").cast("decimal(16,0)"), exact("l") * exact("r"))
    cuts = cuts.withColumn("score", score)
    scored = cuts.groupBy("lang", "gram").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("s")).select("lang", "gram", "s.a", "s.l", "s.r", "s.n", "s.score")
    longer = grams.where("k > 2").select("lang", "n", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("gram"))
    longer = longer.groupBy("lang", "gram").agg(F.max("n").alias("most"))
    left = scored.join(longer, ["lang", "gram"], "left").where("most is null or most < a").drop("most")
    order = [F.desc("score"), F.desc("a"), F.asc("gram")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", F.col("gram").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
e AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
x AS (SELECT lang, w[i:i + k - 1] AS g FROM e, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, array_to_string(g, ' ') AS gram, any_value(g) AS g, count(*)::HUGEINT AS n FROM x GROUP BY lang, gram HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, gram, g, n AS a, unnest(range(1, len(g))) AS cut FROM f WHERE len(g) > 1),
s AS (SELECT c.lang, c.gram, c.cut, c.a, h.n AS l, r.n AS r, t.n, (1000 * c.a * t.n) // (h.n * r.n) AS score
  FROM c JOIN f h ON h.lang = c.lang AND h.gram = array_to_string(c.g[:c.cut], ' ') JOIN f r ON r.lang = c.lang AND r.gram = array_to_string(c.g[c.cut + 1:], ' ') JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
o AS (SELECT lang, array_to_string(unnest([g[:len(g) - 1], g[2:]]), ' ') AS gram, n FROM f WHERE len(g) > 2),
k AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.gram = b.gram AND o.n >= b.a)),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank, gram AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM k)
SELECT * FROM z WHERE rank <= 2000
"""
