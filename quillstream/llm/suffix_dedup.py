"""Removal of repeated byte strings with suffix arrays.

Segments that may share strings (see repeats) are dealt to shards of bounded size.  Each shard's suffix array is built by
Larsson-Sadakane refinement: the suffixes are sorted by their first seven bytes, then only groups that are still tied are
sorted by the ranks 7, 14, 28, ... bytes on.  Kasai's rule gives the common prefixes of neighbours, and runs of neighbours
that share WIDTH bytes are the occurrences of one string.  The segments of a very frequent anchor fill several shards;
these are merged in pairs by binary search of one shard's strings in the other's sorted ones.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm import repeats
from quillstream.llm.common import split_join, table

WIDTH, GRAM = 100, 28
#: Positions of a shard that Kasai's rule runs through one after the other; shards advance in as many lanes as needed.
LANE = 32


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, place of each suffix in that order)."""
    n = len(text)
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = text.astype(np.uint64) + np.uint64(1)  # the end of the text sorts before every byte
    # nine bits for a byte: seven bytes in a word
    key = np.zeros(n, dtype=np.uint64)
    for j in range(7):
        key |= padded[j : j + n] << np.uint64(9 * (6 - j))
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = head
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))  # places whose suffix is still tied
    h = 7
    while len(slots):
        members = order[slots]
        ahead = members + h
        both = rank[members] * (n + 2) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        sorter = np.argsort(both)
        both, members = both[sorter], members[sorter]
        order[slots] = members
        new = np.concatenate(([True], both[1:] != both[:-1]))
        rank[members] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefixes(text: np.ndarray, order: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """For each place of the order, the bytes (up to `most`) shared with the suffix before it, by Kasai's rule in lanes.

    A suffix shares at least one byte less with its predecessor than the suffix one to the left of it did.
    """
    n = len(text)
    padded = np.concatenate((text.astype(np.int16), np.full(most + 1, -1, dtype=np.int16)))
    before = np.where(place > 0, order[np.maximum(place, 1) - 1], -1)
    shared = np.zeros(n, dtype=np.int64)
    lanes = np.arange(0, n, LANE)
    have = np.zeros(len(lanes), dtype=np.int64)
    for d in range(LANE):
        at = lanes + d
        k = int(np.searchsorted(at, n))
        at, have = at[:k], np.maximum(have[:k] - 1, 0)
        lanes = lanes[:k]
        other = before[at]
        have[other < 0] = 0
        live = np.flatnonzero((other >= 0) & (have < most))
        while len(live):
            i, j, l = at[live], other[live], have[live]
            equal = (np.maximum(i, j) + l < n) & (padded[i + l] == padded[np.minimum(j + l, n)])
            live = live[equal]
            have[live] += 1
            live = live[have[live] < most]
        shared[at] = have
    return shared[order]


class Shard:
    """The windows of some segments in sorted order."""

    def __init__(self, pieces: list[bytes], windows: np.ndarray, rank: np.ndarray, width: int):
        """rank: of the first window of each piece in the corpus; the ranks of its other windows follow."""
        self.text = np.frombuffer(b"\xff".join(pieces), dtype=np.uint8)
        size = np.array([len(p) for p in pieces])
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        owner = np.repeat(np.arange(len(pieces)), windows)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.owner, self.offset, self.width = owner, offset, width
        self.where = begin[owner] + offset
        self.rank = rank[owner] + offset
        order, place = suffix_array(self.text)
        shared = common_prefixes(self.text, order, place, width)
        run = np.cumsum(shared < width)
        #: for each window, the run of equal strings that it is in; for each run with windows, its first rank and a window
        self.runs, self.run, example = self._number(run[place[self.where]])
        self.first = np.full(self.runs, np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.run, self.rank)
        self.example = self.where[example]

    @staticmethod
    def _number(run: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        names, example, number = np.unique(run, return_index=True, return_inverse=True)
        return len(names), number, example

    def strings(self) -> np.ndarray:
        """The distinct windows, in sorted order (runs are numbered so)."""
        rows = np.lib.stride_tricks.sliding_window_view(self.text, self.width)[self.example]
        return np.ascontiguousarray(rows).view(f"S{self.width}").ravel()


def repeated(pieces: list[bytes], windows: np.ndarray, rank: np.ndarray, side: np.ndarray, width: int) -> np.ndarray:
    """For each window of all pieces, in order: whether an equal one has a smaller rank."""
    sides = np.unique(side)
    shards = [(np.flatnonzero(side == s)) for s in sides]
    built = [Shard([pieces[i] for i in own], windows[own], rank[own], width) for own in shards]
    firsts = [b.first.copy() for b in built]
    if len(built) == 2:
        a, b = built[0].strings(), built[1].strings()
        at = np.minimum(np.searchsorted(a, b), len(a) - 1)
        found = np.flatnonzero(a[at] == b)
        least = np.minimum(firsts[0][at[found]], firsts[1][found])
        firsts[0][at[found]] = least
        firsts[1][found] = least
    out = np.zeros(int(windows.sum()), dtype=bool)
    begin = np.cumsum(windows) - windows
    for own, b, first in zip(shards, built, firsts, strict=True):
        out[begin[own][b.owner] + b.offset] = first[b.run] < b.rank
    return out


def _ranks(group: pd.DataFrame) -> np.ndarray:
    """The corpus order of the segments' first windows, with room for the windows in between."""
    by = group[["doc_id", "th"]].sort_values(["doc_id", "th"], na_position="first")
    new = ~by.duplicated()
    number = pd.Series(np.cumsum(new.to_numpy()), index=by.index).reindex(group.index).to_numpy()
    return (number.astype(np.int64) << 40) + group["start"].to_numpy(dtype=np.int64)


def remove(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) for every row of docs.

    A byte goes if a string of `width` bytes that covers it also starts earlier: in a document before (by doc_id, null
    first, then by the hash of the text) or in the same one.  Strings are judged on the input.  Null text: empty.
    Texts shorter than width are kept.  Rows with equal doc_id and text are one document and get one result, once for
    each row.  Empty table: no rows.  Other columns are ignored.
    """
    own = repeats.keyed(docs)
    found, hot = repeats.hits(own, "bytes", width, gram)
    first = repeats.firsts(found)
    f = first.where("n > 1").select("anchor", "content", F.struct("doc_id", "th", "start").alias("f"))
    later = split_join(found, f, ["anchor", "content"], hot, ["doc_id", "th", "start"]).where(~F.struct("doc_id", "th", "start").eqNullSafe(F.col("f")))
    later = later.select("doc_id", "th", F.col("b0").alias("s"), F.col("b1").alias("e"))
    mixed = repeats.with_text(repeats.cells(repeats.materialize(first.where("mixed"), "mixed-bytes")), own)
    schema = repeats.span_schema(docs)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["anchor", "content"]).reset_index(drop=True)
        windows = group["windows"].to_numpy(dtype=np.int64)
        flags = repeated(list(group["piece"]), windows, _ranks(group), group["side"].to_numpy(), width)
        begin = np.cumsum(windows) - windows
        rows = [(i, s, e) for i in range(len(group)) if flags[begin[i] : begin[i] + windows[i]].any() for s, e in repeats.ranges(flags[begin[i] : begin[i] + windows[i]])]
        out = group[["doc_id", "th"]].iloc[[r[0] for r in rows]].reset_index(drop=True)
        base = group["start"].to_numpy(dtype=np.int64)
        out["s"] = np.array([base[i] + s for i, s, _ in rows], dtype=np.int64)
        out["e"] = np.array([base[i] + e + width - 1 for i, _, e in rows], dtype=np.int64)
        return out

    spans = later.unionByName(mixed.select("g1", "g2", "side", "anchor", "content", "doc_id", "th", "start", "windows", "piece").groupBy("g1", "g2").applyInPandas(search, schema))

    def cut(text: bytes, gone: list[tuple[int, int]]) -> tuple:
        kept, at = [], 0
        for s, e in gone:
            kept.append(text[at:s])
            at = e
        return len(text), sum(e - s for s, e in gone), len(gone), b"".join([*kept, text[at:]])

    longs = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    return repeats.apply_spans(own, spans, cut, [*longs, T.StructField("kept", T.BinaryType())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
