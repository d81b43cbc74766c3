"""Removal of repeated word sequences with suffix automata.

The corpus is its own reference, so no automaton of it has a size bound and none is broadcast as a whole.  The segments
that may share windows (see repeats) are dealt to reference shards by their anchor instead; the task of a shard builds
one automaton for each anchor and streams the segments of the same anchor through it.  Matching statistics, cut to WIDTH
words, say for each word whether the last WIDTH words occur in the reference, and the number of occurrences kept at the
automaton's states says whether there is one besides the window itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm import repeats
from quillstream.llm.common import split_join, table

WIDTH, GRAM = 35, 8


class SuffixAutomaton:
    """A suffix automaton of several weighted sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, sequence: Sequence, weight: int) -> None:
        nexts, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for x in sequence:
            q = nexts[last].get(x)
            if q is not None and length[q] == length[last] + 1:
                last = q  # a prefix that an earlier sequence has
                count[last] += weight
                continue
            p = last
            if q is None:
                last = len(nexts)
                nexts.append({})
                link.append(0)
                length.append(length[p] + 1)
                count.append(weight)
                while p >= 0 and x not in nexts[p]:
                    nexts[p][x] = last
                    p = link[p]
                if p < 0:
                    continue
                q = nexts[p][x]
                if length[q] == length[p] + 1:
                    link[last] = q
                    continue
                new = last
            else:
                new = -1
            clone = len(nexts)
            nexts.append(nexts[q].copy())
            link.append(link[q])
            length.append(length[p] + 1)
            count.append(0)
            while p >= 0 and nexts[p].get(x) == q:
                nexts[p][x] = clone
                p = link[p]
            link[q] = clone
            if new >= 0:
                link[new] = clone
            else:
                count[clone] += weight
                last = clone

    def finish(self) -> None:
        """Sum the occurrences up the suffix links."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]

    def statistics(self, sequence: Sequence, most: int) -> Iterator[tuple[int, int]]:
        """For each element, the longest match that ends with it (up to `most`) and the number of its occurrences."""
        nexts, link, length, count = self.next, self.link, self.length, self.count
        v = l = 0  # noqa: E741
        for x in sequence:
            while v and x not in nexts[v]:
                v = link[v]
                l = length[v]  # noqa: E741
            to = nexts[v].get(x)
            if to is None:
                v = l = 0  # noqa: E741
            else:
                v, l = to, min(l + 1, most)  # noqa: E741
                while length[link[v]] >= l and link[v] > 0:
                    v = link[v]
            yield l, count[v]


def flags(reference: Sequence[tuple[Sequence, int]], streamed: Sequence[Sequence], width: int, least: int) -> list[np.ndarray]:
    """For each window of each streamed sequence: whether the reference has it `least` times or more."""
    automaton = SuffixAutomaton()
    for sequence, weight in reference:
        automaton.add(sequence, weight)
    automaton.finish()
    return [np.array([l >= width and n >= least for l, n in automaton.statistics(s, width)], dtype=bool)[width - 1 :] for s in streamed]


def remove(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept (binary: the words kept, joined by one space) for every row of docs.

    A word goes if a window of `width` words that covers it also starts anywhere else, in the same document or another;
    windows are judged on the input.  Null text: no words.  Shorter texts are kept.  Rows with equal doc_id and text are one
    document, whose windows are not repeats of each other, and get one result, once for each row.  Empty table: no rows.
    Other columns are ignored.
    """
    own = repeats.keyed(docs)
    found, hot = repeats.hits(own, "words", width, gram)
    first = repeats.firsts(found)
    equal = split_join(found, first.where("n > 1").select("anchor", "content"), ["anchor", "content"], hot, ["doc_id", "th", "start"])
    equal = equal.select("doc_id", "th", F.col("start").alias("s"), (F.col("start") + F.col("windows") + width - 1).alias("e"))
    mixed = repeats.with_text(repeats.cells(repeats.materialize(first.where("mixed"), "mixed-words")), own)
    schema = repeats.span_schema(docs)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["anchor", "content"]).reset_index(drop=True)
        rows: list[tuple[int, int, int]] = []
        for _, part in group.groupby("anchor", sort=False):
            words = {i: p.split() for i, p in zip(part.index, part["piece"], strict=True)}
            sides = [g.index.tolist() for _, g in part.groupby("side")]
            single = part.index[part["n"] == 1]  # the others are repeats as a whole
            for ref in sides:
                reference = [(words[i], int(part["n"][i])) for i in ref]
                inside = set(ref)
                # in a task for two chunks, one is the reference of the other
                streamed = [i for i in single if len(sides) == 1 or i not in inside]
                for i, f in zip(streamed, flags(reference, [words[i] for i in streamed], width, 2 if len(sides) == 1 else 1), strict=True):
                    rows += [(i, s, e) for s, e in repeats.ranges(f)]
        out = group[["doc_id", "th"]].iloc[[r[0] for r in rows]].reset_index(drop=True)
        base = group["start"].to_numpy(dtype=np.int64)
        out["s"] = np.array([base[i] + s for i, s, _ in rows], dtype=np.int64)
        out["e"] = np.array([base[i] + e + width - 1 for i, _, e in rows], dtype=np.int64)
        return out

    columns = ("g1", "g2", "side", "anchor", "content", "n", "doc_id", "th", "start", "piece")
    spans = equal.unionByName(mixed.select(*columns).groupBy("g1", "g2").applyInPandas(search, schema))

    def cut(text: bytes, gone: list[tuple[int, int]]) -> tuple:
        words = text.split()
        kept, at = [], 0
        for s, e in gone:
            kept += words[at:s]
            at = e
        return len(words), sum(e - s for s, e in gone), b" ".join(kept + words[at:])

    return repeats.apply_spans(own, spans, cut, [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
