"""Quality rules as a short-circuit cascade.

Each rule is a predicate over counts of the text.  The cost and the share of rejections of every rule are estimated on a
bounded sample; the rules then run in the order of rejections per cost, and a document that one rule rejects is not looked
at by the later ones.  The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import let, table

#: Rows of the sample on which the order of the rules is chosen, about, and how often each rule is timed on it.
SAMPLE_ROWS, RUNS = 512, 3


@dataclass(frozen=True)
class Rule:
    """A name and the predicate that rejects a document, made from its counts by name."""

    name: str
    rejects: Callable[[Mapping[str, Column]], Column]


def _words(text: Column) -> Column:
    """All words, in order; splitting at single characters is the fastest way to them."""
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " ", -1), "")


def _lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _windows(words: Column) -> Column:
    """One hash for each window of three words."""
    return F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))


def _covered(hashes: Column) -> Column:
    """Words covered by the windows whose hash occurs twice or more.

    Most texts have no repeat, which the number of distinct hashes settles; in the others (hash, place) pairs are sorted,
    after which equal windows are neighbours.
    """
    def places(pairs: Column) -> Column:
        same = lambda i, j: F.get(pairs, j).getField("h") == F.get(pairs, i).getField("h")
        kept = F.filter(pairs, lambda p, i: F.coalesce((i > 0) & same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.sort_array(F.transform(kept, lambda p: p.getField("i")))

    def width(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(pairs, places), width)).otherwise(F.lit(0).cast("long"))


def counts(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """The counts of a text that is not null, from its words and its lines with a word."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_bangs": F.length(F.regexp_replace(text, r"[^!]+", "")).cast("long"),
        "n_repeat_words": let(let(words, _windows), _covered),
    }


#: The counts' names.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_bangs", "n_repeat_words")


#: The rules that the contract fixes; every document that they reject is rejected.
BASE = (
    Rule("few_words", lambda c: c["n_words"] < 50),
    Rule("repeated_words", lambda c: 100 * c["n_repeat_words"] > 50 * c["n_words"]),
)
#: The cascade's own rules, wide of anything that running prose does.
RULES = (
    *BASE,
    Rule("symbols", lambda c: 2 * c["n_symbols"] > c["n_words"]),
    Rule("bangs", lambda c: 2 * c["n_bangs"] > c["n_words"]),
    Rule("repeated_lines", lambda c: 2 * c["n_dup_lines"] > c["n_lines"]),
    Rule("word_length", lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 30 * c["n_words"])),
)


def order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds) by rejections per second, from about sample_rows rows drawn from all of docs.

    Seconds: the best of RUNS runs in one task, less what a run takes that counts rows only.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select(F.coalesce("text", F.lit("")).alias("text")).sample(share, seed=7).limit(2 * sample_rows).persist()

    def timed(rejects: Column) -> tuple[int, float]:
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            hit = sample.agg(F.count_if(rejects)).first()[0]
            took.append(time.perf_counter() - began)
        return hit, min(took)

    try:
        total, bare = timed(F.col("text").isNotNull())
        out = []
        for rule in rules:
            hit, took = timed(F.coalesce(_verdict(F.col("text"), [rule]).isNotNull(), F.lit(False)))
            out.append((rule, hit / max(1, total), max(1e-6, took - bare)))
    finally:
        sample.unpersist()
    return sorted(out, key=lambda x: (-x[1] / x[2], x[2], x[0].name))


def cascade(rules: list[Rule], c: Mapping[str, Column]) -> Column:
    """The name of the first rule that rejects, null if none does; CASE looks at no later rule than that one."""
    first = F.when(rules[0].rejects(c), F.lit(rules[0].name))
    for rule in rules[1:]:
        first = first.when(rule.rejects(c), F.lit(rule.name))
    return first


def _verdict(text: Column, rules: list[Rule]) -> Column:
    """The cascade over a text that is not null; words and lines are found once, counts only as far as the cascade goes."""
    return let(_words(text), lambda w: let(_lines(text), lambda x: cascade(rules, counts(text, w, x))))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with all counts, base_failed, rejected_by (null: none) and kept.

    Null text: no words, so it is rejected.  Every row is judged on its own: repeated rows, ties and null ids need no
    rule.  Empty table: no rows.  Columns of docs that are named like a result are replaced.
    """
    made = {*COUNTS, "base_failed", "rejected_by", "kept", "__text", "__words", "__lines"}
    plain = docs.drop(*[c for c in docs.columns if c.lower() in made])
    ranked = [rule for rule, _, _ in order(plain, rules)]
    text = F.col("__text")
    parted = plain.withColumn("__text", F.coalesce("text", F.lit(""))).withColumn("__words", _words(text)).withColumn("__lines", _lines(text))
    out = parted.select(*plain.columns, *[x.alias(n) for n, x in counts(text, F.col("__words"), F.col("__lines")).items()])
    c = {n: F.col(n) for n in COUNTS}
    out = out.withColumn("base_failed", BASE[0].rejects(c) | BASE[1].rejects(c)).withColumn("rejected_by", cascade(ranked, c))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, columns as they are; nulls, repeats and empty tables as in judge."""
    ranked = [rule for rule, _, _ in order(docs, rules)]
    return docs.where(_verdict(F.coalesce("text", F.lit("")), ranked).isNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, words[i] || chr(32) || words[i + 1] || chr(32) || words[i + 2] AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
h AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
v AS (SELECT rid, count(DISTINCT i + o) AS n_repeat FROM h, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
c AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(regexp_replace(text, '[^!]+', '', 'g')) AS BIGINT) AS n_bangs,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
             CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN v USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 2 * n_symbols > n_words OR 2 * n_bangs > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 30 * n_words) AS kept
FROM b
"""
