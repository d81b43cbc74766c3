"""Personal data: base patterns, and bootstrapped contextual extraction of further identifiers.

The base patterns find seeds.  The words around a seed are its lexical patterns: the two before it, one on either side, the
two after it.  The same words around another word that has a digit or an at sign make that word an instance of the pattern.
In a pattern such a word stands as its class, and the start of the text counts as words; the words of one base span count
as one.  Patterns and instances form a bipartite graph.  In every round a pattern is scored for each kind by its instances
known so far.  What speaks against it are instances known as another kind and words that do not look like the kind at all;
words that might be of the kind and are not known yet do not count.  Patterns of high confidence promote their other
instances that look like the kind, each as sure as its best pattern, and promoted instances make patterns known in the next
round that no seed has.  Promoted words are added as spans.

Everything is DataFrame code; what leaves the scan of the texts are spans and contexts, never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm.common import hot_keys, let, materialize, split_join, table

#: The base patterns (fixed values), written so that no run is tried twice: a match starts where a run of its characters
#: does, or where the match before it ended, and gives nothing back where that could not help.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word with a digit or an at sign.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: What a word of each kind looks like in lower case, without the punctuation around it, and how many digits it has.
LOOKS = {"email": (r"^[a-z][a-z0-9._%+@-]*[0-9@][a-z0-9._%+@-]*$", 0, 99), "ip": (r"^[0-9]+(?:\.[0-9]+){2,}$", 4, 12), "card": (r"^[0-9]+(?:[\x20-][0-9]+)*$", 12, 19), "phone": (r"^[+(]*[0-9][\x20().0-9-]*$", 7, 15)}
#: Words of context, rounds of scoring, known instances that a pattern needs, and confidence from which it brings in others.
CONTEXT, ROUNDS, SUPPORT, CONFIDENCE = 2, 4, 5, 0.8
#: What stands in a context for a word with an at sign, one with a digit, either of them, and the start of the text: never words.
AT, NUMBER, OTHER, START = "<@>", "<0>", "<?>", ""
#: Lengths that are summed up one by one; longer lists are summed up in blocks of this size.
STRIDE = 128

SPANS = "array<struct<s:int,e:int,m:string>>"
WORDS = "array<struct<s:int,e:int,m:string,gap:string,tail:string>>"


def sums_before(sizes: Column) -> Column:
    """For each of the numbers the sum of those before it; its cost is in proportion to the list for all but enormous ones."""
    add = lambda a, x: a + x
    block = lambda i: F.floor(i / STRIDE).cast("int")

    def whole(z: Column) -> Column:
        totals = F.transform(F.sequence(F.lit(0), block(F.size(z) - 1)), lambda b: F.aggregate(F.slice(z, b * STRIDE + 1, F.lit(STRIDE)), F.lit(0), add))
        starts = F.aggregate(totals, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t)))
        return let(starts, lambda base: F.transform(z, lambda _, i: F.get(base, block(i)) + F.aggregate(F.slice(z, block(i) * STRIDE + 1, i % STRIDE), F.lit(0), add)))

    return let(sizes, whole)


def located(text: Column, pattern: str, worth: Column, around: bool = False) -> Column:
    """s, e and m of each match of the pattern; looked for only where `worth`.

    With `around` also the last words of the gap before and the first ones of the gap after, where OTHER stands for the next match.
    """
    kind = WORDS if around else SPANS

    def place(x: Column) -> Column:
        found, gaps = x.getField("m"), x.getField("g")
        sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))

        def one(before: Column, m: Column, i: Column) -> Column:
            s = F.get(before, i) + F.length(F.get(gaps, i))
            parts = [s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")]
            if around:
                words = F.regexp_extract(F.get(gaps, i + 1), rf"^((?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){{0,{CONTEXT}}})", 1)
                parts.append(F.regexp_extract(F.get(gaps, i), rf"((?:(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{0,{CONTEXT}}})$", 1).alias("gap"))
                parts.append(F.concat(words, F.when(i == F.size(found) - 1, F.lit("")).otherwise(F.lit(f" {OTHER}" * CONTEXT))).alias("tail"))
            return F.struct(*parts)

        return F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(let(sums_before(sizes), lambda before: F.transform(found, lambda m, i: one(before, m, i))))

    both = F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1).alias("m"), F.split(text, pattern, -1).alias("g"))
    return F.when(worth, let(both, place)).otherwise(F.array().cast(kind))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of 12 to 19 digits passes."""
    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))

    of = F.aggregate(F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(d == "", 0).otherwise(value(F.when(d == "", "0").otherwise(d), i))), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(number).between(12, 19), of % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind; failing matches are dropped without another try."""
    digit = text.rlike("[0-9]")
    ip = F.filter(located(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: F.forall(F.split(x.getField("m"), r"\.", -1), lambda p: F.coalesce(F.try_to_number(F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.concat(F.lit("0"), F.regexp_replace(p, "^0+", ""))), F.lit("9999")) <= 255, F.lit(False))))
    card = F.filter(located(text, CARD, digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), lambda x: luhn(digits(x.getField("m"))))
    phone = F.filter(located(text, PHONE, text.rlike(r"\+[0-9]")), lambda x: F.length(digits(x.getField("m"))).between(9, 15))
    return {"email": located(text, EMAIL, F.contains(text, F.lit("@"))), "ip": ip, "card": card, "phone": phone}


def split_words(gap: Column) -> Column:
    """Words in lower case, without punctuation at their end."""
    words = F.transform(F.split(F.lower(gap), r"[\x20\x09-\x0D]+", -1), lambda w: F.regexp_replace(w, "[.,;:!?]+$", ""))
    return F.filter(words, lambda w: w != "")


def contexts(narrow: DataFrame) -> DataFrame:
    """row, s, e, m, kind, before, after for each candidate of narrow (row, base, candidates), but those inside a base span.

    s, e, m: the candidate without the punctuation around it, or the base span that begins in it, whose kind is given.
    Everything is a running value in the order of places, so that a text costs what it is long.
    """
    base = narrow.where(F.size("candidates") > 0).select("row", F.explode("base").alias("x")).select("row", "x.s", "x.e", "x.m", "x.kind", F.lit(None).cast("string").alias("gap"), F.lit(None).cast("string").alias("tail"))
    words = narrow.select("row", F.explode("candidates").alias("x")).select("row", "x.s", "x.e", "x.m", F.lit(None).cast("int").alias("kind"), "x.gap", "x.tail")
    is_base = F.col("kind").isNotNull()
    up = Window.partitionBy("row").orderBy("s", is_base, "kind", "e").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row").orderBy(F.desc("s"), is_base.desc(), F.desc("kind"), F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    both = words.unionByName(base)
    both = both.withColumn("covered", F.max(F.when(is_base, F.col("e"))).over(up)).withColumn("own", F.last(F.when(is_base, F.struct("s", "e", "m", "kind")), True).over(down))
    outer = both.where(~is_base & (F.col("covered").isNull() | (F.col("covered") <= F.col("s"))))
    one = F.when(F.col("own.s") < F.col("e"), F.col("own"))
    name = F.when(F.contains("m", F.lit("@")), AT).otherwise(NUMBER)
    outer = outer.select("row", "s", "e", "m", one.alias("own"), split_words(F.col("gap")).alias("gap"), F.slice(split_words(F.col("tail")), 1, CONTEXT).alias("after"), F.array(name).alias("name"))
    order = Window.partitionBy("row").orderBy("s")
    none = F.array().cast("array<string>")
    lag = lambda c, n, d=none: F.coalesce(F.lag(c, n).over(order), d)
    start = F.array(*[F.lit(START)] * CONTEXT)
    before = F.concat(start, lag("name", 2), lag("gap", 1), lag("name", 1), F.col("gap"))
    edge = F.length(F.regexp_extract("m", r"^[\"'(\[<{]*", 0))
    core = F.regexp_replace(F.substring(F.col("m"), edge + 1, F.length("m")), r"[\"'.,;:!?)\]>}]+$", "")
    out = outer.select("row", "own", F.slice(before, -CONTEXT, CONTEXT).alias("before"), "after", (F.col("s") + edge).alias("s"), core.alias("m"))
    has = F.col("own").isNotNull()
    return out.select("row", "before", "after", F.col("own.kind").alias("kind"), F.when(has, F.col("own.s")).otherwise(F.col("s")).alias("s"), F.when(has, F.col("own.e")).otherwise(F.col("s") + F.length("m")).alias("e"), F.when(has, F.col("own.m")).otherwise(F.col("m")).alias("m")).where("m <> ''")


def patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a context, at most three; a side that the text's end cuts short makes none."""
    near, far = F.get(after, F.lit(0)), F.get(after, F.lit(1))
    around = F.when(F.get(before, F.lit(CONTEXT - 1)) != START, F.concat_ws(" ", F.get(before, F.lit(CONTEXT - 1)), F.lit("_"), near))
    made = F.array(F.concat(F.array_join(before, " "), F.lit(" _")), F.when(near.isNotNull(), around), F.when(far.isNotNull(), F.concat_ws(" ", F.lit("_"), near, far)))
    return F.array_distinct(F.array_compact(made))


def looks_like(word: Column, kind: str) -> Column:
    pattern, least, most = LOOKS[kind]
    return word.rlike(pattern) & F.length(digits(word)).between(least, most) & (F.length(word) > 2)


def score(edges: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """pattern, c0 to c3: the confidence of the good patterns for each kind, null where it is too low.

    edges: pattern, instance, kind (of a seed, else null), fits (for each kind whether the instance looks like it).
    A pattern is good for a kind if `support` of its instances are known as that kind and their worth, over one more than these
    and all that speaks against it, reaches confidence.  Seeds are worth 1, others as much as their best pattern.
    """
    kinds = range(len(KINDS))
    bare = edges.groupBy("pattern", "instance").agg(F.first("fits").alias("fits"), *[F.max(F.when(F.col("kind") == n, 1.0)).alias(f"v{n}") for n in kinds])
    # a pattern with fewer instances than the support can never be good; what does not look like a kind speaks against it
    alien = [F.count_if(~F.col("fits")[n] & F.col(f"v{n}").isNull()).alias(f"alien{n}") for n in kinds]
    size = bare.groupBy("pattern").agg(F.count("*").alias("size"), *alien).where(F.col("size") >= support)
    size = materialize(size, "pii-size")
    hot = hot_keys(size, ["pattern"], "size")
    graph = materialize(split_join(bare, size.drop("size"), ["pattern"], hot, ["instance"]), "pii-graph")
    seeds = graph.groupBy("instance").agg(*[F.max(f"v{n}").alias(f"v{n}") for n in kinds])
    graph = graph.drop(*[f"v{n}" for n in kinds])
    seeds = materialize(seeds.where(" or ".join(f"v{n} is not null" for n in kinds)), "pii-seeds")
    often = hot_keys(graph.groupBy("instance").agg(F.count("*").alias("__n")), ["instance"], "__n")
    known, good = seeds, None
    for _ in range(rounds):
        seen = split_join(graph, known, ["instance"], often, ["pattern"])
        other = [F.count_if(F.col(f"v{n}").isNull() & F.col("fits")[n]).alias(f"other{n}") for n in kinds]
        at = seen.groupBy("pattern").agg(*[F.count(f"v{n}").alias(f"k{n}") for n in kinds], *[F.sum(f"v{n}").alias(f"w{n}") for n in kinds], *other, *[F.first(f"alien{n}").alias(f"alien{n}") for n in kinds])
        sure = [F.col(f"w{n}") / (F.col(f"k{n}") + F.col(f"other{n}") + F.col(f"alien{n}") + 1) for n in kinds]
        good = at.select("pattern", *[F.when((F.col(f"k{n}") >= support) & (x >= confidence), x).alias(f"c{n}") for n, x in zip(kinds, sure, strict=True)])
        good = materialize(good.where(" or ".join(f"c{n} is not null" for n in kinds)), "pii-good")
        found = split_join(graph, good, ["pattern"], hot, ["instance"]).select("instance", best("fits").alias("b")).where("b is not null")
        found = found.groupBy("instance").agg(F.max("b").alias("b"))
        # an instance has one kind: a seed's own, else that of its best pattern
        fresh = found.join(seeds.select("instance"), "instance", "left_anti").select("instance", *[F.when(-F.col("b.less") == n, F.col("b.value")).alias(f"v{n}") for n in kinds])
        known = materialize(seeds.unionByName(fresh), "pii-known")
    return good


def best(fits: str) -> Column:
    """(value, minus the kind) of the most confident kind that fits, of equals the first; null if there is none."""
    each = [F.when(F.col(f"c{n}").isNotNull() & F.col(fits)[n], F.struct(F.col(f"c{n}").alias("value"), F.lit(-n).alias("less"))) for n in range(len(KINDS))]
    return F.array_max(F.array(*each))


def find(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, base (array of s, kind number, e, m) and added (array of s, kind number, e) for every row of docs.

    Places are code points, the end is exclusive.  Null text: empty.  The base spans depend on the text alone; an added
    span is a word, without the punctuation around it, that looks like its kind, has the words of a good pattern around it and overlaps no base span.  Repeated rows get
    equal results; ids may be null or equal.  Empty table: no rows.  Other columns are ignored.
    """
    spans = base_spans(F.col("text"))
    step = docs.select("doc_id", *[F.coalesce(x, F.array().cast(SPANS)).alias(k) for k, x in spans.items()], located(F.col("text"), CANDIDATE, F.col("text").rlike("[0-9@]"), True).alias("candidates"))

    def tag(n: int):
        return lambda x: F.struct(x.getField("s").alias("s"), F.lit(n).alias("kind"), x.getField("e").alias("e"), x.getField("m").alias("m"))

    tagged = F.flatten(F.array(*[F.transform(F.col(k), tag(n)) for n, k in enumerate(KINDS)]))
    # the number of a row is written with it, so that it stays
    narrow = materialize(step.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_sort(tagged).alias("base"), "candidates"), "pii-spans")
    instance = F.lower("m")
    fits = F.array(*[looks_like(instance, k) for k in KINDS])
    words = contexts(narrow).select("row", "s", "e", "kind", instance.alias("instance"), fits.alias("fits"), F.explode(patterns(F.col("before"), F.col("after"))).alias("pattern"))
    words = materialize(words, "pii-words")
    good = score(words.select("pattern", "instance", "kind", "fits"), rounds, support, confidence)
    # one span for each word, of the kind of its best pattern
    open_words = words.where("kind is null").drop("kind")
    hot = hot_keys(open_words.groupBy("pattern").agg(F.count("*").alias("__n")), ["pattern"], "__n")
    fresh = split_join(open_words, good, ["pattern"], hot, ["row", "s"]).select("row", "s", "e", best("fits").alias("b")).where("b is not null")
    fresh = fresh.groupBy("row", "s", "e").agg((-F.max("b").getField("less")).alias("kind"))
    added = fresh.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "kind", "e"))).alias("added"))
    return narrow.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<s:int,kind:int,e:int>>")).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, of sorted (s, kind, e)."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.getField("kind")), x.getField("s").cast("string"), x.getField("e").cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    count = lambda n: F.size(F.filter("base", lambda x: x.getField("kind") == n)).cast("long")
    bare = F.transform("base", lambda x: F.struct(x.getField("s").alias("s"), x.getField("kind").alias("kind"), x.getField("e").alias("e")))
    return out.select("doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)], F.sha2(listed(bare).cast("binary"), 256).alias("base_sha256"), listed(F.array_sort(F.concat(bare, "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
