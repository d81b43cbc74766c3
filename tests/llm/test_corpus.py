"""The corpus operators against brute force on a fixture with nulls, empty texts, repeats, ties and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import automata, common, components, containment, line_dedup, mixing, pii, quality, repeats, revisits, sharding, signature_join, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest table, with odd rows and columns that clash with the operators' own."""
    base = spark.read.parquet(DOCS).select("doc_id", "text", "source")
    long = " ".join(f"w{i % 997}" for i in range(30000))
    odd = [(1000, None, None), (1001, "", "src1"), (1002, " \t\n ", "src1"), (1003, "one two", "src1"), (1004, "one two", "src2"), (1005, long, "src2"), (None, long, None), (1006, "a" * 250, None), (1007, "x y " * 60, "src1")]
    df = base.unionByName(spark.createDataFrame(odd, base.schema))
    df = df.selectExpr("*", "1 AS th", "2 AS size", "3 AS target", "'q' AS kept", "0 AS n_words", "7 AS shard")
    return df.persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


def key(r):
    return (r[0] is not None, r[0] or 0)


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("part,chunk", [(common.PART_ROWS, repeats.CHUNK), (2, 4)])
def test_suffix_dedup(docs, rows, monkeypatch, part, chunk):
    monkeypatch.setattr(common, "PART_ROWS", part)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    seen, want = set(), {}
    for d, t, _ in sorted(rows, key=key):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        want[d] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), sha(bytes(x for x, g in zip(b, gone) if not g)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in suffix_dedup.remove(docs).collect()}
    assert got == want


def test_shards_merge_by_binary_search():
    rng = np.random.default_rng(3)
    pieces = [bytes(rng.integers(97, 99, 40).astype(np.uint8)) for _ in range(60)]
    windows = np.array([31] * 60)
    rank = np.arange(60) * 100
    one = suffix_dedup.repeated(pieces, windows, rank, np.zeros(60, dtype=int), 10)
    two = suffix_dedup.repeated(pieces, windows, rank, np.arange(60) % 2, 10)
    seen, want = set(), []
    for p in pieces:
        for o in range(31):
            want.append(p[o : o + 10] in seen)
            seen.add(p[o : o + 10])
    assert one.tolist() == want and two.tolist() == want


@pytest.mark.parametrize("part,chunk", [(common.PART_ROWS, repeats.CHUNK), (2, 4)])
def test_substring_dedup(docs, rows, monkeypatch, part, chunk):
    monkeypatch.setattr(common, "PART_ROWS", part)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    count, want = Counter(), {}
    for _, t, _ in rows:
        w = (t or "").encode().split()
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    for d, t, _ in rows:
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = b"\1" * 35
        want[d] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    assert {r.doc_id: (r.n_words, r.n_removed, sha(bytes(r.kept))) for r in automata.remove(docs).collect()} == want


@pytest.mark.parametrize("chunk,hot", [(line_dedup.CHUNK, line_dedup.HOT), (2, 0)])
def test_line_dedup(docs, rows, monkeypatch, chunk, hot):
    monkeypatch.setattr(line_dedup, "CHUNK", chunk)
    monkeypatch.setattr(line_dedup, "HOT", hot)
    first, want = [], {}
    for d, t, _ in sorted(rows, key=key):
        kept, gone, lines = [], 0, (t or "").split("\n")
        for line in lines:
            w = frozenset(WORD.findall(line))
            late = w and any(min(len(v), len(w)) * 100 >= 80 * max(len(v), len(w)) and 100 * len(v & w) >= 80 * len(v | w) for v in first)
            if w and w not in first:
                first.append(w)
            gone += bool(late)
            kept += [] if late else [line]
        want[d] = (len(lines), gone, "\n".join(kept))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in line_dedup.remove(docs).collect()} == want


def test_resembling_lines_meet():
    rng, seen = np.random.default_rng(9), 0
    words = [rng.integers(0, 1 << 64, 400, dtype=np.uint64) for _ in range(30)]
    lines = []
    for w in words:
        n = int(rng.integers(1, 60))
        for _ in range(6):
            own = w[:n][rng.random(n) > 0.05]
            lines.append(np.concatenate((own, rng.choice(w, int(rng.integers(0, 3))), w[:1])))
    bounds, tokens = line_dedup.distinct(np.concatenate(([0], np.cumsum([len(x) for x in lines]))), np.concatenate(lines))
    sets = [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    assert [sorted(set(x.tolist())) for x in lines] == [x.tolist() for x in sets]
    at, line = line_dedup.prefix(bounds, 80)
    tag, q = line_dedup.meeting(tokens[at].astype(np.uint32), line, np.diff(bounds)[line], at - bounds[:-1][line], *(x[line] for x in line_dedup.bitmaps(bounds, tokens)), 80)
    met = {}
    for t, k in zip(tag.tolist(), q.tolist()):
        met.setdefault(k, set()).add(t)
    for i, a in enumerate(sets):
        for j in range(i):
            if line_dedup.similar(a, sets[j], 80):
                seen += 1
                assert met.get(i, set()) & met.get(j, set())
    assert seen > 100
    assert line_dedup.late(sets, [True] * len(sets), 80) == [i for i, a in enumerate(sets) if any(line_dedup.similar(a, b, 80) for b in sets[:i])]


def groups(rows, words, percent):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for d, t, _ in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append((d, frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()))
    up = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = up[i], up[j]
                up = [y if u == x else u for u in up]
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[up[i]] = min(d, least.get(up[i], d))
    return [(d, len(s), least.get(up[i])) for i, (d, s) in enumerate(sets)]


@pytest.mark.parametrize("words,percent,part,chunk,size", [(3, 90, common.PART_ROWS, signature_join.CHUNK, signature_join.CHUNK_BYTES), (5, 80, common.PART_ROWS, signature_join.CHUNK, signature_join.CHUNK_BYTES), (3, 90, 2, 2, signature_join.CHUNK_BYTES), (3, 90, common.PART_ROWS, signature_join.CHUNK, 20_000)])
def test_jaccard_join(docs, rows, monkeypatch, words, percent, part, chunk, size):
    monkeypatch.setattr(signature_join, "CHUNK_BYTES", size)
    monkeypatch.setattr(common, "PART_ROWS", part)
    monkeypatch.setattr(signature_join, "CHUNK", chunk)
    monkeypatch.setattr(signature_join, "BITMAP_CHUNK", 2 * chunk)
    got = signature_join.link(docs, words, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(groups(rows, words, percent), key=str)


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 80, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: 80 - i % 12], rng.integers(0, 1 << 60, i % 9, dtype=np.uint64)))) for i in range(60)]
    tree = signature_join.SignatureTree(np.stack([signature_join.bitmap(s, 256) for s in sets]), np.array([len(s) for s in sets]), 90)
    found = {frozenset(p) for p in zip(*(x.tolist() for x in tree.pairs()))}
    assert all(frozenset((i, j)) in found for i in range(60) for j in range(i) if signature_join.linked(sets[i], sets[j], 90))


def test_largest_partner_holds_at_the_first_shingle_in_common():
    rng, seen = np.random.default_rng(5), 0
    for percent in (80, 90):
        for _ in range(2000):
            n = int(rng.integers(1, 60))
            a = np.unique(rng.integers(0, 1 << 40, n)).astype(np.uint64)
            b = np.unique(np.concatenate((a[rng.random(len(a)) > 0.06], rng.integers(0, 1 << 40, int(rng.integers(0, 6))).astype(np.uint64))))
            if not len(b) or not signature_join.linked(a, b, percent):
                continue
            seen += 1
            w = np.intersect1d(a, b)[0]
            for x, y in ((a, b), (b, a)):
                place = int(np.searchsorted(x, w))
                assert place < signature_join.prefix_length(len(x), percent)
                assert len(y) <= signature_join.largest_partner(np.array([len(x)]), np.array([place]), percent)[0]
    assert seen > 500


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("x", "y")], "a string, b string")
    assert {tuple(r) for r in components.components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}


def test_split_join_gives_what_a_join_gives(spark, monkeypatch):
    monkeypatch.setattr(common, "PART_ROWS", 3)
    left = spark.createDataFrame([(k, i) for k, n in (("hot", 40), ("warm", 4), ("cold", 1), ("alone", 2)) for i in range(n)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("warm", 2), ("cold", 3), ("other", 4)], "k string, v int")
    hot = common.hot_keys(left.groupBy("k").count(), ["k"], "count")
    assert sorted(map(tuple, hot.collect())) == [("hot", 14), ("warm", 2)]
    for how in ("inner", "left"):
        got = common.split_join(left, right, ["k"], hot, ["i"], how)
        assert sorted(got.collect(), key=str) == sorted(left.join(right, "k", how).collect(), key=str)


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, goal, taken = {}, {}, Counter()
    for r in got:
        assert r.size == len(WORD.findall(r.text or "")) and r.taken <= 3 * r.size
        sizes[r.source], goal[r.source] = r.source_size, r.target
        taken[r.source] += r.taken
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))
    most = {s: max(r.size for r in got if r.source == s) for s in sizes}
    for s in sizes:
        assert goal[s] <= 3 * sizes[s] and abs(taken[s] - goal[s]) <= most[s]


def test_sample_keeps_columns_and_takes_what_the_mix_does(docs):
    clash = docs.selectExpr("* except (size, target)", "777 AS size", "'t' AS target", "'c' AS copies", "-1 AS taken", "0.5 AS source_size")
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] = (want.get((r.doc_id, r.source), (0, 0))[0] + r.copies, max(r.size, want.get((r.doc_id, r.source), (0, 0))[1]))
    got = mixing.sample(clash)
    rows = got.collect()
    assert got.columns == clash.columns and {(r["size"], r.target, r.copies, r.taken, float(r.source_size)) for r in rows} == {(777, "t", "c", -1, 0.5)}
    seen = Counter((r.doc_id, r.source) for r in rows)
    assert all(seen[k] == n for k, (n, size) in want.items() if size) and all(seen[k] <= 3 for k in want)


def test_sharding_digests_and_weights(docs, rows):
    got = {r.doc_id: r for r in sharding.shard(docs).collect()}
    for d, t, _ in rows:
        raw = (t or "").encode()
        assert (got[d].size, got[d].text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    many = docs.sparkSession.range(20000).select(F.col("id").alias("doc_id"))
    base = {r.doc_id: r.shard for r in sharding.assign(many).collect()}
    twice = {r.doc_id: r.shard for r in sharding.assign(many, weights={5: 2.0}).collect()}
    moved = {d for d in base if base[d] != twice[d]}
    # a heavier shard only takes documents: its rack from the region, its region from the other one, none among the rest
    assert moved and all(twice[d] // 4 == 1 or twice[d] // 12 == 0 for d in moved)
    assert not {d for d in moved if base[d] // 12 == 1 and twice[d] // 12 == 1}
    share = Counter(twice.values())
    assert share[5] / 20000 == pytest.approx(2 / 25, rel=0.15) and max(share[s] for s in range(24) if s != 5) / 20000 == pytest.approx(1 / 25, rel=0.25)
    none = {r.shard for r in sharding.assign(many, weights={7: 0.0}).collect()}
    assert none == set(range(24)) - {7}
    grown = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign(many).collect()}
    assert {b for a, b in grown.values() if a != b} == {24}


def test_sharding(docs):
    got = sharding.shard(docs).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))


def test_quality(docs, rows):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for d, t, _ in rows:
        w = WORD.findall(t or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(grams)
        covered = {i + o for i, g in enumerate(grams) if count[g] > 1 for o in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (got[d].n_words, got[d].n_repeat_words) == (len(w), len(covered))
        assert (got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines) == (sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)))
        assert got[d].kept == (got[d].rejected_by is None) and (not got[d].base_failed or got[d].rejected_by)
        assert got[d].base_failed == (len(w) < 50 or 2 * len(covered) > len(w))
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(d for d in got if d is not None and got[d].kept)


def test_any_order_of_rules_gives_one_verdict(docs, monkeypatch):
    def kept(rules):
        monkeypatch.setattr(quality, "order", lambda *_: [(r, 0.0, 1.0) for r in rules])
        return sorted(map(str, quality.keep(docs).collect())), sorted(map(str, quality.judge(docs).where("kept").select(*[c for c in docs.columns if c not in ("kept", "n_words")]).collect()))

    first = kept(quality.RULES)
    assert kept(quality.RULES[::-1]) == first and kept(quality.RULES[3:] + quality.RULES[:3]) == first
    plan = quality.keep(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_remove") == 1


def test_containment(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n))
    items = [word(int(n)) for n in rng.integers(8, 70, 30)]
    texts = [word(3000) + " " + items[i].upper() + " " + word(2000) for i in range(30)] + [word(500)]
    b = spark.createDataFrame([(i, x) for i, x in enumerate([*items, None, "too short"])], "item_id long, text string")
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(97, "a text that is too short by far"), (98, "TOO\n short"), (99, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in containment.leaks(d, b).collect()) == [(i, i) for i in range(30)] + [(98, 31)]
    assert sorted(r.doc_id for r in containment.clean(d, b).collect()) == [30, 97, 99]
    # repeated items and rows, null ids, clashing columns, and bitmaps that say little
    more = b.unionByName(spark.createDataFrame([(100, items[0]), (None, items[1])], b.schema)).withColumn("doc_id", F.lit(5)).withColumn("shared", F.lit("x"))
    twice = d.unionByName(d.where("doc_id = 0")).withColumn("item_id", F.lit(1)).withColumn("th", F.lit("y"))
    monkeypatch.setattr(containment, "fitting", lambda entries: 256)
    want = [(i, i) for i in range(30)] + [(0, 0), (0, 100), (0, 100), (1, None), (98, 31)]
    assert sorted(((r.doc_id, r.item_id) for r in containment.leaks(twice, more).collect()), key=str) == sorted(want, key=str)


def test_containment_finds_scattered_items(spark):
    """Each text holds exactly 80 % of an item's shingles, in four places; or just under."""
    rng = np.random.default_rng(6)
    word = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n)]
    items = [word(104) for _ in range(60)]  # 100 shingles

    def text(w, each):
        return " ".join(sum(([*word(400), *w[k : k + each + 4]] for k in range(0, 100, 25)), []) + word(300))

    d = spark.createDataFrame([(i, text(w, 20)) for i, w in enumerate(items)] + [(100 + i, text(w, 19)) for i, w in enumerate(items)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.shared) for r in containment.leaks(d, b).collect()) == [(i, i, 80) for i in range(60)]


def test_many_items_are_rows_not_closures(spark):
    """Ten thousand items: all that are held are found, and the driver gets counts and bitmaps only."""
    rng = np.random.default_rng(8)
    vocabulary = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(3000)])
    items = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(6, 60, 10000)]
    held = [int(x) for x in rng.choice(10000, 150, replace=False)]
    texts = [" ".join(rng.choice(vocabulary, 300)) + " " + " ".join(items[i] for i in held[k : k + 3]) for k in range(0, 150, 3)] + [" ".join(rng.choice(vocabulary, 4000)) + " é" * 20]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = containment.leaks(d, b)
    assert {(r.doc_id, r.item_id) for r in out.collect()} >= {(k // 3, held[k]) for k in range(150)} and all(r.containment >= 0.8 for r in out.collect())
    plan = out._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "LocalTableScan" not in plan.split("== Physical Plan ==")[1]


def test_pii_discovers(spark):
    rows = [(i, f"text here contact id user{i}@x.com and more") for i in range(8)] + [(8, "so contact id anna77 then"), (9, None), (10, "call +1 (743) 555-3824 or 1.2.3.4")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[8].added] == [(14, 0, 18 + 2)] or got[8].added[0].s == 14
    assert got[9].base == [] and [x.kind for x in got[10].base] == [3, 1]


def plain_spans(t):
    """(s, kind, e) by the base patterns in their plain form, without possessive quantifiers, lookbehind and \\G."""
    def luhn(n):
        of = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(n))))
        return 12 <= len(n) <= 19 and of % 10 == 0

    forms = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda m: all(int(p) <= 255 for p in m.split("."))), (r"[0-9](?:[ -]?[0-9])+", lambda m: luhn(re.sub("[^0-9]", "", m))), (r"\+[0-9][ ().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15)]
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(forms) for m in re.finditer(p, t or "") if good(m[0]))


def test_pii_base_spans_are_those_of_the_plain_patterns(spark, tmp_path):
    rng = np.random.default_rng(7)
    odd = ["a@b.c@d.e", "a@b.c,x@y.z", "a@b", "@b.c", "a@b..c", "a@b.c.", "%@-.-", "a@b.cd@e.f.g@h", "1.2.3.4.5.6.7.8", "1.2.3.4.", "256.1.1.1", "000001.002.3.0255", "1.2.3.99999999999999999999", "..1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "0000000000000000", "4" * 12, "1" * 400, "0" * 19, "0" * 20, "1-" * 40, "+1 (743) 555-3824", "+1+2 34567890", "+1 2 3", "++12345678901", "+12345678901234567", "+1 23456789 +1 98765432", "é4111111111111111é", "😀 a@b.c 1.2.3.4", "x1@y.z1.2.3.4"]
    letters = list("01259a@..+- ()%\n")
    texts = odd + ["".join(rng.choice(letters, int(rng.integers(1, 60)))) for _ in range(1500)]
    small = [(r.doc_id, r.text) for r in spark.read.parquet(DOCS).collect()]
    rows = small + [(10000 + i, t) for i, t in enumerate(texts)] + [(None, None), (99999, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        want = plain_spans(t)
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == n for x in want) for n in range(4)], t
        assert got[d].base_sha256 == sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want).encode()), t
        listed = got[d].spans.split(",") if got[d].spans else []
        assert {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want} <= set(listed) and len(listed) == len(want) + got[d].n_added


def test_pii_context_does_not_end_at_another_identifier(spark):
    rows = [(i, f"a{i}@x.com, phone +1 (743) 555-38{i:02d} is it") for i in range(12)] + [(20, "b@x.com, phone 5551234 is it"), (21, "so c9 or"), (22, "in 12 34 56 555-3824")]
    rows += [(30 + i, f"mail u{i}@y.org") for i in range(12)] + [(50, "mail v77"), (51, "so mail v77")]
    got = {r.doc_id: [tuple(x) for x in r.added] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20] == [(15, 3, 22)] and got[50] == [(5, 0, 8)]
    # The words of a phone number are no pattern for numbers in a list, nor is the start of a text left out of a pattern.
    assert got[22] == [] and got[51] == []


def test_pii_bootstraps_from_what_it_found(spark):
    """Planted identifiers: those of the second and third wave can only be found through the ones found before."""
    rng = np.random.default_rng(4)
    filler = lambda: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(5))
    rows, want = [], {}

    def put(shape, value, planted):
        text = f"{filler()} {shape.format(value)} {filler()}"
        rows.append((len(rows), text))
        if planted:
            s = text.index(value)
            want[len(rows) - 1] = {(s, 0, s + len(value))}

    for i in range(30):
        put("write to {} for help", f"u{i}@x.com", False)  # seeds, with patterns of their own
    handles = [f"anna{i}" for i in range(12)]
    for h in handles:
        put("write to {} for help", h, True)  # found by the seeds' patterns
        put("handle is {} in chat", h, True)  # the same instances have patterns without a seed
    for i in range(4):
        put("handle is {} in chat", f"zoe{i}", True)  # found by those
    for i in range(40):
        put("room no {} was full", f"{100 + i}", False)  # numbers which are no one's
        put("see {}", f"page{i}", False)
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), confidence=0.6).collect()
    got = {r.doc_id: {tuple(x) for x in r.added} for r in found if r.added}
    assert got == want
    once = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1, confidence=0.6).collect()
    assert sum(len(r.added) for r in once) == len(handles)


def test_revisits(spark):
    h = "map<string,string>"
    rows = [(1, "http://WWW.a.com/x/?b=2&a=1#f", 10, False, {"etag": "W/q", "date": "1", "content-type": "t"}, "d1"), (2, "https://a.com/x?a=1&b=2&utm_source=z", 20, True, {"etag": "q", "date": "2", "content-type": "no"}, None), (3, "a.com/x?a=1&b=2", 5, True, None, None), (4, "a.com/x?a=1&b=2", 300000, True, {"etag": "other"}, "d1"), (5, None, 1, True, None, "d1"), (6, None, 0, False, {"etag": "q"}, "d1"), (7, "a.com/x?a=1&b=2", None, True, {"etag": "q"}, None), (8, None, 2, True, {"etag": "q"}, None), (8, None, 2, True, {"etag": "q"}, None)]
    found = revisits.resolve(spark.createDataFrame(rows, f"record_id long, url string, ts long, revisit boolean, headers {h}, digest string")).collect()
    assert sorted(r.record_id for r in found) == [2, 3, 4, 5, 7, 8, 8]
    got = {r.record_id: r for r in found}
    assert (got[2].outcome, got[2].response_id, got[2].headers) == ("resolved", 1, {"etag": "q", "date": "2", "content-type": "t"})
    assert (got[3].outcome, got[4].outcome) == ("no_response", "mismatch")
    assert {got[k].outcome for k in (5, 7, 8)} == {"no_response"}


def test_revisits_ties_and_other_columns(spark):
    h = "map<string,string>"
    kind = f"record_id long, url string, ts long, revisit boolean, headers {h}, digest string"
    rows = [(1, "a.com/x", 10, False, {"etag": "p"}, "d1"), (2, "a.com/x", 10, False, {"etag": "q"}, "d2"), (3, "a.com/x", 10, True, {"etag": "q"}, None), (4, "a.com/x", 11, True, {"etag": "q"}, None), (5, "a.com/x", 11, None, {"etag": "z"}, "d5"), (6, "a.com/x", 12, True, {"etag": "q"}, None)]
    df = spark.createDataFrame(rows, kind)
    clash = df.selectExpr("*", "'x' AS outcome", "5 AS response_id", "1 AS canonical", "0 AS slice")
    for given in (df, clash):
        got = {r.record_id: (r.outcome, r.response_id, r.digest) for r in revisits.resolve(given).collect()}
        # a response of the same time is not earlier; of equal ones the largest id counts; what is not said to be a revisit is a response
        assert got == {3: ("no_response", None, None), 4: ("resolved", 2, "d2"), 6: ("mismatch", None, None)}
    assert revisits.resolve(df.where("ts < 0")).count() == 0


def test_empty_tables(spark, docs):
    none = docs.where("doc_id = -1")
    for f in (suffix_dedup.remove, automata.remove, line_dedup.remove, signature_join.link, mixing.mix, sharding.shard, quality.judge, pii.find, lambda d: containment.leaks(d, spark.createDataFrame([], "item_id long, text string"))):
        assert f(none).count() == 0
