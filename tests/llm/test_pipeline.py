"""The corpus pipeline as a whole against a plain Python version of its five stages."""

import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline
from test_corpus import WORD, groups

DIR = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def good(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {i + o for i, g in enumerate(grams) if count[g] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    chars, symbols, bangs = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), (text or "").count("!")
    if len(w) < 50 or 2 * len(covered) > len(w):
        return False
    return not (2 * symbols > len(w) or 2 * bangs > len(w) or 2 * (len(lines) - len(set(lines))) > len(lines) or chars < 2 * len(w) or chars > 30 * len(w))


def grams(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    out, rest = {}, sum(sizes.values())
    while True:
        live = [s for s in order if s not in out]
        share = {s: rest * weight[s] / sum(weight[x] for x in live) for s in live}
        full = [s for s in live if share[s] >= 3 * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = 3 * sizes[s]
            rest -= out[s]


def mixed(rows):
    """(doc_id, source, text) as often as it is taken."""
    size = {d: len(WORD.findall(t or "")) for d, t, _ in rows}
    draw = {d: int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) >> 2 for d in size}
    by = defaultdict(list)
    for d, _, s in rows:
        by[s].append(d)
    sizes = {s: sum(size[d] for d in ids) for s, ids in by.items()}
    out = Counter()
    for s, goal in targets(sizes).items():
        whole = int(goal // sizes[s]) if sizes[s] else 0
        left, below, open_ = goal - whole * sizes[s], 0, True
        for d in sorted(by[s], key=draw.get):
            after = below + size[d]
            # up to what is left; the one at the boundary if that comes nearer
            more = open_ and (after <= left or after - left < left - below)
            open_ = open_ and after <= left
            below = after
            out[d] = whole + more
    return out


def shard_of(doc_id, shards):
    def draw(name):
        return (int(hashlib.md5(f"{name}:{doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)

    def best(names, weights):
        return names[0] if len(names) == 1 else min(names, key=lambda n: -math.log(draw(n)) / weights[n])

    inside = range(shards)
    for label, per in (("region", 12), ("rack", 4), ("shard", 1)):
        weights = Counter(f"{label}{x // per}" for x in inside)
        name = best(list(weights), weights)
        inside = [x for x in inside if f"{label}{x // per}" == name]
    return inside[0]


def test_pipeline(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    items = [grams(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    rows = [r for r in docs if good(r[1])]
    first = {d for d, n, least in groups(rows, 5, 80) if n == 0 or d == least}
    rows = [r for r in rows if r[0] in first]
    held = [grams(t) for _, t, _ in rows]
    rows = [r for r, g in zip(rows, held, strict=True) if not any(i and 100 * len(i & g) >= 80 * len(i) for i in items)]
    assert 0 < len(rows) < len(first) < len(docs)
    want = Counter()
    for d, n in mixed(rows).items():
        want[d, shard_of(d, 24), shard_of(d, 25)] += n
    got = corpus_pipeline.run(spark, DIR)
    assert set(got.columns) == set(spark.read.parquet(f"{DIR}/documents.parquet").columns) | {"shard", "grown_shard"}
    assert Counter((r.doc_id, r.shard, r.grown_shard) for r in got.collect()) == +want


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "sharding"]
