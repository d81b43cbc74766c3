"""Source divergence, sentence pieces and phrases against brute force, the library and SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.llm import divergence, phrases, registry
from quillstream.llm import sentence_pieces as sp

spm = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

D = "/root/testdata/sf0.001"
ODD = [
    (1000, None, None, None), (1001, "", "en", "src1"), (1002, " \t\n ", None, "src1"), (1003, "Ärger ärger AB ab", "xx", None),
    (None, "one two one two. one two", "en", "src2"), (None, "one two one two. one two", "en", "src2"), (1006, "a" * 250, "zz", ""), (1007, "x y " * 60, "", "src1"),
    (1008, "▁ a  b ▁▁ \x00 日本 🙂 龘\r\n<s>", "ja", "src3"), (1009, " ".join(f"w{i % 97} the of" for i in range(20000)), "en", "src1"),
]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang", "source")
    df = base.unionByName(spark.createDataFrame(ODD, base.schema))
    return df.selectExpr("*", "1 AS n", "2 AS term", "3 AS gram", "'q' AS ids", "0 AS rank", "7 AS chunk", "5 AS total").repartition(3).persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]


def plain_audit(rows, least):
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted((t for t, n in seen[lang].items() if n >= least), key=str.encode)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def p(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return [1 + 10**9 * (c[t] + 2) // total for t in kept]

        q, of = p(whole), {s: p(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(map(f, of[s], of[o])), o.encode(), o) for o in sources if o != s]
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)}
            terms = [(-f(a, b), t.encode(), t) for t, a, b in zip(kept, of[s], q) if counts[lang, s][t] and a > b]
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:10], 1)}
    return out


@pytest.mark.parametrize("least,size", [(10, None), (2, 60)])
def test_divergence(docs, rows, monkeypatch, least, size):
    if size:  # many chunks, blocks of few sources, slices of few bytes, many partial counts
        monkeypatch.setattr(divergence, "ROWS", size)
        monkeypatch.setattr(divergence, "CELLS", 7)
        monkeypatch.setattr(divergence, "WORK", 1 << 40)
    got = [tuple(r) for r in divergence.audit(docs, least).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, least)


def test_shares_are_exact():
    rng = random.Random(4)
    for _ in range(300):
        total, terms = rng.randrange(1 << rng.randrange(1, 52)), rng.randrange(1, 1 << 20)
        counts = [rng.randrange(total + 1) for _ in range(5)]
        got = divergence.shares(np.array([counts]), np.array([[total]]), terms)[0].tolist()
        assert got == [1 + 10**9 * (c + 2) // (total + 2 * terms) for c in counts]


def test_slices_of_long_texts():
    text = " ".join(str(i) * (i % 7 + 1) for i in range(500)).encode() + b" " + b"z" * 900
    for size in (3, 10, 64, 5000):
        assert [w for p in divergence.pieces(text, bytes(range(256)), size) for w in p.split()] == text.split()


def test_terms_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    monkeypatch.setattr(divergence, "SLICE", 5)
    batch = pa.record_batch({"lang": ["a", "a", "b"], "source": ["s", "s", "t"], "text": ["x y x zebra zebra", "x Q", ""]})
    n, docs = Counter(), Counter()
    for out in divergence.count_terms(iter([batch, batch])):
        for r in out.to_pylist():
            n[r["lang"], r["term"]] += r["n"]
            docs[r["lang"], r["term"]] += r["docs"]
    assert n["a", b"x"] == 6 and docs["a", b"x"] == 4 and docs["a", b"zebra"] == 2 and n["a", b"q"] == 2 and ("b", b"") in n


def plain_phrases(rows, least, longest, first):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {g: c for g, c in f.items() if c >= least and len(g[1]) > 1}
    out = defaultdict(list)
    for (lang, g), a in often.items():
        longer = (h for h, c in often.items() if h[0] == lang and len(h[1]) > len(g) and c >= a)
        if any(g == h[1][i : i + len(g)] for h in longer for i in range(len(h[1]) - len(g) + 1)):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        phrase = " ".join(g)
        out[lang].append((-score, -a, phrase.encode(), (phrase, a, l, r, n[lang], score)))
    return {(lang, i, *x[3]) for lang, v in out.items() for i, x in enumerate(sorted(v)[:first], 1)}


@pytest.mark.parametrize("least,longest,first", [(100, 5, 2000), (4, 5, 50), (3, 2, 2000)])
def test_phrases(docs, rows, least, longest, first):
    got = [tuple(r) for r in phrases.mine(docs, least, longest, first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    want = plain_phrases(rows, least, longest, first)
    assert want and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("tokens,entries,slice_", [(20, 30, 16), (100, 1, 1000), (7, 10000, 5)])
def test_grams_are_counted_in_parts(rows, monkeypatch, tokens, entries, slice_):
    monkeypatch.setattr(phrases, "TOKENS", tokens)
    monkeypatch.setattr(phrases, "ENTRIES", entries)
    monkeypatch.setattr(phrases, "ROWS", 5)
    monkeypatch.setattr(phrases, "pieces", lambda raw, table: divergence.pieces(raw, table, slice_))
    some = [r for r in rows if len(r[1] or "") < 3000][:60]
    batch = pa.record_batch({"lang": [r[2] or "" for r in some], "text": [r[1] or "" for r in some]})
    want = Counter()
    for _, text, lang, _ in some:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    want[lang or "", k, " ".join(w[i : i + k]).encode()] += 2
    got = Counter()
    for lowest, highest in ((1, 1), (2, 2), (3, 5)):
        for out in phrases.count_grams(iter([batch, batch]), lowest, highest, None, None):
            for r in out.to_pylist():
                got[r["lang"], r["gram"].count(b" ") + 1, r["gram"]] += r["n"]
    assert got == want
    got = Counter()
    for out in phrases.count_grams(iter([batch, batch]), 1, 5, None, None):
        for r in out.to_pylist():
            got[r["lang"], r["gram"].count(b" ") + 1, r["gram"]] += r["n"]
    assert got == want


def test_bitmaps_have_every_gram(spark):
    df = spark.range(3000).selectExpr("'en' AS lang", "cast(concat('wörd', id) AS binary) AS gram")
    have = phrases.word_bits(df)
    bit = lambda w: phrases.hashed("en", w.encode()) % phrases.BITS
    assert all(phrases.marked(have, bit(f"wörd{i}")) for i in range(3000))
    assert sum(bool(phrases.marked(have, bit(f"other{i}"))) for i in range(3000)) < 10
    have = phrases.pair_bits(df.selectExpr("lang", "cast(concat(cast(gram AS string), ' b') AS binary) AS gram"))
    b = np.array([phrases.hashed("en", b"b")] * 3000, dtype=np.uint64)
    w, o = (np.array([phrases.hashed("en", f"{x}{i}".encode()) for i in range(3000)], dtype=np.uint64) for x in ("wörd", "other"))
    assert phrases.marked(have, phrases.pair_slots(w, b)).all() and phrases.marked(have, phrases.pair_slots(o, b)).sum() < 10
    assert phrases.marked(have, phrases.pair_slots(b, w)).sum() < 10


def test_scores_beyond_64_bits(spark):
    big = spark.createDataFrame([(4 * 10**12, 9 * 10**12, 10**15, 5 * 10**12)], "a long, l long, n long, r long")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    got = big.select(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact("a") * F.col("n").cast("decimal(16,0)"), exact("l") * exact("r"))).first()[0]
    assert got == 1000 * 4 * 10**12 * 10**15 // (45 * 10**24)


@pytest.fixture(scope="module")
def proto():
    return sp.read_model(public_tokenizers.path(sp.MODEL))


def odd_texts(n):
    rng = random.Random(1)
    parts = [" ", "  ", "▁", "\n", "\t", "a", "é", "日", "龘", "x", "\x00", "<s>", "<0x0A>", "ing", "\r\n", "🙂", " the", "�", "ﬁ", "Ａ", "ﾊﾟ", "①", "​", "　", "é"]
    return ["", " ", "a" * 3000, "".join(rng.choice("abcdefghijé日🙂") for _ in range(3000))] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_pieces_and_spans_are_those_of_the_library(proto, rows):
    lib, own = spm.SentencePieceProcessor(model_proto=proto), sp.Encoder(sp.Model(proto))
    texts = [r[1] or "" for r in rows] + odd_texts(600)
    for text, (ids, start, end) in zip(texts, own.block(texts), strict=True):
        want = [(p.id, p.begin, p.end) for p in lib.encode(text, return_type="proto").pieces]
        assert list(zip(ids.tolist(), start.tolist(), end.tolist(), strict=True)) == want
        assert own.model.decode(ids) == lib.decode(ids.tolist())
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)) == raw


def test_forgotten_and_sliced_parts(proto, monkeypatch):
    monkeypatch.setattr(sp, "KNOWN", 5)
    monkeypatch.setattr(sp, "BLOCK", 11)
    lib, own = spm.SentencePieceProcessor(model_proto=proto), sp.Encoder(sp.Model(proto))
    texts = [t for t in odd_texts(300) if len(t) < 200]
    for k in range(0, len(texts), 7):
        for text, (ids, _, _) in zip(texts[k : k + 7], own.block(texts[k : k + 7]), strict=True):
            assert ids.tolist() == lib.encode(text)


def test_ids_that_no_text_has(proto):
    lib, own = spm.SentencePieceProcessor(model_proto=proto), sp.Model(proto)
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.choice([0, 1, 2, 3, 130, 200, 229, 256, 259, 264, 28705, rng.randrange(32000)]) for _ in range(rng.randrange(9))]
        assert own.decode(np.array(ids, dtype=np.uint32)) == lib.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_compiled_character_maps(rule):
    lib = spm.SentencePieceNormalizer(rule_name=rule)
    own = sp.Normalizer(dict(sp.fields(lib.serialized_model_proto()))[3])
    for text in odd_texts(400):
        want, places = lib.normalize(text, with_offsets=True)
        got, at = own.normalize(text)
        raw = text.encode()
        assert (got, [len(raw[:k].decode()) for k in at.tolist()]) == (want, list(places))


def test_encode_and_decode(spark, docs, rows, proto):
    lib = spm.SentencePieceProcessor(model_proto=proto)
    encoded = sp.encode(docs, proto).persist()
    got = sorted((r.doc_id or -1, bytes(r.ids)) for r in encoded.collect())
    want = sorted((i or -1, sp.packed(np.array(lib.encode(t or "", add_bos=True, add_eos=True)))) for i, t, _, _ in rows)
    assert got == want
    assert sorted((r.doc_id or -1, r.decoded) for r in sp.decode(encoded, proto).collect()) == sorted((i or -1, lib.decode(lib.encode(t or "")) if t else "") for i, t, _, _ in rows)
    one = encoded.where("doc_id = 1008").select(*[sp.unpacked(F.col(c)).alias(c) for c in ("ids", "starts", "ends")]).first()
    text = ODD[8][1].encode()
    assert one.ids == lib.encode(ODD[8][1], add_bos=True, add_eos=True) and b"".join(text[a:b] for a, b in zip(one.starts, one.ends)) == text


def test_digests(spark, proto):
    lib = spm.SentencePieceProcessor(model_proto=proto)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    for r in registry.QUERIES["op12_sentence_pieces"](spark, D).collect():
        ids = lib.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_models_that_cannot_be_used(proto):
    other = spm.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto()
    with pytest.raises(ValueError):
        sp.Model(other)


def test_empty_tables(spark, docs, proto):
    none = docs.where("doc_id < 0")
    assert divergence.audit(none).count() == 0 and phrases.mine(none).count() == 0 and sp.decode(sp.encode(none, proto), proto).count() == 0


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_phrases"])
def test_sql(spark, name):
    at = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    rel = c.sql(registry.ORACLES[name])
    want = Counter(rel.fetchall())
    got = Counter(tuple(r) for r in registry.QUERIES[name](spark, at).select(*rel.columns).collect())
    assert got == want and got
