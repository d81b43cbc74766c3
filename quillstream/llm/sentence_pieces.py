"""Encoding with a SentencePiece BPE model that keeps the place of every piece, and decoding.

A text is normalised by the longest prefix that the model's compiled character map has (without one, a character stands for
itself); with every normalised character goes the place of the source that it came from.  The normalised text is cut where
no piece can reach across, equal parts are merged once, and the pieces' lengths are summed up to places in the normalised
text, from there to spans of bytes in the source.  Tasks get the model's bytes, half a megabyte, from the driver.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm import anchors
from quillstream.llm.common import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Characters that are encoded at once; parts whose pieces a task remembers; characters of a part that is merged with others at once.
BLOCK, KNOWN, SHORT = 1 << 20, 1 << 19, 48
#: Kinds of pieces (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, message[at : at + size]
            at += size


class CharacterMap:
    """A compiled character map: a double-array trie from byte strings to places in a list of replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, length) of the longest entry that raw has at this place."""
        units, found = self.units, None
        node = _child(units[0], 0)
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            leaf = units[node] >> 8 & 1
            node = _child(units[node], node)
            if leaf:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        return found and (self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1])


def _child(unit: int, node: int) -> int:
    return node ^ (unit >> 10 << ((unit & 512) >> 6))


class Normalizer:
    def __init__(self, spec: bytes):
        own = dict(fields(spec))
        self.map = CharacterMap(own[2]) if own.get(2) else None
        self.prefix, self.trim, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))

    @property
    def plain(self) -> bool:
        """Whether every character stands for itself."""
        return self.map is None and not self.trim and self.escape

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters and its end the byte of the source that it begins at."""
        raw = text.encode()
        out, place, at, after = [], [], 0, self.trim
        while at < len(raw):
            found = self.map and self.map.longest(raw, at)
            if found:
                part, size = found[0].decode(), found[1]
            else:
                size = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                part = raw[at : at + size].decode()
            if after:
                part = part.lstrip(" ")
            if part:
                out.append(part)
                place += [at] * len(part)
                after = self.trim and part.endswith(" ")
            at += size
        done = "".join(out)
        if not done:
            return "", np.zeros(1, dtype=np.int64)
        if self.prefix:
            done, place = " " + done, [place[0] if self.trim else 0, *place]
        if self.escape:
            done = done.replace(" ", SPACE)
        if self.trim:
            kept = done.rstrip(SPACE if self.escape else " ")
            at = place[len(kept)] if len(kept) < len(done) else at
            done, place = kept, place[: len(kept)]
        return done, np.array([*place, at], dtype=np.int64)


class Model:
    """A BPE model without pieces that a user defined."""

    def __init__(self, proto: bytes):
        self.proto = proto
        self.texts: list[str] = []
        self.kinds: list[int] = []
        scores, normal, trainer = [], b"", {}
        for number, value in fields(proto):
            if number == 1:
                own = dict(fields(value))
                self.texts.append(own[1].decode())
                self.kinds.append(own.get(3, NORMAL))
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = value
        if trainer.get(3, 1) != 2 or trainer.get(24) or {*self.kinds} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with the space before a word and without user-defined or unused pieces can be used")
        self.normalizer = Normalizer(normal)
        self.begin, self.end = (trainer.get(k, d) for k, d in ((41, 1), (42, 2)))
        self.unknown = self.kinds.index(UNKNOWN)
        self.id = {t: i for i, t in enumerate(self.texts) if self.kinds[i] == NORMAL}
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if self.kinds[i] == BYTE} if trainer.get(35) else {}
        order = np.argsort(-np.array(scores), kind="stable")
        tie = np.array(scores)[order]
        self.rank = np.empty(len(scores), dtype=np.int64)
        self.rank[order] = np.cumsum(np.concatenate(([0], tie[1:] != tie[:-1])))  # equal scores have equal ranks
        single = {t: i for t, i in self.id.items() if len(t) == 1}
        self.symbol = {**single}
        for t in self.id:
            for c in t:
                self.symbol.setdefault(c, -ord(c) - 1)
        pairs: dict[tuple[int, int], int] = {}
        for t, i in self.id.items():
            for k in range(1, len(t)):
                a, b = (self.id.get(x, self.symbol[x] if len(x) == 1 else None) for x in (t[:k], t[k:]))
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.pairs = pairs
        keys = np.array([_pack(a, b) for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array([*pairs.values()], dtype=np.int64)[order]
        inside = {t[k : k + 2] for t in self.id for k in range(len(t) - 1)}
        #: characters that no piece joins with another, and whether a piece can run on beyond a word
        self.alone = "".join(c for c in "\n\r\t" if not any(c in pair for pair in inside))
        self.cut = not any(p[0] != SPACE and p[1] == SPACE for p in inside)

    @cached_property
    def parts(self) -> re.Pattern:
        """What a normalised text is cut into: spaces with the word after them."""
        if not self.cut:
            return re.compile("(?s:.+)")
        alone = re.escape(self.alone)
        return re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))

    def slices(self, text: str) -> Iterator[list[str]]:
        """The parts of a text, those of about BLOCK characters at once."""
        at, ahead = 0, re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
        while at < len(text):
            found = ahead.search(text, at + BLOCK) if self.cut and len(text) - at > BLOCK else None
            end = found.start() if found else len(text)
            yield self.parts.findall(text, at, end)
            at = end

    def merge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, characters, pieces): the pieces of the parts, one part after the other, and how many each part has.

        Of the bytes of a character that no piece has, the last one has the character.
        """
        size = np.array([len(p) for p in parts], dtype=np.int64)
        code = np.frombuffer("".join(parts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        there, back = np.unique(code, return_inverse=True)
        sym = np.array([self.symbol.get(chr(c), -int(c) - 1) for c in there], dtype=np.int64)[back]
        seg, place = np.repeat(np.arange(len(parts)), size), np.arange(len(code))
        width = np.ones(len(code), dtype=np.int64)
        done = []
        long = size[seg] > SHORT
        start = np.cumsum(size) - size
        for k in np.flatnonzero(size > SHORT):
            at, own, chars = self._one(sym[start[k] : start[k] + size[k]].tolist())
            done.append((start[k] + at, own, chars, np.full(len(at), k)))
        sym, seg, place, width = (x[~long] for x in (sym, seg, place, width))
        into = self._joined(sym, seg, np.arange(len(sym)))
        while len(sym):
            # of each part the pair of the best piece, of equals the leftmost
            cost = np.where(into >= 0, (self.rank[into] << 32) + np.arange(len(sym)), _NONE)
            head = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            best = np.minimum.reduceat(cost, head)
            live = best < _NONE
            left = best[live] & 0xFFFFFFFF
            sym[left] = into[left]
            width[left] += width[left + 1]
            into[left] = _ASK
            before = left[left > 0] - 1
            into[before[seg[before] == seg[before + 1]]] = _ASK
            stays = np.repeat(live, np.diff(np.append(head, len(sym))))
            done.append((place[~stays], sym[~stays], width[~stays], seg[~stays]))
            stays[left + 1] = False
            sym, seg, place, width, into = (x[stays] for x in (sym, seg, place, width, into))
            ask = np.flatnonzero(into == _ASK)
            into[ask] = self._joined(sym, seg, ask)
        place, sym, width, seg = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        sym, width, seg = sym[order], width[order], seg[order]
        if len(odd := np.flatnonzero(sym < 0)):
            sym, width, seg = self._fall_back(sym, width, seg, odd)
        return sym, width, np.bincount(seg, minlength=len(parts))

    def _joined(self, sym: np.ndarray, seg: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The piece that the symbols at these places make with the next one of their part, -1 if none."""
        after = np.minimum(at + 1, len(sym) - 1)
        key = (sym[at] + _SHIFT << 32) + sym[after] + _SHIFT
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[found] == key) & (seg[at] == seg[after]) & (after > at), self.merged[found], -1)

    def _fall_back(self, sym: np.ndarray, width: np.ndarray, seg: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, ...]:
        """Characters that are no piece: their bytes, or the unknown piece, once for neighbours."""
        if not self.bytes:
            sym[odd] = self.unknown
            return sym, width, seg
        there, back = np.unique(-sym[odd] - 1, return_inverse=True)
        ids = [[self.bytes[b] for b in chr(c).encode()] for c in there.tolist()]
        times = np.ones(len(sym), dtype=np.int64)
        times[odd] = np.array([len(x) for x in ids])[back]
        last = np.cumsum(times) - 1
        out = np.repeat(sym, times)
        for j in range(4):
            has = times[odd] > j
            out[last[odd[has]] - times[odd[has]] + 1 + j] = np.array([x[j] if j < len(x) else 0 for x in ids])[back[has]]
        chars = np.zeros(len(out), dtype=np.int64)
        chars[last] = width
        return out, chars, np.repeat(seg, times)

    def _one(self, sym: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, symbol, characters) of the pieces of one long part, by a heap of pairs."""
        n = len(sym)
        ahead, back, width = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        rank, pairs = self.rank.tolist() if n > 4096 else self.rank, self.pairs
        heap = [(int(rank[m]), i, m, sym[i], sym[i + 1]) for i in range(n - 1) if (m := pairs.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, m, a, b = heapq.heappop(heap)
            j = ahead[i]
            if width[i] == 0 or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], width[i], width[j] = m, width[i] + width[j], 0
            ahead[i] = k = ahead[j]
            if k < n:
                back[k] = i
                if (x := pairs.get((m, sym[k]))) is not None:
                    heapq.heappush(heap, (int(rank[x]), i, x, m, sym[k]))
            if (h := back[i]) >= 0 and (x := pairs.get((sym[h], m))) is not None:
                heapq.heappush(heap, (int(rank[x]), h, x, sym[h], m))
        at = [i for i in range(n) if width[i]]
        return np.array(at), np.array([sym[i] for i in at]), np.array([width[i] for i in at])

    @cached_property
    def library(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.proto)

    @cached_property
    def surfaces(self) -> list[bytes]:
        """What each id decodes to."""
        other = {CONTROL: lambda t: b"", BYTE: lambda t: bytes([int(t[3:5], 16)])}
        return [other.get(k, lambda t: t.replace(SPACE, " ").encode())(t) if k != UNKNOWN else " ⁇ ".encode() for t, k in zip(self.texts, self.kinds, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that normalisation put in front is left out.

        Bytes that make no character: as the library reads them.
        """
        parts = [b"".join(map(self.surfaces.__getitem__, ids[i : i + BLOCK].tolist())) for i in range(0, len(ids), BLOCK)]
        whole = b"".join(parts)
        first = next((int(i) for i in ids[: BLOCK] if self.kinds[i] != CONTROL), None)
        if self.normalizer.trim or self.unknown in ids or first is None and len(ids) > BLOCK:
            return self.library.decode(ids.tolist())
        if self.normalizer.prefix and first is not None and self.kinds[first] == NORMAL and whole[:1] == b" ":
            whole = whole[1:]
        try:
            return whole.decode()
        except UnicodeDecodeError:
            return self.library.decode(ids.tolist())


#: Symbols are at least -0x110000; no pair; a pair to be looked up.
_SHIFT, _NONE, _ASK = 1 << 21, 1 << 62, -2


def _pack(a: int, b: int) -> int:
    return (a + _SHIFT << 32) + b + _SHIFT


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Encoder:
    """Encodes texts, and remembers the pieces of parts."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.pieces = self.start = np.empty(0, dtype=np.int64)
        self.ids = self.chars = np.empty(0, dtype=np.int32)

    def _learn(self) -> None:
        have = len(self.pieces)
        if len(self.number) == have:
            return
        ids, chars, pieces = self.model.merge([*self.number][have:])
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.chars = np.concatenate((self.chars, chars.astype(np.int32)))
        self.pieces = np.concatenate((self.pieces, pieces))
        self.start = np.cumsum(self.pieces) - self.pieces

    def block(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begin, end) of each text: places are bytes of the source; begin and end ids are not among them."""
        plain = self.model.normalizer.plain
        lead = SPACE if self.model.normalizer.prefix else ""
        if plain:
            normal = [lead + t.replace(" ", SPACE) if t else t for t in texts]
        else:
            normal, places = zip(*map(self.model.normalizer.normalize, texts), strict=True) if texts else ((), ())
        count, parts = [], []
        for t in normal:
            before = len(parts)
            for some in self.model.slices(t):
                if len(self.number) > KNOWN and not parts:
                    self._forget()
                parts += map(self.number.__getitem__, some)
            count.append(len(parts) - before)
        self._learn()
        of = np.array(parts, dtype=np.int64)
        pieces = self.pieces[of]
        upto = np.cumsum(pieces)
        at = np.repeat(self.start[of] - (upto - pieces), pieces) + np.arange(upto[-1] if len(upto) else 0)
        ids, chars = self.ids[at], self.chars[at]
        edge = np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum(count, dtype=np.int64)))]
        for k, text in enumerate(texts):
            own, ends = ids[edge[k] : edge[k + 1]], np.cumsum(chars[edge[k] : edge[k + 1]], dtype=np.int64)
            if plain:
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                if lead:
                    place = np.concatenate((place[:1], place))
            else:
                place = places[k]
            begin, end = np.concatenate(([0], ends[:-1])), ends
            end = place[end] if len(end) else end
            # the bytes of one character share its place, all but the last of them are empty
            yield own, place[begin] if len(begin) and len(own) else ends, end


@lru_cache(1)
def encoder(proto: bytes) -> Encoder:
    """A worker's encoder: what it remembers serves the tasks that come after."""
    return Encoder(Model(proto))


def packed(values: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes()


def unpacked(column: Column) -> Column:
    """The numbers of a packed column, as an array of longs."""
    number = lambda i: F.conv(F.hex(F.concat(*[column.substr(4 * i + k, F.lit(1)) for k in (4, 3, 2, 1)])), 16, 10).cast("long")
    n = F.floor(F.octet_length(column) / 4).cast("int")
    return F.when(n == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), number))


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, proto: bytes, begin: bool = True, end: bool = True, decoded: bool = False) -> DataFrame:
    """doc_id, ids, starts, ends for every row of docs, each packed as little-endian unsigned 32-bit numbers.

    ids are those of the library, with its begin and end ids if asked for; starts and ends are the bytes of the text that a
    piece stands for (begin id: 0 and 0, end id: the text's length twice; of a character that is spelled as bytes the last
    byte has it all).  With decoded also the text that decode makes of the ids, in the same pass.  Null text: empty, which has
    no pieces.  Ids of documents may be null or equal.  Long texts are cut
    between words only, so a text without spaces is merged at once.  Empty table: no rows.  Other columns are ignored.
    """
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.BinaryType()) for c in ("ids", "starts", "ends")], *[T.StructField("decoded", T.StringType())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(proto)
        first, last = [own.model.begin] * begin, [own.model.end] * end
        for batch in batches:
            lo = 0
            _, edge = anchors.utf8(batch.column("text"))
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + BLOCK, side="right")) - 1)
                texts = batch.column("text").slice(lo, hi - lo).to_pylist()
                out: tuple[list[bytes], ...] = ([], [], [])
                again = []
                for text, (ids, a, b) in zip(texts, own.block(texts), strict=True):
                    size = len(text.encode())
                    for into, head, values, tail in zip(out, (first, [0] * begin, [0] * begin), (ids, a, b), (last, [size] * end, [size] * end), strict=True):
                        into.append(packed(np.concatenate((head, values, tail))))
                    if decoded:
                        again.append(own.model.decode(np.frombuffer(out[0][-1], dtype="<u4")))
                made = [pa.array(x, type=pa.binary()) for x in out] + [pa.array(again, type=pa.string())] * decoded
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *made], names=schema.names)
                lo = hi

    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, proto: bytes) -> DataFrame:
    """The rows of encoded (doc_id, ids), with decoded, the text that the library makes of the ids; null or no ids: ''.

    Other columns are left out.
    """
    schema = T.StructType([encoded.schema["doc_id"], encoded.schema["ids"], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(proto).model
        for batch in batches:
            text = [model.decode(np.frombuffer(x or b"", dtype="<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(text, type=pa.string())], names=schema.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    proto = read_model(public_tokenizers.path(MODEL))
    out = encode(table(spark, sf_dir, "documents"), proto, decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
