"""Content-defined segments: which windows of a text can have an equal elsewhere.

A window is W consecutive elements (bytes or words).  Its anchor is the k-gram in it with the least hash, the leftmost of
ties.  Equal windows have equal anchors, so only windows whose anchor's hash occurs again need to be compared.
Consecutive windows with one anchor form a segment: each window of a document lies in exactly one segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Elements handled at once; the place within such a block must fit PLACE bits.
BLOCK, PLACE = 1 << 19, 21

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A 64-bit value for each byte.
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers of three polynomial hashes modulo 2**64: of words, of k-grams, of whole segments.
MULTIPLIERS = {name: int(m) | 1 for name, m in zip(("word", "gram", "segment"), _RNG.integers(1 << 62, 1 << 63, 3, dtype=np.uint64), strict=True)}
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a multiplier and of its inverse."""
    have = _powers.get(name)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 4096)
        m = MULTIPLIERS[name]
        pair = []
        for x in (m, pow(m, -1, 1 << 64)):
            p = np.full(size, x, dtype=np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = _powers[name] = (pair[0], pair[1])
    return have


def prefix_sums(values: np.ndarray, name: str) -> np.ndarray:
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * powers(name, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def ranges_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, name: str) -> np.ndarray:
    """A mixed hash of the elements [start, end) for each pair."""
    h = (sums[end] - sums[start]) * powers(name, len(sums))[1][start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def segments(values: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, start, windows, anchor, content) of each segment; values: hashed elements of documents cut at bounds."""
    n = len(values)
    none = np.empty(0, dtype=np.int64)
    if n < width:
        return none, none, none, none, none
    sums = prefix_sums(values, "gram")
    hashes = mix((sums[gram:] - sums[:-gram]) * powers("gram", n + 1)[1][: n - gram + 1])
    low = np.uint64((1 << PLACE) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span, have = width - gram + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    anchor = (least & low).astype(np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: n - width + 1]
    place = np.arange(n - width + 1)
    inside = np.flatnonzero(place + width <= bounds[owner + 1])
    if not len(inside):
        return none, none, none, none, none
    at = anchor[inside]
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1))))
    start = inside[cut]
    windows = np.diff(np.append(cut, len(inside)))
    whole = prefix_sums(values, "segment")
    content = ranges_hash(whole, start, start + windows + width - 1, "segment")
    return owner[start], start, windows, hashes[at[cut]].view(np.int64), content.view(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each row begins and the last one ends."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word; the bytes of documents are cut at bounds."""
    inside = ~IS_SPACE[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    first = bounds[:-1][bounds[:-1] < len(raw)]
    before[first] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[first[first > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(bounds, start, side="right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word; blocks keep the powers of the polynomial few."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
        base = start[i]
        sums = prefix_sums(BYTE[raw[base : end[j - 1]]], "word")
        out[i:j] = ranges_hash(sums, start[i:j] - base, end[i:j] - base, "word")
        i = j
    return out


def blocks(bounds: np.ndarray, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(first document, document after the last, first element, element after the last): about BLOCK elements at once.

    A longer document comes in pieces which overlap by a window less one element, so each window is in one piece.
    """
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, side="right")) - 1)
        if j == i + 1 and bounds[j] - bounds[i] > BLOCK:
            for a in range(int(bounds[i]), int(bounds[j]) - width + 1, BLOCK):
                yield i, j, a, min(int(bounds[j]), a + BLOCK + width - 1)
        else:
            yield i, j, int(bounds[i]), int(bounds[j])
        i = j
