"""Vectorised text kernels over Arrow string arrays.

All functions work on the UTF-8 bytes of a whole batch at once (one numpy buffer with offsets), so no Python loop
runs over words. Memory is bounded by PIECE bytes per step besides the batch itself, whatever a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled in one vectorised step.
PIECE = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    size = len(_POWERS.get("up", ()))
    if size < n:
        size = max(n, PIECE + 4096)
        for name, base in (("up", _BASE), ("down", _inverse(_BASE))):
            steps = np.full(size, base & (2**64 - 1), dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is the empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offs, data = array.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(array) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(lengths: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths sum to limit at most; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths)


def pieces(batches, column: str, limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of each batch, cut so that one step holds limit bytes of text or a single text."""
    for batch in batches:
        array = batch.column(batch.schema.get_field_index(column))
        raw, offsets = utf8(array)
        for a, b in slices(np.diff(offsets), limit):
            yield batch.slice(a, b - a), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words, and the first word of each text with the total at the end."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    black = np.empty(n + 1, dtype=bool)
    np.logical_not(_SPACE[raw], out=black[:n])
    black[n] = False
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = black.copy()
    starts[1:] &= ~black[:-1] | edge[1:]
    starts = np.flatnonzero(starts)
    last = black[:n] & (~black[1:] | edge[1:])
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from prefix sums of a polynomial modulo 2**64."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _powers(b - a + 1)
        sums = np.empty(b - a + 1, dtype=np.uint64)
        sums[0] = 0
        part = raw[a:b].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: b - a]
        np.cumsum(part, out=sums[1:])
        s = starts[i:j] - a
        out[i:j] = (sums[ends[i:j] - a] - sums[s]) * down[s]
        i = j
    return mix(out)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words with A-Z lower-cased, first word of each text and the total)."""
    starts, ends, first = words(raw, offsets)
    return range_hashes(lower_ascii(raw), starts, ends), first


_STEP = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; the whole sequence if it has fewer words."""
    h, first = word_hashes(raw, offsets)
    n = len(h)
    steps = [_STEP[k % 5] * np.uint64(2 * (k // 5) + 1) for k in range(width)]
    full = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        full += h[k : k + len(full)] * steps[k]
    full = mix(full)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(full[a : b - width + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for k in range(b - a):
                whole = (whole * np.uint64(31)) ^ (h[a + k : a + k + 1] * steps[k])
            yield mix(whole)
        else:
            yield np.zeros(0, dtype=np.uint64)
