"""Word and shingle hashes of Arrow text columns, in numpy over the UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lowered. Its 64-bit hash is the sum of its pieces of
eight bytes, each mixed with a key of its place, and its length, mixed again. Hashes of two seeds together have 128 bits. A buffer is
worked through in slices of half a MB, so memory does not depend on the batch; only a single text can be larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] = _lower[97:123]
#: the low bytes of a piece of 0 to 8 bytes
_low_bytes = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_mixers = np.random.default_rng(20240301).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its row boundaries; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    lo, rows = 0, len(bounds) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, min(hi, rows)
        lo = hi


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the total) for rows ``bounds`` of ``raw``."""
    (hashes,), firsts = seeded_hashes(raw, bounds, (0,))
    return hashes, firsts


def seeded_hashes(raw: np.ndarray, bounds: np.ndarray, seeds: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Like ``word_hashes``, with one array of hashes per seed."""
    at = bounds - bounds[0]
    b = raw[bounds[0] : bounds[-1]]
    n = len(b)
    if not n:
        return [np.zeros(0, np.uint64) for _ in seeds], np.zeros(len(bounds), np.int64)
    solid = ~_space[b]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) - starts + 1
    firsts = np.searchsorted(starts, at)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in seeds], firsts
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _lower[b]
    pieces = (lengths + 7) >> 3
    heads = np.cumsum(pieces) - pieces
    nth = np.arange(heads[-1] + pieces[-1]) - np.repeat(heads, pieces)
    place = np.repeat(starts, pieces) + 8 * nth
    size = np.minimum(np.repeat(lengths, pieces) - 8 * nth, 8)
    values = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1))[place].view(np.uint64).ravel() & _low_bytes[size]
    out = []
    for seed in seeds:
        keys = mix((nth.astype(np.uint64) + np.uint64(1 + (seed << 40))) * _LENGTH)
        out.append(mix(np.add.reduceat(mix(values ^ keys), heads) + lengths.astype(np.uint64) * _LENGTH))
    return out, firsts


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, row boundaries). A row of fewer words is one shingle; one without words has none."""
    counts = np.diff(firsts)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(edges[-1], np.uint64)
    if len(words) >= width:
        m = len(words) - width + 1
        full = np.zeros(m, np.uint64)
        for k in range(width):
            full += words[k : k + m] * _mixers[k]
        row = np.repeat(np.arange(len(counts)), counts)
        keep = row[:m] == row[width - 1 :]
        long_rows = np.repeat(counts >= width, sizes)
        out[long_rows] = mix(full[keep])
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = words[firsts[i] : firsts[i + 1]]
        out[edges[i]] = mix((h * _mixers[: len(h)]).sum(dtype=np.uint64, keepdims=True) + _mixers[40 + len(h)])[0]
    return out, edges


def shingle_rows(column: pa.Array, width: int, seed: int = 0) -> Iterator[np.ndarray]:
    """For each row, its distinct shingle hashes in ascending order."""
    raw, bounds = utf8(column)
    for lo, hi in slices(bounds):
        (words,), firsts = seeded_hashes(raw, bounds[lo : hi + 1], (seed,))
        hashes, edges = shingle_hashes(words, firsts, width)
        for i in range(hi - lo):
            yield np.unique(hashes[edges[i] : edges[i + 1]])


def shingle_pairs(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row, its distinct shingle hashes in ascending order, and the same shingles' hashes of another seed."""
    raw, bounds = utf8(column)
    for lo, hi in slices(bounds):
        words, firsts = seeded_hashes(raw, bounds[lo : hi + 1], (0, 1))
        (hashes, edges), (others, _) = (shingle_hashes(w, firsts, width) for w in words)
        for i in range(hi - lo):
            tokens, at = np.unique(hashes[edges[i] : edges[i + 1]], return_index=True)
            yield tokens, others[edges[i] : edges[i + 1]][at]
