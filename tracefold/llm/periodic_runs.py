"""Periodic runs of words, found with string synchronising sets.

A run is a stretch with smallest period q, at least ``least`` words and two periods long, that no neighbouring word extends.
For every power of two t, positions are selected by hash: i is selected if, of the windows of t words that start in [i, i + t], the one
of least hash starts at i or at i + t. Whether i is selected depends on its 2 t words alone, so a run repeats its selected positions at the distance of
its period: two of them with equal 2 t words propose that distance, from 3 t - 1 to 6 t - 2 at this scale. Windows of a period up to t / 3 are never
selected (they would be everywhere); stretches made of such windows only are known from the scales below, and two that touch propose the distances at
which their periods are in step. Periods up to ``SMALL`` are read off directly. Proposed pairs are extended both ways with
hashes of dyadic windows, and what they give is compared word by word.

Documents are independent: nothing is shuffled. A task works on the documents of an Arrow batch together, in chunks of about ``CHUNK_WORDS`` words (a longer
document is a chunk of its own), set apart by numbers that occur once; it needs 8 bytes per word and power of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import bounded_batches

SMALL = 10
LEAST = 12
CHUNK_WORDS = 1 << 17
_NEVER = np.uint64(2**64 - 1)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number of 64 bits for each ordered pair."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x += b
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return x


def _stretches(ids: np.ndarray, period: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of a period that have at least ``least`` items."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], ids[period:] == ids[:-period], [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2] + period
    long = ends - starts >= least
    return starts[long], ends[long]


class _Text:
    """A sequence of numbers with hashes of its windows of 2 ** k items."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.levels = [_mixed(ids.astype(np.uint64), np.full(len(ids), 7, np.uint64))]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            h, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_mixed(h[:-half], h[half:]) if len(h) > half else h[:0])
        return self.levels[k]

    def _agree(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """Items that agree from a and b on, or before them."""
        off = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            h, width = self.levels[k], 1 << k
            x, y = (a + off, b + off) if forward else (a - off - width, b - off - width)
            ok = (y < len(h)) & (x >= 0)
            ok[ok] = h[x[ok]] == h[y[ok]]
            off[ok] += width
        return off

    def extended(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal stretches (start, end, period) around pairs of places ``period`` apart."""
        to = at + period
        return at - self._agree(at, to, False), to + self._agree(at, to, True), period


def _in_step(text: _Text, start: np.ndarray, end: np.ndarray, period: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances, from ``least`` to ``most``, at which stretches of one period are in step where they touch the next one of that period."""
    order = np.lexsort((start, period))
    s, e, p = start[order], end[order], period[order]
    at, by = [start[:0]], [start[:0]]
    for i in np.flatnonzero((p[1:] == p[:-1]) & (s[1:] <= e[:-1])).tolist():
        s1, e1, s2, e2, d = int(s[i]), int(e[i]), int(s[i + 1]), int(e[i + 1]), int(p[i])
        first = text.ids[s1 : s1 + d]
        shift = next((k for k in range(d) if text.ids[s2 + k] == first[0] and np.array_equal(text.ids[s2 + k : s2 + k + d], first)), None)
        if shift is not None:
            q = np.arange(least + (s2 + shift - s1 - least) % d, most + 1, d)
            x = np.maximum(s1, s2 - q)
            ok = (x < e1) & (x + q < e2)
            at.append(x[ok])
            by.append(q[ok])
    return np.concatenate(at), np.concatenate(by)


def runs_of(ids: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of a sequence, by start and period; no run is longer than ``longest``."""
    if len(ids) < 2:
        return np.zeros((0, 3), np.int64)
    text = _Text(ids)
    found: list[np.ndarray] = []
    for p in range(1, SMALL + 1):
        if p < len(ids):
            # stretches of periods 1 and 2 are asked for at scales 4 and 8 too
            s, e = _stretches(ids, p, {1: 4, 2: 8}.get(p, 2 * p))
            found.append(np.stack([s, e, np.full(len(s), p)], 1).astype(np.int64))
    k = 2
    while 2 * (3 * (1 << k) - 1) <= longest:
        t = 1 << k
        windows, contexts = text.level(k), text.level(k + 1)
        known = np.concatenate(found)
        dense = known[(known[:, 2] <= t // 3) & (known[:, 1] - known[:, 0] >= t)]
        order = windows.copy()
        if len(dense):  # windows within a stretch of a small period
            ends = np.zeros(len(order) + 1, np.int64)
            np.add.at(ends, dense[:, 0], 1)
            np.add.at(ends, dense[:, 1] - t + 1, -1)
            order[np.cumsum(ends[:-1]) > 0] = _NEVER
        low = order
        for j in range(k):
            low = np.minimum(low[: -(1 << j)], low[1 << j :])
        low = np.minimum(low[:-1], order[t:])
        chosen = np.flatnonzero(((order[:-t] == low) | (order[t:] == low)) & (low != _NEVER))
        content = contexts[chosen]
        at, by, lag = [], [], 1
        while lag < len(chosen):
            apart = chosen[lag:] - chosen[:-lag]
            if apart.min() > 6 * t - 2:
                break
            pair = np.flatnonzero((content[lag:] == content[:-lag]) & (apart >= 3 * t - 1) & (apart <= 6 * t - 2))
            at.append(chosen[pair])
            by.append(apart[pair])
            lag += 1
        whole = dense[dense[:, 1] - dense[:, 0] >= 3 * t - 1]
        x, q = _in_step(text, *whole.T, 3 * t - 1, 6 * t - 2)
        at.append(x)
        by.append(q)
        places, periods = np.concatenate(at), np.concatenate(by)
        if len(places):
            text.level(max(1, longest.bit_length() - 1))
            s, e, p = text.extended(places, periods)
            new = np.stack([s, e, p], 1)
            found.append(np.unique(new[new[:, 1] - new[:, 0] >= 2 * new[:, 2]], axis=0))
        k += 1
    out = np.concatenate(found)
    out = out[out[:, 1] - out[:, 0] >= np.maximum(least, 2 * out[:, 2])]
    # of equal stretches the one of the smallest period
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    first = np.ones(len(out), bool)
    first[1:] = (out[1:, :2] != out[:-1, :2]).any(1)
    out = out[first]
    exact = [p <= SMALL or np.array_equal(ids[s : e - p], ids[s + p : e]) for s, e, p in out.tolist()]
    out = out[np.array(exact, bool)]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


class _Numbers(dict):
    """Words get numbers in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _chunk_runs(texts: list[list[bytes]], least: int) -> list[np.ndarray]:
    """Runs of each text."""
    numbers = _Numbers()
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))  # a number of its own ends each text
    ids = np.empty(starts[-1], np.int64)
    for t, at, n in zip(texts, starts.tolist(), lengths.tolist()):
        ids[at : at + n] = np.fromiter(map(numbers.__getitem__, t), np.int64, n)
    ids[starts[1:] - 1] = len(numbers) + np.arange(len(texts))
    found = runs_of(ids, int(lengths.max(initial=0)), least)
    cuts = np.searchsorted(found[:, 0], starts)
    return [found[a:b] - [[at, at, 0]] for a, b, at in zip(cuts[:-1].tolist(), cuts[1:].tolist(), starts.tolist())]


def _collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run contains after its first period, one space apart."""
    if not len(found):
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, found[:, 0] + found[:, 2], 1)
    np.add.at(gone, found[:, 1], -1)
    return b" ".join([w for w, g in zip(words, np.cumsum(gone).tolist()) if not g])


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; words counted from 0, by start and period) and ``collapsed``, the text without what
    its runs repeat.

    Words are runs of characters other than space and U+0009 to U+000D. A null or blank text has no words, no run and an empty ``collapsed``. Each
    row stands for itself: repeated rows and null or shared ids change nothing, an empty table gives an empty one, and whole texts are read
    however long. Of runs of one stretch only the smallest period counts; runs that overlap are all reported. Columns of ``docs`` stay as they
    are, but for those named like the new ones, which the new ones replace.
    """
    new = ["n_words", "runs", "collapsed"]
    kept = [c for c in docs.columns if c not in new]
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{text}`").cast("binary").alias("body"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType(list(inner.schema.fields[:-1])).add("n_words", "long").add("runs", T.ArrayType(run)).add("collapsed", "binary")
    row = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(batch: pa.RecordBatch, lo: int, texts: list[list[bytes]]) -> pa.RecordBatch:
        per_text = _chunk_runs(texts, least)
        flat = np.concatenate(per_text)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])], fields=list(row))
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in per_text]))).astype(np.int32)
        columns = [c.slice(lo, len(texts)) for c in batch.columns[:-1]]
        columns += [pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array([_collapsed(t, r) for t, r in zip(texts, per_text)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(kept))] + new)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = n = 0
            texts: list[list[bytes]] = []
            for body in batch.column(len(kept)):
                texts.append((body.as_py() or b"").split())  # bytes are split at the same six characters
                n += len(texts[-1])
                if n >= CHUNK_WORDS:
                    yield found(batch, lo, texts)
                    lo, n, texts = lo + len(texts), 0, []
            if texts:
                yield found(batch, lo, texts)

    bounded_batches(docs.sparkSession)
    out = inner.mapInArrow(tasks, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
