"""Benchmark decontamination with SimHash windows and multi-index Hamming search.

Items are put in classes of similar word counts; a class's window is its smallest item. Every item gets the SimHash
of its first and of its last window, every document the SimHash of each window of each class, from running sums of
the words' bits. A fingerprint within ``RADIUS`` of an item's differs in at most RADIUS // 4 bits in one of its four
16-bit blocks, so tables of all block values that near give every fingerprint within the radius. Rows that share
enough shingles with an item are candidates as well, whatever their fingerprints. Candidates are then compared exactly,
by weighted Jaccard similarity of their word shingles, counts being the weights, over windows of every length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import bounded_batches, sets_apart, settle_table
from .wordhash import _mixers, mix, slices, utf8, word_hashes

RADIUS = 11
CLASS_SPREAD = 1.25
ITEMS_PER_SCAN = 20_000
MATCH = "array<struct<item_id: bigint, similarity: double, first_word: int, n_words: int>>"


def shingles(words: np.ndarray, width: int) -> Counter:
    """Word shingles with counts; a shorter sequence is one shingle."""
    if len(words) < width:
        return Counter({(len(words), *words.tolist()): 1}) if len(words) else Counter()
    return Counter(position_shingles(words, width).tolist())


def position_shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words from each place."""
    m = len(words) - width + 1
    h = np.zeros(m, np.uint64)
    for k in range(width):
        h += words[k : k + m] * _mixers[k]
    return mix(h)


def best_window(places: np.ndarray, kinds: np.ndarray, most: np.ndarray, size: int, threshold: float) -> tuple[float, int, int] | None:
    """(similarity, first place, shingles) of the best of all windows, the earliest and shortest of equal ones.

    ``places`` are where an item's shingles stand, ascending; ``kinds`` tells them apart, ``most`` is how often the item
    has each and ``size`` how many it has. The best window starts and ends at such a place: cutting other ends off
    makes the union smaller only.
    """
    longest = int(size / threshold + 1e-9)
    n = len(places)
    order = np.argsort(kinds, kind="stable")
    at = np.arange(n)
    back = at - most[order]
    same = (back >= 0) & (kinds[order[back]] == kinds[order])
    # a place counts in a window that starts after the place of its kind ``most`` places before
    before = np.empty(n, np.int64)
    before[order] = np.where(same, order[back], -1)
    ends = np.searchsorted(places, places + longest)
    best = None
    for i in np.flatnonzero(ends - at >= threshold * size - 1e-9).tolist():
        e = int(ends[i])
        both = np.cumsum(before[i:e] < i)
        length = places[i:e] - places[i] + 1
        s = both / (size + length - both)
        k = int(np.argmax(s))
        if s[k] >= threshold and (best is None or s[k] > best[0]):
            best = (float(s[k]), int(places[i]), int(length[k]))
            if best[0] == 1.0:
                break
    return best


def running_bits(words: np.ndarray, wide: bool) -> np.ndarray:
    """Running sums of +-1 for the 64 bits of each word, from zero; differences within a window do not overflow."""
    kind = np.int16 if wide else np.int8
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(words) + 1, 64), kind)
    np.cumsum((bits << 1).view(np.int8) - np.int8(1), axis=0, dtype=kind, out=out[1:])
    return out


def window_prints(sums: np.ndarray, window: int) -> np.ndarray:
    """SimHash of every window."""
    return np.packbits((sums[window:] - sums[:-window]) > 0, axis=1).view(np.uint64).ravel()


@dataclass
class ItemClass:
    """Fingerprints of the items of similar size, and the block tables that find them."""

    window: int
    prints: np.ndarray
    item: np.ndarray  # index into the items
    tail: np.ndarray  # True for a last window
    starts: list[np.ndarray]
    members: list[np.ndarray]
    any_hit: list[np.ndarray]

    @classmethod
    def build(cls, window: int, items: list[tuple[int, np.ndarray]], radius: int) -> ItemClass:
        prints, item, tail = [], [], []
        for i, words in items:
            p = window_prints(running_bits(words, window > 120), window)
            for k, is_tail in {0: False, len(p) - 1: len(p) > 1}.items():
                prints.append(p[k])
                item.append(i)
                tail.append(is_tail)
        blocks = np.array(prints, np.uint64).view(np.uint16).reshape(-1, 4)
        near = [0, *(sum(1 << b for b in c) for n in range(1, radius // 4 + 1) for c in combinations(range(16), n))]
        starts, members, hit = [], [], []
        for k in range(4):
            values = (blocks[:, k][:, None] ^ np.array(near, np.uint16)).ravel()
            who = np.repeat(np.arange(len(blocks)), len(near))
            order = np.argsort(values, kind="stable")
            members.append(who[order])
            starts.append(np.searchsorted(values[order], np.arange(65537)))
            hit.append(np.diff(starts[-1]).astype(np.int32))
        return cls(window, np.array(prints, np.uint64), np.array(item), np.array(tail, bool), starts, members, hit)

    def candidates(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, fingerprint) index pairs within the radius."""
        blocks = prints.view(np.uint16).reshape(-1, 4)
        found: list[np.ndarray] = []
        for k in range(4):
            value = blocks[:, k]
            n = self.any_hit[k][value]
            at = np.flatnonzero(n)
            if not len(at):
                continue
            n, first = n[at], self.starts[k][value[at]]
            ends = np.cumsum(n)
            who = self.members[k][np.arange(ends[-1]) + np.repeat(first - ends + n, n)]
            window = np.repeat(at, n)
            close = np.bitwise_count(prints[window] ^ self.prints[who]) <= radius
            if close.any():
                found.append(window[close] * len(self.prints) + who[close])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // len(self.prints), pairs % len(self.prints)


class Benchmark:
    """The items of one scan, by class."""

    def __init__(self, items: list[tuple[int, str]], width: int, radius: int):
        self.width, self.radius, self.ids, self.words, self.shingles = width, radius, [], [], []
        for item_id, text in items:
            words, _ = word_hashes(*utf8(pa.array([text])))
            if len(words):
                self.ids.append(item_id)
                self.words.append(words)
                self.shingles.append(shingles(words, width))
        # (shingle, item, times) in order of shingles; a shingle of any item sets its place in ``known``
        held = sorted((x, i, n) for i, s in enumerate(self.shingles) for x, n in s.items() if isinstance(x, int))
        self.held = np.array([x for x, _, _ in held], np.uint64)
        self.held_item = np.array([i for _, i, _ in held], np.int64)
        self.held_times = np.array([n for _, _, n in held], np.int64)
        self.known = np.zeros(1 << 20, bool)
        self.known[self.held & np.uint64((1 << 20) - 1)] = True
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        order = sorted(range(len(self.ids)), key=lambda i: len(self.words[i]))
        self.classes: list[ItemClass] = []
        while order:
            window = len(self.words[order[0]])
            most = window * CLASS_SPREAD if window >= width else window
            group = [i for i in order if len(self.words[i]) <= most]
            self.classes.append(ItemClass.build(window, [(i, self.words[i]) for i in group], radius))
            order = order[len(group) :]

    def shared(self, words: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, entry of ``held``) of every shingle that a row shares with an item."""
        if len(words) < self.width or not len(self.held):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = position_shingles(words, self.width)
        at = np.flatnonzero(self.known[h & np.uint64((1 << 20) - 1)])
        at = at[row_of[at] == row_of[at + self.width - 1]]
        first = np.searchsorted(self.held, h[at])
        n = np.searchsorted(self.held, h[at], "right") - first
        ends = np.cumsum(n)
        return np.repeat(at, n), np.arange(n.sum()) + np.repeat(first - ends + n, n)

    def matches(self, words: np.ndarray, firsts: np.ndarray, threshold: float) -> list[list[dict]]:
        """For each row, the best window per item, of all windows a similarity of ``threshold`` allows.

        Fingerprints propose rows for items, and so do shared shingles where there are enough for the threshold: these
        also find passages whose fingerprints are beyond the radius, and rows shorter than the class's window.
        """
        rows, items = len(firsts) - 1, max(1, len(self.ids))
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(rows)]
        row_of = np.repeat(np.arange(rows), np.diff(firsts))
        sums = {wide: running_bits(words, wide) for wide in {c.window > 120 for c in self.classes if c.window <= len(words)}}
        proposed: list[np.ndarray] = []
        for c in self.classes:
            if len(words) < c.window:
                continue
            where, which = c.candidates(window_prints(sums[c.window > 120], c.window), self.radius)
            inside = row_of[where] == row_of[where + c.window - 1]
            where, item = where[inside], c.item[which[inside]]
            if c.window >= self.width:
                proposed.append(row_of[where] * items + item)
                continue
            # fewer words than a shingle: the class's items are as long as its window and match whole
            for p, i in zip(where.tolist(), item.tolist()):
                row = int(row_of[p])
                if i not in best[row] and np.array_equal(words[p : p + c.window], self.words[i]):
                    best[row][i] = (1.0, p, c.window)
        place, entry = self.shared(words, row_of)
        pair = row_of[place] * items + self.held_item[entry]
        order = np.argsort(pair, kind="stable")
        pair, place, entry = pair[order], place[order], entry[order]
        pairs, start = np.unique(pair, return_index=True)
        end = np.append(start[1:], len(pair))
        enough = end - start >= threshold * (self.sizes[pairs % items] - self.width + 1) - 1e-9 if len(pairs) else np.zeros(0, bool)
        if proposed:
            enough |= np.isin(pairs, np.concatenate(proposed))
        for k in np.flatnonzero(enough).tolist():
            row, i, a, b = int(pairs[k]) // items, int(pairs[k]) % items, int(start[k]), int(end[k])
            found = best_window(place[a:b], entry[a:b], self.held_times[entry[a:b]], int(self.sizes[i]) - self.width + 1, threshold)
            if found:
                best[row][i] = (found[0], found[1], found[2] + self.width - 1)
        return [[{"item_id": self.ids[i], "similarity": s, "first_word": p - int(firsts[row]), "n_words": n} for i, (s, p, n) in sorted(b.items())] for row, b in enumerate(best)]


@sets_apart("__text", "found")
def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """``docs`` with ``matches``: the benchmark items a document contains, each with its best window.

    Null and empty texts match nothing; items without words are left out; equal items all match. Rows are judged one
    by one, so repeated rows repeat; an empty table of either kind gives no matches; a column named ``matches`` is replaced. Texts are read in
    slices, a single longer text whole, with about 100 bytes of memory per byte. Items are read in blocks of ``ITEMS_PER_SCAN``, one scan of the
    documents each, whose result is written before the next, so what executors hold of the items is bounded.
    """
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    blocks = max(1, -(-items.count() // ITEMS_PER_SCAN))
    kept = docs.drop(*[c for c in ("matches", "__text") if c != text])
    out = kept.withColumn("matches", F.array().cast(MATCH))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        shared = docs.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in part])
        out = _scan(out, shared, text, width, threshold, radius)
        if block + 1 < blocks:  # one block in memory at a time
            out = settle_table(out)
    return out


def _scan(docs: DataFrame, shared, text: str, width: int, threshold: float, radius: int) -> DataFrame:
    rest = [c for c in docs.columns if c != "matches"]
    all_columns = [*rest, "matches"]
    kept = docs.select(*all_columns)
    schema = T.StructType([*kept.schema.fields, T.StructField("found", kept.schema["matches"].dataType)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(shared.value, width, radius)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int32()), ("n_words", pa.int32())]))
        for batch in batches:
            raw, bounds = utf8(batch.column(batch.schema.get_field_index("__text")))
            found: list[list[dict]] = []
            for lo, hi in slices(bounds, 1 << 19):
                found += bench.matches(*word_hashes(raw, bounds[lo : hi + 1]), threshold)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in all_columns), pa.array(found, kind)], names=[*all_columns, "found"])

    scanned = kept.withColumn("__text", F.col(text)).mapInArrow(scan, schema)
    return scanned.select(*rest, F.array_sort(F.concat("matches", "found")).alias("matches"))
