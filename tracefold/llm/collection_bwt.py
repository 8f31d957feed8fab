"""Burrows-Wheeler transform and common prefixes of a bounded collection of byte strings, built column by column.

The rows are all suffixes of all strings in order; ends of strings are distinct and come first. Each round inserts one
symbol of every string, from the right: the row of a string's new suffix follows from the row of its last one by the
last-to-first step, and only the common prefixes of new rows and of those below them change. A round reads and writes
transform and prefixes once, in order, as two streams.
"""

from __future__ import annotations

import numpy as np


def _least(lcp: np.ndarray, above: np.ndarray, here: np.ndarray) -> np.ndarray:
    """min(lcp[above + 1 .. here]) for each pair of rows."""
    least = lcp[here]
    far = np.flatnonzero(here > above + 1)
    if len(far):
        by = far[np.argsort(-above[far], kind="stable")]  # from below upwards, so that the gaps between ranges cost nothing
        flat = np.empty(2 * len(by), np.int64)
        flat[::2], flat[1::2] = above[by] + 1, here[by] + 1
        least[by] = np.minimum.reduceat(np.append(lcp, lcp[:1]), flat)[::2]
    return least


def build(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bwt, lcp) of ``items``. bwt: 0 where a string begins, else the byte before plus one (UTF-8 has no byte 255);
    lcp: common prefix with the row above. An empty list gives two empty arrays."""
    m = len(items)
    sizes = np.array([len(x) for x in items], np.int64)
    columns = int(sizes.max(initial=0))
    if columns >= 1 << 24:
        raise ValueError("a string of a collection has to be shorter than 16 MB")
    text = np.zeros((m, columns + 1), np.uint8)
    for row, x in zip(text, items):
        row[: len(x)] = np.frombuffer(x, np.uint8)[::-1] + np.uint8(1)
    text = np.ascontiguousarray(text.T)  # text[k]: symbol k from the right, 0 before the first
    rowed = text[0].astype(np.uint32) << np.uint32(24)  # symbol and, below it, common prefix of each row (strings end before 16 MB)
    at = np.arange(m)  # the row of each string's last suffix
    place = max(24, int(sizes.sum() + m).bit_length())
    key = np.uint32 if place == 24 else np.uint64  # a symbol above a row: sorted, the rows of a symbol stand together in order
    rows = np.arange(int(sizes.sum()) + m, dtype=key)
    room = np.empty(len(rows), key)
    for column in range(1, columns + 1):
        live = np.flatnonzero(sizes >= column)
        asked = (text[column - 1][live].astype(key) << key(place)) | at[live].astype(key)
        by = np.argsort(asked)
        live, asked = live[by], asked[by]
        order = room[: len(rowed)]
        np.bitwise_and(rowed, np.uint32(0xFF000000), out=order)
        if place > 24:
            order <<= key(place - 24)
        order |= rows[: len(rowed)]
        order.sort()
        order = order[m - len(live) :]  # without those where a string begins
        new = np.searchsorted(order, asked)  # places of the new suffixes among those that are not empty
        changed = np.repeat(new, 2)
        changed[1::2] += 1
        fits = (changed > 0) & (changed < len(order))
        fits[1:] &= changed[1:] != changed[:-1]
        changed = changed[fits]
        above, here = ((order[x] & key((1 << place) - 1)).astype(np.int64) for x in (changed - 1, changed))
        same = order[changed - 1] >> key(place) == order[changed] >> key(place)
        prefix = np.zeros(len(changed), np.uint32)
        prefix[same] = _least(rowed & np.uint32(0xFFFFFF), above[same], here[same]) + np.uint32(1)
        at[live] = m + new
        old = np.ones(m + len(order), bool)
        old[m + new] = False
        both = np.zeros(len(old), np.uint32)
        both[old] = rowed
        both[m + new] = text[column][live].astype(np.uint32) << np.uint32(24)
        both[m + changed] = (both[m + changed] & ~np.uint32(0xFFFFFF)) | prefix
        rowed = both
    return (rowed >> np.uint32(24)).astype(np.uint8), (rowed & np.uint32(0xFFFFFF)).astype(np.uint16 if columns < 1 << 16 else np.uint32)


def repeated(bwt: np.ndarray, lcp: np.ndarray, sizes: list[int], length: int) -> list[np.ndarray]:
    """For each string, which of its ``length``-byte windows also start elsewhere in the collection: rows of an interval
    of prefixes of ``length`` or more, given back to their strings by last-to-first steps from the ends of strings."""
    m = len(sizes)
    hit = lcp >= length
    hit[:-1] |= hit[1:]
    size = np.array(sizes, np.int64)
    order = np.argsort(bwt, kind="stable")[len(bwt) - np.count_nonzero(bwt) :]
    step = np.zeros(len(bwt), np.int64)
    step[order] = m + np.arange(len(order))
    columns = int(size.max(initial=0))
    marks = np.zeros((columns + 1, m), bool)
    at = np.arange(m)
    for column in range(1, columns + 1):
        live = np.flatnonzero(size >= column)
        at[live] = step[at[live]]
        marks[column, live] = hit[at[live]]
    return [marks[length : n + 1, i][::-1] if n >= length else np.zeros(0, bool) for i, n in enumerate(sizes)]
