"""Byte-level BPE by ranks: texts to ids and back.

A text is split by a pattern; each match (a word) is encoded apart. The merges of distinct words are folded in Spark: the state has a number for each part of
the word, and each step joins the first pair of least rank and looks up the two pairs next to it. The ranks are a literal: an array of small maps,
found by checksum. A word is kept as text of one character (U+0000 to U+00FF) for each byte.

The words that most documents contain, counted over all documents, are folded once each and sent to all tasks: at most ``WORDS`` words of ``WORD_BYTES`` bytes.
A word outside this dictionary is merged where it is met, by the same ranks, in the task that splits the text: it is rare, and so neither texts nor the places of words are
shuffled. Decoding joins the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import heapq
import json
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import bounded_batches, kept_by, settle_table
from .tokens import Encoder

WORDS, WORD_BYTES = 1 << 19, 64
#: Distinct words that a task counts before it hands them on; words up to this length are merged by looking through all pairs.
HELD_WORDS, SHORT = 200_000, 100
_BUCKETS = 1 << 16
#: Bits of a place in a word; its last value stands for no place. A rank that no pair has.
_BITS = 15
_ENDS, _NONE = (1 << _BITS) - 1, (1 << 32) - 1
#: Bits of the number of ids of a word of the dictionary: at most WORD_BYTES.
_COUNT_BITS = 7


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _rank_literal(ranks: dict[bytes, int]) -> Column:
    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        buckets[zlib.crc32(key.encode()) % _BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,bigint>>")


def _rank(literal: Column, part: Column) -> Column:
    return F.coalesce(F.get(literal, F.crc32(part.cast("binary")).bitwiseAND(F.lit(_BUCKETS - 1).cast("long")).cast("int"))[part], F.lit(_NONE).cast("long"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _fold(word: Column, literal: Column) -> Column:
    """Ids of a word, given as text of one character for each byte.

    The state has a number for each part, in order: the rank of the part joined with the next one, where the part starts, and where the next one ends. The
    least number names the next merge. Its second part's number then stands for both, and the part before gets a new rank.
    """
    n = F.length(word)
    starts = lambda x: F.shiftright(x, _BITS).bitwiseAND(_ENDS)
    ends = lambda x: x.bitwiseAND(_ENDS)

    def pair(start: Column, end: Column) -> Column:
        rank = F.when(end == _ENDS, F.lit(_NONE)).otherwise(_rank(literal, F.substring(word, start + 1, end - start)))
        return F.shiftleft(rank, 2 * _BITS).bitwiseOR(F.shiftleft(start, _BITS)).bitwiseOR(end)

    def merged(state: Column, least: Column) -> Column:
        def around(start: Column, end: Column, rest: Column) -> Column:
            second = lambda x: (starts(x) > start) & (starts(x) < end)
            before = lambda x: (ends(x) > start) & (ends(x) < end)
            return F.transform(rest, lambda x: F.when(before(x), pair(starts(x), end)).when(second(x), pair(start, ends(x))).otherwise(x))

        return around(starts(least), ends(least), F.array_remove(state, least))

    def step(state: Column, _: Column) -> Column:
        return _let(F.array_min(state), lambda least: F.when(least >= _NONE << 2 * _BITS, state).otherwise(merged(state, least)))

    def ids(state: Column) -> Column:
        return F.transform(state, lambda x, i: _rank(literal, F.substring(word, (starts(x) + 1).cast("int"), (F.coalesce(starts(F.get(state, i + 1)), n) - starts(x)).cast("int"))).cast("int"))

    at = F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))
    begin = F.transform(at, lambda i: pair(i, F.when(i == n - 1, F.lit(_ENDS)).otherwise(i + 2)))
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(_let(F.aggregate(at, begin, step), ids))


def _merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the first pair of least rank is joined until no pair has one."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SHORT:
        return _merged_long(word, ranks)
    rank = ranks.get
    starts = list(range(len(word) + 1))
    found = [rank(word[i : i + 2], _NONE) for i in starts[:-2]]
    while found and (least := min(found)) < _NONE:
        i = found.index(least)
        del found[i], starts[i + 1]
        if i:
            found[i - 1] = rank(word[starts[i - 1] : starts[i + 1]], _NONE)
        if i < len(found):
            found[i] = rank(word[starts[i] : starts[i + 2]], _NONE)
    return [ranks[word[i:j]] for i, j in zip(starts, starts[1:])]


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, for words of any length."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # part i is word[i : after[i]]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1" * n)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue
        alive[j], after[i] = 0, end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : end])) is not None:
            heapq.heappush(heap, (r, before[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class RankEncoder(Encoder):
    """Ids of texts by a dictionary of folded words; other words are merged. ``folded``: (word, ids), kept as one array and each word's place in it."""

    LIMIT = 400_000

    def __init__(self, ranks: dict[bytes, int], pattern: str, folded: pa.Table):
        self.ranks, self.split, self.added = ranks, regex.compile(pattern).findall, []
        words, ids = (folded.column(c).combine_chunks() for c in ("word", "ids"))
        bounds = ids.offsets.to_numpy().astype(np.int64)
        self.words = dict(zip(words.to_numpy(zero_copy_only=False).tolist(), (bounds[:-1] - bounds[:1] << _COUNT_BITS | np.diff(bounds)).tolist()))
        self.folded = array("I", ids.flatten().to_numpy().astype(np.uint32).tobytes())
        self._reset()

    def _word(self, word: str) -> Sequence[int]:
        place = self.words.get(word)
        if place is None:
            return _merged(word.encode(), self.ranks)
        start = place >> _COUNT_BITS
        return self.folded[start : start + (place & (1 << _COUNT_BITS) - 1)]

    def _ids(self, text: str) -> list[int]:
        return [i for w in self.split(text) for i in self._word(w)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._ids(text), np.uint32)

    def _learn(self, keys: list[str]) -> None:
        flat, cuts = array("I"), []
        for k in keys:
            part = k[1:] if k[:1] == " " else " " + k
            flat.extend(self._word(part) if part in self.words or k.isascii() and k.isalpha() else self._ids(part))
            cuts.append(len(flat))
        self._add(np.array(flat, np.uint32), np.array(cuts, np.int64))


def _coder(name: str, ranks: dict[bytes, int], pattern: str, folded: pa.Table) -> RankEncoder:
    """One coder per worker process and dictionary, which later tasks find with what it has learned."""
    held = kept_by("bpe")
    if name not in held:
        held.clear()
        held[name] = RankEncoder(ranks, pattern, folded)
    return held[name]


def word_counts(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(word, n): the documents that contain each word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        known: dict[str, list[str]] = {}
        # words of letters are counted without the space before them
        held, plain = Counter[str](), Counter[str]()

        def table() -> pa.RecordBatch:
            words = [*held, *(" " + w for w in plain)]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([*held.values(), *plain.values()], pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                body = t.as_py() or ""
                # the pattern splits a text at each single space, before it; a text with two in a row is taken whole
                first, *rest = [body] if "  " in body else body.split(" ")
                words, letters = set(split(first)), set()
                for part in set(rest):
                    if part.isascii() and part.isalpha():
                        letters.add(part)
                        continue
                    found = known.get(part)
                    if found is None:
                        found = split(" " + part)
                        if len(known) < HELD_WORDS and len(part) <= WORD_BYTES:
                            known[part] = found
                    words.update(found)
                spaced = {w for w in words if w[:1] == " " and w[1:] in letters}
                held.update(words - spaced)
                plain.update(letters)
            if len(held) + len(plain) > HELD_WORDS:
                yield table()
                held.clear()
                plain.clear()
        yield table()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fold_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """``words`` with ``ids``, by the fold; words of up to 32,766 bytes."""
    bytes_as_text = F.decode(F.col(word).cast("binary"), "ISO-8859-1")
    return words.withColumn("ids", _let(_rank_literal(ranks), lambda literal: _let(bytes_as_text, lambda w: F.when(_rank(literal, w) < _NONE, F.array(_rank(literal, w).cast("int"))).otherwise(_fold(w, literal)))))


def dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", words: int = WORDS) -> DataFrame:
    """(word, ids) of at most ``words`` words: those that more documents contain than any other."""
    counts = settle_table(word_counts(docs, pattern, text).where((F.octet_length("word") <= WORD_BYTES)))
    # how many words have each count: fewer rows than the square root of twice the sum of all counts
    least, total = None, 0
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
        total += r["words"]
        if total > words:
            break
        least = r["n"]
    common = counts.where(F.col("n") >= least) if least is not None else counts.limit(0)
    return settle_table(fold_words(common.select("word").repartition("word"), ranks))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with ``ids`` (array<int>): the ids that the tiktoken library gives for the ranks and pattern without special tokens.

    A null or empty text has no ids. Each row stands for itself, so null, shared and repeated ids and rows change nothing; an empty table gives an empty one. Whole
    texts are encoded, however long, also those that are one word. Columns stay as they are, but for one named ``ids``, which is replaced.
    """
    folded = dictionary(docs, ranks, pattern, text, words).toArrow()  # at most ``words`` rows
    name = uuid.uuid4().hex
    kept = [c for c in docs.columns if c != "ids"]
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{text}`").cast("string").alias("body"))
    schema = T.StructType(list(inner.schema.fields[:-1])).add("ids", T.ArrayType(T.IntegerType()))
    names = [f"c{i}" for i in range(len(kept))] + ["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, ranks, pattern, folded)
        for batch in batches:
            coded = coder.rows(batch.column(len(kept)))
            for lo in range(0, batch.num_rows, 256):
                part, ids = batch.slice(lo, 256), coded[lo : lo + 256]
                ends = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), flat)], names=names)

    bounded_batches(docs.sparkSession)
    out = inner.mapInArrow(run, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "ids")


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of ids; ids without a token have none, null stays null."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return _let(literal, lambda hexes: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(hexes, i)), "")))
