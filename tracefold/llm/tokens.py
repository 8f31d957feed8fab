"""Token ids of documents, kept as one wavelet matrix per shard.

A shard is a compressed blob of bit planes, most significant bit first. Each plane holds one bit of every id, in the
order the planes above have put them (zeros before ones, stably), with a running count of ones per block of
512 bits for rank. From one blob ids can be read at any place (access), counted before a place (count)
and found again (select), without decoding the rest. Shards are rows of a Parquet table written by Spark, so that they live in
any store Spark writes to and lost tasks are simply run again.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import bounded_batches, kept_by
from .wordhash import slices, utf8

BLOCK = 512
SHARD_TOKENS = 1 << 20
#: Bytes of text whose pieces are numbered together.
SLICE_BYTES = 1 << 21
_MAGIC = b"WMX1"


class WaveletMatrix:
    """Read access to a shard's ids."""

    def __init__(self, blob: bytes):
        if blob[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        self.n, self.depth = struct.unpack_from("<QI", blob, 4)
        at, self.planes, self.zeros, self.ranks = 16, [], [], []
        row = (self.n + 7) // 8
        for _ in range(self.depth):
            (packed,) = struct.unpack_from("<I", blob, at)
            raw = zstandard.decompress(blob[at + 4 : at + 4 + packed])
            at += 4 + packed
            self.planes.append(np.frombuffer(raw, np.uint8, row))
            self.ranks.append(np.frombuffer(raw, np.uint32, self.n // BLOCK + 1, row))
            self.zeros.append(self.n - int(self._rank(len(self.planes) - 1, self.n)))

    @staticmethod
    def build(ids: np.ndarray, depth: int | None = None) -> bytes:
        a = np.ascontiguousarray(ids, np.uint32)
        depth = depth if depth is not None else max(1, int(a.max()).bit_length() if len(a) else 1)
        if depth <= 16:
            a = a.astype(np.uint16)
        out = [_MAGIC, struct.pack("<QI", len(a), depth)]
        for level in range(depth - 1, -1, -1):
            bits = (a >> a.dtype.type(level) & a.dtype.type(1)).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            whole = len(a) // BLOCK
            blocks = np.bitwise_count(packed[: whole * BLOCK // 8]).reshape(whole, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(blocks, dtype=np.uint32)])
            raw = zstandard.compress(packed.tobytes() + ranks.tobytes(), 1)
            out += [struct.pack("<I", len(raw)), raw]
            a = np.concatenate([a.take(np.flatnonzero(~bits)), a.take(np.flatnonzero(bits))])  # places are found faster than masks are read
        return b"".join(out)

    def _rank(self, level: int, place: int) -> int:
        """Ones before ``place``."""
        block = place // BLOCK
        start = block * BLOCK // 8
        bits = np.unpackbits(self.planes[level][start : (place + 7) // 8], bitorder="little")[: place - block * BLOCK]
        return int(self.ranks[level][block]) + int(bits.sum())

    def access(self, place: int) -> int:
        value = 0
        for level in range(self.depth):
            ones = self._rank(level, place)
            bit = int(self.planes[level][place >> 3] >> (place & 7) & 1)
            value = value << 1 | bit
            place = self.zeros[level] + ones if bit else place - ones
        return value

    def _descend(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.depth):
            a, b = self._rank(level, lo), self._rank(level, hi)
            if token >> (self.depth - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in [lo, hi)."""
        if token >> self.depth:
            return 0
        a, b = self._descend(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, nth: int) -> int:
        """Place of the nth occurrence (from 0), or -1."""
        if token >> self.depth:
            return -1
        lo, hi = self._descend(token, 0, self.n)
        if nth < 0 or lo + nth >= hi:
            return -1
        place = lo + nth
        for level in range(self.depth - 1, -1, -1):
            bit = token >> (self.depth - 1 - level) & 1
            place = self._nth(level, bit, place - self.zeros[level] if bit else place)
        return place

    def _nth(self, level: int, bit: int, nth: int) -> int:
        """Place of the nth one or zero of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, nth, "right")) - 1
        start = block * BLOCK // 8
        bits = np.unpackbits(self.planes[level][start : start + BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[nth - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids in order: the planes undone from the last to the first."""
        a = np.zeros(self.n, np.uint16 if self.depth <= 16 else np.uint32)
        for level in range(self.depth - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(a)
            up[np.flatnonzero(~bits)] = a[: self.zeros[level]]
            up[np.flatnonzero(bits)] = a[self.zeros[level] :] | a.dtype.type(1 << (self.depth - 1 - level))
            a = up
        return a


class _Pieces(dict):
    """Piece numbers; unknown pieces get the next number and are noted."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n


def _ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` from ``starts``, one after another."""
    return flat[np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)]


class Encoder:
    """Ids of texts. Pieces that begin at a single space are encoded once and remembered.

    The tokenizer's splitting never crosses a space that follows a non-space, so pieces can be encoded apart;
    texts with two spaces in a row, and texts with an added token such as an end mark, are encoded whole. New pieces are encoded joined together and cut apart again by the
    number of bytes each id stands for. The first ``LIMIT`` pieces stay; later ones are forgotten after their slice.
    """

    LIMIT = 700_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # texts that contain an added token go to the library whole, which sets it apart
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # in a byte-level vocabulary every character stands for one byte
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)], np.int64)
        self._reset()

    def _reset(self) -> None:
        self.known = _Pieces()
        self.count = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: list[str]) -> None:
        """A key is what follows a space, or, with a space before it, the start of a text. Keys have consecutive numbers."""
        plain, odd = [], []
        for i, k in enumerate(keys):
            (plain if k and not k[0].isspace() and not k[-1].isspace() else odd).append(i)
        parts, lengths = [], np.zeros(len(keys), np.int64)
        for at in range(0, len(plain), 512):
            part = [keys[i] for i in plain[at : at + 512]]
            (e,) = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum([len(k.encode()) + 1 for k in part])
            cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            parts.append(ids)
            lengths[plain[at : at + 512]] = np.diff(cuts, prepend=0)
        texts = [keys[i][1:] if keys[i][:1] == " " else " " + keys[i] for i in odd]
        for i, e in zip(odd, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if odd else (), strict=True):
            parts.append(np.array(e.ids, np.uint32))
            lengths[i] = len(e.ids)
        order = np.array(plain + odd)
        lie = np.zeros(len(keys), np.int64)
        lie[order] = np.cumsum(lengths[order]) - lengths[order]
        self._add(_ragged(np.concatenate(parts), lie, lengths), np.cumsum(lengths))

    def _add(self, ids: np.ndarray, cuts: np.ndarray) -> None:
        end = self.used + len(ids)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(cuts) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : end] = ids
        self.starts[self.count + 1 : self.count + 1 + len(cuts)] = cuts + self.used
        self.used, self.count = end, self.count + len(cuts)

    def __call__(self, text: str) -> np.ndarray:
        return self.rows(pa.array([text], pa.string()))[0]

    def rows(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column; null texts are empty. A slice's texts are split and its distinct pieces numbered by Arrow, so a piece is looked up once a slice."""
        out: list[np.ndarray] = []
        _, bounds = utf8(column)
        for lo, hi in slices(bounds, SLICE_BYTES):
            out += self._slice(column.slice(lo, hi - lo).fill_null(""))
        return out

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        apart = pc.match_substring(texts, "  ")
        for a in self.added:
            apart = pc.or_(apart, pc.match_substring(texts, a))
        apart = pc.or_(apart, pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        got = iter(self._pieces(texts.filter(pa.array(~apart))))
        return [(self.whole(texts[i].as_py()) if len(texts[i].as_py()) else np.zeros(0, np.uint32)) if alone else next(got) for i, alone in enumerate(apart)]

    def _pieces(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        first = split.offsets.to_numpy()[:-1].astype(np.int64)
        coded = split.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        used, count = self.used, self.count
        k = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[codes]
        # the start of a text is a key of its own; if a space comes first, there is none
        starts = [distinct[c] for c in codes[first].tolist()]
        spaced = np.array([w == "" for w in starts], bool)
        k[first[~spaced]] = [self.known[" " + w] for w in starts if w]
        fresh = self.known.fresh
        if fresh:
            self._learn(fresh)
        lengths = self.starts[k + 1] - self.starts[k]
        lengths[first[spaced]] = 0
        ends = np.cumsum(lengths)
        flat = _ragged(self.flat, self.starts[k], lengths)
        if fresh:
            if count >= self.LIMIT:
                for p in fresh:
                    del self.known[p]
                self.used, self.count = used, count
            self.known.fresh = []
        cuts = [0, *ends[first[1:] - 1].tolist(), int(ends[-1])]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, until another operator's task comes."""
    held = kept_by("tokens")
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, text: str = "text", key: str = "doc_id", partitions: int | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes every text, appends ``end_id`` and writes shards in ascending order of the id to ``out``.

    Rows are range-partitioned by id and text hash, so equal ids may span tasks; null ids come first; null texts are empty. A document is never
    split: a shard has about ``shard_tokens`` ids, or those of one document. ``docs`` without rows give no shard.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        ids: list[np.ndarray] = []
        keys: list = []
        nth = before = size = 0

        def emit() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            lengths = np.array([len(x) for x in ids], np.uint32)
            flat = np.insert(flat, np.cumsum(lengths, dtype=np.int64), np.uint32(end_id))
            lengths += np.uint32(1)
            return pa.record_batch(
                {
                    "shard": pa.array([nth], pa.int32()),
                    "before": pa.array([before], pa.int64()),
                    "n": pa.array([len(flat)], pa.int64()),
                    "keys": pa.array([keys], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths.tobytes()], pa.binary()),
                    "blob": pa.array([WaveletMatrix.build(flat)], pa.binary()),
                    "part": pa.array([part], pa.int32()),
                }
            )

        part = 0
        for batch in batches:
            for k, got, part in zip(batch.column(0).to_pylist(), encode.rows(batch.column(1)), batch.column(2).to_pylist()):
                ids.append(got)
                keys.append(k)
                size += len(got) + 1
                if size >= shard_tokens:
                    yield emit()
                    nth, before, size, ids, keys = nth + 1, before + size, 0, [], []
        if ids:
            yield emit()

    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    rows = rows.repartitionByRange(n, F.col("k").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("k").asc_nulls_first(), F.xxhash64("t"))
    rows = rows.withColumn("p", F.spark_partition_id())
    schema = "shard int, before long, n long, keys array<bigint>, lengths binary, blob binary, part int"
    rows.mapInArrow(shards, schema).write.mode("overwrite").parquet(out)


def read_shards(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """(doc id, start, ids) of every document in a folder of shards, ids as little-endian bytes of 4 each."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                flat = WaveletMatrix(r["blob"]).decode()
                lengths = np.frombuffer(r["lengths"], np.uint32).astype(np.int64)
                ends = np.cumsum(lengths)
                for lo in range(0, len(lengths), 512):
                    hi = min(lo + 512, len(lengths))
                    yield pa.record_batch(
                        {
                            key: pa.array(r["keys"][lo:hi], pa.int64()),
                            "start": r["base"] + ends[lo:hi] - lengths[lo:hi],
                            "n_tokens": lengths[lo:hi],
                            "ids": pa.array([flat[e - n : e].astype("<u4").tobytes() for e, n in zip(ends[lo:hi], lengths[lo:hi])], pa.binary()),
                        }
                    )

    shards = _with_bases(spark, out)
    return shards.select("keys", "lengths", "blob", "base").mapInArrow(documents, f"{key} long, start long, n_tokens long, ids binary")


def _with_bases(spark: SparkSession, out: str) -> DataFrame:
    """Shards with the number of ids before each; the running sum is over one row per written partition."""
    shards = spark.read.parquet(out)
    totals = shards.groupBy("part").agg(F.sum("n").alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return shards.join(totals, "part").withColumn("base", F.col("before") + F.col("ahead"))


def document_digests(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """(doc id, start, n_tokens, ids_crc32) from the shards."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                flat = WaveletMatrix(r["blob"]).decode().astype("<u4")
                lengths = np.frombuffer(r["lengths"], np.uint32).astype(np.int64)
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({key: pd.array(r["keys"], "Int64"), "start": r["base"] + ends - lengths, "n_tokens": lengths, "ids_crc32": np.array([zlib.crc32(flat[e - n : e].tobytes()) for e, n in zip(ends, lengths)], np.int64)}),
                    preserve_index=False,
                )

    return _with_bases(spark, out).select("keys", "lengths", "blob", "base").mapInArrow(digests, f"{key} long, start long, n_tokens long, ids_crc32 long")


def token_lookup(spark: SparkSession, out: str, token: int, most_per_shard: int | None = None) -> DataFrame:
    """(shard base, occurrences, places) of a token in every shard, from rank and select alone."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                m = WaveletMatrix(r["blob"])
                n = m.count(token)
                places = [r["base"] + m.select(token, k) for k in range(n if most_per_shard is None else min(n, most_per_shard))]
                yield pa.record_batch({"base": pa.array([r["base"]], pa.int64()), "occurrences": pa.array([n], pa.int64()), "places": pa.array([places], pa.list_(pa.int64()))})

    return _with_bases(spark, out).select("blob", "base").mapInArrow(look, "base long, occurrences long, places array<bigint>")
