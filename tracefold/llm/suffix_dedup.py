"""Removal of long byte strings that occur more than once, from suffix order.

Every ``length``-byte window of a text belongs to the smallest hash of its ``GRAM``-byte pieces, its anchor; equal windows have
equal anchors at equal places. Windows with a common anchor form one item, so items cover every window once and equal windows meet under the anchor's
hash. Equal items are counted before any bytes move, and one of them stands for all. Items that share an anchor but differ, and enough bytes around it
for a window in common to be possible, are put in collections, and each collection's Burrows-Wheeler transform with its common prefixes is built column by column: each round inserts one
symbol per item (``collection_bwt``). A finished collection is one row of a table in the shared folder: its items, the transform and the
prefixes, each one sequential run of bytes. From that table alone come the repeated windows: rows whose common prefix with a
neighbour reaches ``length``.

A block is bounded: an anchor with more than ``BLOCK`` different items is split by halves of the windows' places under the
hash of the bytes that those windows have in common, until each part fits or is a single window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import collection_bwt
from .base import bounded_batches, sets_apart, settle_table
from .wordhash import mix, slices, utf8

GRAM = 48
BLOCK = 256
#: A collection takes whole anchors until it has this many items; it is below COLLECTION + BLOCK items of less than two windows each.
COLLECTION = 128
#: An item enters its collection only if it shares one of this many stretches around the anchor with another item of its part, and with the windows between such stretches only.
CORES = 8
_BASE = 0x9E3779B97F4A7C17 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)

_bytes = np.random.default_rng(20240401).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, 1 << 21) + 1, base, np.uint64)
            steps[0] = 1
            _pow[name] = np.cumprod(steps)
    return _pow["up"], _pow["down"]


def item_table(raw: np.ndarray, bounds: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Items of the rows ``bounds`` of ``raw``: row, lo, size (bytes), place (of the anchor within the item), h, c."""
    empty = {k: np.zeros(0, np.int64) for k in ("row", "lo", "size", "place", "h", "c")}
    at = bounds - bounds[0]
    b = raw[bounds[0] : bounds[-1]]
    n = len(b)
    if n < length:
        return empty
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_bytes[b] * up[:n], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    width = length - GRAM + 1
    places = np.uint64((1 << max(1, int(n).bit_length())) - 1)
    packed = grams & ~places | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(packed) // width)
    padded = np.full((blocks + 1) * width, ~np.uint64(0))
    padded[: len(packed)] = packed
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    anchor = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & places).astype(np.int64)
    row = np.searchsorted(at, np.arange(windows), "right") - 1 if len(at) < 3 else np.repeat(np.arange(len(at) - 1), np.diff(at))[:windows]
    inside = np.arange(windows) + length <= at[1:][row]
    change = np.ones(windows, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    change[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(change)
    last = np.append(first[1:], windows) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    where = anchor[first]
    ends = last + length
    c = mix((sums[ends] - sums[first]) * down[first] + (ends - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (where - first).astype(np.uint64))
    return {"row": row[first], "lo": first - at[row[first]], "size": ends - first, "place": where - first, "h": mix(grams[where] + np.uint64(1)).view(np.int64), "c": c.view(np.int64)}


def item_print(piece: np.ndarray, place: int) -> int:
    """``c`` of one item, from its bytes."""
    up, _ = _powers(len(piece))
    total = (_bytes[piece] * up[: len(piece)]).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.array([len(piece)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([place], np.uint64)).view(np.int64)[0])


def repeated_windows(items: list[bytes], length: int) -> list[np.ndarray]:
    """For each item, which of its ``length``-byte windows also start elsewhere in the collection."""
    return collection_bwt.repeated(*collection_bwt.build(items), [len(x) for x in items], length)


def _runs(mask: np.ndarray) -> list[int]:
    """start, end pairs of the true runs."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist()


def _resolve(parts: DataFrame, length: int, step: int) -> DataFrame:
    """(h, c, runs): repeated windows of the items in ``parts`` (part, h, c, place, skip, bytes)."""
    settled: list[DataFrame] = []
    open_items: list[DataFrame] = []
    low, high = 0, length - GRAM
    nodes = parts.withColumn("o1", F.lit(low)).withColumn("o2", F.lit(high))
    while True:  # at a range of one place all windows are equal, so rounds end after as many as the length has bits
        # equal bytes under a part are one entry; both are repeated then
        alike = nodes.withColumn("print", F.xxhash64("bytes", "place"))
        kinds = alike.groupBy("part", "print").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("h", "c", "skip")).alias("first"))
        counts = kinds.groupBy("part").agg(F.count(F.lit(1)).alias("kinds"))
        alike = alike.join(kinds, ["part", "print"]).join(counts, "part")
        alike = settle_table(alike, "zstd")  # near-equal items stand together
        repeated = alike.where("copies > 1").select("h", "c", F.array(F.col("skip"), F.col("skip") + F.length("bytes") - length + 1).alias("runs"))
        settled.append(repeated)
        one = alike.where(F.col("first") == F.struct("h", "c", "skip")).where("kinds > 1")
        open_items.append(one.where(F.col("kinds") <= BLOCK).select("part", "h", "c", "skip", "place", "bytes"))
        wide = one.where(F.col("kinds") > BLOCK).drop("print", "copies", "first", "kinds")
        if wide.isEmpty():
            break
        half = F.floor((F.col("o1") + F.col("o2")) / 2).cast("int")
        both = wide.withColumn("n", F.explode(F.array(F.struct(F.col("o1").alias("a"), half.alias("b")), F.struct((half + 1).alias("a"), F.col("o2").alias("b"))))).withColumn("o1", F.col("n.a")).withColumn("o2", F.col("n.b")).where("o1 <= o2").drop("n")
        # windows at distance o before the anchor, o1 <= o <= o2, start at place - o of the item's bytes
        windows = F.length("bytes") - length + 1
        s_lo, s_hi = F.greatest(F.col("place") - F.col("o2"), F.lit(0)), F.least(F.col("place") - F.col("o1"), windows - 1)
        both = both.withColumn("s_lo", s_lo).withColumn("s_hi", s_hi).where("s_lo <= s_hi")
        core = F.expr(f"substring(bytes, place - o1 + 1, {length} - (o2 - o1))")
        nodes = both.select(
            F.xxhash64("part", "o1", "o2", core).alias("part"), "h", "c", (F.col("place") - F.col("s_lo")).alias("place"), (F.col("skip") + F.col("s_lo")).alias("skip"),
            F.expr(f"substring(bytes, s_lo + 1, s_hi - s_lo + {length})").alias("bytes"), "o1", "o2",
        )
        nodes = settle_table(nodes, "zstd")
    collections = settle_table(transforms(candidates(_union(open_items), length), length), "zstd")
    return _union([*settled, repeats_of(collections, length)])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def may_repeat(items: list[tuple[int, bytes]], length: int) -> list[tuple[int, int] | None]:
    """For each item (place of the anchor, bytes) of one part, the stretch (start, end) of it that may have a window in common with another, or None. A window whose
    anchor is between a and z bytes from its start holds the bytes from a before the anchor to ``length`` - z after it, so items without such a stretch in common share none
    of these windows. The windows of the ranges between the first and the last that are shared stay."""
    width = -(-(length - GRAM + 1) // CORES)
    out: list[tuple[int, int] | None] = [None] * len(items)
    for a in range(0, length - GRAM + 1, width):  # from the last windows of an item to its first
        z = min(a + width - 1, length - GRAM)
        cores: dict[bytes, int] = {}
        for i, (place, x) in enumerate(items):
            lo, hi = place - z, place - a + length  # of all windows of this range together
            lo, hi = max(lo, 0), min(hi, len(x))
            if lo + length > hi:
                continue  # the item has none of them
            first = cores.setdefault(x[place - a : place - z + length], i)
            if first != i:
                for j in (first, i):
                    at, y = items[j]
                    out[j] = max(at - z, 0), out[j][1] if out[j] else min(at - a + length, len(y))
    return out


def by_part(rows: DataFrame) -> DataFrame:
    """Whole parts together. Few bytes but long work: a stated number of tasks, which is not lowered by size."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "part").sortWithinPartitions("part")


def candidates(rows: DataFrame, length: int) -> DataFrame:
    """The stretches (part, h, c, skip, bytes) of the items of ``rows`` that may share a window with another item of their part."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []  # at most BLOCK items
        schema = pa.schema([("part", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("skip", pa.int32()), ("bytes", pa.binary())])

        def chosen() -> list[tuple]:
            may = may_repeat([(x[5], x[4]) for x in part], length)
            return [(*x[:3], x[3] + to[0], x[4][to[0] : to[1]]) for x, to in zip(part, may) if to]

        def table(items: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in items], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            out = []
            for item in zip(*(column.to_pylist() for column in batch.columns)):
                if part and part[0][0] != item[0]:
                    out += chosen()
                    part = []
                part.append(item)
            yield table(out)
        yield table(chosen())

    return by_part(rows.select("part", "h", "c", "skip", "bytes", "place")).mapInArrow(choose, "part long, h long, c long, skip int, bytes binary")


COLLECTIONS = "items array<struct<h:bigint,c:bigint,skip:int,size:int>>, bwt binary, lcp binary, width int"


def transforms(rows: DataFrame, length: int) -> DataFrame:
    """(items, bwt, lcp, width): collections of whole parts, each with its transform and its common prefixes, written as numbers of
    ``width`` bytes up to ``length``: what is longer is repeated all the same."""
    width = 1 if length < 256 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        schema = pa.schema([("items", pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("skip", pa.int32()), ("size", pa.int32())]))), ("bwt", pa.binary()), ("lcp", pa.binary()), ("width", pa.int32())])

        def collection() -> pa.RecordBatch:
            bwt, lcp = collection_bwt.build([x[4] for x in held])
            items = [{"h": h, "c": c, "skip": skip, "size": len(x)} for _, h, c, skip, x in held]
            return pa.RecordBatch.from_pylist([{"items": items, "bwt": bwt.tobytes(), "lcp": np.minimum(lcp, length).astype(f"u{width}").tobytes(), "width": width}], schema=schema)

        for batch in batches:
            for item in zip(*(column.to_pylist() for column in batch.columns)):
                if len(held) >= COLLECTION and held[-1][0] != item[0]:
                    yield collection()
                    held = []
                held.append(item)
        if held:
            yield collection()

    return by_part(rows.select("part", "h", "c", "skip", "bytes")).mapInArrow(write, COLLECTIONS)


def repeats_of(collections: DataFrame, length: int) -> DataFrame:
    """(h, c, runs): starts of the repeated windows of each item, read from the transforms and prefixes of ``collections``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("runs", pa.list_(pa.int32()))])
        for batch in batches:
            for items, bwt, lcp, width in zip(*(batch.column(k) for k in ("items", "bwt", "lcp", "width"))):
                items = items.as_py()
                lcp = np.frombuffer(lcp.as_buffer(), f"u{width.as_py()}")
                masks = collection_bwt.repeated(np.frombuffer(bwt.as_buffer(), np.uint8), lcp, [x["size"] for x in items], length)
                got = [{"h": x["h"], "c": x["c"], "runs": [at + x["skip"] for at in _runs(mask)]} for x, mask in zip(items, masks) if mask.any()]
                yield pa.RecordBatch.from_pylist(got, schema=schema)

    return collections.mapInArrow(read, "h long, c long, runs array<int>")


def repeated_spans(docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """(t, marks): per text hash, its items with repeated windows: lo, whole (all ``size`` bytes) or runs of window starts."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = utf8(batch.column(1))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(bounds, 1 << 20):
                x = item_table(raw, bounds[lo : hi + 1], length)
                yield pa.record_batch({"h": x["h"], "c": x["c"], "t": keys[lo:hi][x["row"]], "lo": x["lo"].astype(np.int32), "size": x["size"].astype(np.int32), "place": x["place"].astype(np.int32)})

    texts = docs.where(F.octet_length(text) >= length).select(F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    every = settle_table(texts.mapInArrow(items, "h long, c long, t long, lo int, size int, place int"))
    again = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    shared = settle_table(every.join(again, "h"))
    kinds = shared.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "lo", "size", "place")).alias("at"))
    kinds = settle_table(kinds)
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h")
    wanted = kinds.join(several, "h").select("h", "c", "at.*")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = utf8(batch.column(1))
            found = []
            for i, wants in enumerate(batch.column(0).to_pylist()):
                for w in wants:
                    a = int(bounds[i]) + w["lo"]
                    piece = raw[a : min(a + w["size"], int(bounds[i + 1]))]
                    if len(piece) == w["size"] and item_print(piece, w["place"]) == w["c"]:  # not another text of the same hash
                        found.append((w["h"], w["c"], w["place"], piece.tobytes()))
            yield pa.RecordBatch.from_pydict({k: [f[j] for f in found] for j, k in enumerate(("h", "c", "place", "bytes"))}, schema=pa.schema([("h", pa.int64()), ("c", pa.int64()), ("place", pa.int32()), ("bytes", pa.binary())]))

    wants = wanted.groupBy("t").agg(F.collect_list(F.struct("h", "c", "lo", "size", "place")).alias("wants"))
    sources = texts.join(wants, "t").select("wants", "text")
    pieces = settle_table(sources.mapInArrow(cut, "h long, c long, place int, bytes binary").dropDuplicates(["h", "c"]))
    resolved = _resolve(pieces.select(F.col("h").alias("part"), "h", "c", "place", F.lit(0).alias("skip"), "bytes"), length, BLOCK)
    runs = resolved.groupBy("h", "c").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    cover = kinds.select("h", "c", (F.col("n") > 1).alias("whole")).join(runs, ["h", "c"], "left").where("whole or runs is not null")
    cover = cover.withColumn("runs", F.when(~F.col("whole"), F.col("runs")))
    marks = shared.join(cover, ["h", "c"]).groupBy("t", "lo", "size").agg(F.max("whole").alias("whole"), F.first("runs").alias("runs"))
    return marks.groupBy("t").agg(F.collect_list(F.struct("lo", "size", "whole", "runs")).alias("marks"))


def without(raw: np.ndarray, bounds: np.ndarray, marks: pa.Array, length: int) -> list[pa.Array]:
    """kept, spans, n_bytes, n_removed, n_spans of the rows ``bounds`` of ``raw``, all rows together."""
    base, n = bounds[:-1] - bounds[0], np.diff(bounds)
    b = raw[bounds[0] : bounds[-1]]
    row = np.repeat(np.arange(len(n)), pc.fill_null(pc.list_value_length(marks), 0).to_numpy())
    lo, size, whole, runs = marks.flatten().flatten()
    lo, size, whole = lo.to_numpy(), size.to_numpy(), whole.to_numpy(zero_copy_only=False)
    # window starts a..z-1 cover bytes a..z+length-2
    pairs = runs.flatten().to_numpy()
    of = np.repeat(np.arange(len(lo)), pc.fill_null(pc.list_value_length(runs), 0).to_numpy() // 2)
    some = ~whole[of]
    of = np.concatenate([np.flatnonzero(whole), of[some]])
    a = np.concatenate([np.zeros(whole.sum(), np.int64), pairs[::2][some]]) + lo[of]
    z = np.concatenate([size[whole].astype(np.int64), pairs[1::2][some] + (length - 1)]) + lo[of]
    fits = z <= n[row[of]]
    at = base[row[of]][fits]
    steps = np.zeros(len(b) + 1, np.int32)
    np.add.at(steps, at + a[fits], 1)
    np.add.at(steps, at + z[fits], -1)
    gone = np.cumsum(steps[:-1], dtype=np.int32) > 0
    # a run ends with its row
    edge = np.zeros(len(b) + 1, bool)
    edge[base], edge[-1] = True, True
    first, last = gone.copy(), gone.copy()
    first[1:] &= ~gone[:-1] | edge[1:-1]
    last[:-1] &= ~gone[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    cuts = np.searchsorted(starts, np.append(base, len(b)))
    spans = np.empty(2 * len(starts), np.int32)
    of = np.repeat(np.arange(len(n)), np.diff(cuts))
    spans[::2], spans[1::2] = starts - base[of], ends - base[of]
    n_removed = np.bincount(of, ends - starts, len(n)).astype(np.int64)
    edges = np.append(0, np.cumsum(n - n_removed)).astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(b[~gone]))])
    return [kept, pa.ListArray.from_arrays(pa.array((2 * cuts).astype(np.int32)), pa.array(spans)), pa.array(n.astype(np.int64)), pa.array(n_removed), pa.array(np.diff(cuts).astype(np.int64))]


@sets_apart("__t", "__text", "__marks")
def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 200) -> DataFrame:
    """``docs`` with kept (bytes left), spans (removed start, end pairs), n_bytes, n_removed and n_spans.

    A byte goes if a ``length``-byte string that covers it also starts elsewhere in any text, the same one included. Texts are
    bytes of UTF-8; null texts are empty; repeated rows repeat each other and so go entirely if they are long enough. An empty table gives no rows. A text is
    worked on whole, with about 60 bytes of memory per byte of it. Columns named like an output are replaced.
    """
    bounded_batches(docs.sparkSession)
    outputs = ["kept", "spans", "n_bytes", "n_removed", "n_spans"]
    kept = docs.drop(*[c for c in outputs if c != text])
    spans = repeated_spans(docs, text, length).select(F.col("t").alias("__t"), F.col("marks").alias("__marks"))
    joined = kept.withColumn("__t", F.xxhash64(text)).withColumn("__text", F.col(text)).join(spans, "__t", "left").drop("__t")
    from pyspark.sql import types as T

    schema = T.StructType(
        [*kept.schema.fields, T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.IntegerType()))] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = utf8(batch.column(batch.schema.get_field_index("__text")))
            marks = batch.column(batch.schema.get_field_index("__marks"))
            done = [without(raw, bounds[lo : hi + 1], marks.slice(lo, hi - lo), length) for lo, hi in slices(bounds, 1 << 20)]
            columns = [pa.concat_arrays(parts) for parts in zip(*done)] or [pa.array([], t) for t in (pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept_fields), *columns], names=[*(f.name for f in kept_fields), *outputs])

    kept_fields = kept.schema.fields
    return joined.mapInArrow(remove, schema)

