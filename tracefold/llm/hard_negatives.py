"""Hard negatives from a multiway hyperplane tree of vectors.

A row's score is its inner product with the anchor. With one more component, sqrt(M - |x|^2) for rows and 0 for anchors (M the greatest squared length of
all rows), a score is a distance: |a' - x'|^2 = |a|^2 + M - 2 score. So a range of scores is an annulus around the anchor.

The tree is fitted on a bounded sample: a node has up to ``DEGREE`` split points, far from one another, and a row goes to the nearest of them. Every
row of the table is then put into its leaf, and for every pair of siblings the least and greatest distance of one's split point to all rows below
the other is counted over all rows. A search goes down the tree with its annulus: a sibling is left out where, for some split point, the distances that
the triangle inequality allows for the annulus do not meet the sibling's range. What is left are leaves, searched exactly in blocks of bounded size.
The sample gives the first bounds of the best scores; they only narrow the annuli, and no row within them is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import settle_table

#: Rows that the tree is fitted on, of least hash; split points of a node; sample rows below which a node is a leaf.
SAMPLE_ROWS, DEGREE, LEAF_SAMPLE = 8192, 16, 256
#: Numbers in the sample at most.
SAMPLE_NUMBERS = 1 << 20
#: Rows of a leaf's block and anchors of a block, on average.
LEAF_BLOCK, ANCHOR_BLOCK = 256, 128
_LEAST = np.iinfo(np.int64).min


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 2**56:  # 100 times a score is compared
        raise ValueError("scores of these components do not fit 64 bits")
    return a.astype(np.int64) @ b.T.astype(np.int64)


@dataclass
class Node:
    points: np.ndarray
    below: list[int] = field(default_factory=list)
    #: a leaf's number, -1 inside
    leaf: int = -1
    near: np.ndarray | None = None
    far: np.ndarray | None = None


class Tree:
    """Split points, and the ranges of distances between siblings once they are counted."""

    def __init__(self, sample: np.ndarray, greatest: float, degree: int = DEGREE, least: int = LEAF_SAMPLE):
        self.greatest, self.nodes, self.leaves = greatest, [], 0
        self.slack = 1e-6 * (1 + greatest**0.5)
        self._grow(sample, degree, least)

    def heights(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.greatest - np.einsum("ij,ij->i", x, x), 0))

    def distances(self, x: np.ndarray, points: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Distances of rows, or of anchors, to split points."""
        squares = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", points, points)[None] - 2 * (x @ points.T)
        up = 0 if anchors else self.heights(x)[:, None]
        return np.sqrt(np.maximum(squares + (up - self.heights(points)[None]) ** 2, 0))

    def _grow(self, x: np.ndarray, degree: int, least: int) -> int:
        at = len(self.nodes)
        node = Node(np.zeros((0, x.shape[1])))
        self.nodes.append(node)
        if len(x) > least:
            chosen, gap = [0], self.distances(x, x[:1])[:, 0]
            while len(chosen) < degree and gap.max() > 0:
                chosen.append(int(gap.argmax()))
                gap = np.minimum(gap, self.distances(x, x[chosen[-1:]])[:, 0])
            if len(chosen) > 1:
                node.points = x[chosen]
                side = self.distances(x, node.points).argmin(1)
                node.below = [self._grow(x[side == j], degree, least) for j in range(len(chosen))]
                return at
        node.leaf, self.leaves = self.leaves, self.leaves + 1
        return at

    def place(self, x: np.ndarray, ranges: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """Leaf of every row; ``ranges`` gets the least and greatest distances met at each node."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if node.leaf >= 0:
                out[rows] = node.leaf
            elif len(rows):
                d = self.distances(x[rows], node.points)
                side = d.argmin(1)
                for j, child in enumerate(node.below):
                    mine = side == j
                    if mine.any():
                        if ranges is not None:
                            near, far = ranges.setdefault(at, (np.full((d.shape[1],) * 2, np.inf), np.full((d.shape[1],) * 2, -np.inf)))
                            near[:, j] = np.minimum(near[:, j], d[mine].min(0))
                            far[:, j] = np.maximum(far[:, j], d[mine].max(0))
                        todo.append((child, rows[mine]))
        return out

    def survivors(self, anchors: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, with the numbers of the annuli [inner, outer] around anchors that may have rows there."""
        todo = [(0, np.flatnonzero(inner <= outer))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if not len(rows):
                continue
            if node.leaf >= 0:
                yield node.leaf, rows
                continue
            if node.near is None:
                continue
            d = self.distances(anchors[rows], node.points, anchors=True)
            lo, hi = inner[rows, None], outer[rows, None]
            nearest, farthest = np.maximum(d - hi, lo - d) - self.slack, d + hi + self.slack
            for j, child in enumerate(node.below):
                todo.append((child, rows[((nearest <= node.far[:, j]) & (farthest >= node.near[:, j])).all(1)]))

    def radius(self, anchors: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance of rows of a score."""
        return np.sqrt(np.maximum(np.einsum("ij,ij->i", anchors, anchors) + self.greatest - 2 * score, 0))


def _best(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best allowed scores of each row, with all that tie with the last."""
    held = np.where(ok, scores, _LEAST)
    m = held.shape[1]
    least = np.partition(held, m - k, axis=1)[:, m - k] if m > k else np.full(len(held), _LEAST)
    return np.nonzero(ok & (held >= least[:, None]))


class _Packed:
    """Vectors as bytes of ``width`` numbers each."""

    def __init__(self, width: int, most: float):
        self.width, self.kind = width, np.dtype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8")

    def read(self, column: pa.Array) -> np.ndarray:
        raw = column.cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        if not len(raw) or ends[0] == ends[-1]:
            return np.zeros((len(raw), self.width), np.int64)
        return np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(self.kind).reshape(len(raw), self.width).astype(np.int64)

    def write(self, x: np.ndarray) -> pa.Array:
        return pa.array([r.tobytes() for r in np.ascontiguousarray(x, self.kind)], pa.binary())

    def pack(self, column: pa.ListArray) -> pa.Array:
        """Lists of numbers, shorter ones filled up with zeros."""
        ends, values = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
        out = np.zeros((len(column), self.width), self.kind)
        lengths = np.diff(ends)
        out[np.repeat(np.arange(len(column)), lengths), np.arange(lengths.sum()) - np.repeat(ends[:-1] - ends[0], lengths)] = values[ends[0] : ends[-1]]
        return self.write(out)


def _fields(column: pa.ListArray, i: int) -> list[pa.Array]:
    rows = column.slice(i, 1).flatten()
    return [rows.field(j) for j in range(rows.type.num_fields)]


def mine(rows: DataFrame, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``rows`` (id long, label long, vector array<bigint>, is_anchor boolean).

    An anchor's positives are its ``n_positives`` best other rows of its label; for each, the negatives are the first ``n_negatives`` rows of other labels whose score
    times 100 is from ``low`` to ``high`` times the positive's. Best means higher score, then smaller id. A positive of a score below 0 has no negatives; one of 0 has
    those of score 0. Rows with a null id, label, vector or component take no part; rows alike in id, label and vector count once; rows of the anchor's own
    id are never its partners; of other rows that share an id each counts, those of one score to the anchor once. Vectors of unequal length are filled up with zeros, an empty one is all zeros. Columns other than the four are
    ignored, and an empty table gives an empty one. Scores are exact; components for which they would not fit 64 bits raise a ValueError.

    Of equal vectors of one label only the smallest ids can be among the best, so only these are indexed, however many there are.
    """
    spark = rows.sparkSession
    x = rows.where("id is not null and label is not null and vector is not null and forall(vector, x -> x is not null)")
    x = x.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<bigint>"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))
    x = settle_table(x.groupBy("id", "label", "vector").agg(F.max("is_anchor").alias("is_anchor")))
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    width, most, greatest = x.agg(F.max(F.size("vector")), F.max(F.coalesce(F.array_max(F.transform("vector", lambda v: F.abs(v.cast("double")))), F.lit(0.0))), F.max(square)).first()
    packed = _Packed(width or 1, most or 0.0)
    nth = F.dense_rank().over(W.partitionBy("vector", "label").orderBy("id"))
    points = x.select("id", "label", "vector", nth.alias("nth")).where(F.col("nth") <= max(n_positives, n_negatives) + 1).drop("nth")
    points = settle_table(points)
    sample = points.orderBy(F.xxhash64("vector", "id"), "id", "label").limit(max(1, min(sample_rows, SAMPLE_NUMBERS // packed.width))).collect()
    s_id, s_label = np.array([r["id"] for r in sample], np.int64), np.array([r["label"] for r in sample], np.int64)
    s_vector = np.zeros((len(sample), packed.width), packed.kind)
    for i, r in enumerate(sample):
        s_vector[i, : len(r["vector"])] = r["vector"]
    tree = Tree(s_vector.astype(np.float64), greatest or 0.0)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = packed.pack(batch.column(2))
            leaf = tree.place(packed.read(vectors).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors, pa.array(leaf)], names=["id", "label", "v", "leaf"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            tree.place(packed.read(batch.column(0)).astype(np.float64), met)
        flat = [(n, i, j, near[i, j], far[i, j]) for n, (near, far) in met.items() for i in range(len(near)) for j in range(len(near)) if near[i, j] < np.inf]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat)], names=["node", "i", "j", "near", "far"])

    table = "id long, label long, v binary, leaf int"
    points = settle_table(points.select("id", "label", "vector").mapInArrow(placed, table))
    # as many rows as the tree has pairs of siblings
    ranges = points.select("v").mapInArrow(spans, "node long, i long, j long, near double, far double").groupBy("node", "i", "j").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    for r in ranges.collect():
        node = tree.nodes[r["node"]]
        if node.near is None:
            node.near, node.far = np.full((len(node.points),) * 2, np.inf), np.full((len(node.points),) * 2, -np.inf)
        node.near[r["i"], r["j"]], node.far[r["i"], r["j"]] = r["near"], r["far"]
    if tree.nodes[0].leaf < 0 and tree.nodes[0].near is None:
        tree.nodes[0].near = tree.nodes[0].far = np.zeros((len(tree.nodes[0].points),) * 2)

    # blocks of a leaf, dealt by hash; blocks of anchors in the order of their leaves: both tables have a row for each leaf
    def by_leaf(df: DataFrame) -> DataFrame:
        return df.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))

    sizes = by_leaf(points).select("leaf", F.ceil(F.col("n") / LEAF_BLOCK).cast("int").alias("blocks"))
    dealt = points.join(F.broadcast(sizes), "leaf").withColumn("block", F.expr("cast(pmod(xxhash64(id, v), blocks) as int)"))
    blocks = settle_table(dealt.groupBy("leaf", "block").agg(F.collect_list(F.struct("id", "label", "v")).alias("rows")))
    anchors = settle_table(x.where("is_anchor").select("id", "label", "vector").mapInArrow(placed, table))
    ahead = F.sum("n").over(W.orderBy("leaf")) - F.col("n")
    anchors = anchors.join(F.broadcast(by_leaf(anchors).select("leaf", "n", ahead.alias("ahead"))), "leaf")
    anchors = anchors.withColumn("group", F.expr(f"cast((ahead + pmod(xxhash64(id, v), n)) div {ANCHOR_BLOCK} as int)"))
    groups = settle_table(anchors.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("id", "label", "v"))).alias("anchors")))

    # an item is what is asked: an anchor (and, for negatives, one of its positives) with the least and greatest score allowed
    item = "struct<nth:int,id:bigint,label:bigint,v:binary,partner:bigint,score:bigint,low:bigint,high:bigint>"

    def routed(group: int, nth: list[np.ndarray], columns: list[np.ndarray], vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Items for the leaves that may have rows for them."""
        a = vectors.astype(np.float64)
        inner = np.where(high == np.iinfo(np.int64).max, 0.0, tree.radius(a, high.astype(np.float64)))
        outer = np.where(low == _LEAST, np.inf, tree.radius(a, low.astype(np.float64)))
        for leaf, rows in tree.survivors(a, np.where(low > high, np.inf, inner), np.where(low > high, -1.0, outer)):
            ids, labels, partners, scored = (c[rows] for c in columns)
            cells = pa.StructArray.from_arrays([pa.array(nth[rows]), pa.array(ids), pa.array(labels), packed.write(vectors[rows]), pa.array(partners), pa.array(scored), pa.array(low[rows]), pa.array(high[rows])], names=["nth", "id", "label", "v", "partner", "score", "low", "high"])
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([leaf], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), cells)], names=["group", "leaf", "items"])

    def ask_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, group in enumerate(batch.column(0).to_pylist()):
                ids, labels, v = _fields(batch.column(1), i)
                ids, labels, v = ids.to_numpy(), labels.to_numpy(), packed.read(v)
                scores = products(v, s_vector)
                held = np.where((labels[:, None] == s_label) & (ids[:, None] != s_id), scores, _LEAST)
                m = held.shape[1]
                low = np.partition(held, m - n_positives, axis=1)[:, m - n_positives] if m >= n_positives else np.full(len(ids), _LEAST)
                yield from routed(group, np.arange(len(ids), dtype=np.int32), [ids, labels, ids, np.zeros(len(ids), np.int64)], v, low, np.full(len(ids), np.iinfo(np.int64).max))

    def ask_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, group in enumerate(batch.column(0).to_pylist()):
                ids, labels, v = _fields(batch.column(1), i)
                ids, labels, v = ids.to_numpy(), labels.to_numpy(), packed.read(v)
                nth, partners, scored = (c.to_numpy() for c in _fields(batch.column(2), i))
                from_, to = -(-low * scored // 100), high * scored // 100
                known = products(v, s_vector)
                for at in range(0, len(nth), 64):  # 64 x sample rows at a time
                    part = slice(at, at + 64)
                    a, s = nth[part], known[nth[part]]
                    ok = (labels[a][:, None] != s_label) & (ids[a][:, None] != s_id) & (s >= from_[part, None]) & (s <= to[part, None])
                    held = np.where(ok, s, _LEAST)
                    m = held.shape[1]
                    if m >= n_negatives:
                        from_[part] = np.maximum(from_[part], np.partition(held, m - n_negatives, axis=1)[:, m - n_negatives])
                yield from routed(group, nth, [ids[nth], labels[nth], partners, scored], v[nth], from_, to)

    def answered(same_label: bool, k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, group in enumerate(batch.column(0).to_pylist()):
                    nth, ids, labels, v, partner, scored, low, high = _fields(batch.column(1), i)
                    nth, ids, labels, partner, scored, low, high = (c.to_numpy() for c in (nth, ids, labels, partner, scored, low, high))
                    p_id, p_label, p_v = _fields(batch.column(2), i)
                    p_id, p_label = p_id.to_numpy(), p_label.to_numpy()
                    scores = products(packed.read(v), packed.read(p_v))
                    label = labels[:, None] == p_label
                    ok = (label if same_label else ~label) & (ids[:, None] != p_id) & (scores >= low[:, None]) & (scores <= high[:, None])
                    r, c = _best(scores, ok, k)
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), group, np.int32)), pa.array(nth[r]), pa.array(ids[r]), pa.array(partner[r]), pa.array(scored[r]), pa.array(p_id[c]), pa.array(scores[r, c])], names=["group", "nth", "anchor", "partner", "partner_score", "id", "score"])

        return run

    def searched(asked: DataFrame, same_label: bool, k: int) -> DataFrame:
        each = asked.join(F.broadcast(sizes), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = each.join(blocks, ["leaf", "block"]).select("group", "items", "rows")
        found = pairs.mapInArrow(answered(same_label, k), "group int, nth int, anchor long, partner long, partner_score long, id long, score long")
        rank = F.dense_rank().over(W.partitionBy("group", "nth", "partner", "partner_score").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).distinct()

    routes = f"group int, leaf int, items array<{item}>"
    positives = settle_table(searched(groups.mapInArrow(ask_positives, routes), True, n_positives))
    held = positives.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("positives"))
    asked = groups.join(held, "group").mapInArrow(ask_negatives, routes)
    negatives = searched(asked, False, n_negatives)
    return negatives.select(F.col("anchor").alias("anchor_id"), F.col("partner").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("partner_score").alias("positive_score"), F.col("score").alias("negative_score"))
