"""Quality classifier: random-indexing word vectors pooled per document, then a small calibrated network.

Words are dealt into BUCKETS buckets, each with a sparse random +-1 index vector. A bucket's vector is its index vector plus the
index vectors met around its words in the sampled texts. A document is the mean of its words' vectors beside shares of byte
classes and counts of lines, repeated words and length. A two-layer network in numpy gives the logit, and one
temperature fitted on texts kept apart turns it into a probability.

The fit uses at most ``max_rows`` labelled rows, those with the smallest hash of the id; scoring covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import bounded_batches, sets_apart, settle, settle_table
from .wordhash import mix, slices, utf8, word_hashes

DIMS = 64
BUCKETS = 1 << 15
MAX_ROWS = 20_000
WINDOW = 2

# byte classes: 0 space, 1 lower or non-ASCII, 2 upper, 3 digit, 4 and above: one class per symbol
_class = np.full(256, 1, np.uint8)
_class[:33] = 0
_class[33:127] = np.arange(4, 98)
_class[48:58], _class[65:91], _class[97:123] = 3, 2, 1
SHAPES = 128


def index_matrix(rows: int, dims: int = DIMS, ones: int = 8) -> np.ndarray:
    """Sparse ternary index vectors."""
    rng = np.random.default_rng(11)
    out = np.zeros((rows, dims), np.float32)
    at = rng.integers(0, dims, (rows, ones))
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (rows, ones)), axis=1)
    return out


def _tokens(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, first word of each row)."""
    hashes, firsts = word_hashes(raw, bounds)
    return (mix(hashes) % np.uint64(BUCKETS)).astype(np.int64), firsts


def _shapes(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Share of each byte class, per row; then lines, repeated words and length."""
    out = np.zeros((len(bounds) - 1, SHAPES), np.float32)
    for i in range(len(bounds) - 1):
        b = raw[bounds[i] : bounds[i + 1]]
        if len(b):
            c = _class[b]
            out[i, :98] = np.bincount(c, minlength=98) / len(b)
            out[i, 100] = (b == 10).mean()
            out[i, 101] = ((c[1:] == 2) & (c[:-1] == 2)).mean() if len(b) > 1 else 0
    return out


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Feature rows of a text column; an empty text has zeros."""
    raw, bounds = utf8(column)
    rows = []
    for lo, hi in slices(bounds):
        words, firsts = _tokens(raw, bounds[lo : hi + 1])
        shape = _shapes(raw, bounds[lo : hi + 1])
        mean = np.zeros((hi - lo, vectors.shape[1]), np.float32)
        for i in range(hi - lo):
            w = words[firsts[i] : firsts[i + 1]]
            if len(w):
                distinct, counts = np.unique(w, return_counts=True)
                mean[i] = counts.astype(np.float32) @ vectors[distinct] / len(w)
                shape[i, 102] = len(distinct) / len(w)
                shape[i, 103] = np.log1p(len(w)) / 10
                shape[i, 104] = (counts[counts > 1].sum() / len(w)) if len(w) > 1 else 0
                shape[i, 105] = len(np.unique(w[1:] * BUCKETS + w[:-1])) / max(1, len(w) - 1)
        rows.append(np.hstack([mean, shape]))
    return np.vstack(rows) if rows else np.zeros((0, vectors.shape[1] + SHAPES), np.float32)


def word_vectors(texts: DataFrame, dims: int = DIMS) -> np.ndarray:
    """Index plus context vectors. Each task sums the contexts of its rows per bucket; there are BUCKETS rows."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index_matrix(BUCKETS, dims)
        total = np.zeros((BUCKETS, dims), np.float32)
        for batch in batches:
            raw, bounds = utf8(batch.column(0))
            for lo, hi in slices(bounds):
                words, firsts = _tokens(raw, bounds[lo : hi + 1])
                row = np.repeat(np.arange(hi - lo), np.diff(firsts))
                for step in range(1, WINDOW + 1):
                    together = np.flatnonzero(row[step:] == row[:-step])
                    for centre, other in ((words[together], words[together + step]), (words[together + step], words[together])):
                        order = np.argsort(centre, kind="stable")
                        for at in range(0, len(order), 1 << 16):
                            part = order[at : at + (1 << 16)]
                            heads = np.flatnonzero(np.diff(centre[part], prepend=-1))
                            total[centre[part][heads]] += np.add.reduceat(own[other[part]], heads, axis=0)
        used = np.flatnonzero(total.any(axis=1))
        if len(used):
            whole = np.rint(total[used]).astype(np.int64)
            yield pa.record_batch({"bucket": used.astype(np.int64)} | {c: np.ascontiguousarray(whole[:, i]) for i, c in enumerate(places)})

    # one row per bucket, a column per place: a quarter of the bytes of a row per place
    places = [f"c{i}" for i in range(dims)]
    sums = texts.mapInArrow(contexts, ", ".join(f"{c} long" for c in ("bucket", *places))).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in places])
    sums = sums.select("bucket", F.array(*places).alias("v"))
    own = index_matrix(BUCKETS, dims)
    for r in sums.toLocalIterator():  # at most BUCKETS rows
        v = np.array(r["v"], np.float32)
        own[r["bucket"]] += v / max(1e-9, float(np.linalg.norm(v))) * np.sqrt(8)
    return own / np.maximum(1e-9, np.linalg.norm(own, axis=1, keepdims=True))


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -40, 40)))

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.maximum(0, (features - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2


def _network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 30, seed: int = 5) -> tuple:
    """Adam on the logistic loss of a two-layer network."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            i = order[at : at + 128]
            h = np.maximum(0, x[i] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[i]) / len(i)
            back = np.outer(error, p[2]) * (h > 0)
            grads = [x[i].T @ back + 1e-4 * p[0], back.sum(0), h.T @ error + 1e-4 * p[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def sample_labels(labels: DataFrame, label: str = "quality", key: str = "doc_id", max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` (key, label) rows, those of the smallest id hashes: chosen before any text is read, small enough to broadcast."""
    rank = F.xxhash64(F.col(key), F.lit(1))
    return settle(labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, label).orderBy(rank, label).limit(max_rows))


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", max_rows: int = MAX_ROWS) -> QualityModel:
    """Fits on at most ``max_rows`` rows that have a label, those of the smallest id hashes. Rows alike in id, text and label count once;
    null texts are empty. Without any row, every score will be 0.5."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("double").alias("label"), F.xxhash64(F.col(key), F.lit(1)).alias("rank"), F.xxhash64(text).alias("print"))
    rows = settle_table(rows.dropDuplicates(["rank", "print", "label"]))  # read several times below
    if rows.count() > max_rows:  # only numbers are sorted
        order = F.struct("rank", "print", "label")
        last = rows.select(order.alias("o")).orderBy("o").limit(max_rows).agg(F.max("o").alias("o")).first()["o"]
        rows = rows.where(order <= F.struct(*[F.lit(v) for v in last]))
    vectors = word_vectors(rows.select("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = pooled(batch.column(0), vectors)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array([r.tobytes() for r in f], pa.binary())], names=["rank", "label", "f"])

    got = rows.mapInArrow(features, "rank long, label double, f binary").collect()  # max_rows vectors
    width = vectors.shape[1] + SHAPES
    if not got:
        return QualityModel(vectors, np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    got.sort(key=lambda r: (r["rank"], bytes(r["f"]), r["label"]))
    x = np.stack([np.frombuffer(r["f"], np.float32) for r in got]).astype(np.float64)
    y = np.array([r["label"] for r in got])
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-6, scale, 1)
    z = (x - mean) / scale
    apart = np.arange(len(z)) % 5 == 4 if len(z) >= 50 else np.zeros(len(z), bool)
    model = QualityModel(vectors, mean, scale, *_network(z[~apart], y[~apart]), 1.0)
    if apart.any():
        logits = model.logits(x[apart])
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, -np.where(y[apart] > 0.5, 1, -1) * logits / t)) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


@sets_apart("__text")
def score(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``.

    Null and empty texts are scored from zero features; a text is pooled whole, however long. Repeated rows are rows; an empty table gives none; columns named like an output are
    replaced.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.drop(*[c for c in ("score", "predicted", "__text") if c != text])
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIMS floats: 8 MB

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = m.probability(pooled(batch.column(batch.schema.get_field_index("__text")), m.vectors))
            rest = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                names=[*rest, "score", "predicted"],
            )

    return kept.withColumn("__text", F.col(text)).mapInArrow(apply, schema)
