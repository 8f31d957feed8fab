"""Language identification with hyperdimensional profiles.

Every letter has a random +-1 vector. A trigram is the element-wise product of its letters' vectors, each rotated
by its place; a text is the sum of its trigrams' vectors, a language prototype the sum of its training texts'
unit vectors. A text gets the language whose prototype has the highest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import bounded_batches, kept_by, sets_apart

DIMENSIONS = 1024
_BREAK = 32
_GROUP_CHARS = 1 << 18


def letter_vector(code: int, dims: int = DIMENSIONS) -> np.ndarray:
    """The random +-1 vector of a code point; the same on every machine."""
    cache = kept_by("language_id")
    key = code * 100_003 + dims
    if key not in cache:
        if len(cache) > 20_000:
            cache.clear()
        cache[key] = (np.random.default_rng([7, code]).integers(0, 2, dims) * 2 - 1).astype(np.int8)
    return cache[key]


def _letters(text: str) -> np.ndarray:
    """Lower-cased code points; every run of other characters becomes one break."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, inverse = np.unique(codes, return_inverse=True)
    is_letter = np.array([chr(c).isalpha() for c in alphabet], bool)
    codes = np.where(is_letter[inverse], codes, np.uint32(_BREAK)) if len(codes) else codes
    padded = np.concatenate([[_BREAK], codes, [_BREAK]]).astype(np.int64)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != _BREAK) | (padded[:-1] != _BREAK)
    return padded[keep]


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams, packed in 63 bits, and their counts. Empty without a letter."""
    c = _letters(text)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:], return_counts=True)


def ngram_matrix(codes: np.ndarray, dims: int) -> np.ndarray:
    """One bound vector per packed trigram."""
    mask = (1 << 21) - 1
    parts = [codes >> 42, codes >> 21 & mask, codes & mask]
    out = np.ones((len(codes), dims), np.int8)
    for place, part in enumerate(parts):
        alphabet, inverse = np.unique(part, return_inverse=True)
        vectors = np.stack([np.roll(letter_vector(int(a), dims), 2 - place) for a in alphabet]) if len(alphabet) else np.zeros((0, dims), np.int8)
        out *= vectors[inverse]
    return out


def unit_vectors(texts: list[str | None], dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, unit vectors) of consecutive rows; a text without letters has a zero vector."""
    lo = 0
    while lo < len(texts):
        hi, chars, counted = lo, 0, []
        while hi < len(texts) and (hi == lo or chars < _GROUP_CHARS) and hi - lo < 256:
            counted.append(trigram_counts(texts[hi] or ""))
            chars += len(texts[hi] or "")
            hi += 1
        every = np.unique(np.concatenate([c for c, _ in counted]))
        out = np.zeros((hi - lo, dims), np.float32)
        for at in range(0, len(every), 4096):  # bounded blocks of trigrams
            block = every[at : at + 4096]
            weights = np.zeros((hi - lo, len(block)), np.float32)
            for i, (codes, counts) in enumerate(counted):
                a, b = np.searchsorted(codes, [block[0], block[-1] + 1])
                weights[i, np.searchsorted(block, codes[a:b])] = counts[a:b]
            out += weights @ ngram_matrix(block, dims).astype(np.float32)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        yield lo, out / np.where(norms > 0, norms, 1)
        lo = hi


def train_prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototype per language from every row with text and language.

    Each task sums its rows per language; the driver gets one vector per language.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lo, vectors in unit_vectors(batch.column(0).to_pylist(), dims):
                here = langs[lo : lo + len(vectors)]
                for name in set(here):
                    sums[name] = sums.get(name, 0) + vectors[here == name].sum(axis=0, dtype=np.float64)
        for name, total in sums.items():
            # whole numbers, so that the order of summing does not matter
            yield pa.record_batch({"lang": [name] * dims, "place": np.arange(dims, dtype=np.int32), "total": np.rint(total * 1e6).astype(np.int64)})

    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang))
    sums = rows.mapInArrow(bundle, "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x dimensions rows
        out.setdefault(r["lang"], np.zeros(dims))[r["place"]] = r["total"]
    return {k: (v / n).astype(np.float32) for k, v in sorted(out.items()) if (n := np.linalg.norm(v)) > 0}


@sets_apart("__text")
def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dims: int = DIMENSIONS) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (cosine, cut at 0).

    Null texts, texts without a letter and an empty set of prototypes give ``und`` and 0. Equal cosines go to the
    first language by name. Repeated rows are rows; columns named like an output are replaced.
    """
    bounded_batches(docs.sparkSession)
    names = list(prototypes)
    matrix = np.stack([prototypes[k] for k in names], axis=1) if names else np.zeros((dims, 0), np.float32)

    def predict(batches: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            for lo, vectors in unit_vectors(texts, dims) if names else ():
                cosines = vectors @ matrix
                for i, k in enumerate(cosines.argmax(axis=1)):
                    if vectors[i].any():
                        langs[lo + i], scores[lo + i] = names[k], min(1.0, max(0.0, float(cosines[i, k])))
            rest = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(langs, pa.string()), pa.array(scores)],
                names=[*rest, "lang_pred", "score"],
            )

    kept = docs.drop(*[c for c in ("lang_pred", "score", "__text") if c != text])
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.withColumn("__text", F.col(text)).mapInArrow(predict, schema)
