"""Operators 1 and 5 against plain restatements: trigram vectors letter by letter, features and network word by word."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracefold.llm import language_id, quality_model, registry
from tracefold.llm.base import id_remainder
from tracefold.llm.wordhash import mix, utf8, word_hashes

SF = "/root/testdata/sf0.001"


def profile(text, known):
    """The sum of a text's trigram vectors, each the product of its letters' vectors, turned by their place."""
    letters, out = [" "], np.zeros(language_id.DIMENSIONS)
    for c in (text or "").lower() + " ":
        c = c if c.isalpha() else " "
        if c != " " or letters[-1] != " ":
            letters.append(c)
    for gram, n in Counter(zip(letters, letters[1:], letters[2:])).items():
        if gram not in known:
            turned = [np.roll(language_id.letter_vector(ord(c)).astype(int), 2 - place) for place, c in enumerate(gram)]
            known[gram] = turned[0] * turned[1] * turned[2]
        out += n * known[gram]
    return out / (np.linalg.norm(out) or 1)


def test_language_query_equals_a_restatement(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    known = {}
    units = {r["doc_id"]: profile(r["text"], known) for r in rows}
    prototypes = {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            prototypes[r["lang"]] = prototypes.get(r["lang"], 0) + units[r["doc_id"]]
    prototypes = {k: v / np.linalg.norm(v) for k, v in sorted(prototypes.items())}
    got = {r["doc_id"]: r for r in registry.op1_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    for d, unit in units.items():
        cosines = {k: float(unit @ v) for k, v in prototypes.items()}
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        if not unit.any():
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0)
            continue
        assert abs(cosines[got[d]["lang_pred"]] - max(cosines.values())) < 1e-5
        assert abs(got[d]["score"] - max(0.0, max(cosines.values()))) < 1e-4


def test_quality_query_equals_a_restatement(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").where(id_remainder(F.col("doc_id"), 5) != 0)
    model = quality_model.fit(docs.join(quality_model.sample_labels(labels), "doc_id"))
    got = {r["doc_id"]: r for r in registry.op5_quality_model(spark, SF).collect()}

    def bucket(word):
        return int(mix(word_hashes(*utf8(pa.array([word])))[0])[0] % np.uint64(quality_model.BUCKETS))

    for d, text in docs.limit(60).collect():
        raw, bounds = utf8(pa.array([text or ""]))
        words = [w.decode() for w in (text or "").encode().split()]
        mean = sum((model.vectors[bucket(w)].astype(float) for w in words), np.zeros(model.vectors.shape[1])) / max(1, len(words))
        shape = quality_model.pooled(pa.array([text or ""]), model.vectors)[0, len(mean) :]
        x = (np.concatenate([mean, shape]) - model.mean) / model.scale
        hidden = [max(0.0, float(x @ model.w1[:, j]) + model.b1[j]) for j in range(model.w1.shape[1])]
        logit = sum(h * w for h, w in zip(hidden, model.w2)) + model.b2
        want = 1 / (1 + np.exp(-np.clip(logit / model.temperature, -40, 40)))
        assert abs(got[d]["score"] - want) < 1e-3 and got[d]["predicted"] == int(got[d]["score"] >= 0.3)
        assert len(raw) == bounds[-1]
