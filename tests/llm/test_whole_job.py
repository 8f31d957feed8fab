"""Results that earlier forms of the operators left out, against full searches."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import decontaminate, pii


def _grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def _jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def _best(item, words):
    """The similarity of the best window, over all windows of every length."""
    mine, n = _grams(item), len(item)
    return max((_jaccard(mine, _grams(words[a:b])) for a in range(len(words)) for b in range(a + 1, min(len(words), a + 2 * n) + 1)), default=0.0)


# 4


def test_decontamination_equals_a_search_over_all_lengths(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(400)]
    pick = lambda n: rng.choice(vocabulary, n).tolist()
    items = [pick(n) for n in (3, 5, 6, 14, 25, 40, 44, 58)] + [["la", "di"] * 10]
    texts = []
    for x in items:
        n = len(x)
        cut = max(1, n // 12)
        forms = [x, x[cut:], x[:-cut], x[cut : n - cut], x[:n // 2] + x[n // 2 + 3 :], x[:n // 2] + pick(3) + x[n // 2 :], x[:n // 2] + pick(1) + x[n // 2 :], x + x]
        texts += [f for f in forms]
        texts += [pick(12) + f + pick(9) for f in forms]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], m["item_id"]): m for r in decontaminate.decontaminate(docs, bench).collect() for m in r["matches"]}
    want = {(d, i): s for d, w in enumerate(texts) for i, x in enumerate(items) if (len(x) < 5 or _grams(x) & _grams(w)) and (s := _best(x, w)) >= 0.8}
    assert set(got) == set(want) and len(want) >= 70
    for (d, i), m in got.items():
        assert m["similarity"] == pytest.approx(want[d, i])
        assert _jaccard(_grams(items[i]), _grams(texts[d][m["first_word"] : m["first_word"] + m["n_words"]])) == pytest.approx(m["similarity"])


# 7


def test_terms_far_from_their_entity_disclose(spark):
    far = " plain words of filling" * 8
    data = [(i, f"Zorblax{far} mail zed@corp.org or call +1 555 123 4567 please") for i in range(6)]
    data += [(10 + i, f"mail and call please{far} number {i}") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(df.withColumn("body", F.col("text")), text="body").collect()}
    for i in range(6):
        terms = {data[i][1][s["start"] : s["end"]] for s in got[i] if s["kind"] == "term"}
        assert terms == {"Zorblax", "zed", "corp", "org"}  # the address gives the number away
    assert not any(got[10 + i] for i in range(60))
