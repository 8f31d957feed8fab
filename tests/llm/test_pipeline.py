import zlib
from functools import cache

import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq

from tests.llm import brute
from tests.llm.test_whole_job import _best, _grams
from tracefold.llm import registry

SF = "/root/testdata/sf0.001"


@cache
def _items():
    return [w for t in pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist() if (w := brute.words((t or "").lower()))]


@cache
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.tokenizer_path())


def _contaminated(text):
    """A search over all windows of the items that share most shingles with the text."""
    words = brute.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    held = _grams(words)
    for item in _items():
        mine = _grams(item)
        if sum((mine & held).values()) >= 0.8 * sum(mine.values()):
            at = [i for i in range(len(words) - 4) if tuple(words[i : i + 5]) in mine]
            if not at or any(_best(item, words[max(0, i) : i + 2 * len(item)]) >= 0.8 for i in at[:: max(1, len(item) // 8)]):
                return True
    return False


def _encoded(doc_id, text):
    ids = [*_tokenizer().encode(text or "", add_special_tokens=False).ids, registry.END_ID]
    return doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "mix", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} if name != "tokens" else {}
        n = docs.count()
        texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        out = f"{registry.shared_folder(spark)}-{name}"
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "language":
            assert docs.count() >= 0.97 * n
        if name == "near_duplicates":
            want = {d for d, c in brute.components(sorted(before.items())).items() if d == c}
            assert {r["doc_id"] for r in docs.collect()} == want and len(want) < n
        if name == "benchmark":
            held = {r["doc_id"] for r in docs.collect()}
            assert held == {d for d in before if not _contaminated(before[d])} and len(held) < n
        if name == "mix":
            total = sum(len(brute.words(t)) for t in before.values())
            taken = sum(len(brute.words(r["text"])) for r in docs.collect())
            assert abs(taken - 1.5 * total) < 0.05 * total
        if name == "tokens":
            assert docs.count() == n
            assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in docs.collect()) == sorted(_encoded(d, t) for d, t in texts)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_rows_that_share_an_id_or_have_none(spark):
    """Different texts of one id are different documents; of alike ones, and of copies without an id, one stays."""
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (1, other), (1, other), (2, long), (None, long), (None, other), (None, "a b"), (None, "a b"), (3, None), (4, ""), (5, "c d")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    texts = [t for _, t in got]
    assert texts.count(long) == 1 and (2, long) in got and texts.count(other) == 1 and texts.count("a b") == 1
    assert (3, None) in got and (4, "") in got and (5, "c d") in got and len(got) == 6
