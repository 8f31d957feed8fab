"""Operator 11 codes a batch of texts together and keeps the dictionary as one array."""

import pyarrow as pa
import public_tokenizers

from tracefold.llm import bpe, registry

RANKS = bpe.read_ranks(registry.multi_ranks_path())
WORDS = [" the", "the", ",", " rare-", " été", " 12", "\n"]


def coder(words):
    ids = [bpe._merged(w.encode(), RANKS) for w in words]
    table = pa.table({"word": pa.array(["no", *words], pa.string()), "ids": pa.array([[1, 2, 3], *ids], pa.list_(pa.int32()))})
    return bpe.RankEncoder(RANKS, public_tokenizers.PATTERN, table.slice(1))


def test_the_dictionary_is_one_array():
    texts = ["the été, the rare-12 zyzzogeton\n", "", None, "  two  spaces the", " the", "the", "a\tb the ", "x" * 300]
    split = bpe.regex.compile(public_tokenizers.PATTERN).findall
    want = [[i for w in split(t or "") for i in bpe._merged(w.encode(), RANKS)] for t in texts]
    for words in (WORDS, []):
        e = coder(words)
        assert all(isinstance(x, int) for x in e.words.values()) and len(e.words) == len(words)  # a list of ids for each word took most of a worker's memory
        assert [x.tolist() for x in e.rows(pa.array(texts))] == want and [e(t or "").tolist() for t in texts] == want


def test_a_piece_is_split_once_a_slice(monkeypatch):
    monkeypatch.setattr(bpe.RankEncoder, "LIMIT", 0)
    e, seen = coder([]), []
    e.split = lambda t, split=e.split: seen.append(t) or split(t)
    want = e("so end-point, done").tolist()
    seen.clear()
    assert [x.tolist() for x in e.rows(pa.array(["so end-point, done"] * 300))] == [want] * 300
    assert len(seen) <= 3


def test_batches_are_coded_as_texts_are(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["so end-point, done", None, "", "the  end", "été"] * 300)], "doc_id int, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN, words=2).collect()}
    e = coder([])
    assert len(got) == 1500 and all(got[r.doc_id] == e(r.text or "").tolist() for r in docs.collect())
