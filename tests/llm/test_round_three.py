"""Operators 11 to 13: against the library, brute force and small cases of every kind."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracefold.llm import bpe, hard_negatives, periodic_runs, registry

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (None, "one two three"), (7, LONG), (7, LONG), (8, "$$$ !!! 123 \U0001f600"), (9, "a" * 5000), (10, "漢字" * 3000), (11, "it's  we'll   x \n\n y"), (12, "a b c d " * 9)]
CLASHING = "doc_id long, text string, ids string, runs string, collapsed string, n_words string, c0 string, body string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *["kept"] * 6) for r in ODD], CLASHING).cache()


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(registry.multi_ranks_path())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def test_bpe_query_equals_the_library(spark, library):
    want = {}
    for d, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(text or "")
        want[d] = (len(ids), sha(",".join(map(str, ids))), sha(text or ""))
    got = registry.op11_byte_bpe(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("words", [bpe.WORDS, 3, 0])
def test_bpe_of_odd_rows_with_any_dictionary(spark, odd, ranks, library, words):
    got = bpe.encode(odd, ranks, public_tokenizers.PATTERN, words=words)
    assert got.columns == ["doc_id", "text", "runs", "collapsed", "n_words", "c0", "body", "ids"]
    rows = got.withColumn("back", bpe.decode(F.col("ids"), ranks)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["back"]) == (r["text"] or "").encode() and r["c0"] == "kept"


def test_bpe_of_nothing(spark, odd, ranks):
    assert bpe.encode(odd.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_folded_words_are_the_merged_ones(spark, ranks, library):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéßñ漢１ \n'st.") for _ in range(rnd.randint(0, 25))) for _ in range(500)] + ["a" * 2000, " the", "'s", "\U0001f600" * 9]
    got = bpe.fold_words(spark.createDataFrame([(w,) for w in set(words)], "word string"), ranks).collect()
    for r in got:
        want = bpe._merged(r["word"].encode(), ranks) if r["word"] else []
        assert r["ids"] == want == (library._encode_single_piece(r["word"]) if r["word"] else [])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.integers(0, 300))
def test_words_of_any_length_merge_alike(ranks, text, n):
    word = (text * (1 + n // max(1, len(text)))).encode()
    if word and word not in ranks:
        assert bpe._merged_long(word, ranks) == tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece(word)


def test_the_commonest_words_are_chosen_by_documents(spark, ranks):
    docs = spark.createDataFrame([(1, "aa bb bb bb"), (2, "aa cc"), (3, "aa cc dd")], "doc_id long, text string")
    assert {r["word"] for r in bpe.dictionary(docs, ranks, public_tokenizers.PATTERN, words=2).collect()} == {"aa", " cc"}
    assert bpe.dictionary(docs, ranks, public_tokenizers.PATTERN, words=1).count() == 1


# 12


def mined(rows, n_positives=5, n_negatives=10):
    """rows of (id, label, vector, is_anchor), by sorting all of them for each anchor."""
    rows = list(dict.fromkeys((i, la, tuple(v), bool(a)) for i, la, v, a in rows if i is not None and la is not None and v is not None and None not in v))
    rows = {r[:3]: r[3] or (*r[:3], True) in rows for r in rows}
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for (i, la, v), anchor in rows.items():
        if anchor:
            scored = sorted({(-dot(v, w), j, lb) for j, lb, w in rows if j != i})
            positives = list(dict.fromkeys((j, -s) for s, j, lb in scored if lb == la))[:n_positives]
            for p, ps in positives:
                near = list(dict.fromkeys((j, -s) for s, j, lb in scored if lb != la and 30 * ps <= -100 * s <= 90 * ps))[:n_negatives]
                out |= {(i, p, n + 1, j, ps, s) for n, (j, s) in enumerate(near)}
    return sorted(out)


POINTS = "id long, label long, vector array<long>, is_anchor boolean, score string, leaf string, v string"


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], POINTS)
    return sorted(map(tuple, hard_negatives.mine(df, **options).collect()))


def test_negatives_query_equals_brute_force(spark):
    rows = []
    for i, v, la in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect():
        rows.append((i, (la + 1) % 10 if i % 7 == 0 else la, [int(np.floor(256 * float(x))) for x in v], i % 100 == 0))
    assert sorted(map(tuple, registry.op12_hard_negatives(spark, SF).collect())) == mined(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_with_a_small_tree_of_clusters_ties_and_copies(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "LEAF_BLOCK", 8)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)
    rnd = random.Random(seed)
    centres = [[rnd.randint(-40, 40) for _ in range(5)] for _ in range(6)]
    rows = [(i, rnd.randint(0, 3), [c + rnd.randint(-3, 3) for c in rnd.choice(centres)], i % 9 == 0) for i in range(300)]
    rows += [(i, 1, [7, 7, 7, 7, 7], i % 50 == 0) for i in range(300, 400)]
    rows += rows[:20] + [(None, 1, [1, 2, 3, 4, 5], True), (500, None, [1, 2, 3, 4, 5], True), (501, 1, None, True), (502, 1, [1, None, 3, 4, 5], True), (503, 1, [], True), (504, 2, [0, 0, 0, 0, 0], True), (505, 2, [9, 9], True)]
    small = hard_negatives.Tree
    monkeypatch.setattr(hard_negatives, "Tree", lambda sample, greatest: small(sample, greatest, 4, 12))
    assert found(spark, rows) == mined(rows)
    assert found(spark, rows, sample_rows=40) == mined(rows)


def test_the_tree_leaves_siblings_out():
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(20, 8)) * 100
    x = np.concatenate([c + rnd.normal(size=(50, 8)) for c in centres])
    tree = hard_negatives.Tree(x, float((x**2).sum(1).max()), 5, 60)
    met = {}
    leaf = tree.place(x, met)
    for n, (near, far) in met.items():
        tree.nodes[n].near, tree.nodes[n].far = near, far
    a = x[::50]
    d = np.sqrt(np.maximum((a**2).sum(1)[:, None] + tree.greatest - 2 * a @ x.T, 0))
    outer = np.sort(d, axis=1)[:, 9]
    kept = [(at, r) for at, rows in tree.survivors(a, np.zeros(len(a)), outer) for r in rows.tolist()]
    assert len(kept) < 0.5 * len(a) * tree.leaves
    assert {(int(leaf[j]), i) for i in range(len(a)) for j in np.flatnonzero(d[i] <= outer[i])} <= set(kept)


def test_negatives_of_nothing_and_scores_too_large(spark):
    assert found(spark, [(1, 1, [1, 2], True)]) == []
    assert hard_negatives.mine(spark.createDataFrame([], POINTS)).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.products(np.full((1, 2), 2**40), np.full((1, 2), 2**40))
    big = 2**27
    assert hard_negatives.products(np.full((1, 2), big), np.full((1, 2), big - 1)).tolist() == [[2 * big * (big - 1)]]


# 13


def runs(words, least=12):
    best = {}
    n = len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                best.setdefault((i, j + p), p)
            i = j
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_query_equals_brute_force(spark):
    want, planted = {}, 0
    for d, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = word_list(text)
        h, n = zlib.crc32(str(d).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], planted + 1
        if n > 1500:
            continue
        r = runs(w)
        best = max(r, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        want[d] = (len(r), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in r)), sha(collapsed(w, r)))
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.op13_periodic_runs(spark, SF).collect()}
    assert planted > 5 and {d: got[d] for d in want} == want
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_runs_of_odd_rows(spark, odd):
    out = periodic_runs.collapse_runs(odd)
    assert out.columns == ["doc_id", "text", "ids", "c0", "body", "n_words", "runs", "collapsed"]
    got = out.collect()
    assert len(got) == len(ODD)
    for r in got:
        w = word_list(r["text"])
        assert r["n_words"] == len(w) and r["c0"] == "kept"
        if len(w) < 2000:
            assert [tuple(x) for x in r["runs"]] == runs(w) and r["collapsed"] == collapsed(w, runs(w))
    # 20,000 words of period 12,701 are not two periods
    assert [list(r["runs"]) for r in got if r["text"] == LONG] == [[], []]
    assert periodic_runs.collapse_runs(odd.limit(0)).count() == 0


def test_a_very_long_document_of_long_runs(spark):
    words = [f"w{i}" for i in range(30_000)]
    text = " ".join(words * 3 + ["end"] + ["a", "b"] * 10_000)
    r = periodic_runs.collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 90_000, 30_000), (90_001, 20_000, 2)]
    assert r["collapsed"] == " ".join([*words, "end", "a", "b"])


def block(rnd, depth):
    if not depth:
        return [rnd.randint(0, 2) for _ in range(rnd.randint(1, 4))]
    b, r = block(rnd, depth - 1), rnd.random()
    if r < 0.6:
        b = b * rnd.randint(1, 9)
        b = b[: len(b) - rnd.randint(0, min(3, len(b) - 1))]
    b = b + block(rnd, 0) if r > 0.4 else b
    return block(rnd, 0) + b if r > 0.8 else b


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_repetitive_sequences(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        x = (block(rnd, rnd.randint(1, 6)) * rnd.choice([1, 2, 2, 3]))[:700]
        if len(x) > 1:
            got = periodic_runs.runs_of(np.array(x), len(x))
            assert [(s, e - s, p) for s, e, p in got.tolist()] == runs(x)


@pytest.mark.parametrize("first, second", [([0], [0, 1]), ([1, 0, 1], [1, 0, 1, 1, 0])])
def test_runs_of_fibonacci_words(first, second):
    while len(second) < 900:
        first, second = second, second + first
    got = periodic_runs.runs_of(np.array(second), len(second))
    assert [(s, e - s, p) for s, e, p in got.tolist()] == runs(second)


# earlier operators keep the caller's columns, whatever they are called


INNER = ["__text", "found", "__marks", "__t", "__size", "__print", "__key", "__c0", "c0", "t", "h", "tie", "print"]


@pytest.fixture(scope="module")
def named(spark):
    rows = [(i, f"the same words again and again in row {i % 3} " * 9, "en", "a", 0, *[f"{n}{i}" for n in INNER]) for i in range(8)] + [(9, None, None, None, 0, *INNER), (None, "", "de", "b", 1, *INNER)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, quality int, {', '.join(f'`{n}` string' for n in INNER)}").cache()


@pytest.mark.parametrize("name", ["language", "mix", "benchmark", "quality", "repeats"])
def test_columns_of_inner_names_stay(spark, named, name):
    from tracefold.llm import decontaminate, language_id, mixing, quality_model, suffix_dedup

    items = spark.createDataFrame([(1, "the same words again and again in row 1")], "item_id long, text string")
    runs = {
        "language": lambda d, **k: language_id.identify(d, language_id.train_prototypes(named), **k), "mix": lambda d, **k: mixing.mix_sources(d, **k), "benchmark": lambda d, **k: decontaminate.decontaminate(d, items, **k),
        "quality": lambda d, **k: quality_model.score(d, quality_model.fit(named), **k), "repeats": lambda d, **k: suffix_dedup.remove_repeats(d, **k),
    }
    got = runs[name](named)
    key = ["doc_id", *INNER]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, named.select(*key).collect()))
    plain = runs[name](named.select("doc_id", "text", "lang", "source", "quality"))
    new = [c for c in plain.columns if c not in ("lang", "source", "quality", "text")]
    assert sorted(map(str, got.select(*new).collect())) == sorted(map(str, plain.select(*new).collect()))
    other = runs[name](named.drop("__text").withColumnRenamed("text", "__text"), text="__text")
    assert sorted(map(str, other.select(*new).collect())) == sorted(map(str, plain.select(*new).collect())) and "__text" in other.columns
