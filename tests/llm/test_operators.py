import hashlib
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tracefold.llm import chat, collection_bwt, decontaminate, jaccard, language_id, mixing, pii, quality_model, quality_rules, registry, suffix_dedup, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]


LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))
ODD_ROWS = [
    (1, None, None, None, "x"),
    (2, "", "en", "a", "x"),
    (3, " \n\t ", "en", "a", "x"),
    (4, "one two three", None, "a", "x"),
    (5, "One TWO three", "en", None, "x"),
    (None, "one two three", "en", "b", "x"),
    (6, LONG, "de", "b", "x"),
    (7, LONG, "de", "b", "x"),
    (7, LONG, "de", "b", "x"),
    (8, "$$$ !!! 123 \U0001f600", "fr", "c", "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *keys):
    return sorted((tuple(r) for r in df.select(*keys).collect()), key=str)


# 1


def test_language_of_held_out_rows(spark):
    got = registry.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 200 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark, docs, odd, none):
    p = language_id.train_prototypes(docs)
    got = language_id.identify(odd, p).collect()
    assert len(got) == len(ODD_ROWS) and "score" in got[0]
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 8)} == {1: "und", 2: "und", 3: "und", 8: "und"}
    assert language_id.identify(none, p).count() == 0
    assert language_id.train_prototypes(none) == {}
    assert {r["lang_pred"] for r in language_id.identify(odd, {}).collect()} == {"und"}


def test_document_vector_is_the_sum_of_bound_trigrams():
    d = 256
    v = {c: language_id.letter_vector(ord(c), d).astype(int) for c in "ab "}
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in (" ab", "ab ", "b a", " a "))
    ((_, got),) = language_id.unit_vectors(["Ab, a"], d)
    assert np.allclose(got[0], want / np.linalg.norm(want), atol=1e-6)


# 2


def test_mixing_meets_targets(spark, docs):
    got = mixing.mix_sources(docs, columns=False).collect()
    sizes = {d: len(brute.words(t)) for d, t in ((r["doc_id"], r["text"]) for r in docs.collect())}
    assert len(got) == len(sizes) and all(r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in got)
    per = {}
    for r in got:
        per.setdefault(r["source"], [0, 0, r["source_size"], r["target"]])
        per[r["source"]][0] += r["taken"]
        per[r["source"]][1] += r["size"]
    assert all(x[1] == x[2] for x in per.values())
    total = sum(sizes.values())
    assert sum(x[3] for x in per.values()) == pytest.approx(1.5 * total)
    weights, open_sources, left, want = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(per))}, set(per), 1.5 * total, {}
    while open_sources:
        level = left / sum(weights[s] for s in open_sources)
        capped = {s for s in open_sources if level * weights[s] > 2 * per[s][1]}
        for s in capped or open_sources:
            want[s] = 2 * per[s][1] if capped else level * weights[s]
            left -= want[s]
        open_sources -= capped or set(open_sources)
    assert {s: x[3] for s, x in per.items()} == pytest.approx(want)
    assert all(abs(x[0] - x[3]) <= 0.03 * x[3] + 60 for x in per.values())
    again = mixing.mix_sources(docs.repartition(5), columns=False)
    assert rows(again, "doc_id", "taken") == sorted(((r["doc_id"], r["taken"]) for r in got), key=str)


def test_mixing_odd_rows(odd, none):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(ODD_ROWS) and all(r["taken"] == r["copies"] * r["size"] for r in got) and "score" in got[0]
    assert sum(r["taken"] for r in got if r["source"] is None) <= 2 * 3
    clash = mixing.mix_sources(odd.withColumn("size", F.lit("x")).withColumn("copies", F.lit("y")).withColumn("tie", F.lit("z")).withColumn("print", F.lit("p")))
    assert sorted(clash.columns) == sorted([*odd.columns, "tie", "print", "size", "source_size", "target", "copies", "taken"]) and {r["tie"] for r in clash.collect()} == {"z"}
    assert {r["copies"] for r in mixing.mix_sources(odd.where("doc_id = 7").unionByName(odd.where("doc_id = 7"))).collect()} <= {1, 2}
    assert mixing.mix_sources(none).count() == 0 and mixing.mix_sources(none, columns=False).count() == 0


# 3


def test_chats_read_back(spark):
    got = {r["conv_id"]: r for r in registry.op3_chat_format(spark, SF).collect()}
    by = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == brute.digest("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), brute.digest(loss))


def test_chat_odd_rows(spark):
    data = [(1, 0, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", " \n lead <s>[x]\\ tail \U0001f600 "), (None, 0, "assistant", "a"), (2, 0, "we]ird\n<", "\\l\\\\"), (3, 0, "assistant", "b" * 50_000)]
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string").withColumn("extra", F.lit(1))
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(df, registry.tokenizer_path())).collect()}
    said = " \n lead <s>[x]\\ tail \U0001f600 "
    assert got[1]["turns_sha256"] == brute.digest("\n\n" + "assistant\n\n" + f"assistant\n{said}\n")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(said), brute.digest(said))
    assert got[2]["turns_sha256"] == brute.digest("we]ird\n<\n\\l\\\\\n") and got[2]["loss_chars"] == 0
    assert got[None]["loss_chars"] == 1 and got[3]["loss_chars"] == 50_000
    assert chat.format_chats(df.limit(0), registry.tokenizer_path()).count() == 0


@given(st.lists(st.tuples(st.text(alphabet="a<[]\\\n/sl ", max_size=6), st.text(alphabet="ab<>[]\\/\n slé", max_size=12)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_render_parses_back(turns):
    assert chat.parse(chat.render(turns)[0]) == turns


# 4


def test_decontamination_finds_what_a_full_search_finds(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in registry.op4_decontaminate(spark, SF).collect()}
    want = set()
    items = [(r["item_id"], brute.words(r["text"].lower())) for r in bench.collect()]
    for d, t in texts:
        w = brute.words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        held = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for i, x in items:
            mine = [tuple(x[k : k + 5]) for k in range(len(x) - 4)]
            if sum(m in held for m in mine) >= 0.8 * len(mine):
                best = max(len(set(mine) & (s := {tuple(w[a + k : a + k + 5]) for k in range(len(x) - 4)})) / len(set(mine) | s) for a in range(max(1, len(w) - len(x) + 1)))
                if best >= 0.8:
                    want.add((d, i))
    assert want and want <= got and len(got - want) <= 0.1 * len(want) + 1


def test_decontamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two three"), (4, " ".join(LONG.split()[500:540]))], "item_id long, text string")
    got = {(r["doc_id"]): [m["item_id"] for m in r["matches"]] for r in decontaminate.decontaminate(odd, bench).collect()}
    assert got[4] == [3] and got[None] == [3] and got[6] == [4] and got[1] == [] and got[8] == []
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).where(F.size("matches") > 0).count() == 0


def test_every_fingerprint_within_the_radius_is_a_candidate():
    rng = np.random.default_rng(0)
    items = [(i, rng.integers(0, 1 << 63, 20, dtype=np.uint64)) for i in range(30)]
    c = decontaminate.ItemClass.build(20, items, decontaminate.RADIUS)
    prints = c.prints.copy()
    for k in range(len(prints)):
        for bit in rng.choice(64, decontaminate.RADIUS, replace=False):
            prints[k] ^= np.uint64(1) << np.uint64(bit)
    where, which = c.candidates(prints, decontaminate.RADIUS)
    assert set(zip(range(len(prints)), range(len(prints)))) <= set(zip(where.tolist(), which.tolist()))


# 5


def test_quality_of_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    got = registry.op5_quality_model(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([(r["score"] >= 0.3) == bool(r["quality"]) for r in got]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_quality_odd_rows(odd, none):
    labelled = odd.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    model = quality_model.fit(labelled)
    got = quality_model.score(odd, model).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_model.score(none, model).count() == 0
    few = quality_model.fit(labelled, max_rows=2)
    assert len(few.mean) == len(model.mean)
    blank = quality_model.fit(none.withColumn("quality", F.lit(1)))
    assert {r["score"] for r in quality_model.score(odd, blank).collect()} == {0.5}


# 6


def test_components_equal_brute_force(spark, docs, texts):
    got = {r["doc_id"]: r for r in registry.op6_jaccard_join(spark, SF).collect()}
    want = brute.components(texts)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(got[d]["n_shingles"] == len(brute.shingle_set(t)) for d, t in texts)


def test_components_of_made_up_near_copies(spark):
    rng = np.random.default_rng(3)
    data, base = [], []
    for g in range(12):
        n = int(rng.integers(3, 120))
        base = [f"w{rng.integers(0, 300)}" for _ in range(n)] if g % 3 else (base or ["a"] * 9)
        for _ in range(int(rng.integers(1, 9))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"w{rng.integers(0, 300)}"
            data.append((len(data), " ".join(w)))
    shared = " ".join(f"s{i}" for i in range(30))
    data += [(len(data) + i, f"{shared} t{i} u{i} v{i} x{i} y{i} z{i} q{i}") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert got == brute.components(data)


def test_words_of_like_polynomials_are_not_linked(spark):
    """A Thue-Morse word and its complement have the same value under every polynomial mod 2 ** 64."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    df = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_components_of_families_and_a_common_passage(spark):
    """Large groups of near copies whose members are not all alike, and many short texts with one passage."""
    rng = np.random.default_rng(8)
    data, base = [], [f"w{i}" for i in range(400)]
    for family in range(3):
        start = [f"f{family}x{i}" for i in range(120)]
        for _ in range(40):
            w = list(start)
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(0, len(w)))] = str(rng.choice(base))
            data.append((len(data), " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(24))
    data += [(len(data) + i, f"{passage} " + " ".join(rng.choice(base, int(rng.integers(3, 14))))) for i in range(80)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute.components(data)


def test_families_just_below_the_threshold_meet_in_the_matrix_only(spark, monkeypatch):
    """Texts of about 0.7 in common stay groups of one document: no row of the join with members is made for them, and the pairs proposed are the same."""
    rng = np.random.default_rng(11)
    data = []
    for family in range(6):
        base = [f"f{family}w{int(k)}" for k in rng.integers(0, 10**6, 200)]
        for k in range(8):
            words = list(base)
            for at in rng.choice(200, 3, replace=False):
                words[at] = f"x{family}_{k}_{at}"
            data.append((100 * family + k, " ".join(words)))
    seen = []

    def counted(placed, opened, pct, f=jaccard.member_pairs):
        several = opened.where("g_docs > 1").select("token", "g", F.col("rep").alias("a")).join(placed.select("token", F.col("grp").alias("g"), F.col("rep").alias("b")), ["token", "g"])
        every = opened.select("token", "g", F.col("rep").alias("a")).join(placed.select("token", F.col("grp").alias("g"), F.col("rep").alias("b")), ["token", "g"])
        out = f(placed, opened, pct)
        seen.append((several.count(), every.count(), out.count(), out.join(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti").count()))
        return out

    monkeypatch.setattr(jaccard, "member_pairs", counted)
    monkeypatch.setattr(jaccard, "MERGE_ROUNDS", 0)
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in data}
    want = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    want[a] = want[b] = min(want[a], want[b])
    assert got == want
    several, every, pairs, strange = seen[0]
    assert every > 0 and pairs > 0 and several < every and strange == 0


def test_components_odd_rows(odd, none):
    got = jaccard.jaccard_components(odd).collect()
    assert len(got) == len(ODD_ROWS)
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert by[(4, 1)] == by[(5, 1)] == by[(None, 1)] == 4 and by[(1, 0)] == 1 and by[(3, 0)] == 3
    assert {r["component_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
    assert jaccard.jaccard_components(none).count() == 0


# 7


def test_personal_data_equals_brute_force(spark, docs, texts):
    got = {r["doc_id"]: r for r in registry.op7_personal_data(spark, SF).collect()}
    for d, t in texts:
        want = brute.personal(t)
        assert got[d]["base_sha256"] == brute.digest(",".join(f"{k}:{a}:{b}" for k, a, b in want))
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        assert set(",".join(f"{k}:{a}:{b}" for k, a, b in want).split(",")) - {""} <= set(got[d]["spans"].split(","))


HARD = ["a@b.c@d.e f@g h.i@j.k..l", "1.2.3.4.5 1.2.3.256 0001.2.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567. +44 20 7946 0958 12 +1", "\U0001f600 x@y.zz \U0001f600 10.0.0.1", "1" * 9000, "a" * 9000 + "@b.c", "1 " * 5000, ".@-.-@-.-", None, "", "a@b.c_d@e.f"]


def test_personal_data_hard_texts(spark, odd, none):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for r in df.select("text", pii.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["s"]] == brute.personal(r["text"])
    assert pii.find_personal_data(odd).count() == len(ODD_ROWS)
    clash = pii.find_personal_data(odd.withColumn("base", F.lit(1)).withColumn("spans", F.lit(2)).withColumn("__row", F.lit(3)))
    assert clash.columns == [*odd.columns, "__row", "base", "spans"] and clash.count() == len(ODD_ROWS)
    assert pii.find_personal_data(none).count() == 0


def test_personal_data_of_a_text_full_of_it(spark):
    """The work grows with the matches of a text, not with their square."""
    many = " ".join(f"+1 555 {i:07d} a{i}@b.c 10.0.{i % 300}.1 {i}" for i in range(20_000))
    df = spark.createDataFrame([(1, many)], "doc_id long, text string")
    started = time.perf_counter()
    (row,) = df.select(pii.base_spans(F.col("text")).alias("s")).collect()
    assert time.perf_counter() - started < 60  # seconds; about 4 are needed, squared work takes many minutes
    assert [(s["kind"], s["start"], s["end"]) for s in row["s"]] == brute.personal(many)


def test_terms_that_disclose(spark):
    data = [(i, f"contact zorblax at zed@corp.org about item{chr(97 + i)} please") for i in range(6)]
    data += [(10 + i, f"please write about contact number {i} plain words") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = pii.find_personal_data(df.withColumn("body", F.col("text")), text="text").select("doc_id", pii.joined(F.col("spans")).alias("s"), pii.sanitise(F.col("text"), F.col("spans")).alias("clean")).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["s"] == "email:19:31,term:8:15" and by[0]["clean"] == "contact [TERM] at [EMAIL] about itema please"
    assert by[10]["s"] == ""


# 8


def removed(df, text="text", length=200):
    return {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, text, length=length).collect()}


def test_repeats_equal_brute_force(spark, docs, texts):
    got = {r["doc_id"]: r for r in registry.op8_suffix_dedup(spark, SF).collect()}
    for (d, t), gone in zip(texts, brute.repeats([t for _, t in texts], 200)):
        raw = (t or "").encode()
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("block", [256, 3])
def test_repeats_of_shared_passages(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 8))))
    passage = " ".join(word() for _ in range(90))
    data = []
    for i in range(30):
        cut = int(rng.integers(0, 150))
        data.append((i, " ".join(word() for _ in range(30)) + passage[cut : cut + 330] + " ".join(word() for _ in range(30))))
    data += [(100, "ab" * 400), (101, passage[:199]), (102, passage[:200])]
    got = removed(spark.createDataFrame(data, "doc_id long, text string"))
    for (d, t), gone in zip(data, brute.repeats([t for _, t in data], 200)):
        assert got[d]["kept"] == bytes(b for b, g in zip(t.encode(), gone) if not g), d


@given(st.lists(st.text(alphabet="abc", max_size=14), max_size=8))
@settings(max_examples=300, deadline=None)
def test_collection_transform_equals_sorted_suffixes(texts):
    """Transform and prefixes equal those of all suffixes sorted, ends of strings distinct and first; windows of 4 equal a count."""
    items = [x.encode() for x in texts]
    bwt, lcp = collection_bwt.build(items)
    rows = sorted(((*(b + len(items) for b in x[k:]), i), i, k) for i, x in enumerate(items) for k in range(len(x) + 1))
    assert bwt.tolist() == [items[i][k - 1] + 1 if k else 0 for _, i, k in rows]
    common = [next(n for n in range(99) if above[0][n] != here[0][n]) for above, here in zip(rows, rows[1:])]
    assert lcp.tolist()[1:] == common
    windows = [[x[i : i + 4] for i in range(len(x) - 3)] for x in items]
    seen = [w for x in windows for w in x]
    assert [m.tolist() for m in suffix_dedup.repeated_windows(items, 4)] == [[seen.count(w) > 1 for w in x] for x in windows]


def test_collections_outlive_their_task(spark):
    """Repeated windows are read back from the table of transforms, whatever the number of collections."""
    rng = np.random.default_rng(3)
    rows = [(part, part, c, 0, bytes(rng.integers(97, 99, 12).astype(np.uint8))) for part in range(40) for c in range(30)]
    df = spark.createDataFrame(rows, "part long, h long, c long, skip int, bytes binary")
    tables = suffix_dedup.transforms(df, 8)
    got = {(r["h"], r["c"]): r["runs"] for r in suffix_dedup.repeats_of(tables, 8).collect()}
    assert sum(len(r["items"]) for r in tables.collect()) == len(rows)
    for part in range(40):
        mine = [(c, x) for p, _, c, _, x in rows if p == part]
        seen = [x[i : i + 8] for _, x in mine for i in range(5)]
        for c, x in mine:
            must = {i for i in range(5) if seen.count(x[i : i + 8]) > 1}
            runs = got.get((part, c), [])
            assert must <= {i for a, z in zip(runs[::2], runs[1::2]) for i in range(a, z)}


@pytest.mark.parametrize("common", [150, 199, 200, 230])
def test_only_items_that_may_repeat_enter_a_collection(spark, monkeypatch, common):
    """Texts that share less than a window around an anchor, wherever it lies, need no transform; a window in common is found at every place."""
    built = []
    monkeypatch.setattr(suffix_dedup, "transforms", lambda rows, length, f=suffix_dedup.transforms: built.append(rows.count()) or f(rows, length))
    rng = np.random.default_rng(common)
    own = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    data = []
    for i in range(60):
        passage = own(common if i % 2 else 150)
        data += [(2 * i + k, own(170) + "AB"[k] + passage + "AB"[k] + own(170)) for k in range(2)]
    got = removed(spark.createDataFrame(data, "doc_id long, text string"))
    assert {d: got[d]["n_removed"] for d, _ in data} == {d: common if d // 2 % 2 and common >= 200 else 0 for d, _ in data}
    assert (built[0] > 0) == (common > 150)


def test_repeats_odd_rows(odd, none):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == len(ODD_ROWS)
    assert all(r["n_removed"] == r["n_bytes"] and r["n_spans"] == 1 for r in got if r["doc_id"] in (6, 7))
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] not in (6, 7))
    assert suffix_dedup.remove_repeats(none).count() == 0
    clash = suffix_dedup.remove_repeats(odd.select("doc_id", F.col("text").alias("t"), F.lit("m").alias("marks"), F.lit("k").alias("kept")), text="t").collect()
    assert {(r["doc_id"], r["t"], r["marks"], r["n_removed"]) for r in clash} == {(r["doc_id"], r["text"], "m", r["n_removed"]) for r in got}


# 9


def test_token_shards_equal_plain_encoding(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registry.tokenizer_path())
    got = {r["doc_id"]: r for r in registry.op9_token_shards(spark, SF).collect()}
    start = 0
    for d, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@given(st.text(alphabet="ab \n\t é'12.,<|endoftext|>", max_size=40))
@settings(max_examples=300, deadline=None)
def test_pieces_encode_as_the_whole(text):
    e = tokens.encoder(registry.tokenizer_path())
    assert e(text).tolist() == e.whole(text).tolist()


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "<|endoftext| >", "  <|endoftext|>  a"])
def test_added_tokens_encode_as_in_the_library(text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.tokenizer_path())
    assert tokens.encoder(registry.tokenizer_path())(text).tolist() == library.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 70_000), max_size=1500), st.data())
@settings(max_examples=60, deadline=None)
def test_wavelet_matrix(ids, data):
    m = tokens.WaveletMatrix(tokens.WaveletMatrix.build(np.array(ids, np.uint32)))
    assert m.decode().tolist() == ids
    for _ in range(3 if ids else 0):
        i = data.draw(st.integers(0, len(ids) - 1))
        assert m.access(i) == ids[i]
        assert m.count(ids[i], 0, i) == ids[:i].count(ids[i])
        assert m.select(ids[i], ids[:i].count(ids[i])) == i
    assert m.count(99_999) == ids.count(99_999) and m.select(131_072, 0) == -1


def test_token_odd_rows(spark, odd, none):
    out = registry.shared_folder(spark)
    tokens.write_shards(odd, out, registry.tokenizer_path(), shard_tokens=1000)
    got = sorted(tokens.read_shards(spark, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8] and got[1]["n_tokens"] == 1
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    end = sorted(p for r in tokens.token_lookup(spark, out, 2).collect() for p in r["places"])
    assert {r["start"] + r["n_tokens"] - 1 for r in got} <= set(end)
    tokens.write_shards(none, out, registry.tokenizer_path())
    assert tokens.document_digests(spark, out).count() == 0


# 10


def test_rules_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(odd).collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[6]["n_words"] == 20_000 and "score" in got[6].asDict()
    assert quality_rules.quality_rules(none).count() == 0


def test_repeated_windows(spark):
    df = spark.createDataFrame([(1, "a b c a b c d"), (2, "x x x x"), (3, "a b c d"), (4, "l\nl\n\n \n l\nl")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_repeat_words"], r["n_dup_lines"]) for r in quality_rules.quality_rules(df).collect()}
    assert got == {1: (6, 0), 2: (4, 0), 3: (0, 0), 4: (4, 2)}
