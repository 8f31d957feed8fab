"""Pieces are looked up once a slice; items of a collection are cut to what may repeat; worker processes let go of other operators' tables."""

import gc
import weakref

import numpy as np
import pyarrow as pa

from tracefold.llm import language_id, registry, suffix_dedup, tokens

ODD = ["", None, " ", "  ", "a b", " a b", "a ", "a  b", "\n a", "\tx y\n\nz <|endoftext|> q", "é ü", " \n x", "'s it's don't", "\x00 a\x00b", "x" * 5000 + " y", "日本 語", " a \nb c\n"]


def test_pieces_are_looked_up_once_a_slice():
    class Counting(tokens._Pieces):
        asked = 0

        def __getitem__(self, piece):
            Counting.asked += 1
            return super().__getitem__(piece)

    e = tokens.Encoder(registry.tokenizer_path())
    e.known = Counting()
    got = e.rows(pa.array(["one two three four"] * 1000))
    assert Counting.asked <= 1000 + 4  # the starts of the texts, and each distinct piece
    assert all(g.tolist() == e.whole("one two three four").tolist() for g in got)


def test_slices_of_odd_texts_equal_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 16)
    monkeypatch.setattr(tokens.Encoder, "LIMIT", 5)
    e = tokens.Encoder(registry.tokenizer_path())
    for column in (pa.array(ODD), pa.array(ODD).slice(3, 9), pa.array(ODD, pa.string()).slice(0, 0)):
        for _ in range(2):
            assert [g.tolist() for g in e.rows(column)] == [e.whole(t or "").tolist() for t in column.to_pylist()]


def test_a_worker_lets_go_of_what_another_operator_kept():
    kept = weakref.ref(tokens.encoder(registry.tokenizer_path()))
    assert tokens.encoder(registry.tokenizer_path()) is kept()
    language_id.letter_vector(97)
    gc.collect()
    assert kept() is None


def test_items_enter_a_collection_with_the_windows_that_may_repeat_only():
    rng = np.random.default_rng(4)
    own = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    for at in range(0, 153, 8):  # where the passage in common starts; the anchor stands at 152
        passage = own(200)
        items = [(152, own(at) + bytes([65 + k]) + passage[1:] + own(352 - at - 200)) for k in range(3)]
        items[1] = (152, items[1][1][:at] + items[0][1][at : at + 200] + items[1][1][at + 200 :])
        found = suffix_dedup.may_repeat(items, 200)
        assert found[2] is None or at < 152  # a window without its first byte is not in common
        for (_, x), to in zip(items[:2], found[:2]):
            assert to[0] <= at and to[1] >= at + 200 and to[1] - to[0] < 240 < len(x)


def test_bytes_are_removed_from_all_rows_together_as_from_each():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 30, 8, 0, 50, 3, 0)]
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("size", pa.int32()), ("whole", pa.bool_()), ("runs", pa.list_(pa.int32()))]))
    mark = lambda lo, size, whole, runs: {"lo": lo, "size": size, "whole": whole, "runs": runs}
    marks = [None, [mark(20, 10, True, None), mark(2, 12, False, [0, 1, 3, 4]), mark(25, 9, True, None)], [mark(0, 8, True, None)], [], [mark(0, 10, False, []), mark(40, 10, False, [1, 3])], None, None]
    raw, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    kept, spans, n_bytes, n_removed, n_spans = (x.to_pylist() for x in suffix_dedup.without(raw, bounds, pa.array(marks, kind), 8))
    assert spans == [[], [2, 13, 20, 30], [0, 8], [], [41, 50], [], []]
    assert n_bytes == [len(t) for t in texts] and n_spans == [len(x) // 2 for x in spans]
    for t, k, x, n in zip(texts, kept, spans, n_removed):
        gone = {i for a, z in zip(x[::2], x[1::2]) for i in range(a, z)}
        assert k == bytes(c for i, c in enumerate(t) if i not in gone) and n == len(gone)
