"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as ``<s>[role]\\ntext</s>\\n`` per turn and encoded once, whole, with character offsets. Inside texts and roles
the characters that could form a control string are escaped (``\\`` as ``\\\\``, ``<`` as ``\\l``, ``[`` as ``\\b``; in
roles also ``]`` and line ends), which ``unescape`` undoes. The sorted spans of assistant texts are intersected
with the sorted token spans by binary search; tokens that meet a span carry loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches
from .tokens import encoder

_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_ROLE_ESCAPES = _ESCAPES | {"]": "\\r", "\n": "\\n"}
_BACK = {"\\": "\\", "l": "<", "b": "[", "r": "]", "n": "\n"}
_TURN = re.compile(r"<s>\[((?:[^\]\\]|\\.)*)\]\n([^<]*)</s>\n")


def escape(text: str, table: dict[str, str] = _ESCAPES) -> str:
    return text.translate(str.maketrans(table))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted conversation, span of each turn's escaped text)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[{escape(role, _ROLE_ESCAPES)}]\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</s>\n"]
        at = spans[-1][1] + 5
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def loss_mask(token_starts: np.ndarray, token_ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for each token that meets one of the sorted spans (columns start, end)."""
    mask = np.zeros(len(token_starts) + 1, np.int32)
    if len(spans) and len(token_starts):
        first = np.searchsorted(token_ends, spans[:, 0], "right")
        last = np.searchsorted(token_starts, spans[:, 1], "left")
        meets = (first < last) & (spans[:, 0] < spans[:, 1])
        np.add.at(mask, first[meets], 1)
        np.add.at(mask, last[meets], -1)
    return np.cumsum(mask[:-1]) > 0


def masked_pieces(token_starts: np.ndarray, token_ends: np.ndarray, mask: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The parts of ``spans`` under the mask: from its first to its last masked token, cut at the span."""
    out = []
    for lo, hi in spans:
        a, b = np.searchsorted(token_ends, lo, "right"), np.searchsorted(token_starts, hi, "left")
        under = np.flatnonzero(mask[a:b]) + a
        if lo < hi and len(under):
            out.append((max(lo, token_starts[under[0]]), min(hi, token_ends[under[-1]])))
    return np.array(out, np.int64).reshape(-1, 2)


def format_chats(rows: DataFrame, tokenizer: str, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, ids, loss, text_spans) from rows (conv_id, turn, role, text).

    ``loss`` has one boolean per id; ``text_spans`` are start, end pairs of the texts under the mask. Turns come in the order of turn, then role, then text, so ties have
    a fixed order and repeated rows repeat. A null role or text is empty; a null conv_id is a conversation of its
    own; other columns are left out. A conversation is encoded whole, so its memory follows its own length.
    """

    def chats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = encoder(tokenizer).tokenizer
        now, turns, ready = object(), [], []

        def encoded(group: list) -> pa.RecordBatch:
            rendered = [render(x) for _, x in group]
            cols: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "formatted", "ids", "loss", "text_spans")}
            for (conv, x), (text, spans), e in zip(group, rendered, t.encode_batch([r for r, _ in rendered], add_special_tokens=False)):
                ends = np.array([b for _, b in e.offsets], np.int64)
                ends = np.maximum.accumulate(ends) if len(ends) else ends
                starts = np.array([a for a, _ in e.offsets], np.int64)
                # white space that the tokenizer leaves out of a token's span belongs to that token
                starts[1:] = np.minimum(starts[1:], ends[:-1])
                wanted = np.array([s for (role, _), s in zip(x, spans) if role == loss_role], np.int64).reshape(-1, 2)
                mask = loss_mask(starts, ends, wanted)
                for k, v in zip(cols, (conv, len(x), text, e.ids, mask.tolist(), masked_pieces(starts, ends, mask, wanted).ravel().tolist())):
                    cols[k].append(v)
            return pa.RecordBatch.from_pydict(cols, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())), ("text_spans", pa.list_(pa.int64()))]))

        size = 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if conv != now or not turns:
                    if turns:
                        ready.append((now, turns))
                    if size > 500_000:
                        yield encoded(ready)
                        ready, size = [], 0
                    now, turns = conv, []
                turns.append((role or "", text or ""))
                size += len(text or "") + 30
        if turns:
            ready.append((now, turns))
        if ready:
            yield encoded(ready)

    bounded_batches(rows.sparkSession)
    x = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id")
    x = x.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return x.mapInArrow(chats, "conv_id long, n_turns long, formatted string, ids array<int>, loss array<boolean>, text_spans array<bigint>")


def chat_digests(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens), read back from the output."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens")}
            rows = batch.select(["conv_id", "formatted", "text_spans"]).to_pylist()
            n_ids, loss_at = pc.list_value_length(batch.column("ids")).to_pylist(), batch.column("loss")
            for i, r in enumerate(rows):
                turns = parse(r["formatted"])
                loss = "".join(unescape(r["formatted"][a:b]) for a, b in zip(r["text_spans"][::2], r["text_spans"][1::2]))
                digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
                for k, v in zip(out, (r["conv_id"], len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"]), n_ids[i], pc.sum(loss_at[i].values).as_py() or 0)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    return chats.select("conv_id", "formatted", "ids", "loss", "text_spans").mapInArrow(digests, schema)
