"""Plain restatements of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(rows):
    """rows: (doc_id, text) -> {doc_id: smallest id reachable}."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].add(i)
    done = set()
    for group in by.values():
        for i in group:
            for j in group:
                if i < j and (i, j) not in done:
                    done.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    n = len(a & b)
                    if 100 * n >= 80 * (len(a) + len(b) - n):
                        x, y = sorted((root(sets[i][0]), root(sets[j][0])))
                        parent[y] = x
    return {d: root(d) for d in parent}


def repeats(texts, length):
    """For each text: mask of removed bytes."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        out.append(gone)
    return out


def personal(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(c) for c in digits(s)][::-1]
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(d)) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()
