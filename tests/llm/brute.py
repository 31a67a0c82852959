"""Slow, plain versions of what the operators compute."""

import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

SPACES = " \t\n\x0b\x0c\r"


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def slow_score(model, text: bytes) -> float:
    """The network, one chunk and one place at a time."""
    width, half = len(model.filters), 128
    at = lambda k: text[k] if k < len(text) else 0
    n = max(1, len(text))
    response = np.array([sum(model.filters[j][at(k + j)].astype(np.float64) for j in range(width)) for k in range(n)])
    starts = range(0, n, half) if n <= half else range(0, (n - 1) // half * half, half)
    hidden = [np.tanh(response[a : a + 2 * half].max(0) @ model.v.astype(np.float64) + model.c) for a in starts]
    z = np.concatenate([np.mean(hidden, 0), np.max(hidden, 0)]) @ model.w.astype(np.float64) + model.b
    return 1 / (1 + np.exp(-z))


def kept_lines(rows: list[tuple]) -> list[tuple]:
    """(id, lines, lines left) of each row."""
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = fold(line.strip(SPACES))
            if doc is not None and len(key) >= 10:
                held[key].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(held[fold(x.strip(SPACES))]) < 2 or min(held[fold(x.strip(SPACES))]) == doc]
        out.append((doc, lines, kept))
    return out


def shingles(text: str | None) -> set:
    words = fold(text or "").encode().split()
    if len(words) >= 5:
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def near_components(rows: list[tuple]) -> dict:
    """The smallest id that each id's links reach."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            low, high = sorted((find(a), find(b)))
            up[high] = low
    return {d: find(d) for d in up}


def repeats_removed(rows: list[tuple], window: int = 35) -> list[tuple]:
    """(id, words, words left) of each row."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    count = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((d, [x.decode() for x in w], [x.decode() for x, g in zip(w, gone) if not g]))
    return out


def pieces(rows: list[tuple], tokenizer, longest: int = 2048) -> Counter:
    """(id, start, length, crc of the ids, tokens) of binary pieces."""
    out = Counter()
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)
        start = 0
        while start < len(ids):
            n = min(longest, 1 << (len(ids) - start).bit_length() - 1)
            out[(doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids))] += 1
            start += n
    return out
