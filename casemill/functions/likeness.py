"""Likeness of texts over whole arrays of pairs: longest common subsequences in 64-bit words.

A text's characters are the columns of a matrix, a pair is a row. For each character of the second texts, one bit a
character of the first says where they are equal; sums with carries over the words do the rest, for all pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import floor

import numpy as np

#: Pairs that are taken at once, times characters.
CELLS = 2_000_000
#: Insertions and deletions up to which two texts are found by two whole segments in common; beyond, by one.
TWO_SEGMENTS = 16
ODD = 0x9E3779B97F4A7C15


def _codes(texts: list[str], width: int) -> np.ndarray:
    """A row of code points a text, 0 behind its end."""
    out = np.zeros((len(texts), max(width, 1)), np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) + np.uint32(1)
    n = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _common(a: np.ndarray, b: np.ndarray, size_a: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of rows of codes; b's rows may end in 0, which is no character."""
    words = -(-a.shape[1] // 64)
    wide = np.zeros((len(a), 64 * words), np.uint32)
    wide[:, : a.shape[1]] = a
    left = np.full((len(a), words), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(b.shape[1]):
        same = (wide == b[:, j : j + 1]) & (b[:, j : j + 1] != 0)
        match = np.packbits(same, axis=1, bitorder="little").view("<u8")
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            v = left[:, w]
            u = v & match[:, w]
            some = v + u
            total = some + carry
            carry = ((some < v) | (total < some)).astype(np.uint64)
            left[:, w] = total | (v - u)
    inside = np.arange(64 * words) < size_a[:, None]
    zero = np.unpackbits(left.view(np.uint8), axis=1, bitorder="little") == 0
    return (zero & inside).sum(axis=1)


def common(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of texts."""
    out = np.zeros(len(a), np.int64)
    size_a, size_b = (np.array([len(t) for t in x], np.int64) for x in (a, b))
    order = np.argsort(size_a * 4096 + size_b, kind="stable")  # pairs of about the same lengths together
    at = 0
    while at < len(order):
        step = max(1, CELLS // (64 + int(size_a[order[at]])))
        own = order[at : at + step]
        x, y = [a[i] for i in own], [b[i] for i in own]
        out[own] = _common(_codes(x, int(size_a[own].max(initial=0))), _codes(y, int(size_b[own].max(initial=0))), size_a[own])
        at += step
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """100 x (1 - insertions and deletions / lengths) of pairs of texts; two empty ones are equal."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    return np.where(total == 0, 100.0, 200.0 * common(a, b) / np.maximum(total, 1))


def _least(broken: int, moved: int) -> int:
    """The least insertions and deletions that break so many segments and move what follows so far."""
    n = max(broken, abs(moved))
    return n + (n - moved) % 2


@lru_cache(maxsize=65_536)
def whole_segments(s: int, r: int, t: float) -> tuple[int, tuple[tuple[int, int, int, int], ...]]:
    """How many segments a text of length s is cut into, and (i, j, p, q): its segments i and j stand whole, moved by p and q, in one of length r >= s.

    Any two texts of these lengths whose ratio reaches t agree in one of these ways at least. With d insertions and
    deletions allowed (as many as t allows, as odd or even as r - s), the text is cut into parts of up to 3 of them each,
    such that one part holds no more than its own. A part for b has b + 2 segments, of which two stand whole then; i and j
    are the first two, so segments before and between them are broken. The parts before a part hold more than their own.
    With very many insertions and deletions a part is for none and one segment, i = j.
    """
    d = floor((s + r) * (1 - t) + 1e-9)
    d -= (d - (r - s)) % 2
    whole = 2 if d <= TWO_SEGMENTS else 1
    parts = -(-(d + 1) // 3) if whole == 2 else d + 1
    ways, first, before = set(), 0, 0
    for n in range(parts):
        own = (d + 1) // parts + (n < (d + 1) % parts) - 1
        for i in range(own + 1):
            for j in range(i + 1, own + 2) if whole == 2 else [i]:
                for z in range(-d, d + 1):
                    for p in range(z - own, z + own + 1):
                        for q in range(p - own, p + own + 1):
                            inside = _least(i, p - z) + _least(max(j - i - 1, 0), q - p)
                            if inside <= own and _least(before, z) + inside + abs(r - s - q) <= d:
                                ways.add((first + i, first + j, p, q))
        first, before = first + own + whole, before + own + 1
    return first, tuple(sorted(ways))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(ODD)
    return h ^ (h >> np.uint64(29))


def letter_marks(texts: list[str]) -> np.ndarray:
    """56 bits a text of one length, one of which at most an insertion or deletion changes, and 8 bits of its length (255: that or more).

    A character belongs to one of 14 kinds; a kind has as many of its 4 bits set as the text has characters of it.
    """
    n = len(texts[0])
    kinds = _codes(texts, n) % np.uint32(14)
    out = np.full(len(texts), min(n, 255), np.int64)
    for k in range(14):
        some = (kinds[:, :n] == k).sum(axis=1)
        for level in range(4):
            out |= (some > level).astype(np.int64) << (8 + 4 * k + level)
    return out


def segment_keys(texts: list[str], salts: np.ndarray, lengths: list[int], t: float, longer: bool) -> Iterator[np.ndarray]:
    """64-bit keys, a row a text of one length; two texts of equal salts whose ratio reaches t have a key in common.

    Keys of texts as the longer ones meet keys of texts as the shorter ones; lengths are those the other texts have.
    """
    n = len(texts[0])
    codes = _codes(texts, n).astype(np.uint64)

    @lru_cache(maxsize=1_024)
    def piece(at: int, size: int) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for c in range(at, at + size):
            h = _mixed(h ^ codes[:, c])
        return h

    for m in lengths:
        s, r = (m, n) if longer else (n, m)
        if s > r or floor((s + r) * (1 - t) + 1e-9) < r - s:
            continue
        parts, ways = whole_segments(s, r, t)
        start = [i * s // parts for i in range(parts + 1)]
        for i, j, p, q in ways if longer else sorted({(i, j, 0, 0) for i, j, _, _ in ways}):
            a, b = start[i] + p, start[j] + q
            u, v = start[i + 1] - start[i], start[j + 1] - start[j]
            if min(a, b) >= 0 and a + u <= n and b + v <= n:
                kind = np.uint64((((s * 65_537 + r) * 4_099 + i) * 4_099 + j) * ODD & 0xFFFFFFFFFFFFFFFF)
                yield _mixed(_mixed(_mixed(piece(a, u) ^ kind) + piece(b, v)) + salts).view(np.int64)


def similarities(values: list[str], canonical: list[str]) -> np.ndarray:
    """A row a value, a column a canonical text: the best of whole, word-order-free and partial likeness.

    Case and repeated blanks don't matter; the last two count a little less (0.95, 0.9). Partial is the best window of the
    longer text that is as long as the shorter one, where the shorter one has more than three characters or the longer one
    is over half as long again. An empty text is like nothing.
    """
    plain = lambda texts: [" ".join(t.lower().split()) for t in texts]
    v, c = plain(values), plain(canonical)
    out = np.zeros((len(v), len(c)))
    cells = [(i, j) for i, x in enumerate(v) for j, y in enumerate(c) if x and y]
    if not cells:
        return out
    row, col = np.array(cells).T
    a, b = [v[i] for i in row], [c[j] for j in col]
    words = lambda texts: [" ".join(sorted(t.split())) for t in texts]
    best = np.maximum(ratios(a, b), 0.95 * ratios(words(a), words(b)))
    pair, short, window = [], [], []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        s, long = (x, y) if len(x) <= len(y) else (y, x)
        if len(long) > 1.5 * len(s) or len(s) > 3:
            n = len(long) - len(s) + 1
            pair += [k] * n
            short += [s] * n
            window += [long[i : i + len(s)] for i in range(n)]
    if pair:
        np.maximum.at(best, np.array(pair), 0.9 * ratios(short, window))
    out[row, col] = best
    return out
