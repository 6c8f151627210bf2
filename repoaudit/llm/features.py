"""Hashed n-gram features of whole texts, computed with numpy over their code points.

Words are runs of characters outside space and 0x09-0x0D. Every hash is taken modulo 2**64, so equal n-grams get equal
hashes in any text and on any executor.
"""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers = {"n": 0}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2**64, grown on demand."""
    if _powers["n"] < n:
        size = 1 << max(14, (n - 1).bit_length())
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for key, base in (("p", _P), ("q", inverse)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
        _powers["n"] = size
    return _powers["p"][:n], _powers["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the entropy of 64-bit values to their high bits."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def points(text: str | None) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def word_spans(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    if not len(c):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.empty(len(c) + 2, np.bool_)
    inside[0] = inside[-1] = False
    inside[1:-1] = (c != 32) & ((c < 9) | (c > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def span_hashes(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each span of characters, from prefix sums of a polynomial."""
    p, q = _tables(len(c) + 1)
    total = np.zeros(len(c) + 1, np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(1)) * p[: len(c)], out=total[1:])
    return mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))


def char_ngrams(c: np.ndarray, n: int) -> np.ndarray:
    if len(c) < n:
        return np.empty(0, np.uint64)
    h = np.full(len(c) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x110003) + c[k : len(c) - n + 1 + k]
    return mix(h * _P)


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def grams(text: str | None, bits: int, sizes: tuple[int, ...], words: bool) -> np.ndarray:
    """Buckets, with repeats, of character n-grams of the ``sizes``, and of words and pairs of neighbouring words."""
    c = points(text)
    parts = [bucket(char_ngrams(c, n), bits) for n in sizes]
    if words:
        w = span_hashes(c, *word_spans(c))
        parts += [bucket(w, bits), bucket(mix(w[:-1] * np.uint64(3) + w[1:]), bits)]
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


#: Numbers of occurrences from which on an n-gram has a further indicator.
LEVELS = (4, 16)


def indicators(text: str | None, bits: int, sizes: tuple[int, ...]) -> np.ndarray:
    """The distinct buckets of a text's character and word n-grams, in order, and those of their occurring ``LEVELS`` times or more."""
    found = np.sort(grams(text, bits, sizes, True))
    if not len(found):
        return found
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    count, found = np.diff(np.append(first, len(found))), found[first]
    often = [bucket(mix(found[count >= k].astype(np.uint64) * np.uint64(2 * k + 1) + np.uint64(k)), bits) for k in LEVELS]
    return np.unique(np.concatenate([found, *often]))


def platt(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that turns margins into probabilities (Newton steps on smoothed targets).

    ``weight``: how many rows of the population each sampled row stands for.
    """
    pos, neg = int(label.sum()), int(len(label) - label.sum())
    t = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = weight / weight.mean()
    a, c = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -40, 40)))
        w, g = weight * np.maximum(p * (1 - p), 1e-9), weight * (p - t)
        grad = np.array([(g * margin).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, c = a - float(np.clip(step[0], -5, 5)), c - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return a, c


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))
