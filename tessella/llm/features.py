"""Hashed features computed over whole batches of texts with numpy."""

from __future__ import annotations

import zlib

import numpy as np

_GAP = "\n\n\n"


def ngrams(texts: list[str], orders: tuple[int, ...], bits: int, *, chars: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams of each lower-cased text, one array for each order, and the row each start belongs to.

    Units are UTF-8 bytes, or code points with ``chars``. Starts in the gaps between texts
    belong to row ``len(texts)``; n-grams never reach the next text.
    """
    low = [t.lower() for t in texts]
    if chars:
        sizes = [len(t) for t in low]
        data = np.frombuffer((_GAP.join(low) + _GAP).encode("utf-32-le", "surrogatepass"), np.uint32)
    else:
        raw = [t.encode("utf-8", "replace") for t in low]
        sizes = [len(r) for r in raw]
        data = np.frombuffer(_GAP.encode().join(raw) + _GAP.encode(), np.uint8).astype(np.uint32)
    row = np.full(len(data), len(texts), dtype=np.int64)
    at = 0
    for i, n in enumerate(sizes):
        row[at : at + n] = i
        at += n + len(_GAP)
    out = []
    for order in orders:
        h = np.full(len(data), order, dtype=np.uint32)
        for k in range(order):
            h = h * np.uint32(0x01000193)
            h ^= np.concatenate([data[k:], np.zeros(k, np.uint32)]) if k else data
        h *= np.uint32(0x9E3779B1)
        out.append((h >> np.uint32(32 - bits)).astype(np.int64))
    return out, row


def ngram_counts(texts: list[str], orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Dense counts of byte n-grams, a row a text."""
    dims, n = 1 << bits, len(texts)
    hashes, row = ngrams(texts, orders, bits)
    total = np.zeros((n + 1) * dims, dtype=np.int64)
    base = row * dims
    for h in hashes:
        total += np.bincount(base + h, minlength=len(total))
    return total.reshape(n + 1, dims)[:n]


def hash_words(words: list[bytes], bits: int) -> np.ndarray:
    """crc32 of each word, cut to ``bits``."""
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    return (crc >> np.uint32(32 - bits)).astype(np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Gradient ascent steps for a list of arrays, in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.first = [np.zeros_like(p) for p in params]
        self.second = [np.zeros_like(p) for p in params]

    def ascend(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        for p, g, a, b in zip(self.params, grads, self.first, self.second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += self.rate * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.99**self.step)) + 1e-8)


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, with smoothed targets."""
    pos, neg = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    spread = float(margin.std()) or 1.0
    ab = np.array([1.0 / spread, 0.0])
    adam = Adam([ab], 0.05)
    for _ in range(steps):
        gap = target - sigmoid(ab[0] * margin + ab[1])
        adam.ascend([np.array([(gap * margin).mean() * spread, gap.mean()])])
    return max(float(ab[0]), 1e-6), float(ab[1])
