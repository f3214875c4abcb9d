"""Hashed text features, computed on whole byte arrays, and a small logistic model.

All hashes are fixed: the same bytes have the same code in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a text that are worked on at a time: bounds memory, no result depends on it.
PIECE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A random 64-bit value per byte, and an odd multiplier with its inverse, for hashes of words from prefix sums.
_BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0xD1342543DE82EF95
_STEP_BACK = pow(_STEP, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, step in enumerate((_STEP, _STEP_BACK)):
            factors = np.full(size, step, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers[0][:n], _powers[1][:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~BLANK[data]
    change = np.diff(solid)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def raw_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of byte values times powers of a fixed step, modulo 2^64, of each word: that of two words in a row is the first's plus the second's times the step to the first's length."""
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes, size: int = PIECE) -> Iterator[np.ndarray]:
    """The mixed hashes of the words of ``text`` in order, worked out on pieces of ``size`` bytes; a word that pieces cut has the hash that it has whole."""
    data = np.frombuffer(text, np.uint8)
    held, length = 0, 0  # the word that the piece before ended in
    for at in range(0, len(data), size):
        part = data[at : at + size]
        starts, ends = word_spans(part)
        h, n = raw_hashes(part, starts, ends), ends - starts
        if length:
            if len(starts) and starts[0] == 0:
                h[0] = (held + pow(_STEP, length, 1 << 64) * int(h[0])) % (1 << 64)
                n[0] += length
            else:
                h, n, ends = np.r_[np.uint64(held), h], np.r_[length, n], np.r_[0, ends]
            held = length = 0
        if len(h) and ends[-1] == len(part) and at + size < len(data):
            held, length, h = int(h[-1]), int(n[-1]), h[:-1]
        if len(h):
            yield mixed(h)


def gram_codes(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A code of ``bits`` bits for each run of ``n`` bytes, by start."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    h = data[:size].astype(np.uint32)
    for k in range(1, n):
        h *= np.uint32(0x01000193)
        h += data[k : k + size]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - bits)


def logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, dim: int, rounds: int = 150, ridge: float = 1e-4, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on sparse rows, by full-batch Adam."""
    n = len(y)
    w, b = np.zeros(dim), 0.0
    m, v, mb, vb = np.zeros(dim), np.zeros(dim), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[cols] * vals, n) + b
        r = (logistic(z) - y) / n
        g, gb = np.bincount(cols, r[rows] * vals, dim) + ridge * w, r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, float(b)


def calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift that make logistic(slope * z + shift) a probability, by Newton steps on smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    a = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = logistic(x @ a)
        g = x.T @ (p - t) + 1e-3 * (a - [1, 0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a = a - step
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0]), float(a[1])
