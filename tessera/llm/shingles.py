"""Weighted word shingles, ProbMinHash signatures and exact similarities, in NumPy over batches of texts."""

from __future__ import annotations

import math

import numpy as np

from .common import WORD_BYTES

SHINGLE = 5
THRESHOLD = 0.8
#: Bytes of a text whose words are hashed at once, more only where one word is longer; and places in a word whose hashes are in a table.
PIECE, PLACES = 1 << 19, 64
#: Shingles that a worker handles at once.
SLICE = 1 << 17

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64 bits (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


TABLE = mix(np.arange(PLACES << 8, dtype=U) * U(0x9E3779B97F4A7C15))


def word_hashes(data: bytes | None) -> np.ndarray:
    """A hash of each word, the sum of random values of its bytes by their places, mixed; long texts a piece at a time."""
    low = data.translate(WORD_BYTES) if data else b""
    out, at = [np.zeros(0, U)], 0
    while at < len(low):
        # A piece ends at a separator.
        end = len(low) if at + PIECE >= len(low) else low.rfind(b" ", at, at + PIECE) + 1 or low.find(b" ", at + PIECE) + 1 or len(low)
        out.append(piece_hashes(np.frombuffer(low, np.uint8, end - at, at)))
        at = end
    return np.concatenate(out)


def piece_hashes(low: np.ndarray) -> np.ndarray:
    """The hashes of the words of ``low``, whose separators are spaces."""
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    length = edges[1::2] - edges[::2]
    if not len(length):
        return np.zeros(0, U)
    begin = np.cumsum(length) - length
    code = (np.arange(begin[-1] + length[-1]) - np.repeat(begin, length) << 8) + low[inside[1:-1]]
    if length.max() <= PLACES:
        value = TABLE[code]
    else:
        value = mix(code.astype(U) * U(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(value, begin) + length.astype(U))


def shingle_hashes(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A hash of each run of n words; of all words where there are fewer, but not none."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, U)
    for k in range(n):
        h = h * U(0x9E3779B97F4A7C15) + words[k : k + len(h)]
    return mix(h + U(n))


def weighted(data: bytes | None, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes(word_hashes(data), n), return_counts=True)


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """ProbMinHash of weighted sets, a row each. Every element is a Poisson process with its weight as rate, whose points fall on random
    places; a place takes the element of its first point. An element stops once it is later than all first points of its set. Elements
    come a bounded number at a time, so a long text needs no more memory than a short one; later ones stop sooner."""
    first = np.full(len(texts) * size, np.inf)
    out = np.zeros(len(texts) * size, U)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    n = 0
    for k, (x, w) in enumerate(texts):
        for i in range(0, len(x), SLICE):
            held.append((k, x[i : i + SLICE], w[i : i + SLICE]))
            n += len(held[-1][1])
            if n >= SLICE:
                arrive(held, size, first, out)
                held, n = [], 0
    if held:
        arrive(held, size, first, out)
    return out.reshape(-1, size)


def arrive(parts: list[tuple[int, np.ndarray, np.ndarray]], size: int, first: np.ndarray, out: np.ndarray) -> None:
    """Lets the elements of (text, elements, weights) arrive: updates the times of the first points and what came first."""
    owner = np.repeat(np.array([k for k, _, _ in parts]), [len(x) for _, x, _ in parts])
    element = np.concatenate([x for _, x, _ in parts])
    rate = np.concatenate([w for _, _, w in parts]).astype(np.float64)
    low, high = parts[0][0], parts[-1][0] + 1
    time, seed, round_ = np.zeros(len(element)), element, 0
    while len(element):
        round_ += 1
        seed = mix(seed + U(0x9E3779B97F4A7C15))
        time = time - np.log(((seed >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        place = owner * size + (mix(seed ^ U(0xD6E8FEB86659FD93)) % U(size)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = first[place] == time
        out[place[won]] = element[won]
        if round_ < 8 or round_ % 4 == 0:  # stopping later is right, too
            go = time < first[low * size : high * size].reshape(-1, size).max(1)[owner - low]
            owner, element, rate, time, seed = owner[go], element[go], rate[go], time[go], seed[go]


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A bucket for each band of ``rows`` places, as signed longs."""
    n = signature.shape[1] // rows
    out = np.empty((len(signature), n), U)
    for k in range(n):
        h = np.full(len(signature), U(k + 1))
        for x in signature[:, k * rows : (k + 1) * rows].T:
            h = mix(h * U(0x9E3779B97F4A7C15) + x)
        out[:, k] = h
    return out.view(np.int64)


def tuned_bands(rows: int, threshold: float, recall: float) -> int:
    """Bands that find a pair at the threshold with at least the wanted recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Jaccard of the shingle sets, and the probability Jaccard of the weighted sets, both exact."""
    (x, wx), (y, wy) = a, b
    if not len(x) or not len(y):
        return 0.0, 0.0
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    jaccard = len(both) / (len(x) + len(y) - len(both))
    if not len(both) or (len(wx) == wx.sum() and len(wy) == wy.sum()):
        return jaccard, jaccard
    p, q = wx[i].astype(float), wy[j].astype(float)
    # Sum over all shingles of max(wx / p, wy / q): those with wx / wy over p / q count by wx, the others by wy.
    ratio = p / q
    order = np.argsort(ratio)
    by_x = np.concatenate([np.cumsum(p[order][::-1])[::-1], [0]])
    by_y = np.concatenate([[0], np.cumsum(q[order])])
    at = np.searchsorted(ratio[order], ratio)
    only_x, only_y = wx.sum() - p.sum(), wy.sum() - q.sum()
    return jaccard, float(np.sum(1 / ((by_x[at] + only_x) / p + (by_y[at] + only_y) / q)))
