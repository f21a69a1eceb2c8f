"""Hashes of all words of many texts at once, in numpy, for use inside Arrow functions.

A word's hash is a polynomial over its bytes modulo 2^64, read off running sums,
so the work a byte is a few array operations and no word becomes an object.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPAN = 1 << 18
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Bytes that belong to words: all but ASCII white space, and letters, digits, ``_`` and what is not ASCII.
UNSPACED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LETTERS = np.array([b >= 128 or b == 95 or chr(b).isalnum() for b in range(256)])


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers up to n, and their inverses modulo 2^64."""
    if len(_powers["up"]) <= n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n + 1, _SPAN + 1), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def spans(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``inside`` has."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = inside[raw]
    edges = np.flatnonzero(own[1:] != own[:-1]) + 1
    if own[0]:
        edges = np.concatenate(([0], edges))
    if own[-1]:
        edges = np.concatenate((edges, [len(raw)]))
    return edges[0::2], edges[1::2]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        lo = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, lo + _SPAN, side="right")))
        hi = int(ends[b - 1])
        if hi - lo > _SPAN:  # one very long word, by pieces
            cuts = np.arange(lo, hi, _SPAN)
            for piece in hash_spans(raw, cuts, np.append(cuts[1:], hi)):
                out[a : a + 1] = out[a : a + 1] * np.uint64(_BASE) + piece
            a = b
            continue
        up, down = _power(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_CODES[raw[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        a = b
    return mix64(out)


def join(texts: list[bytes], mark: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """The texts in one array, with ``mark`` after each, and where each begins and the last ends."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(mark)
    return np.frombuffer(mark.join([*texts, b""]), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def words(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words begin and the last's end."""
    raw, begin = join(texts)
    starts, ends = spans(raw, inside)
    return hash_spans(raw, starts, ends), np.searchsorted(starts, begin)


def shingles(hashes: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within each text, and where each text's begin; a text of fewer words is one run, an empty one none."""
    sizes = np.diff(starts)
    n = len(hashes)
    mixed, valid = np.zeros(n, np.uint64), np.zeros(n, bool)
    padded = np.concatenate((hashes, np.zeros(k, np.uint64)))
    for i in range(k):
        mixed = mixed * np.uint64(_BASE) + padded[i : i + n]
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(n) - starts[text]
    valid = at <= sizes[text] - k
    for t in np.flatnonzero((sizes > 0) & (sizes < k)).tolist():  # whole short texts
        x = 0
        for h in hashes[starts[t] : starts[t + 1]].tolist():
            x = (x * _BASE + h) & (1 << 64) - 1
        mixed[starts[t]], valid[starts[t]] = x ^ int(sizes[t]), True
    return mix64(mixed[valid]), np.concatenate(([0], np.cumsum(valid)))[starts]


def sorted_unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and where each begins in the sorted array."""
    x = np.sort(x)
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))
    return x[new], new


def distinct(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text, of which 44 bits are told apart, and where each text's begin."""
    text = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    both, _ = sorted_unique(text << np.uint64(44) | hashes >> np.uint64(20))
    return mix64(both & np.uint64((1 << 44) - 1)), np.searchsorted(both, np.arange(len(starts), dtype=np.uint64) << np.uint64(44))


def groups(sizes: np.ndarray, most: int) -> list[slice]:
    """Neighbouring items in groups whose sizes add up to ``most`` or so, none empty."""
    at = np.cumsum(sizes) // most
    edges = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(sizes)]))
    return [slice(int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False) if b > a]
