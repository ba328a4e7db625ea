"""Vectorised hashing of bytes, words and n-grams, and window minima (numpy)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240607)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
GRAM_CODES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int, which: str) -> np.ndarray:
    have, n = _POWERS.get(which), int(n)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        out = np.full(size, BASE if which == "up" else BASE_INV, dtype=np.uint64)
        out[0] = 1
        _POWERS[which] = have = np.multiply.accumulate(out)
    return have[:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than 0x20 and 0x09 to 0x0D."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~IS_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each span of codes, which depends on their values and order only; starts and ends both rise.

    Prefix sums of codes times powers of an odd base, over pieces of bounded length however long the input is.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    out, at = [], 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + piece, "right")))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        summed = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(codes[lo:hi] * powers(hi - lo, "up"), out=summed[1:])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out.append((summed[e] - summed[s]) * powers(hi - lo, "down")[s])
        at = stop
    return np.concatenate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words hash alike wherever they stand."""
    return mix(span_hashes(BYTE_CODES[data], starts, ends) + (ends - starts).astype(np.uint64))


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive units; fewer than k units give none."""
    n = len(units) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += units[j : j + n] * GRAM_CODES[j]
    return mix(total)


def byte_gram_hashes(data: np.ndarray, k: int = 16) -> np.ndarray:
    """A hash of each k consecutive bytes, k a power of two."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    code, width = data.astype(np.uint64), 1
    while width < k:
        head, tail = code[: len(code) - width], code[width:]
        code = (head << U(8 * width)) | tail if width < 8 else mix(head) * GRAM_CODES[0] + tail
        width *= 2
    return mix(code[:n])


def window_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost least value (by its upper 40 bits) of each w consecutive values."""
    n, step = len(values) - w + 1, 1 << 23
    if n <= 0:
        return np.empty(0, np.int64)
    out = []
    for at in range(0, n, step):
        part = values[at : min(at + step, n) + w - 1]
        tagged = (part & U(0xFFFFFFFFFF000000)) | np.arange(len(part), dtype=np.uint64)
        out.append((window_min(tagged, w) & U(0xFFFFFF)).astype(np.int64) + at)
    return np.concatenate(out)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values: running minima of blocks from both ends."""
    n = len(values) - w + 1
    padded = np.concatenate([values, np.full(-len(values) % w, np.iinfo(np.uint64).max, np.uint64)])
    blocks = padded.reshape(-1, w)
    to_end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:n]
    from_start = np.minimum.accumulate(blocks, axis=1).reshape(-1)[w - 1 : w - 1 + n]
    return np.minimum(to_end, from_start)
