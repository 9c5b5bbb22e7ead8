"""Vectorised text kernels on UTF-8 bytes: words, hashes, shingles and minima."""

from __future__ import annotations

import numpy as np

#: ASCII white space as the contracts state it: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = np.array(x, np.uint64)
    room = x >> np.uint64(33)
    x ^= room
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= np.right_shift(x, np.uint64(33), out=room)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= np.right_shift(x, np.uint64(33), out=room)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed))


_BYTE = {0: constants(256, 11), 1: constants(256, 12)}
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    name, base = ("i", _INVERSE) if inverse else ("p", _BASE)
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.cumprod(np.full(max(n, 1 << 16), base, np.uint64))
        if n <= 1 << 23:
            _powers[name] = have
    return have[:n]


def range_hash(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2^64 of each range of 64-bit symbols, finished with ``mix``."""
    n = len(symbols)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * powers(n), out=total[1:])
    inverse = powers(n + 1, inverse=True)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the number of words before each text."""
    return word_edges(~SPACE[data], offs)


def word_edges(solid: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from marks of what is not white space."""
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    edge = np.zeros(len(solid) + 1, bool)
    edge[offs] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def one_space(data: np.ndarray, solid: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with a space after each, and where each word starts there (and the end)."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(at[-1]), 32, data.dtype)
    room = np.ones(int(at[-1]), bool)
    room[at[1:] - 1] = False
    out[room] = data[solid]
    return out, at


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0, limit: int = 1 << 20) -> np.ndarray:
    """Hashes of words in ascending order, about ``limit`` bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + limit, "right")))
        out[i:j] = range_hash(_BYTE[family][data[a : ends[j - 1]]], starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def shingles(hashes: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and the number before each text.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(before)
    if not len(hashes):
        return hashes, np.zeros(len(counts) + 1, np.int64)
    n = len(hashes)
    c = constants(k, 77)
    whole = np.zeros(n, np.uint64)
    for t in range(min(k, n)):
        whole[: n - t] += (hashes[t:] ^ c[t]) * (c[t] | np.uint64(1))
    whole = mix(whole)
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        own = hashes[before[d] : before[d + 1]]
        part = c[: len(own)]
        whole[before[d]] = mix(np.sum((own ^ part) * (part | np.uint64(1)), keepdims=True) + np.uint64(len(own)))[0]
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    after = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(after[-1]) - np.repeat(after[:-1], made) + np.repeat(before[:-1], made)
    return whole[at], after


def distinct(values: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text."""
    out = values.copy()
    for a, b in zip(after[:-1].tolist(), after[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[after[:-1][np.diff(after) > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)]).astype(np.int64)[after]


def minima(values: np.ndarray, after: np.ndarray, functions: int, seed: int) -> np.ndarray:
    """The minimum of each text's values under each hash function; texts without values get 0.

    The functions map the upper 32 bits of a value to 32 bits, which halves the memory they touch;
    callers join several minima to a key of 64 bits.
    """
    out = np.zeros((len(after) - 1, functions), np.uint64)
    full = np.flatnonzero(np.diff(after) > 0)
    if not len(full):
        return out
    starts = after[full]
    short = (values >> np.uint64(32)).astype(np.uint32)
    c = (constants(2 * functions, seed) >> np.uint64(32)).astype(np.uint32)
    room = np.empty_like(short)
    for f in range(functions):
        np.bitwise_xor(short, c[2 * f], out=room)
        np.multiply(room, c[2 * f + 1] | np.uint32(1), out=room)
        out[full, f] = np.minimum.reduceat(room, starts)
    return out


def set_sums(values: np.ndarray, after: np.ndarray) -> np.ndarray:
    """128-bit fingerprints of sets, as two sums over their members."""
    out = np.zeros((len(after) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(after) > 0)
    if len(full):
        for k, odd in enumerate((np.uint64(0), np.uint64(0xD6E8FEB86659FD93))):
            out[full, k] = np.add.reduceat(mix(values ^ odd), after[full])
    return mix(out + np.diff(after).astype(np.uint64)[:, None])
