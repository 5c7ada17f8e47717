"""Words of many texts at once: their boundaries and 64-bit hashes, found with numpy over UTF-8 bytes.

Both ways of splitting look at single bytes below 0x80 only, so a multi-byte character is never cut.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: One odd 64-bit value for each byte; the multipliers of the mixing steps.
BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]

_b = np.arange(256)
LOWER = np.where((_b >= 65) & (_b <= 90), _b + 32, _b).astype(np.uint8)
#: Words are runs of what isn't white space ...
NOT_SPACE = ~((_b == 32) | ((_b >= 9) & (_b <= 13)))
#: ... or runs of letters and digits, where every byte of a multi-byte character counts as a letter.
ALNUM = ((_b >= 48) & (_b <= 57)) | ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
_LOWER_BYTE = BYTE[LOWER]
_INVERSE = np.uint64(pow(int(MUL[0]), -1, 1 << 64))
_kept = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * MUL[4]
    h ^= h >> np.uint64(29)
    h *= MUL[5]
    h ^= h >> np.uint64(32)
    return h


def comb(a: np.ndarray, b: np.ndarray, step: int = 0) -> np.ndarray:
    """The hash of what ``a`` and ``b`` stand for, one after the other."""
    h = a * MUL[step % 6]
    h ^= h >> np.uint64(31)
    h += b
    h ^= h >> np.uint64(29)
    h *= MUL[(step + 1) % 6]
    return h


def words(data: np.ndarray, off: np.ndarray, of: np.ndarray = NOT_SPACE, stem: int = 0) -> tuple[np.ndarray, ...]:
    """(hash, row, start, end) of each word of the rows, A-Z in lower case; with ``stem``, also the hash of its first ``stem`` bytes."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return (none.astype(np.uint64), none, none, none, *[none.astype(np.uint64)] * bool(stem))
    w = of[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True  # a row's first byte
    first = first[:-1]
    start = w.copy()
    start[1:] &= ~w[:-1] | first[1:]
    s = np.flatnonzero(start)
    if not len(s):
        return (none.astype(np.uint64), none, none, none, *[none.astype(np.uint64)] * bool(stem))
    last = w.copy()
    last[:-1] &= ~w[1:] | first[1:]
    e = np.flatnonzero(last) + 1
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER_BYTE[data] * power, out=total[1:])
    before, scale = total[s], inverse[s]  # a word's sum, as if it began at place 0
    row = np.repeat(np.arange(-1, len(off)), np.diff(np.concatenate([[0], np.searchsorted(s, off), [len(s)]])))
    out = mix((total[e] - before) * scale), row, s, e
    if stem:
        out = (*out, mix((total[np.minimum(e, s + stem)] - before) * scale))
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MUL[0] to the power of 1 to n, and 0 to 1 - n (modulo 2 ** 64); those for blocks are kept."""
    global _kept
    if n <= len(_kept[0]):
        return _kept[0][:n], _kept[1][:n]
    size = max(n, 1 << 16)
    made = np.multiply.accumulate(np.full(size, MUL[0])), np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _INVERSE)])
    if size <= 1 << 20:
        _kept = made
    return made[0][:n], made[1][:n]


def shingles(data: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word shingles of each row, in order; with fewer words the whole sequence is one."""
    h, row, _, _ = words(data, off)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out_h, out_r = [], []
    if len(h) >= size:
        a, same = h[: len(h) - size + 1], row[: len(h) - size + 1] == row[size - 1 :]
        for k in range(1, size):
            a = comb(a, h[k : len(h) - size + 1 + k], k)
        out_h.append(mix(a[same]))
        out_r.append(row[: len(h) - size + 1][same])
    n = np.bincount(row, minlength=len(off) - 1)
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        at = (np.cumsum(n) - n)[few]
        a = h[at] + n[few].astype(np.uint64)
        for k in range(1, size - 1):
            more = n[few] > k
            a = np.where(more, comb(a, h[np.minimum(at + k, len(h) - 1)], k), a)
        out_h.append(mix(a))
        out_r.append(few)
    hh, rr = np.concatenate(out_h), np.concatenate(out_r)
    o = np.lexsort((hh, rr))
    hh, rr = hh[o], rr[o]
    new = np.ones(len(hh), bool)
    new[1:] = (hh[1:] != hh[:-1]) | (rr[1:] != rr[:-1])
    return rr[new], hh[new]
