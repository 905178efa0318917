"""Words and shingle sets of text columns as 64-bit hashes, computed over whole batches with numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULT = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but space and \t \n \v \f \r.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, text after text, and each text's number of words.

    A word's hash is a polynomial over the bytes' random values modulo 2**64, taken from prefix sums.
    """
    flat = LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    word = WORD_BYTE[flat]
    edge = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = edge[::2], edge[1::2]  # the last byte is a space, so every word ends
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(flat), _BASE, np.uint64)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(flat), _INVERSE, np.uint64)])
    total = np.r_[np.uint64(0), np.cumsum(_BYTE[flat] * power[:-1])]
    hashes = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(x) + 1 for x in texts])
    upto = np.searchsorted(starts, bounds)
    return hashes, np.diff(upto, prepend=0)


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, repeats included, and each text's number of them; a text of fewer than k words, but not
    none, has its whole sequence of words as one."""
    words, n = word_hashes(texts)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    first = np.repeat(np.cumsum(n) - n, count)
    at = first + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
    length = np.repeat(np.minimum(n, k), count)
    out = length.astype(np.uint64) * _MULT[63]
    for j in range(k):
        has = length > j
        if has.all():
            out += words[at + j] * _MULT[j]
        else:
            out[has] += words[at[has] + j] * _MULT[j]
    return mix(out), count
