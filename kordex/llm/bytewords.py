"""Words of many texts at once, on their UTF-8 bytes, in numpy.

All word classes used by the operators cut at ASCII bytes only, so they can be decided byte by
byte: bytes of longer characters are word bytes in each class. A word's hash is a polynomial over
its folded bytes modulo 2**64, taken from prefix sums, then mixed; it is the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
SPACED = np.ones(256, dtype=bool)  # [^\x20\x09-\x0D]
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _PINV)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings end to end, and where each row begins (nulls are empty)."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if texts.null_count:
        texts = pa.array([x or b"" for x in texts.to_pylist()], pa.large_binary())
    raw = texts.buffers()
    offs = np.frombuffer(raw[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (in bytes of data) of each maximal run of bytes in a class; runs end with their text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = inside[data]
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    first = offs[:-1][offs[:-1] < offs[1:]]
    last = offs[1:][offs[:-1] < offs[1:]] - 1
    s[first] = m[first]
    e[last] = m[last]
    return np.flatnonzero(s), np.flatnonzero(e) + 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair; start is in order. Works through long data in segments."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + SEGMENT, "right")))
        hi = int(end[j - 1])
        p, q = _pow(hi - lo + 1)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[fold[data[lo:hi]]] * p[:-1], out=total[1:])
        a, b = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((total[b] - total[a]) * q[a] + (b - a).astype(np.uint64))
        i = j
    return out


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray = SPACED, fold: np.ndarray = SAME):
    """Begin, end and hash of each word, and for each text the number of its first word (one more entry at the end)."""
    start, end = spans(data, offs, inside)
    return start, end, hashes(data, start, end, fold), np.searchsorted(start, offs)


def grams(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words within a text, and the number of the word each run begins with.

    h: hashes of words; of: number of each text's first word, and the end.
    """
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.diff(of)
    keep = np.ones(len(h), dtype=bool)
    for k in range(1, n):
        at = of[1:] - k
        keep[at[size >= k]] = False
    begin = np.flatnonzero(keep)
    begin = begin[begin <= len(h) - n]
    out = np.zeros(len(begin), dtype=np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + h[begin + k])
    return out, begin


def first_rows(of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of the text that each word number belongs to."""
    return np.searchsorted(of, at, "right") - 1
