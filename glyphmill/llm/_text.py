"""Vectorised word and shingle hashing shared by the operators of this subpackage.

A *word* is a maximal run of letters, marks and digits, compared in lower case.
Words and shingles are 64-bit hashes made with whole-array numpy operations, so
that a batch of texts costs some tens of nanoseconds a character in Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_LUT: dict[str, np.ndarray] = {}
_POW: dict[int, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _LUT:
        word = np.zeros(0x110000, bool)
        lower = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if unicodedata.category(c)[0] in "LMN":
                word[i] = True
                low = c.lower()
                if low != c and len(low) == 1:
                    lower[i] = ord(low)
        _LUT["word"], _LUT["lower"] = word, lower
    return _LUT["word"], _LUT["lower"]


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POW[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def each(column: pa.Array | list, step: int = 256) -> Iterator:
    """The values of an Arrow column or a list in turn, so many made at once."""
    for at in range(0, len(column), step):
        yield from column[at : at + step] if isinstance(column, list) else column.slice(at, step).to_pylist()


def pieces(texts: pa.Array | list, chars: int = 250_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive groups of texts of about so many characters: (index of the first, texts).

    A null counts as an empty text. One very long text is a group of its own.
    """
    first, group, size = 0, [], 0
    for i, t in enumerate(each(texts)):
        t = t or ""
        if group and size + len(t) > chars:
            yield first, group
            first, group, size = i, [], 0
        group.append(t)
        size += len(t)
    if group:
        yield first, group


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in turn: word hashes, each word's first and past-the-last
    character within its text, and for each text the index of its first word
    (one entry more than texts)."""
    is_word, lower = _tables()
    cps = codepoints("\n".join(texts) + "\n")
    low = lower[cps]
    w = is_word[cps]
    edge = np.flatnonzero(w[1:] != w[:-1]) + 1
    if len(w) and w[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    n = len(cps)
    inverse = pow(_P, -1, 1 << 64)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((low + np.uint32(1)).astype(np.uint64) * _powers(_P, n), out=total[1:])
    h = (total[end] - total[start]) * _powers(inverse, n)[start]
    h = mix(h + (end - start).astype(np.uint64) * np.uint64(_Q))
    base = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=base[1:])
    of = np.searchsorted(start, base)
    shift = np.repeat(base[:-1], np.diff(of))
    return h, start - shift, end - shift, of


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, of the whole array: len(h) - k + 1
    values; the caller leaves out those that cross into another text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    inverse = pow(_Q, -1, 1 << 64)
    total = np.empty(len(h) + 1, np.uint64)
    total[0] = 0
    np.cumsum(h * _powers(_Q, len(h)), out=total[1:])
    return mix((total[k:] - total[:n]) * _powers(inverse, n))


def inside(of: np.ndarray, k: int) -> np.ndarray:
    """For texts with word offsets `of`, which of the whole array's k-word
    windows lie within one text."""
    n = int(of[-1]) - k + 1
    if n <= 0:
        return np.empty(0, bool)
    ok = np.ones(n, bool)
    for end in of[1:-1]:
        ok[max(0, end - k + 1) : end] = False
    return ok
