"""Vectorised text kernels: words and word n-grams of many texts at once, as 64-bit hashes.

All functions work on one batch of texts joined into a single byte buffer, so the cost per word is a few NumPy passes
and no Python object is made for a word.  Hashes are polynomial sums modulo 2**64 over a fixed random byte table,
finished by a multiply-xorshift mixer; they depend on the bytes alone and are the same in every process.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
WHITESPACE = bytes([32, *range(9, 14)])
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(n, b, dtype=np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        have = _powers[base] = (out[0], out[1])
    return have


def byte_classes(separators: bytes, fold_ascii: bool) -> tuple[np.ndarray, bytes]:
    """A mask of separator bytes and a translation table that lower-cases A-Z if asked to."""
    fold = bytes(b + 32 if fold_ascii and 65 <= b <= 90 else b for b in range(256))
    mask = np.zeros(256, dtype=bool)
    mask[list(separators)] = True
    return mask, fold


class Words:
    """The words of a batch: start and end in `buf`, the text each belongs to, its hash; `first[i]:first[i+1]` are text i's."""

    def __init__(self, texts: list[bytes | None], separators: bytes = WHITESPACE, fold_ascii: bool = False):
        mask, fold = byte_classes(separators, fold_ascii)
        joint = separators[:1]
        raw = joint.join([t or b"" for t in texts]) + joint if texts else joint
        self.raw = raw
        buf = np.frombuffer(raw.translate(fold) if fold_ascii else raw, dtype=np.uint8)
        self.buf = buf
        word = np.empty(len(buf) + 1, dtype=bool)
        word[0] = False
        np.logical_not(mask[buf], out=word[1:])
        edges = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        lengths = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first)) if len(texts) else np.empty(0, dtype=np.int64)
        up, down = powers(_BASE, len(buf) + 1)
        sums = np.empty(len(buf) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[buf] * up[: len(buf)], dtype=np.uint64, out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def runs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word runs [begin, end)."""
        up, down = powers(_STEP, len(self.hash) + 1)
        sums = np.zeros(len(self.hash) + 1, dtype=np.uint64)
        np.cumsum(self.hash * up[: len(self.hash)], dtype=np.uint64, out=sums[1:])
        return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * U(_BASE))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all runs of k words within one text."""
        begin = np.arange(max(0, len(self.hash) - k + 1))
        begin = begin[self.doc[begin] == self.doc[begin + k - 1]] if len(begin) else begin
        return begin, self.runs(begin, begin + k)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(x[i : i + width]), by doubling."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == width else np.minimum(out[: len(out) - (width - span)], out[width - span :])


def chunks(columns: list[list], size_of: int, limit: int):
    """Cut parallel lists into runs whose column `size_of` (bytes or None) holds about `limit` bytes, one row at least."""
    begin = total = 0
    for i, t in enumerate(columns[size_of]):
        n = len(t) if t else 0
        if i > begin and total + n > limit:
            yield [c[begin:i] for c in columns]
            begin, total = i, 0
        total += n
    if columns and len(columns[0]) > begin:
        yield [c[begin:] for c in columns]
