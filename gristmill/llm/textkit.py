"""Array kernels shared by the text operators.

A batch of documents is laid out as one byte buffer; words, word hashes and
shingle hashes are then flat numpy arrays with an offset array that says where
each document begins. Words are maximal runs of bytes other than
``\\x20\\x09-\\x0D``, which is the word rule of every operator here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_powers = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, _CHUNK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            t = np.full(size, base, U)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every span; equal contents hash equally."""
    up, down = _power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


class Words:
    """Words of a batch: ``hashes`` flat, those of document d at ``off[d]:off[d+1]``."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        buf = b"\n".join(texts) + b"\n"
        self.buf = buf.lower() if lower else buf
        self.n = len(texts)
        arr = np.frombuffer(self.buf, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, self.n)
        self.byte_off = np.concatenate(([0], np.cumsum(sizes)))
        self._index(arr)

    def _index(self, arr: np.ndarray) -> None:
        self.arr = arr
        word = ~_SPACE[arr]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.hashes = span_hashes(_BYTE[arr], self.starts, self.ends)
        self.off = np.searchsorted(self.starts, self.byte_off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def docs(self) -> np.ndarray:
        """The document of every word."""
        return np.repeat(np.arange(self.n), self.counts)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows, and the offsets of each document in them."""
        return windows(self.hashes, self.off, k)


def windows(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(np.diff(off) - k + 1, 0)
    out = np.concatenate(([0], np.cumsum(n)))
    if not out[-1]:
        return np.zeros(0, U), out
    g = np.zeros(len(h) - k + 1, U)
    for i in range(k):
        g = g * U(0xC2B2AE3D27D4EB4F) + h[i : len(h) - k + 1 + i]
    at = np.arange(out[-1]) + np.repeat(off[:-1] - out[:-1], n)
    return mix(g[at]), out


def encoded(column: pa.Array) -> list[bytes]:
    """The column's texts in UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = _CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``most`` bytes of text, or one document."""
    for whole in batches:
        # a batch can hold thousands of texts; few of them are Python objects at a time
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            texts = encoded(b.column(b.schema.get_field_index(text)))
            i = 0
            while i < len(texts):
                j, size = i + 1, len(texts[i])
                while j < len(texts) and size + len(texts[j]) <= most:
                    size += len(texts[j])
                    j += 1
                yield b.slice(i, j - i), texts[i:j]
                i = j


def per_document_unique(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, with offsets."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((values, doc)) if len(off) > 2 else np.argsort(values)
    v, d = values[order], doc[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[first], d[first]
    return v, np.searchsorted(d, np.arange(len(off)))


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each document's values."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[off[1:]] - total[off[:-1]]
