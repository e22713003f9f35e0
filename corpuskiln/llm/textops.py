"""Numpy building blocks over Arrow string columns, shared by the operators of this subpackage.

A batch of texts is one flat byte array plus document offsets. Every helper works on whole texts: a slice is cut only
between documents, so memory is bounded by ``SLICE_BYTES`` or by the longest single document, whichever is larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
SLICE_DOCS = 4096

#: The separators of the word rule ``[^\x20\x09-\x0D]+``; all are ASCII, so the rule holds on UTF-8 bytes as well.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power_table(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[kind] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its document offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``most`` bytes each, SLICE_DOCS at most; a longer document comes alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        hi = min(hi, n, lo + SLICE_DOCS)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of a slice: byte range of each, and for document i its words [first[i], first[i + 1])."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def find_words(data: np.ndarray, off: np.ndarray) -> Words:
    if not len(data):
        z = np.zeros(0, dtype=np.int64)
        return Words(z, z, np.zeros(len(off), dtype=np.int64))
    word = ~_IS_SPACE[data]
    edge = np.empty(len(data), dtype=bool)  # no word reaches over a document's first byte
    edge[0] = True
    edge[1:] = ~word[:-1]
    edge[off[:-1][off[:-1] < len(data)]] = True
    start = np.flatnonzero(word & edge)
    stop = np.empty(len(data), dtype=bool)
    stop[-1] = True
    stop[:-1] = edge[1:] | ~word[1:]
    end = np.flatnonzero(word & stop) + 1
    return Words(start, end, np.searchsorted(start, off))


LONG = 64  # bytes; polynomials modulo 2^64 collide on long ranges of a certain form, so those get a digest


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: polynomials of short ones, digests of those over LONG bytes."""
    n = len(data)
    acc = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table("p", _BASE, n), out=acc[1:])
    out = mix64((acc[end] - acc[start]) * _power_table("i", _BASE_INV, n + 1)[start])
    far = np.flatnonzero(end - start > LONG)
    if len(far):
        out[far] = digests(data, start[far], end[far])[:, 0]
    return out


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests (rows of two 64-bit numbers) of ranges of an array, by their bytes; equality of them decides results."""
    size = data.itemsize
    raw = memoryview(np.ascontiguousarray(data).view(np.uint8).data) if len(data) else memoryview(b"")
    out = b"".join(hashlib.blake2b(raw[lo * size : hi * size], digest_size=16).digest() for lo, hi in zip(start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(out, dtype=np.uint64).reshape(-1, 2)


def window_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive item hashes (also over document borders; callers mask those)."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = items[:n].copy()
    for k in range(1, width):
        out *= _STEP
        out += items[k : k + n]
    return mix64(out)


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every ``width``-word shingle; a document of fewer words gives its whole sequence as one."""
    count = np.diff(first)
    all_ = window_hashes(words, width)
    doc = np.repeat(np.arange(len(count)), np.maximum(count - width + 1, 0))
    at = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(count - width + 1, 0)) - np.maximum(count - width + 1, 0), np.maximum(count - width + 1, 0))
    out = all_[first[:-1][doc] + at] if len(doc) else np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        own = np.zeros(len(short), dtype=np.uint64)
        for i, d in enumerate(short):
            with np.errstate(over="ignore"):
                h = np.uint64(int(count[d]))
                for w in words[first[d] : first[d + 1]]:
                    h = h * _STEP + w
            own[i] = h
        doc = np.concatenate([doc, short])
        out = np.concatenate([out, mix64(own + np.uint64(77))])
    return doc, out


def shingle_sets(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash), ordered by both."""
    if not len(doc):
        return doc, h
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.empty(len(doc), dtype=bool)
    keep[0] = True
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]
