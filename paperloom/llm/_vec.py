"""Byte-level tokenising and hashing over whole Arrow columns with numpy.

Texts stay UTF-8 bytes.  A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which on UTF-8 is the
same as ``[^\\x20\\x09-\\x0D]+`` on characters, since continuation bytes never fall in those ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS = {_BASE: np.ones(1, U64), _BASE_INV: np.ones(1, U64)}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS[base]
    if len(have) < n:
        full = np.full(1 << max(16, int(n - 1).bit_length()), base, U64)
        full[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(full)
    return have[:n]


@dataclass
class Words:
    """The words of a run of documents: byte spans, and word ``first[d]:first[d + 1]`` belong to document d."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.start))


def find_words(buf: np.ndarray, offs: np.ndarray) -> Words:
    if not len(buf):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64))
    inside = ~IS_SPACE[buf]
    fresh = np.ones(len(buf), bool)
    fresh[1:] = ~inside[:-1]
    bounds = offs[:-1][offs[:-1] < len(buf)]
    fresh[bounds] = True
    last = np.ones(len(buf), bool)
    last[:-1] = ~inside[1:]
    last[bounds[bounds > 0] - 1] = True
    start = np.flatnonzero(inside & fresh)
    end = np.flatnonzero(inside & last) + 1
    return Words(start, end, np.searchsorted(start, offs))


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of byte spans, ordered by place, that do not depend on where the spans lie.

    Spans are taken some at a time, about ``step`` bytes, which bounds what is held beside long texts.
    """
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        low = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, low + step, side="right")))
        part = buf[low : int(end[j - 1])]
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTE_CODE[part] * _powers(_BASE, len(part)), out=total[1:])
        back = _powers(_BASE_INV, len(part) + 1)
        a, b = start[i:j] - low, end[i:j] - low
        out[i:j] = mix64((total[b] - total[a]) * back[a] + (b - a).astype(U64))
        i = j
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position (the last k - 1 positions run over the end and mean nothing)."""
    out = np.full(len(words), k, U64)
    for j in range(k):
        out *= U64(_BASE)
        out[: max(0, len(words) - j)] += words[j:]
    return mix64(out)


def gram_hashes_rows(values: np.ndarray) -> np.ndarray:
    """One hash for the last axis of an integer array."""
    out = np.zeros(values.shape[:-1], U64)
    for j in range(values.shape[-1]):
        out = out * U64(_BASE) + mix64(values[..., j].astype(U64) + U64(1))
    return mix64(out)


def chunks(texts: pa.Array, target: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows i:j of a string array with about ``target`` bytes: (i, j, bytes, offsets). Null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    bufs = texts.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offs, offs[i] + target, side="right")) - 1
        j = min(len(texts), max(i + 1, j))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for each pair."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(length) - length
    return np.arange(total) - np.repeat(skip, length) + np.repeat(start, length)
