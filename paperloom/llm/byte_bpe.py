"""Byte-level BPE encoding and decoding (operator 7).

Texts are split by the tokenizer's pattern.  The distinct words of a block that are not known yet are folded together by ranked merges
over their byte arrays (``bpe_fold``): every word merges its leftmost pair of least rank, round by round.  A word of more than ``LONG_WORD`` bytes is merged
on its own with a heap, so no text costs more than n log n.  Ids are gathered in text order.  Decoding gathers each id's bytes.

Row-wise map tasks without a shuffle; each Python worker keeps a memo of up to ``MEMO_WORDS`` words, which does not change results.

A form of this operator in Spark's higher-order functions was measured first; see the README.

Null text reads as empty: no ids.  Repeated rows are encoded each on its own; a null doc_id passes through; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V
from .bpe_fold import PairRanks, fold_merges

LONG_WORD = 512
MEMO_WORDS = 1 << 18
BLOCK_ROWS = 500


def read_ranks(path: str) -> list[bytes]:
    """The pieces by rank of a rank file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (1 + max(int(r) for _, r in pairs))
    for piece, rank in pairs:
        out[int(rank)] = base64.b64decode(piece)
    return out


class Codec:
    """Encoding and decoding with one rank file and pattern."""

    def __init__(self, rank_path: str, pattern: str | None):
        import regex

        self.pieces = read_ranks(rank_path)
        self.rank = {p: r for r, p in enumerate(self.pieces) if p}
        self.split = regex.compile(pattern).findall if pattern else None
        parts = [(self.rank[p[:i]], self.rank[p[i:]], r) for p, r in self.rank.items() for i in range(1, len(p)) if p[:i] in self.rank and p[i:] in self.rank]
        left, right, whole = (np.array(x, np.int64) for x in zip(*parts, strict=True))
        self.table = PairRanks(left, right, whole, whole)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.word_start, self.word_size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _merge_long(self, raw: bytes) -> list[int]:
        """The merges of one word in order of rank and place, by a heap over a linked list."""
        n = len(raw)
        ids, before, after = self.single[np.frombuffer(raw, np.uint8)].tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
        pieces, heap = self.pieces, []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0:
                rank = self.rank.get(pieces[ids[i]] + pieces[ids[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], j, ids[j]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, a, j, b = heapq.heappop(heap)
            if ids[i] != a or after[i] != j or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def learn(self, words: list[str]) -> None:
        if len(self.number) + len(words) > MEMO_WORDS:
            self.clear()
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        known: list[list[int] | None] = [[self.rank[r]] if r in self.rank else self._merge_long(r) if len(r) > LONG_WORD else None for r in raw]
        rest = [r for r, k in zip(raw, known, strict=True) if k is None]
        bounds = np.concatenate(([0], np.cumsum([len(r) for r in rest]))).astype(np.int64)
        ids, cut = fold_merges(self.single[np.frombuffer(b"".join(rest), np.uint8)], bounds, self.table)
        fold = iter(zip(cut[:-1].tolist(), np.diff(cut).tolist(), strict=True))
        done = [x for k in known if k is not None for x in k]
        start, size, at = [], [], len(self.ids) + len(ids)
        for k in known:
            if k is None:
                s, n = next(fold)
                start.append(len(self.ids) + s)
                size.append(n)
            else:
                start.append(at)
                size.append(len(k))
                at += len(k)
        self.ids = np.concatenate((self.ids, ids.astype(np.int32), np.array(done, np.int32)))
        first = len(self.number)
        self.word_start, self.word_size = np.concatenate((self.word_start, np.array(start, np.int64))), np.concatenate((self.word_size, np.array(size, np.int64)))
        self.number.update((w, first + i) for i, w in enumerate(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's begin."""
        split = [self.split(t) for t in texts]
        new = list({w for words in split for w in words} - self.number.keys())
        if len(self.number) + len(new) > MEMO_WORDS:
            self.clear()
            new = list({w for words in split for w in words})
        if new:
            self.learn(new)
        number = self.number.__getitem__
        which = np.fromiter((n for words in split for n in map(number, words)), np.int64)
        size = self.word_size[which]
        out = self.ids[V.ranges(self.word_start[which], size)]
        ends = np.concatenate(([0], np.cumsum([len(words) for words in split]))).astype(np.int64)
        return out, np.concatenate(([0], np.cumsum(size)))[ends]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes in order, and where each list's begin."""
        size = self.size[ids]
        return self.flat[V.ranges(self.start[ids], size)], np.concatenate(([0], np.cumsum(size)))[bounds]


_CODECS: dict[tuple, Codec] = {}


def codec(rank_path: str, pattern: str | None = None) -> Codec:
    """One codec per Python worker, rank file and pattern."""
    if (rank_path, pattern) not in _CODECS:
        _CODECS[rank_path, pattern] = Codec(rank_path, pattern)
    return _CODECS[rank_path, pattern]


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` for each row of docs."""
    ident = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = codec(rank_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ids, bounds = coder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {ident}, ids array<int>")


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """doc_id, ids and ``bytes``, the concatenated pieces, for each row of encoded."""
    ident = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = codec(rank_path)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                lists = part.column(1)
                bounds = lists.offsets.to_numpy()
                raw, ends = coder.decode(lists.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0])
                whole = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, whole], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {ident}, ids array<int>, bytes binary")
