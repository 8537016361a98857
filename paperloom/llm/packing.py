"""Packing token sequences by best-fit decreasing (operator 6).

Each map task tokenises its documents, cuts those longer than a window into full windows and packs the rests
by best-fit decreasing: longest first, each into the open window with the least room that still holds it, found
in a segment tree indexed by remaining capacity.  Packing within map tasks needs no shuffle and no driver state; the cost is
at most a few under-filled windows per task, against thousands of windows in a task of usual size.  Only
pieces' numbers are held while packing: 32 bytes a piece of the task, and as much again for its place.

Null text reads as empty: a document of the end id alone.  Repeated rows are packed each on its own; a null doc_id passes through; other columns
are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V
from ._worker import memo, task
from .bpe_fold import PairRanks, WordMemo, fold_merges

WINDOW = 2048
END_ID = 1


class CapacityTree:
    """A segment tree over remaining capacities 0..size: how many open windows have each, and the least that fits."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def least_at_or_above(self, need: int) -> int | None:
        """The tightest capacity >= need with an open window."""
        count, i = self.count, need + self.leaves
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) for pieces of 1..window tokens; ties go to the earlier piece and the window opened last."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, open_by_room = CapacityTree(window), {}
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.least_at_or_above(need)
        if room is None:
            room, at = window, opened
            opened += 1
        else:
            at = open_by_room[room].pop()
            tree.add(room, -1)
        bins[i], offsets[i] = at, window - room
        if room > need:
            open_by_room.setdefault(room - need, []).append(at)
            tree.add(room - need, 1)
    return bins, offsets


#: Code points that the block path handles: Latin letters up to U+024F and general punctuation.  They are stable under the
#: tokenizer's normaliser but for lower case; texts with any other code point, or one whose lower case is another, are encoded by the library itself.
_SPACE, _LETTER, _NUMBER, _OTHER, _FOREIGN = range(5)


def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    import unicodedata

    kind = np.full(0x110000, _FOREIGN, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in [*range(0x20, 0x7F), *range(9, 14), *range(0xA0, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        low = chr(c).lower()
        if len(low) > 1:
            continue
        lower[c] = ord(low)
        what = unicodedata.category(chr(c))[0]
        kind[c] = _SPACE if c in (32, 0xA0, *range(9, 14)) else _LETTER if what == "L" else _NUMBER if what == "N" else _OTHER
    kind[kind[lower] == _FOREIGN] = _FOREIGN
    return kind, lower


class BlockEncoder:
    """Token ids of many texts at a time, equal to the tokenizers library's.

    A block of texts is split into pieces by character class, its distinct pieces are encoded by one fold of the
    ranked merges, and the ids are gathered in text order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, mark = model["vocab"], model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, merged = (np.array([vocab[x] for x in xs]) for xs in zip(*((a, b, a + b) for a, b in merges), strict=True))
        self.table = PairRanks(left, right, np.arange(len(left)), merged)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[shown[b] + mark] for b in range(256)], np.int64)
        self.kind, self.lower = _character_tables()
        self.memo = WordMemo()

    def alone(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def pieces(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the splitter's pieces in lower-case code points."""
        kind = self.kind[points]
        begin = kind != _SPACE
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        mark = np.flatnonzero(begin & (points == 39))
        mark = mark[mark + 1 < len(points)]
        a = points[mark + 1]
        b = points[np.minimum(mark + 2, len(points) - 1)] * (mark + 2 < len(points))
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ~one & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        for at, n in ((mark[one], 2), (mark[two], 3)):
            begin[at + 1] = False
            after = at[at + n < len(points)] + n
            begin[after] |= kind[after] != _SPACE
        start = np.flatnonzero(begin)
        stop = np.append(start[1:], len(points))
        gap = np.flatnonzero(np.append(kind[1:] == _SPACE, True) & (kind != _SPACE)) + 1
        return start, np.minimum(stop, gap[np.searchsorted(gap, start, side="right")] if len(start) else stop)

    def block(self, texts: list[str], points: np.ndarray) -> list[np.ndarray]:
        points = self.lower[points]
        start, end = self.pieces(points)
        if not len(start):
            return [np.zeros(0, "<u4")] * len(texts)
        width = np.ones(len(points), np.int64)
        width[points >= 0x80] += 1
        width[points >= 0x800] += 1
        byte_at = np.concatenate(([0], np.cumsum(width)))
        raw = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
        first, last = byte_at[start], byte_at[end]
        hashes = V.hash_spans(raw, first, last)
        if self.memo.n > self.memo.most:
            self.memo.clear()
        which = self.memo.find(hashes)
        new = np.flatnonzero(which < 0)
        if len(new):
            by = new[np.argsort(hashes[new], kind="stable")]
            pick = by[np.append(True, hashes[by[1:]] != hashes[by[:-1]])]
            size = last[pick] - first[pick]
            symbols = self.inner[raw[V.ranges(first[pick], size)]]
            bounds = np.concatenate(([0], np.cumsum(size)))
            symbols[bounds[1:] - 1] = self.final[raw[last[pick] - 1]]
            self.memo.add(hashes[pick], *fold_merges(symbols, bounds, self.table))
            which[new] = self.memo.find(hashes[new])
        count = self.memo.size[which]
        out = self.memo.ids[V.ranges(self.memo.start[which], count)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        token_at = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(start, np.concatenate(([0], ends)))]
        return [out[a:b] for a, b in zip(token_at[:-1].tolist(), token_at[1:].tolist(), strict=True)]

    def encode(self, texts: list[str], block_chars: int = 1 << 20) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text; memory is bounded by a block or by the longest text, and the memo."""
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and (j == i or held + len(texts[j]) <= block_chars):
                held += len(texts[j])
                j += 1
            part = texts[i:j]
            points = np.frombuffer("\n".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            if (self.kind[points] == _FOREIGN).any() or any("<|" in t for t in part):
                for t in part:
                    own = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                    foreign = "<|" in t or (self.kind[own] == _FOREIGN).any()
                    out.append(self.alone(t) if foreign else self.block([t], own)[0])
            else:
                out += self.block(part, points)
            i = j
        return out


def encoder(path: str) -> BlockEncoder:
    """One encoder per Python worker and vocabulary, until tasks of another operator use the worker."""
    encoders = memo("op6")
    if path not in encoders:
        encoders[path] = BlockEncoder(path)
    return encoders[path]


def cut_document(tokens: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full windows, then the rest."""
    return [(s, min(window, tokens - s)) for s in range(0, tokens, window)]


_SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    ``sequence_id`` holds the task's number in its upper bits, so ids are unique without any exchange.
    """
    ident = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    @task("op6")
    def run(batches):
        codec = encoder(tokenizer_path)
        ids_parts, raws = [], []
        start, length, crc, total = (array("q") for _ in range(4))
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows = []
                for row, ids in enumerate(codec.encode([t or "" for t in part.column(1).to_pylist()])):
                    raw = ids.tobytes() + end
                    n = len(raw) // 4
                    for s, size in cut_document(n, window):
                        piece = raw[4 * s : 4 * (s + size)]
                        rows.append(row)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            raws.append(piece)
                ids_parts.append(part.column(0).take(pa.array(rows, pa.int32())))
        if not start:
            return
        context = TaskContext.get()
        bins, offsets = best_fit_decreasing(np.frombuffer(length, np.int64), window)
        sequence = bins + ((context.partitionId() if context else 0) << 40)
        columns = [pa.concat_arrays(ids_parts).cast(kind), *(pa.array(np.frombuffer(x, np.int64)) for x in (start, length, crc, total)), pa.array(sequence), pa.array(offsets)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(pa.array([np.frombuffer(r, "<u4").astype(np.int32) for r in raws], pa.list_(pa.int32())))
            names.append("ids")
        done = pa.RecordBatch.from_arrays(columns, names=names)
        for i in range(0, done.num_rows, 10_000):
            yield done.slice(i, 10_000)

    schema = f"doc_id {ident}, {_SCHEMA}" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
