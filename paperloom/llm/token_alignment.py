"""Alignment of two tokenizers by byte-owner arrays (operator 11).

A text with one space before it is encoded by a byte-level BPE (A) and by a sentence-piece model (B).  Repeating each token's index over its bytes
gives an owner array for A and one for B: neighbouring bytes with different owner pairs begin a link, an A token and a B token
that overlap, and bytes where both owners change begin a group, the least stretch that both tokenizers cut out alike.
Texts are taken some hundreds of kilobytes at a time, and owner arrays a window of bytes at a time, so long texts take no more than their tokens.

How often a pair of ids is linked is counted by documents over the whole corpus.  Documents are packed into blocks of bounded size that
carry each distinct pair once, with the number of the block's documents that hold it: only these pairs are shuffled, for their sums and back to their
blocks, so a pair that every document holds costs a row a block.  No table of the vocabulary's pairs is broadcast.

Texts that are null or empty, and those that a tokenizer does not give back byte for byte, have no tokens: counts of 0, null groups, no links.  Special tokens'
strings in texts are plain text.  Repeated rows are documents of their own; a null doc_id passes through; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V
from ._store import TEXT_ROWS, cut, drop
from ._worker import memo, task, trim

#: Bytes of text encoded at once, and bytes that owner arrays span.
BLOCK_BYTES = 1 << 18
OWNER_BYTES = 1 << 20
#: A block of documents for the corpus counts holds up to so many link pairs (of several documents) and so many documents.
BLOCK_PAIRS = 1 << 19
BLOCK_DOCUMENTS = 1 << 13
#: Documents of a block lie in rows of up to so many link pairs (of several documents), as executors hold many rows at a time.
ROW_PAIRS = 1 << 15
#: Bits of a token id in a pair of ids.
ID_BITS = 24

PAIRS = "array<struct<a:int,b:int,times:int>>"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The bytes of every token id, one after the other."""

    def __init__(self, tokens: list[bytes]):
        if len(tokens) >= 1 << ID_BITS:
            raise ValueError(f"a vocabulary of {len(tokens)} tokens; at most {1 << ID_BITS} are supported")
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[V.ranges(self.start[ids], self.size[ids])]


class ByteLevel:
    """A byte-level BPE read from a tokenizers file.

    Where merges stand in the order of the ids they make, ids are ranks, and the encoder that takes ranks gives the library's ids several times faster; else the
    library encodes.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        vocab, letters = stated["model"]["vocab"], byte_alphabet()
        special = {t["content"] for t in stated.get("added_tokens", ())}
        tokens = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            tokens[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        self.vocabulary = Vocabulary(tokens)
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in stated["model"]["merges"]]
        if made == sorted(set(made)) and len(made) + 256 + len(special & vocab.keys()) == len(vocab):
            import tiktoken

            ranks = {tokens[i]: i for token, i in vocab.items() if token not in special}
            coder = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [coder.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentence-piece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
        self.vocabulary = Vocabulary([bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces])
        self.encode = lambda texts: model.encode(texts, num_threads=1)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    return np.fromiter((i for x in lists for i in x), np.int32, int(first[-1])), first


def owners(ends: np.ndarray, low: int, high: int) -> np.ndarray:
    """The index of the token that owns each byte of low:high; tokens end at ``ends``, the first begins at 0, none is empty."""
    first, last = np.searchsorted(ends, [low, high - 1], side="right")
    stop = np.minimum(ends[first : last + 1], high)
    return np.repeat(np.arange(first, last + 1), np.diff(stop, prepend=low))


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray, window: int = OWNER_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (an A and a B token each) in byte order, and the first A and B token of each group, of two ways to cut the same bytes."""
    whole = int(ends_a[-1]) if len(ends_a) else 0
    links, cuts, before = [], [], (-1, -1)
    for low in range(0, whole, window):
        high = min(whole, low + window)
        a, b = owners(ends_a, low, high), owners(ends_b, low, high)
        new_a, new_b = np.diff(a, prepend=before[0]) != 0, np.diff(b, prepend=before[1]) != 0
        at = np.flatnonzero(new_a | new_b)
        links.append((a[at], b[at]))
        at = np.flatnonzero(new_a & new_b)
        cuts.append((a[at], b[at]))
        before = int(a[-1]), int(b[-1])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *(x[i] for x in part)]) for part in (links, cuts) for i in (0, 1))


class Aligner:
    """Two tokenizers and the decimal forms of their ids."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        self.a, self.b = ByteLevel(path_a, pattern), Pieces(path_b)
        #: For each id its decimal form followed by nothing, a comma, the mark between sides, or the mark between groups.
        self.written = [np.array([[f"{i}{mark}" for i in range(len(t.vocabulary.size))] for mark in ("", ",", "|", ";")], object) for t in (self.a, self.b)]

    def tokens(self, texts: list[str]) -> tuple[tuple, tuple]:
        """(ids, bounds by text) of A and B; none for texts that one of them does not give back."""
        raw = [b" " + t.encode() if t else b"" for t in texts]
        lists = [t.encode([before + x for x in texts if x]) for t, before in ((self.a, " "), (self.b, ""))]
        for which in range(2):
            own = iter(lists[which])
            lists[which] = [next(own) if x else [] for x in texts]
        flat = [_flat(x) for x in lists]
        bad = np.zeros(len(texts), bool)
        length = np.array([len(x) for x in raw])
        for (ids, first), t in zip(flat, (self.a, self.b), strict=True):
            bad |= np.diff(np.concatenate(([0], np.cumsum(t.vocabulary.size[ids])))[first]) != length
        for which, t in enumerate((self.a, self.b)):
            held = [[] if bad[i] else x for i, x in enumerate(lists[which])]
            ids, first = _flat(held) if bad.any() else flat[which]
            want = np.frombuffer(b"".join(x for i, x in enumerate(raw) if not bad[i]), np.uint8)
            wrong = np.flatnonzero(t.vocabulary.bytes_of(ids) != want)
            bounds = np.cumsum(np.where(bad, 0, length))
            bad = bad.copy()
            bad[np.unique(np.searchsorted(bounds, wrong, side="right"))] = True
        if bad.any():
            flat = [_flat([[] if bad[i] else x for i, x in enumerate(part)]) for part in lists]
        return flat[0], flat[1]

    def align(self, texts: list[str]) -> dict[str, np.ndarray]:
        """ids, first (bounds by text) of both sides; links and their bounds by text; first tokens of groups and their bounds by text."""
        (a, first_a), (b, first_b) = self.tokens(texts)
        ends_a, ends_b = (np.cumsum(t.vocabulary.size[ids]) for t, ids in ((self.a, a), (self.b, b)))
        link_a, link_b, cut_a, cut_b = overlaps(ends_a, ends_b)
        return {
            "a": a, "b": b, "first_a": first_a, "first_b": first_b, "link_a": link_a, "link_b": link_b, "cut_a": cut_a, "cut_b": cut_b,
            "links": np.searchsorted(link_a, first_a), "cuts": np.searchsorted(cut_a, first_a),
        }

    def texts(self, x: dict[str, np.ndarray]) -> list[str | None]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``, ids in order; None where there are no tokens."""
        n_a, n_b = len(x["a"]), len(x["b"])
        size_a, size_b = np.diff(x["cut_a"], append=n_a), np.diff(x["cut_b"], append=n_b)
        group = np.arange(len(size_a))
        place_a = np.arange(n_a) + np.repeat(x["cut_b"], size_a)
        place_b = np.arange(n_b) + np.repeat(x["cut_a"] + size_a, size_b)
        mark_a, mark_b = np.ones(n_a, np.int64), np.ones(n_b, np.int64)
        mark_a[x["cut_a"] + size_a - 1] = 2
        last = np.full(len(group), 3)
        stops = x["cuts"][1:]
        last[stops[np.diff(x["cuts"]) > 0] - 1] = 0
        mark_b[x["cut_b"] + size_b - 1] = last
        out = np.empty(n_a + n_b, object)
        out[place_a] = self.written[0][mark_a, x["a"]]
        out[place_b] = self.written[1][mark_b, x["b"]]
        bounds = x["first_a"] + x["first_b"]
        return ["".join(out[i:j].tolist()) if j > i else None for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def pairs(self, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked pairs of ids by text: bounds, A ids, B ids, times."""
        which = np.repeat(np.arange(len(x["links"]) - 1), np.diff(x["links"]))
        key = (which.astype(np.int64) << 2 * ID_BITS) | (x["a"][x["link_a"]].astype(np.int64) << ID_BITS) | x["b"][x["link_b"]]
        key.sort()
        new = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(new, append=len(key))
        key, low = key[new], (1 << ID_BITS) - 1
        return np.searchsorted(key >> 2 * ID_BITS, np.arange(len(x["links"]))), (key >> ID_BITS) & low, key & low, times


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of bounded size and number."""
    for i, j, _, _ in V.chunks(texts, BLOCK_BYTES):
        for at in range(i, j, BLOCK_DOCUMENTS):
            yield at, min(j, at + BLOCK_DOCUMENTS)


def _bytes(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    """Runs of integers as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _from_bytes(column: pa.ChunkedArray, sizes: list[int]) -> np.ndarray:
    """The integers of binary values, so many in each."""
    # An integer has one, two or four bytes.
    parts = [np.frombuffer(x.as_py(), f"u{len(x.as_buffer()) // n}").astype(np.int64) for x, n in zip(column, sizes, strict=True) if n]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _list(bounds: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32), pa.int32())


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str, spans: bool = False, packed: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``) and pairs (linked A and B ids with the number of links) of each row of docs.

    With ``packed``, pairs are binary, three integers of four bytes each, which rate_links() takes as well and executors carry in a third of the memory.
    With ``spans`` also a_ids and b_ids, the tokens; a_cuts and b_cuts, the first token of each group; link_a and link_b, the links as token numbers.
    """
    ident = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ident}, n_a bigint, n_b bigint, n_groups bigint, groups string, pairs {'binary' if packed else PAIRS}"
    arrays = ("a_ids", "b_ids", "a_cuts", "b_cuts", "link_a", "link_b") if spans else ()
    schema += "".join(f", {name} array<int>" for name in arrays)

    @task("op11")
    def run(batches):
        kept = memo("op11")
        key = (path_a, path_b, pattern)
        if key not in kept:
            kept[key] = Aligner(*key)
        aligner = kept[key]
        for batch in batches:
            for i, j in _blocks(batch.column(1)):
                x = aligner.align([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                bounds, a, b, times = aligner.pairs(x)
                if packed:
                    pairs = _bytes(3 * bounds, np.stack([a, b, times], axis=1).astype(np.int32).ravel())
                else:
                    pairs = _list(bounds, pa.StructArray.from_arrays([_ints(a), _ints(b), _ints(times)], names=["a", "b", "times"]))
                out = [batch.column(0).slice(i, j - i), *(pa.array(np.diff(x[c]), pa.int64()) for c in ("first_a", "first_b", "cuts")), pa.array(aligner.texts(x), pa.string()), pairs]
                if spans:
                    sides = (("a", "first_a", None), ("b", "first_b", None), ("cut_a", "cuts", "first_a"), ("cut_b", "cuts", "first_b"), ("link_a", "links", "first_a"), ("link_b", "links", "first_b"))
                    for name, by, base in sides:
                        values = x[name] - np.repeat(x[base][:-1], np.diff(x[by])) if base else x[name]
                        out.append(_list(x[by], _ints(values)))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", *arrays])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _pack_blocks(aligned: DataFrame, others: list[str]) -> DataFrame:
    """block, rows (the other columns of some of its rows), sizes, pair, times (each row's pairs as numbers among the block's), and once a block keys, held (its distinct pairs)."""
    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema}
    row = ",".join(f"`{c}`:{kinds[c]}" for c in others)

    @task("op11")
    def run(batches):
        prefix, number = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            pairs = batch.column(0)
            packed = pa.types.is_binary(pairs.type)
            if packed:
                offs = np.frombuffer(pairs.buffers()[1], np.int32)[pairs.offset : pairs.offset + len(pairs) + 1] if len(pairs) else np.zeros(1, np.int32)
                table = np.frombuffer(pairs.buffers()[2] or b"", np.uint8)[: offs[-1]].view(np.int32).reshape(-1, 3)
                offs = offs // 12
            else:
                offs = pairs.offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                stop = int(np.searchsorted(offs, offs[at] + BLOCK_PAIRS, side="right")) - 1
                stop = min(batch.num_rows, max(at + 1, stop), at + BLOCK_DOCUMENTS)
                if packed:
                    a, b, times = table[offs[at] : offs[stop]].T
                else:
                    part = pairs.values.slice(offs[at], offs[stop] - offs[at])
                    a, b, times = (part.field(i).to_numpy() for i in range(3))
                keys, pair, held = np.unique((a.astype(np.int64) << ID_BITS) | b, return_inverse=True, return_counts=True)
                first, cuts = (offs[at : stop + 1] - offs[at]).astype(np.int64), [0]
                while cuts[-1] < stop - at:
                    cuts.append(max(cuts[-1] + 1, int(np.searchsorted(first, first[cuts[-1]] + ROW_PAIRS, side="right")) - 1))
                cuts = np.array(cuts)
                once = np.minimum(np.arange(len(cuts)), 1)
                rows = pa.StructArray.from_arrays([c.slice(at, stop - at) for c in batch.columns[1:]], names=others)
                one = [pa.array(np.full(len(cuts) - 1, prefix | number)), _list(cuts, rows), _list(cuts, _ints(np.diff(first)))]
                one += [_bytes(first[cuts], v.astype(np.min_scalar_type(v.max(initial=0)))) for v in (pair, times)]
                one += [_list(once * len(keys), pa.array(keys)), _list(once * len(held), _ints(held))]
                yield pa.RecordBatch.from_arrays(one, names=["block", "rows", "sizes", "pair", "times", "keys", "held"])
                at, number = stop, number + 1

    kind = f"block bigint, rows array<struct<{row}>>, sizes array<int>, pair binary, times binary, keys array<bigint>, held array<int>"
    return aligned.select("pairs", *others).mapInArrow(run, kind)


def link_counts(blocks: DataFrame) -> DataFrame:
    """key (A id and B id), n (documents that hold the pair linked) and best (whether no pair of its A id is held by more) of the blocks' pairs."""
    pairs = blocks.select(F.explode(F.arrays_zip("keys", "held")).alias("p"))
    counts = pairs.groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.held").alias("n")).withColumn("a", F.shiftright("key", ID_BITS))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def rate_links(aligned: DataFrame) -> DataFrame:
    """The rows of aligned, which has ``pairs``, with n_links, n_best (links that are their A id's most frequent) and count_sum in its place."""
    others = [c for c in aligned.columns if c != "pairs"]
    added = [c for c in ("n_links", "n_best", "count_sum") if c not in others]
    if len(added) < 3:
        raise ValueError("aligned has columns of the names n_links, n_best or count_sum already")
    blocks = cut(_pack_blocks(aligned, others), "op11-blocks", TEXT_ROWS, wide=True)
    rated = cut(link_counts(blocks), "op11-counts", wide=True)
    own = blocks.select(F.col("block").alias("of"), F.explode("keys").alias("key")).join(rated.hint("merge"), "key")
    kinds = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in others)

    def rate(block: pa.Table, rates: pa.Table) -> pa.Table:
        if memo("op11"):
            memo("op11").clear()
            trim()
        sizes = [x.values.to_numpy() for x in block["sizes"]]
        pair, times = (_from_bytes(block[c], [int(x.sum()) for x in sizes]) for c in ("pair", "times"))
        key, n, best = (rates[c].to_numpy() for c in ("key", "n", "best"))
        order = np.argsort(key)
        first = np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int64)
        n, best = n[order][pair] * times, best[order][pair] * times
        sums = [np.diff(np.append(0, np.cumsum(v.astype(np.int64)))[first]) for v in (times, best, n)]
        return pa.table([*block["rows"].combine_chunks().flatten().flatten(), *(pa.array(v) for v in sums)], names=[*others, *added])

    whole = blocks.select("block", "rows", "sizes", "pair", "times").groupBy("block").cogroup(own.groupBy("of"))
    out = cut(whole.applyInArrow(rate, f"{kinds}, n_links bigint, n_best bigint, count_sum bigint"), "op11-result", wide=True)
    drop(blocks, rated)
    return out
