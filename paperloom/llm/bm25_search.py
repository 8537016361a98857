"""Exact top-k BM25 search with block-max pruning, per shard (operator 9).

Document frequencies, the number of documents and their mean length are computed over the whole corpus first, so scores do not depend on the
sharding.  Documents are dealt into shards of about ``words_per_shard`` words, one task each, which turns them, some two million words at a time, into one
inverted index: per term the postings (document and impact).  Documents are numbered by their most frequent word and length, so that blocks of 64 hold similar documents.
Terms that more than one document in 20 has (of these the most frequent, as far as ``TILE_CELLS`` goes) have a dense row of impacts instead, with the greatest impact in each block.

Queries run as block-max WAND does, a block at a time, in two steps.  The lists of usual terms are short and are added up for all their documents.  What a block's
documents reach by them, and the maxima of the dense rows in the block, add up to a bound for the block, which is a pivot only if that bound reaches the threshold, the k-th
best score so far.  The blocks with the greatest bounds are scored first and raise the threshold; the dense rows are never read in other blocks.  Dense rows are
multiplied in single precision for many queries at a time, which only chooses documents, with a margin for its error; the chosen ones are scored in double precision.
Shards' lists of k are merged by (score, doc_id).

Index rows and queries of a shard reach its task as one sorted stream: first the shard's documents, which become the indexes, then all queries in batches.
A task holds its shard's index (about ten bytes a posting and 48 MB of dense rows at most) and scores of some queries at a time (``SCORE_CELLS``), however many
queries there are; nothing is broadcast or collected.

A document's words are the lower-cased (A-Z) runs outside white space, hashed to 64 bits (two words with one hash would count as one); a query is the
set of its words, of all rows where several share a doc_id.  Score: the sum over shared words of
ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)), rounded to six decimals; equal scores
rank by doc_id.  Null or empty texts find nothing and are never found.  Repeated rows are found each on its own; rows with a null doc_id count in the statistics
but are neither found nor asked.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _vec as V
from ._store import TEXT_ROWS, cut, drop
from ._worker import task

K1, B = 1.2, 0.75
BLOCK = 64
WORDS_PER_SHARD = 16_000_000
WORDS_PER_INDEX = 24_000_000
WORDS_PER_PART = 2_000_000
BATCH = 512
#: Cells of an index's dense rows, and of the scores of the queries that are taken at once.
TILE_CELLS = 12_000_000
SCORE_CELLS = 4_000_000
LONG_LIST = 0.05
DECIMALS = 6
_DF, _DOCS, _WORDS = 0, 1, 2


def _hashed_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = V.find_words(buf, offs)
    return V.hash_spans(V.LOWER[buf], words.start, words.end), words.first


def _statistics(docs: DataFrame) -> DataFrame:
    """kind, term, n: partial document frequencies, and the numbers of documents and words."""

    def fold(parts):
        term, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(term, kind="stable")
        term, n = term[by], n[by]
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        return term[first], np.add.reduceat(n, first) if len(first) else n

    def rows(kind, term, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(term.view(np.int64)), pa.array(n)], names=["kind", "term", "n"])

    def run(batches):
        parts, held, n_docs, n_words = [], 0, 0, 0
        for batch in batches:
            n_docs += batch.num_rows
            for _, _, buf, offs in V.chunks(batch.column(0)):
                term, first = _hashed_words(buf, offs)
                n_words += len(term)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                by = np.argsort(term, kind="stable")
                t, d = term[by], doc[by]
                new = np.append(True, (t[1:] != t[:-1]) | (d[1:] != d[:-1])) if len(t) else np.zeros(0, bool)
                parts.append((t[new], np.ones(int(new.sum()), np.int64)))
                held += len(parts[-1][0])
                if held > 2_000_000:
                    parts = [fold(parts)]
                    if len(parts[0][0]) > 1_500_000:
                        yield rows(_DF, *parts[0])
                        parts = []
                    held = sum(len(p[0]) for p in parts)
        if parts:
            term, n = fold(parts)
            for i in range(0, len(n), 100_000):
                yield rows(_DF, term[i : i + 100_000], n[i : i + 100_000])
        yield rows(_DOCS, np.zeros(1, np.uint64), np.array([n_docs]))
        yield rows(_WORDS, np.zeros(1, np.uint64), np.array([n_words]))

    return docs.select("text").mapInArrow(run, "kind int, term bigint, n bigint")


def _query_terms(queries: DataFrame) -> DataFrame:
    ident = queries.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, j, buf, offs in V.chunks(batch.column(1)):
                term, first = _hashed_words(buf, offs)
                own = [np.unique(term[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                which = np.repeat(np.arange(j - i), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(which, pa.int32())), pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64))], names=["query_id", "term"]
                )

    return queries.mapInArrow(run, f"query_id {ident}, term bigint")


def _small(x: np.ndarray) -> np.ndarray:
    """The same non-negative integers in two bytes each, or in four where they need it."""
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)


class Part:
    """The postings of some documents by term and document: vocabulary, first (bounds by term), doc and tf."""

    def __init__(self, texts: list[pa.Array]):
        parts, lengths, base = [], [np.zeros(0, np.int64)], 0
        for column in texts:
            for i, j, buf, offs in V.chunks(column):
                term, first = _hashed_words(buf, offs)
                lengths.append(np.diff(first))
                doc = np.repeat(np.arange(base, base + j - i), lengths[-1])
                by = np.argsort(term, kind="stable")
                term, doc = term[by], doc[by]
                at = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))) if len(term) else np.zeros(0, np.int64)
                parts.append((term[at], doc[at].astype(np.int32), np.diff(np.append(at, len(term))).astype(np.int32)))
                base += j - i
        self.length = np.concatenate(lengths)
        term, doc, tf = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        del parts
        by = np.argsort(term, kind="stable")
        term, doc, tf = term[by], doc[by], tf[by]
        at = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        self.vocabulary, self.first = term[at], np.append(at, len(term))
        best = np.full(len(self.length), -1, np.int64)
        np.maximum.at(best, doc, tf * np.int64(1 << 32) + np.repeat(np.arange(len(at)), np.diff(self.first)))
        #: Each document's most frequent word; documents without words have one for themselves.
        self.top = np.append(self.vocabulary, np.uint64(0))[np.where(best < 0, len(at), best & 0xFFFFFFFF)]
        self.doc, self.tf = _small(doc), _small(tf)


class Shard:
    """The inverted index of some documents and its exact top-k.

    Lists of usual terms lie in ``doc`` and ``impact``, a term's between ``first``.  The terms of long lists have a row each: ``tiles`` holds their impacts on the
    64 documents of every block in single precision, ``ceiling`` the greatest of them, and ``l_row`` and ``l_tf`` by document, between ``l_first``, what exact scores are made of.
    """

    def __init__(self, texts: Iterable[pa.Array | Part], ids: list[pa.Array], mean_length: float):
        parts = [x if isinstance(x, Part) else Part([x]) for x in texts]
        length = np.concatenate([p.length for p in parts])
        n = self.n = len(length)
        order = np.lexsort((length, np.concatenate([p.top for p in parts])))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids = pa.concat_arrays(ids).take(pa.array(order))
        self.blocks = max(1, -(-n // BLOCK))
        self.norm = np.ones(self.blocks * BLOCK)
        self.norm[:n] = K1 * (1 - B + B * length[order] / mean_length)
        self.vocabulary = np.unique(np.concatenate([p.vocabulary for p in parts]))
        at = [np.searchsorted(self.vocabulary, p.vocabulary).astype(np.int32) for p in parts]
        size = np.zeros(len(self.vocabulary), np.int64)
        for p, own in zip(parts, at, strict=True):
            size[own] += np.diff(p.first)
        long = np.flatnonzero(size > max(BLOCK, LONG_LIST * n))
        room = TILE_CELLS // (self.blocks * BLOCK)
        self.long = np.sort(long[np.argsort(-size[long], kind="stable")[:room]])
        self.row = np.full(len(size), -1, np.int32)
        self.row[self.long] = np.arange(len(self.long))
        size[self.long] = 0
        self.first = np.append(0, np.cumsum(size))
        self.tiles = np.zeros((self.blocks, len(self.long), BLOCK), np.float32)
        rows = []
        self.doc, self.impact = np.zeros(self.first[-1], np.uint16 if n <= 1 << 16 else np.uint32), np.zeros(self.first[-1])
        free, base = self.first[:-1].copy(), 0
        while parts:
            p, own = parts.pop(0), at.pop(0)
            count = np.diff(p.first)
            doc, tf = place[p.doc.astype(np.int64) + base], p.tf
            row = np.repeat(self.row[own], count)
            dense = row >= 0
            rows.append((doc[dense], row[dense], tf[dense]))
            self.tiles[doc[dense] // BLOCK, row[dense], doc[dense] % BLOCK] = self._impact(doc[dense], tf[dense])
            to = (np.repeat(free[own] - p.first[:-1], count) + np.arange(len(doc)))[~dense]
            doc, tf = doc[~dense], tf[~dense]
            self.doc[to], self.impact[to] = doc, self._impact(doc, tf)
            free[own] += count
            base += len(p.length)
        self.ceiling = self.tiles.max(axis=2).T.copy()
        doc, row, tf = (np.concatenate(x) for x in zip(*rows, strict=True))
        by = np.argsort(doc, kind="stable")
        self.l_first = np.searchsorted(doc[by], np.arange(n + 1))
        self.l_row, self.l_tf = _small(row[by]), _small(tf[by])
        self.scored_blocks = 0

    def _impact(self, doc: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + self.norm[doc])

    def _usual(self, at: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
        """Scores by the terms of usual lists."""
        low, high = self.first[at], self.first[at + 1]
        ends = list(zip(low.tolist(), high.tolist(), strict=True))
        if ends:
            value = np.concatenate([self.impact[i:j] for i, j in ends])
            value *= np.repeat(weight, high - low)
            out[:] = np.bincount(np.concatenate([self.doc[i:j] for i, j in ends]), value, len(out))

    def top(self, terms: list[np.ndarray], weights: list[np.ndarray], k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(document numbers, scores) of the k best for each query, ties included; what scores below ``least`` may be left out."""
        step = max(1, SCORE_CELLS // (self.blocks * BLOCK))
        out = []
        for i in range(0, len(terms), step):
            out += self._top(terms[i : i + step], weights[i : i + step], k, None if least is None else least[i : i + step])
        return out

    def _top(self, terms: list[np.ndarray], weights: list[np.ndarray], k: int, least: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        b, width = len(terms), self.blocks * BLOCK
        query, usual = np.zeros((b, len(self.long))), np.zeros((b, width))
        for q, (term, weight) in enumerate(zip(terms, weights, strict=True)):
            at = np.searchsorted(self.vocabulary, term)
            at[at == len(self.vocabulary)] = 0
            hit = self.vocabulary[at] == term if len(self.vocabulary) else np.zeros(len(at), bool)
            at, weight = at[hit], weight[hit]
            row = self.row[at]
            query[q, row[row >= 0]] = weight[row >= 0]
            self._usual(at[row < 0], weight[row < 0], usual[q])
        #: Single precision serves the choice of documents alone: sums of so many terms are off by less than ``slack`` times themselves.
        slack = 4 * (len(self.long) + 16) * float(np.finfo(np.float32).eps)
        rough = np.nextafter(query.astype(np.float32), np.float32(np.inf)) * (query > 0)
        most = usual.reshape(b, self.blocks, BLOCK).max(axis=2)
        bound = (most + rough @ self.ceiling) * (1 + slack)
        score, peak = np.full((b, width), -1.0, np.float32), np.full((b, self.blocks), -1.0)

        def evaluate(wanted: np.ndarray) -> None:
            for block in np.flatnonzero(wanted.any(axis=0)).tolist():
                span, rows = slice(block * BLOCK, (block + 1) * BLOCK), np.flatnonzero(wanted[:, block])
                value = rough[rows] @ self.tiles[block] + usual[rows, span]
                score[rows, span] = value
                peak[rows, block] = value.max(axis=1)
            self.scored_blocks += int(wanted.sum())

        def threshold() -> np.ndarray:
            """What a document needs: k others, of other blocks or of the leading ones, have as much at least."""
            at = max(0, self.blocks - k)
            kth = np.partition(peak, at, axis=1)[:, at] if self.blocks >= k else np.full(b, -1.0)
            return np.maximum(np.maximum(kth, floor), low) * (1 - slack) - 1e-6

        low = np.full(b, -1.0) if least is None else least
        if self.blocks >= k:
            low = np.maximum(low, np.partition(most, self.blocks - k, axis=1)[:, self.blocks - k])
        lead = min(self.blocks, 1 + -(-k // BLOCK))
        ahead = np.argpartition(-bound, lead - 1, axis=1)[:, :lead]
        left = np.zeros((b, self.blocks), bool)
        np.put_along_axis(left, ahead, True, axis=1)
        floor = np.full(b, -1.0)
        left &= (bound > 0) & (bound >= low[:, None] - 1e-6)
        evaluate(left)
        own = np.take_along_axis(score.reshape(b, self.blocks, BLOCK), ahead[:, :, None], axis=1).reshape(b, -1)
        if own.shape[1] >= k:
            floor = np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k].astype(np.float64)
        evaluate((bound >= threshold()[:, None]) & (bound > 0) & ~left)
        need = threshold()
        q, block = np.nonzero((peak >= need[:, None]) & (peak > 0))
        near = score.reshape(b, self.blocks, BLOCK)[q, block]
        which, col = np.nonzero((near >= need[q][:, None]) & (near > 0))
        q, block = q[which], block[which]
        doc = block * BLOCK + col
        exact = usual[q, doc]
        for i in range(0, len(q), 4096):
            part = slice(i, i + 4096)
            size = self.l_first[doc[part] + 1] - self.l_first[doc[part]]
            at, of = V.ranges(self.l_first[doc[part]], size), np.repeat(np.arange(len(size)), size)
            exact[part] += np.bincount(of, query[q[part][of], self.l_row[at]] * self._impact(doc[part][of], self.l_tf[at]), len(size))
        exact = np.round(exact, DECIMALS)
        out, bounds = [], np.searchsorted(q, np.arange(b + 1))
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            found, value = doc[i:j], exact[i:j]
            good = value > 0
            if good.sum() > k:
                good &= value >= np.partition(value, -k)[-k]
            out.append((found[good], value[good]))
        return out


def _answers(shards: list[Shard], piece: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """query_id, doc_id, score: the k best documents of all the indexes for a batch of queries."""
    terms = [np.array(x.values.to_numpy(), np.int64).view(np.uint64) for x in piece.column("terms")]
    weights = [np.array(x.values.to_numpy()) for x in piece.column("weights")]
    best, tables = np.full((len(terms), k), -1.0), []
    for shard in shards:
        found = shard.top(terms, weights, k, best.min(axis=1))
        which = np.repeat(np.arange(len(terms)), [len(f[0]) for f in found])
        doc, score = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        tables.append(pa.table({"q": which, "score": score, "doc_id": shard.ids.take(pa.array(doc))}))
        for q, (_, own) in enumerate(found):
            if len(own):
                best[q] = np.sort(np.concatenate([best[q], own]))[-k:]
    table = pa.concat_tables(tables).sort_by([("q", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
    q = table["q"].to_numpy()
    table = table.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k)).combine_chunks()
    ids = piece.column("id").take(table["q"].combine_chunks().cast(pa.int32()))
    return pa.RecordBatch.from_arrays([ids, table["doc_id"].combine_chunks(), table["score"].combine_chunks()], names=["query_id", "doc_id", "score"])


def search(docs: DataFrame, queries: DataFrame, k: int = 10, words_per_shard: int = WORDS_PER_SHARD) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents for every query (both frames have doc_id and text)."""
    ident = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    queries = queries.filter("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    stats = cut(_statistics(docs), "op9-statistics")
    total = {r["kind"]: r["n"] for r in stats.filter(F.col("kind") != _DF).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    n_docs, n_words = total.get(_DOCS, 0), total.get(_WORDS, 0)
    shards = max(1, math.ceil(n_words / words_per_shard))
    mean_length = max(1e-9, n_words / max(1, n_docs))
    df = stats.filter(F.col("kind") == _DF).groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = _query_terms(queries).join(df, "term").select("query_id", F.struct("term", idf.alias("w")).alias("t"))
    asked = cut(asked.groupBy("query_id").agg(F.array_sort(F.collect_set("t")).alias("ts")), "op9-queries")
    drop(stats)
    none = F.lit(None)
    index_rows = docs.filter("doc_id is not null").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.col("doc_id").alias("id"), "text", none.cast("array<bigint>").alias("terms"), none.cast("array<double>").alias("weights")
    )
    query_rows = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), none.cast("string").alias("text"), F.col("ts.term").alias("terms"), F.col("ts.w").alias("weights")
    )

    @task("op9")
    def run(batches):
        texts, parts, ids, held, size, shards = [], [], [], 0, 0, []

        def part():
            nonlocal texts, held
            if texts:
                parts.append(Part(texts))
            texts, held = [], 0

        def build():
            nonlocal ids, size
            part()
            if parts:
                # Each part is free as soon as its postings are in the index.
                shards.append(Shard((parts.pop(0) for _ in range(len(parts))), ids, mean_length))
            ids, size = [], 0

        for batch in batches:
            n_index = int(np.searchsorted(batch.column(1).to_numpy(), 1))
            for at in range(0, n_index, 256):
                rows = batch.slice(at, min(256, n_index - at))
                texts.append(rows.column(3))
                ids.append(rows.column(2))
                held += rows.column(3).nbytes
                size += rows.column(3).nbytes
                if held >= 6 * WORDS_PER_PART:
                    part()
                if size >= 6 * WORDS_PER_INDEX:
                    build()
            for at in range(n_index, batch.num_rows, BATCH):
                build()
                if shards:
                    yield _answers(shards, batch.slice(at, BATCH), k)

    stream = index_rows.unionByName(query_rows).repartitionById(shards, "shard").sortWithinPartitions("kind", "id")
    best = cut(stream.mapInArrow(run, f"query_id {ident}, doc_id {ident}, score double"), "op9-best", TEXT_ROWS)
    drop(asked)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
