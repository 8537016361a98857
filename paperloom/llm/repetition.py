"""Quality rules from a word suffix array (operator 5).

Repeats are found on words: one suffix array per block of documents, with word codes that differ between
documents, so that no common prefix crosses a document.  Adjacent longest common prefixes (LCP) give, for every
suffix, the longest passage starting there that occurs again in the document.  LCP intervals whose occurrences
have different words before them are the maximal repeats; the union of their spans is the covered part.

Row-wise and free of shuffles: memory is bounded by a block of about 1 MB of text, or by the longest document.
Null text reads as empty.  Empty texts have all counts 0 and fail the base rule.  Repeated rows are scored each on
its own; a null doc_id passes through; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V

MIN_REPEAT_WORDS = 8
MAX_COVERED_PERCENT = 40
MAX_LONGEST_WORDS = 100

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat", "n_maximal_repeats")


def suffix_ranks(code: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... codes; the last level has no ties.

    Only suffixes that still tie are sorted again.  A suffix that ends within the compared length ranks before
    its continuations.
    """
    n = len(code)
    order = np.argsort(code, kind="stable")
    change = np.ones(n, bool)
    change[1:] = code[order[1:]] != code[order[:-1]]
    first = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, k = [rank], 1
    size = np.diff(np.append(np.flatnonzero(change), n))
    tied = order[np.repeat(size > 1, size)]
    while len(tied):
        more = left[tied] > k
        key = rank[tied] * (n + 1) + np.where(more, rank[np.minimum(tied + k, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        parent = rank[tied]
        at = np.arange(len(tied))
        new_parent = np.ones(len(tied), bool)
        new_parent[1:] = parent[1:] != parent[:-1]
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        parent_at = np.maximum.accumulate(np.where(new_parent, at, 0))
        own_at = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[tied] = parent + own_at - parent_at
        levels.append(rank)
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(size > 1, size)]
        k *= 2
    return levels


def adjacent_lcp(levels: list[np.ndarray], left: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """LCP of each suffix in order with the one before it; the first has 0."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    a, b = sa[1:], sa[:-1]
    at = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[at], b[at]
    got = np.zeros(len(at), np.int64)
    room = np.minimum(left[a], left[b])
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        i, j = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
        got += np.where((got < room) & (rank[i] == rank[j]), 1 << level, 0)
    lcp[at + 1] = got
    return lcp


def maximal_repeats(lcp: np.ndarray, sa: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the LCP intervals of at least ``least`` words that no word before them extends."""
    differs = np.zeros(len(sa), np.int64)
    differs[1:] = before[sa[1:]] != before[sa[:-1]]
    differs = np.cumsum(differs)
    out: list[tuple[int, int, int]] = []
    rows = np.flatnonzero(lcp >= least)
    if not len(rows):
        return out
    for run in np.split(rows, np.flatnonzero(np.diff(rows) > 1) + 1):
        stack: list[tuple[int, int]] = []
        values = lcp[run].tolist() + [0]
        for i, value in enumerate(values, int(run[0])):
            low = i - 1
            while stack and stack[-1][0] > value:
                length, low = stack.pop()
                if differs[i - 1] > differs[low]:
                    out.append((length, low, i - 1))
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, low))
    return out


def _covered(longest: np.ndarray, least: int) -> np.ndarray:
    at = np.flatnonzero(longest >= least)
    step = np.zeros(len(longest) + 1, np.int64)
    step[at] += 1
    np.subtract.at(step, at + longest[at], 1)
    return np.cumsum(step[:-1]) > 0


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _dup_lines(buf: np.ndarray, offs: np.ndarray, words: V.Words) -> np.ndarray:
    n_docs = len(offs) - 1
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:] = buf == 10
    cut[offs] = True
    start = np.flatnonzero(cut[:-1])
    end = np.append(start[1:], len(buf))
    end = end - ((end > start) & (buf[end - 1] == 10))
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[has], end[has]
    doc = np.searchsorted(offs, start, side="right") - 1
    key = V.hash_spans(buf, start, end) + V.mix64(doc.astype(V.U64) + V.U64(1))
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=n_docs) - np.bincount(doc[first], minlength=n_docs)


def block_counts(buf: np.ndarray, offs: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """The counts of each document of a block, by name."""
    n_docs = len(offs) - 1
    words = V.find_words(buf, offs)
    inside = (buf & 0xC0) != 0x80
    out = {
        "n_words": np.diff(words.first),
        "word_chars": _per_doc(inside & ~V.IS_SPACE[buf], offs),
        "n_symbols": _per_doc(_SYMBOL[buf], offs),
        "n_dup_lines": np.zeros(n_docs, np.int64),
    }
    zero = dict.fromkeys(_COUNTS[4:], np.zeros(n_docs, np.int64))
    if not len(words):
        return out | zero
    out["n_dup_lines"] = _dup_lines(buf, offs, words)
    doc, left = words.doc(), words.left()
    code = V.hash_spans(buf, words.start, words.end) + V.mix64(doc.astype(V.U64) + V.U64(1))
    levels = suffix_ranks(code, left)
    sa = np.argsort(levels[-1], kind="stable")
    lcp = adjacent_lcp(levels, left, sa)
    longest = np.zeros(len(sa), np.int64)
    longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    before = np.empty(len(sa), np.int64)
    before[0], before[1:] = -1, levels[0][:-1]
    starts = words.first[:-1][np.diff(words.first) > 0]
    before[starts] = -1 - np.arange(len(starts))
    found = np.zeros(n_docs, np.int64)
    top = np.zeros(n_docs, np.int64)
    repeats = maximal_repeats(lcp, sa, before, least)
    if repeats:
        length, low, _ = (np.array(x) for x in zip(*repeats, strict=True))
        of = doc[sa[low]]
        found = np.bincount(of, minlength=n_docs)
        np.maximum.at(top, of, length)
    return out | {
        "n_repeat_words": _per_doc(_covered(longest, 3), words.first),
        "n_covered_words": _per_doc(_covered(longest, least), words.first),
        "longest_repeat": top,
        "n_maximal_repeats": found,
    }


def repetition_rules(
    docs: DataFrame, min_repeat_words: int = MIN_REPEAT_WORDS, max_covered_percent: int = MAX_COVERED_PERCENT, max_longest_words: int = MAX_LONGEST_WORDS
) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``repetitive`` (the method's verdict) and ``kept`` for each row of docs."""
    ident = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j, buf, offs in V.chunks(texts):
                got = block_counts(buf, offs, min_repeat_words)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *(pa.array(got[c], pa.int64()) for c in _COUNTS)], names=["doc_id", *_COUNTS])

    counted = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(score, f"doc_id {ident}, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return (
        counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("repetitive", (100 * F.col("n_covered_words") > max_covered_percent * F.col("n_words")) | (F.col("longest_repeat") > max_longest_words))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("repetitive"))
    )
