"""Ranked merges folded over many words at once with numpy.

All distinct words of a block advance together: in each round every word merges its leftmost pair of least rank,
until no word has a mergeable pair.  This is exactly the order in which BPE merges a word on its own.
"""

from __future__ import annotations

import numpy as np

_FAR = np.int64(1) << 40


class PairRanks:
    """(left, right) -> (rank, merged id) in an open-addressed table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(12, int(4 * len(left)).bit_length())
        size = 1 << self.bits
        self.key = np.full(size, -1, np.int64)
        self.rank = np.full(size, _FAR, np.int64)
        self.merged = np.zeros(size, np.int64)
        keys = (left.astype(np.int64) << 24) | right.astype(np.int64)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            slot = at[todo]
            free = np.flatnonzero(self.key[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.key[slot[won]] = keys[todo[won]]
            self.rank[slot[won]] = rank[todo[won]]
            self.merged[slot[won]] = merged[todo[won]]
            todo = np.delete(todo, won)
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 where there is none."""
        keys = (left << 24) | right
        slot = self._slot(keys)
        got = self.key[slot]
        out = np.where(got == keys, slot, -1)
        open_ = np.flatnonzero((got != keys) & (got != -1))
        step = slot[open_]
        while len(open_):
            step = (step + 1) & (len(self.key) - 1)
            got = self.key[step]
            hit = got == keys[open_]
            out[open_[hit]] = step[hit]
            go = ~hit & (got != -1)
            open_, step = open_[go], step[go]
        return out


def fold_merges(symbols: np.ndarray, bounds: np.ndarray, table: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Merge each word ``symbols[bounds[w]:bounds[w + 1]]`` to the end: (ids of all words in order, new bounds)."""
    n_words = len(bounds) - 1
    size = np.diff(bounds)
    done_ids: list[np.ndarray] = []
    done_word: list[np.ndarray] = []
    word = np.repeat(np.arange(n_words), size)
    sym = symbols.astype(np.int64)

    def pair_slots(sym, word):
        slot = np.full(len(sym), -1, np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(sym) else np.zeros(0, np.int64)
        slot[inner] = table.find(sym[inner], sym[inner + 1])
        return slot

    slot = pair_slots(sym, word)
    while len(sym):
        rank = np.where(slot >= 0, table.rank[slot], _FAR)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.minimum.reduceat(rank, first)
        length = np.diff(np.append(first, len(sym)))
        active = least < _FAR
        if not active.all():
            gone = np.repeat(~active, length)
            done_ids.append(sym[gone])
            done_word.append(word[gone])
            keep = ~gone
            sym, word, slot, rank = sym[keep], word[keep], slot[keep], rank[keep]
            length, least = length[active], least[active]
            if not len(sym):
                break
            first = np.cumsum(length) - length
        hits = np.flatnonzero(rank == np.repeat(least, length))
        of = word[hits]
        at = hits[np.append(True, of[1:] != of[:-1])]
        sym[at] = table.merged[slot[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new_at = (np.cumsum(keep) - 1)[at]
        sym, word, slot = sym[keep], word[keep], slot[keep]
        touched = np.concatenate((new_at, new_at[new_at > 0] - 1))
        slot[touched] = -1
        inner = touched[touched + 1 < len(sym)]
        inner = inner[word[inner] == word[inner + 1]]
        slot[inner] = table.find(sym[inner], sym[inner + 1])
    if not done_ids:
        return np.zeros(0, np.int64), np.zeros(n_words + 1, np.int64)
    ids, owner = np.concatenate(done_ids), np.concatenate(done_word)
    by = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=n_words)
    return ids[by], np.concatenate(([0], np.cumsum(count)))


class WordMemo:
    """Ids of words by 64-bit hash, in an open-addressed table; it is emptied once it holds ``most`` words."""

    def __init__(self, most: int = 1 << 21):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.bits = 16
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.slot_word = np.zeros(1 << self.bits, np.int64)
        self.n = 0
        self.hashes = np.zeros(1 << 14, np.uint64)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.n_ids = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if it is not held."""
        hashes = np.maximum(hashes, np.uint64(1))
        mask, shift = np.int64(len(self.key) - 1), np.uint64(64 - self.bits)
        slot = (hashes >> shift).astype(np.int64)
        got = self.key[slot]
        out = np.where(got == hashes, self.slot_word[slot], -1)
        open_ = np.flatnonzero((got != hashes) & (got != 0))
        step = slot[open_]
        while len(open_):
            step = (step + 1) & mask
            got = self.key[step]
            hit = got == hashes[open_]
            out[open_[hit]] = self.slot_word[step[hit]]
            go = ~hit & (got != 0)
            open_, step = open_[go], step[go]
        return out

    def _place(self, hashes: np.ndarray, words: np.ndarray) -> None:
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            at = slot[todo]
            free = self.key[at] == 0
            self.key[at[free]] = hashes[todo[free]]
            self.slot_word[at[free]] = words[todo[free]]
            lost = ~free | (self.key[at] != hashes[todo])
            slot[todo[lost]] = (slot[todo[lost]] + 1) & (len(self.key) - 1)
            todo = todo[lost]

    def add(self, hashes: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Distinct new words with ids ``ids[bounds[w]:bounds[w + 1]]``."""
        hashes = np.maximum(hashes, np.uint64(1))
        n, total = self.n + len(hashes), self.n_ids + len(ids)
        for name, need in (("hashes", n), ("start", n), ("size", n), ("ids", total)):
            have = getattr(self, name)
            if len(have) < need:
                setattr(self, name, np.concatenate((have, np.zeros(need, have.dtype))))
        self.hashes[self.n : n] = hashes
        self.start[self.n : n] = self.n_ids + bounds[:-1]
        self.size[self.n : n] = np.diff(bounds)
        self.ids[self.n_ids : total] = ids
        if 3 * n > len(self.key):
            self.bits = int(6 * n).bit_length()
            self.key = np.zeros(1 << self.bits, np.uint64)
            self.slot_word = np.zeros(1 << self.bits, np.int64)
            self._place(self.hashes[:n], np.arange(n))
        else:
            self._place(hashes, np.arange(self.n, n))
        self.n, self.n_ids = n, total
