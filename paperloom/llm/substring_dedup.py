"""Substring dedup by collinear chaining (operator 1).

Seeds are five-word k-mers: those whose hash lies in the lowest quarter, which are the same ones in every copy whatever stands beside them, and the
least of every 32, so every shared run of 36 words has one even where few k-mers differ.  A seed's owner is its first
place in the corpus by (doc_id, word); every other place is joined with the owner only, which keeps a passage in a third of all
documents linear.  Seeds that several documents hold are also keyed by seed and following seed, at two distances, with the first owner of each such
pair, so that a passage is met whole where the owner of its seeds holds only a stock phrase of it.  In either join the owners are cut before the join, so
that AQE can split a hot seed's rows.  Joins that move all seeds or all texts take a slice of their
keys at a time, so that shuffle files of one slice only lie on disk beside the tables.  The matches of a document with one owner document are merged along diagonals into blocks, blocks are chained by
dynamic programming with a linear gap cost, the best predecessor coming from a Fenwick tree over source positions, and chains are aligned word
by word: blocks are extended, gaps of any length are aligned by edit distance, ends are extended past small edits, up to 64 words beyond a chain's last
seed.  A chain whose identity is too low is split at its worst gaps and its parts are judged alone.  Aligned fragments of at least 16 words and 80 % identity
that touch or overlap form passages; passages of at least 50 words are repeats.

Of an exact passage of 50 words in ordinary text, seeds miss 2e-6.  Words are compared by 32-bit codes in alignments that 64-bit seeds led to.
Documents are compared with other documents only, never with themselves.  Of a repeated passage the document with the least doc_id keeps its copy.

Null text reads as empty and stays null; texts under 50 words have no repeats.  Rows that share a doc_id are one document and must
have one text; rows with a null doc_id stay as they are.  Other columns are kept untouched; where one is named as the number of words removed, that number's name
gets underscores behind it.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _vec as V
from ._store import TEXT_ROWS, cut, cut_parts, drop, free_names
from ._worker import task

K = 5
WINDOW = 32
LOWEST = np.uint64(1 << 62)
LEAST_WORDS = 50
LEAST_FRAGMENT = 16
IDENTITY = 0.8
GAP_COST = 0.25
#: So that a share of edits that is just allowed isn't refused by rounding.
ROUND = 1e-9
TOUCH = 2
MARGIN = 12
REACH = 64
GRID = 32
CONTEXTS = (1, 4)
SLICES = 4
ANCHOR = 4
#: Words passed over in the document and in the source at an edit.
_STEPS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2), (3, 3), (3, 0), (0, 3), *((p, p) for p in range(4, 17)))
_NONE = np.iinfo(np.uint64).max


def seed_places(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, word place) of the chosen k-mers of a block of texts.

    Windows that run over the end of a document only add seeds.
    """
    words = V.find_words(buf, offs)
    if len(words) < K:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = V.gram_hashes(V.hash_spans(V.LOWER[buf], words.start, words.end), K)
    grams[words.left() < K] = _NONE
    least = grams.copy()
    step = 1
    while step < WINDOW:
        np.minimum(least[:-step], least[step:], out=least[:-step])
        step *= 2
    most = least.copy()
    step = 1
    while step < WINDOW:
        most[step:] = np.maximum(most[step:], most[:-step])
        step *= 2
    at = np.flatnonzero(((most == grams) | (grams < LOWEST)) & (grams != _NONE))
    doc = np.searchsorted(words.first, at, side="right") - 1
    return grams[at], doc, at - words.first[doc]


def _seeds(docs: DataFrame) -> DataFrame:
    ident = docs.schema["doc_id"].dataType.simpleString()

    @task("op1")
    def run(batches):
        for batch in batches:
            for i, j, buf, offs in V.chunks(batch.column(1)):
                seed, doc, place = seed_places(buf, offs)
                ids = batch.column(0).slice(i, j - i).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), ids, pa.array(place, pa.int32())], names=["seed", "doc_id", "place"])

    return docs.mapInArrow(run, f"seed bigint, doc_id {ident}, place int")


def _slice(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of the n-th of ``SLICES`` parts of the keys."""
    return df.filter(F.pmod(F.xxhash64(key), F.lit(SLICES)) == n)


def _shared(seeds: DataFrame) -> Iterator[DataFrame]:
    """By slices, all places of seeds that several documents hold, with their first owner: seed, doc_id, place, src, other."""
    for n in range(SLICES):
        own = _slice(seeds, "seed", n)
        owner = own.groupBy("seed").agg(F.min(F.struct("doc_id", "place")).alias("o"), F.max("doc_id").alias("last")).filter("o.doc_id < last")
        owner = cut(owner.select("seed", F.col("o.doc_id").alias("src"), F.col("o.place").alias("other")), "op1-owners")
        yield own.join(owner, "seed")
        drop(owner)


def _matches(shared: DataFrame) -> DataFrame:
    """doc_id, place, src, other: the seeds with their first owner, and with the first owners of what follows them in context.

    ``shared`` are all places of seeds that several documents hold.  The first owner of a seed may hold no more of a passage than that seed.  So each
    place is also keyed by its seed and another one, ``CONTEXTS`` shared seeds on: inside a passage that two documents share, the shared seeds are the
    same ones in the same order, so the earliest document with both is met as well.
    """
    after = Window.partitionBy("doc_id").orderBy("place")
    ahead = [F.struct(F.xxhash64(F.col("seed"), F.col(f"seed{n}"), F.lit(n)).alias("key"), F.col(f"seed{n}").isNotNull().alias("there")) for n in CONTEXTS]
    once = shared.repartition("doc_id").dropDuplicates(["doc_id", "place"])
    rows = once.select("seed", "doc_id", "place", "src", *(F.lead("seed", n).over(after).alias(f"seed{n}") for n in CONTEXTS))
    rows = rows.select("doc_id", "place", "src", F.explode(F.array(*ahead)).alias("x")).filter("x.there")
    rows = cut(rows.select(F.col("x.key").alias("key"), "doc_id", "place", F.col("src").alias("known")), "op1-contexts")
    owner = rows.groupBy("key").agg(F.min(F.struct("doc_id", "place")).alias("o"), F.max("doc_id").alias("last")).filter("o.doc_id < last")
    owner = cut(owner.select("key", F.col("o.doc_id").alias("src"), F.col("o.place").alias("other")), "op1-context-owners")
    more = cut(rows.join(owner, "key").filter("doc_id <> src and src <> known").select("doc_id", "place", "src", "other"), "op1-more")
    drop(rows, owner)
    return shared.filter("doc_id <> src").select("doc_id", "place", "src", "other").unionByName(more)


class MaxTree:
    """A Fenwick tree for the greatest value, and who has it, among keys up to a bound."""

    def __init__(self, size: int):
        self.best = [(-1e18, -1)] * (size + 1)

    def put(self, key: int, value: float, who: int) -> None:
        key += 1
        while key < len(self.best):
            if value > self.best[key][0]:
                self.best[key] = (value, who)
            key += key & -key

    def upto(self, key: int) -> tuple[float, int]:
        out = (-1e18, -1)
        key += 1
        while key:
            if self.best[key][0] > out[0]:
                out = self.best[key]
            key -= key & -key
        return out


def chain(d: list[int], s: list[int], n: list[int]) -> list[list[int]]:
    """Chains of blocks (start in the document, start in the source, words), each a list of block numbers in order."""
    if len(d) == 1:
        return [[0]]
    ends = sorted({s[i] + n[i] for i in range(len(d))})
    rank = {e: r for r, e in enumerate(ends)}
    import bisect

    tree = MaxTree(len(ends))
    by_start = sorted(range(len(d)), key=lambda i: (d[i], s[i]))
    by_end = sorted(range(len(d)), key=lambda i: d[i] + n[i])
    score, before, nxt = [0.0] * len(d), [-1] * len(d), 0
    for i in by_start:
        while nxt < len(by_end) and d[by_end[nxt]] + n[by_end[nxt]] <= d[i]:
            j = by_end[nxt]
            tree.put(rank[s[j] + n[j]], score[j] + GAP_COST * (d[j] + n[j] + s[j] + n[j]), j)
            nxt += 1
        score[i] = float(n[i])
        low = bisect.bisect_right(ends, s[i]) - 1
        if low >= 0:
            value, j = tree.upto(low)
            value -= GAP_COST * (d[i] + s[i])
            if value > 0:
                score[i], before[i] = n[i] + value, j
    used, out = [False] * len(d), []
    for i in sorted(range(len(d)), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        if path:
            out.append(path[::-1])
    return out


def _blocks(doc: np.ndarray, src: np.ndarray, place: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of matches on a diagonal less than a margin apart: (group start flags come from doc and src) doc, src, d, s, n."""
    shift = other - place
    by = np.lexsort((place, shift, src, doc))
    doc, src, place, shift = doc[by], src[by], place[by], shift[by]
    fresh = np.ones(len(by), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (src[1:] != src[:-1]) | (shift[1:] != shift[:-1]) | (place[1:] != place[:-1])
    by = by[fresh]
    doc, src, place, shift = doc[fresh], src[fresh], place[fresh], shift[fresh]
    new = np.ones(len(by), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (src[1:] != src[:-1]) | (shift[1:] != shift[:-1]) | (place[1:] - place[:-1] > MARGIN)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(by)) - 1
    return doc[first], src[first], place[first], place[first] + shift[first], place[last] + K - place[first]


def _chains(matches: DataFrame) -> DataFrame:
    """doc_id, src, low, high (the source words that an alignment may touch) and the chain's blocks."""
    ident = matches.schema["doc_id"].dataType.simpleString()

    def solve(table: pa.Table):
        ids = table["doc_id"].combine_chunks().dictionary_encode()
        srcs = table["src"].combine_chunks().dictionary_encode()
        doc, src, d, s, n = _blocks(ids.indices.to_numpy(), srcs.indices.to_numpy(), table["place"].to_numpy().astype(np.int64), table["other"].to_numpy().astype(np.int64))
        edge = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (src[1:] != src[:-1])))
        rows = []
        d, s, n = d.tolist(), s.tolist(), n.tolist()
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(doc)], strict=True):
            for path in chain(d[a:b], s[a:b], n[a:b]):
                first, last = a + path[0], a + path[-1]
                flat = [x for i in path for x in (d[a + i], s[a + i], n[a + i])]
                low, high = max(0, s[first] - REACH) // GRID * GRID, -(-(s[last] + n[last] + REACH) // GRID) * GRID
                rows.append((int(doc[a]), int(src[a]), low, high, flat))
        if not rows:
            return None
        x = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [ids.dictionary.take(pa.array(x[0])), srcs.dictionary.take(pa.array(x[1])), pa.array(x[2], pa.int32()), pa.array(x[3], pa.int32()), pa.array(x[4], pa.list_(pa.int32()))],
            names=["doc_id", "src", "low", "high", "blocks"],
        )

    @task("op1")
    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            last = ids[batch.num_rows - 1].as_py()
            cut_at = batch.num_rows
            while cut_at and ids[cut_at - 1].as_py() == last:
                cut_at -= 1
            if cut_at:
                done = solve(pa.Table.from_batches([*held, batch.slice(0, cut_at)]))
                held = []
                if done:
                    yield done
            held.append(batch.slice(cut_at))
        if held:
            done = solve(pa.Table.from_batches(held))
            if done:
                yield done

    dealt = matches.select("doc_id", "src", "place", "other").repartition("doc_id").sortWithinPartitions("doc_id")
    return dealt.mapInArrow(run, f"doc_id {ident}, src {ident}, low int, high int, blocks array<int>")


def _word_codes(buf: np.ndarray, offs: np.ndarray) -> tuple[V.Words, np.ndarray]:
    words = V.find_words(buf, offs)
    return words, (V.hash_spans(V.LOWER[buf], words.start, words.end) >> V.U64(32)).astype(np.uint32)


def _regions(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """src, low, high and the word codes there; a source's text is read once for all its regions, whose bounds lie on a grid."""
    ident = docs.schema["doc_id"].dataType.simpleString()

    @task("op1")
    def run(batches):
        for batch in batches:
            for i, j, buf, offs in V.chunks(batch.column(2)):
                words, codes = _word_codes(buf, offs)
                which, lows, highs, out = [], [], [], []
                for r, spans in enumerate(batch.column(1).slice(i, j - i).to_pylist()):
                    f, g = int(words.first[r]), int(words.first[r + 1])
                    for span in spans:
                        which.append(i + r)
                        lows.append(span["low"])
                        highs.append(span["high"])
                        out.append(codes[f + span["low"] : min(f + span["high"], g)].tobytes())
                        if len(out) == 4096:
                            yield emit(batch, which, lows, highs, out)
                            which, lows, highs, out = [], [], [], []
                yield emit(batch, which, lows, highs, out)

    def emit(batch, which, lows, highs, out):
        columns = [batch.column(0).take(pa.array(which, pa.int32())), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), pa.array(out, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["src", "low", "high", "codes"])

    spans = wanted.groupBy("src").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    joined = spans.join(docs.select(F.col("doc_id").alias("src"), "text").dropDuplicates(["src"]), "src").select("src", "spans", "text")
    return joined.mapInArrow(run, f"src {ident}, low int, high int, codes binary")


def _placed(chains: DataFrame, docs: DataFrame) -> Iterator[DataFrame]:
    """By slices of the sources, doc_id and the chain c with its source's word codes."""
    for n in range(SLICES):
        own = _slice(chains, "src", n)
        regions = cut(_regions(own.select("src", "low", "high"), _slice(docs, "doc_id", n)), "op1-regions", TEXT_ROWS)
        yield own.join(regions, ["src", "low", "high"]).select("doc_id", F.struct("src", "low", "blocks", "codes").alias("c"))
        drop(regions)


def edit_distance(a: list[int], b: list[int]) -> int:
    """Myers' bit vectors over one integer of any length: exact, a few steps a word of ``b``."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, out = full, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        out += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | ~(xv | up) & full, up & xv
    return out


def _grow(a: list[int], b: list[int], i: int, j: int, step: int) -> tuple[int, int, int]:
    """Extend from a[i], b[j] (the next pair to compare) in one direction past edits of a few words: new i, j and edits.

    Of all the places where the extension could stop, the last that leaves it at ``IDENTITY`` is taken.
    """
    from_i, edits, best = i, 0, (i, j, 0)

    def same(x: int, y: int) -> bool:
        return 0 <= x < len(a) and 0 <= y < len(b) and a[x] == b[y]

    while True:
        while same(i, j):
            i, j = i + step, j + step
        if edits <= (1 - IDENTITY) * abs(i - from_i) + ROUND:
            best = i, j, edits
        for p, q in _STEPS:
            if all(same(i + step * (p + k), j + step * (q + k)) for k in range(ANCHOR)):
                edits += sum(not same(i + step * k, j + step * k) for k in range(p)) if p == q else max(p, q)
                i, j = i + step * p, j + step * q
                break
        else:
            return best


def align(own: list[int], other: list[int], shift: int, blocks: list[int]) -> tuple[int, int, int, int, int]:
    """(start, end, source start, source end, edits) of a chain; source places are ``shift`` more than indices of ``other``."""
    triples = [(blocks[k], blocks[k + 1] - shift, blocks[k + 2]) for k in range(0, len(blocks), 3)]
    edits = 0
    i, j, n = triples[0]
    start_i, start_j, more = _grow(own, other, i - 1, j - 1, -1)
    edits += more
    for at, (i, j, n) in enumerate(triples):
        edits += sum(x != y for x, y in zip(own[i : i + n], other[j : j + n], strict=False))
        i, j = i + n, j + n
        if at + 1 < len(triples):
            to_i, to_j, _ = triples[at + 1]
            while i < to_i and j < to_j and own[i] == other[j]:
                i, j = i + 1, j + 1
            while i < to_i and j < to_j and own[to_i - 1] == other[to_j - 1]:
                to_i, to_j = to_i - 1, to_j - 1
            a, b = own[i:to_i], other[j:to_j]
            edits += edit_distance(a, b)
    end_i, end_j, more = _grow(own, other, i, j, 1)
    return start_i + 1, end_i, start_j + 1 + shift, end_j + shift, edits + more


def exact_runs(own: list[int], other: list[int], shift: int, blocks: list[int]) -> list[tuple[int, int, int]]:
    """The runs of at least ``ANCHOR`` equal words in a chain's blocks, as blocks."""
    out = []
    for k in range(0, len(blocks), 3):
        i, j, n = blocks[k], blocks[k + 1] - shift, blocks[k + 2]
        run = 0
        for t in range(n + 1):
            if t < n and i + t < len(own) and j + t < len(other) and own[i + t] == other[j + t]:
                run += 1
                continue
            if run >= ANCHOR:
                out.append((i + t - run, j + t - run + shift, run))
            run = 0
    return out


def fragments(own: list[int], other: list[int], shift: int, blocks: list[int], identity: float) -> list[tuple[int, int, int, int, int]]:
    """What ``align`` gives for a chain, or, where its identity is too low, for the parts that it falls into at its worst gaps."""
    out, seen = [], set()
    todo = [exact_runs(own, other, shift, blocks)]
    while todo:
        runs = todo.pop()
        if not runs:
            continue
        found = align(own, other, shift, [x for r in runs for x in r])
        if found[4] <= (1 - identity) * (found[1] - found[0]) + ROUND:
            if found not in seen:
                seen.add(found)
                out.append(found)
            continue
        if len(runs) == 1:
            i, j, n = runs[0]
            out.append((i, i + n, j, j + n, 0))
            continue
        cost = [edit_distance(own[a + m : c], other[b + m - shift : d - shift]) - (1 - identity) * (c - a - m) for (a, b, m), (c, d, _) in zip(runs, runs[1:], strict=False)]
        at = int(np.argmax(cost)) + 1
        todo += [runs[:at], runs[at:]]
    return out


def hopeless(own: np.ndarray, bounds: np.ndarray, other: np.ndarray, ends: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Which chains of one block can't grow to ``LEAST_FRAGMENT`` words: ``_grow`` stops on both sides before, for many chains at a time.

    Columns of ``bounds`` and ``ends`` are where a chain's document and region begin and end in ``own`` and ``other``, of ``block`` where the block starts in
    either and its words.  A block with unequal words in it is never hopeless.
    """
    i, j, n = block.T

    def same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        inside = (x >= bounds[:, 0]) & (x < bounds[:, 1]) & (y >= ends[:, 0]) & (y < ends[:, 1])
        return inside & (own[np.where(inside, x, 0)] == other[np.where(inside, y, 0)])

    out = n < LEAST_FRAGMENT
    for t in range(LEAST_FRAGMENT):
        out &= (t >= n) | same(i + t, j + t)
    length = n.copy()
    for step, x, y in ((-1, i - 1, j - 1), (1, i + n, j + n)):
        going = out.copy()
        for _ in range(LEAST_FRAGMENT):
            going &= same(x, y)
            x, y, length = x + step * going, y + step * going, length + going
        for p, q in _STEPS:
            hit = out.copy()
            for k in range(ANCHOR):
                hit &= same(x + step * (p + k), y + step * (q + k))
            out &= ~hit
    return out & (length < LEAST_FRAGMENT)


def _worth_aligning(chains: pa.ListArray, first: np.ndarray, codes: np.ndarray) -> list[list[tuple]]:
    """(source, low, blocks, bytes of the source's codes) of each document's chains, without those of one block that are hopeless."""
    flat, row = chains.flatten(), np.repeat(np.arange(len(chains)), np.diff(chains.offsets.to_numpy()))
    source, low, blocks, raw = (flat.field(c) for c in ("src", "low", "blocks", "codes"))
    at, values = blocks.offsets.to_numpy(), blocks.values.to_numpy().astype(np.int64)
    words = raw.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    other = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint32) if len(words) and ends[-1] > ends[0] else np.zeros(1, np.uint32)
    ends = (ends - ends[0]) // 4
    keep = np.ones(len(flat), bool)
    one = np.flatnonzero(np.diff(at) == 3)
    if len(one) and len(codes):
        block, start, low_ = values[at[one][:, None] + np.arange(3)], first[row[one]], low.to_numpy()[one]
        block = np.stack([block[:, 0] + start, block[:, 1] - low_ + ends[one], block[:, 2]], axis=1)
        keep[one] = ~hopeless(codes, np.stack([start, first[row[one] + 1]], axis=1), other, np.stack([ends[one], ends[one + 1]], axis=1), block)
    out: list[list[tuple]] = [[] for _ in range(len(chains))]
    chosen = np.flatnonzero(keep)
    picked = flat.take(pa.array(chosen))
    for r, c in zip(row[chosen].tolist(), picked.to_pylist(), strict=True):
        out[r].append((c["src"], c["low"], c["blocks"], c["codes"]))
    return out


def passages_of(own: list[int], chains: list[tuple], least_words: int, identity: float) -> list[tuple]:
    """Fragments (start, words, source, source start, edits) that lie in passages of at least ``least_words``.

    ``chains`` are (source, low, blocks, bytes of the source's word codes from ``low`` on).  Longer chains go first; a chain that lies inside a whole
    passage already found, of whatever source, is not aligned again.
    """
    found, whole = [], []
    for src, low, blocks, codes in sorted(chains, key=lambda c: (-sum(c[2][2::3]), str(c[0]), c[2])):
        if any(a <= blocks[0] and blocks[-3] + blocks[-1] <= b for a, b in whole):
            continue
        for a, b, c, _, edits in fragments(own, np.frombuffer(codes, np.uint32).tolist(), low, blocks, identity):
            if b - a >= LEAST_FRAGMENT:
                found.append((a, b - a, src, c, edits))
            if b - a >= least_words:
                whole.append((a, b))
    found = sorted(set(found), key=lambda f: (f[0], -f[1], str(f[2]), f[3]))
    out, run, end = [], [], -1
    for f in [*found, None]:
        if run and (f is None or f[0] > end + TOUCH):
            if end - run[0][0] >= least_words:
                out += run
            run = []
        if f is not None:
            end = max(end, f[0] + f[1]) if run else f[0] + f[1]
            run.append(f)
    return out


_FIELDS = ("start", "words", "source_id", "source_start", "edits")
_FOUND = "array<struct<start:int,words:int,source_id:{0},source_start:int,edits:int>>"


def find_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, identity: float = IDENTITY) -> DataFrame:
    """For each document that has repeats: doc_id, ``repeats`` (fragments of passages), ``cuts`` (their union in characters) and ``words_removed``."""
    docs = docs.filter("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    ident = docs.schema["doc_id"].dataType.simpleString()
    seeds = cut(_seeds(docs), "op1-seeds", TEXT_ROWS)
    shared = cut_parts(_shared(seeds), "op1-shared")
    drop(seeds)
    chains = cut(_chains(_matches(shared)), "op1-chains")
    drop(shared)
    placed = cut_parts(_placed(chains, docs), "op1-placed")
    drop(chains)

    @task("op1")
    def run(batches):
        for batch in batches:
            ids, out_rows, out, cuts, gone = batch.column(0), [], [], [], []
            for i, j, buf, offs in V.chunks(batch.column(1)):
                words, codes = _word_codes(buf, offs)
                chains_ = _worth_aligning(batch.column(2).slice(i, j - i), words.first, codes)
                for r in range(i, j):
                    first, last = int(words.first[r - i]), int(words.first[r - i + 1])
                    got = passages_of(codes[first:last].tolist(), chains_[r - i], least_words, identity) if chains_[r - i] else []
                    if not got:
                        continue
                    out_rows.append(r)
                    out.append([dict(zip(_FIELDS, f, strict=True)) for f in got])
                    step = np.zeros(last - first + 1, np.int64)
                    for f in got:
                        step[f[0]] += 1
                        step[f[0] + f[1]] -= 1
                    inside = np.cumsum(step[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))).reshape(-1, 2)
                    begins = np.cumsum((buf[offs[r - i] : offs[r - i + 1]] & 0xC0) != 0x80)
                    spans = [(words.start[first + x] - offs[r - i], words.end[first + y - 1] - offs[r - i]) for x, y in edge.tolist()]
                    cuts.append([{"a": int(begins[x]) - 1, "b": int(begins[y - 1])} for x, y in spans])
                    gone.append(int(inside.sum()))
            fields = dict.fromkeys(_FIELDS, pa.int32()) | {"source_id": ids.type}
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(out_rows, pa.int32())), pa.array(out, pa.list_(pa.struct(list(fields.items())))), pa.array(cuts, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(gone, pa.int32())],
                names=["doc_id", "repeats", "cuts", "words_removed"],
            )

    def found() -> Iterator[DataFrame]:
        for n in range(SLICES):
            per_doc = _slice(placed, "doc_id", n).groupBy("doc_id").agg(F.collect_list("c").alias("chains"))
            joined = _slice(docs, "doc_id", n).join(per_doc, "doc_id").select("doc_id", "text", "chains")
            yield joined.mapInArrow(run, kind).dropDuplicates(["doc_id"])

    kind = f"doc_id {ident}, repeats {_FOUND.format(ident)}, cuts array<struct<a:int,b:int>>, words_removed int"
    out = cut_parts(found(), "op1-repeats", TEXT_ROWS)
    drop(placed)
    return out


def substring_dedup(docs: DataFrame, least_words: int = LEAST_WORDS, identity: float = IDENTITY, removed: str = "words_removed") -> DataFrame:
    """The rows of docs with repeated passages cut out of ``text``, and ``removed``, the number of words cut."""
    removed, ident, cuts = free_names(docs, removed, "repeat_doc", "cuts")
    repeats = find_repeats(docs, least_words, identity).select(F.col("doc_id").alias(ident), F.col("cuts").alias(cuts), F.col("words_removed").alias(removed))
    joined = docs.withColumn("text", F.col("text").cast("string")).join(repeats, F.col("doc_id") == F.col(ident), "left")
    edges = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["b"]))
    pieces = F.transform(edges, lambda at, i: F.substring("text", at + 1, F.coalesce(F.get(cuts, i)["a"], F.length("text")) - at))
    kept = F.when(F.col(cuts).isNotNull(), F.array_join(pieces, "")).otherwise(F.col("text"))
    out = joined.withColumn("text", kept).select(*docs.columns, F.coalesce(removed, F.lit(0)).alias(removed))
    return out
