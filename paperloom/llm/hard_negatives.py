"""Hard negatives by bit-sliced integer products (operator 13).

Components become integers, floor(256 * x).  Rows lie in blocks of about 4,096 as bit-planes in two's complement, one packed bit a component and plane.  A
block of anchors meets a block of rows plane by plane, the most significant first: with the planes down to 2^k known, an anchor's score with a row lies
between the sum so far less (2^k - 1) times the anchor's negative components and that sum plus (2^k - 1) times its positive ones.  A pair
whose interval can't qualify is dropped; the others go on, as a dense product while many are left, pair by pair when few are, until the last plane
makes scores exact.

Positives first: of an anchor's own label a row is dropped when the upper end is below the k-th best lower end.  Then negatives: of other labels a row is dropped
when for each positive its interval misses the range of scores asked for, or lies below the k-th best lower end of the rows that are surely inside.

The anchors are a stated query set against all rows, in blocks: anchors, 1 % of the rows in the query, are copied once per block of rows, and the rows are shuffled once.  Every
pair of blocks gives at most k rows an anchor and positive, ranked by a window that cuts before its shuffle.  Blocks are dealt by the hash of vec_id, so
a label of a third of all rows is spread over all of them.  Nothing passes through the driver but two row counts.

Rows with a null vec_id, label or embedding, and those with a null or non-finite component, take no part.  Shorter vectors count as if zeros followed.
Rows that share a vec_id are one row, the one with the least label, then the least vector.  Ties go to the smaller vec_id.  An
anchor without another row of its label, and a positive without a row in its range, give no rows.  Scores that don't fit 63 bits raise an error.  Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut, drop
from ._worker import task

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Per cent of the positive's score that a negative's lies between.
LOW, HIGH = 30, 90
BLOCK_ROWS, BLOCK_ANCHORS = 4096, 256
#: Pairs are taken one by one when fewer than one in so many are left, so many at a time.
SPARSE, AT_ONCE = 16, 1 << 16


def slice_bits(v: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of bits of the integers in v (rows x components), and their packed bit-planes, the sign's first."""
    bits = 1 + max(int(v.max(initial=0)).bit_length(), int(~v.min(initial=0)).bit_length())
    planes = [np.packbits(((v >> k) & 1).astype(np.uint8), axis=1) for k in range(bits - 1, -1, -1)]
    return bits, np.stack(planes)


def _kth(i: np.ndarray, low: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of n anchors the k-th largest of its values ``low``, -inf where there are fewer."""
    order = np.lexsort((-low, i))
    first = np.searchsorted(i[order], np.arange(n))
    count = np.bincount(i, minlength=n)
    out = np.full(n, -np.inf)
    has = count >= k
    out[has] = low[order][first[has] + k - 1]
    return out


class Best:
    """Keeps pairs that may be among an anchor's k best."""

    def __init__(self, k: int):
        self.k = k

    def dense(self, partial: np.ndarray, alive: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        n = partial.shape[1]
        if n <= self.k:
            return alive
        kth = np.partition(np.where(alive, partial, -np.inf), n - self.k, axis=1)[:, n - self.k]
        return alive & (partial >= (kth - down - up).astype(partial.dtype)[:, None])

    def pairs(self, i: np.ndarray, s: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        return s + up[i] >= _kth(i, s - down[i], self.k, len(up))[i]


class Within:
    """Keeps pairs that may be among the k best inside one of an anchor's ranges (low and high: anchors x ranges)."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.low, self.high = k, low.astype(np.float64), high.astype(np.float64)

    def _floors(self, up: np.ndarray, down: np.ndarray):
        """For each range: where an interval's upper end must reach, and where sums of rows surely inside lie."""
        for p in range(self.low.shape[1]):
            low, high = self.low[:, p], self.high[:, p]
            yield low.copy(), high, low + down, high - up

    def dense(self, partial: np.ndarray, alive: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        out, kind, n = np.zeros_like(alive), partial.dtype, partial.shape[1]
        for low, high, sure_low, sure_high in self._floors(up, down):
            if n > self.k:
                for r in np.flatnonzero(sure_low <= sure_high):
                    inside = partial[r][alive[r] & (partial[r] >= sure_low[r]) & (partial[r] <= sure_high[r])]
                    if len(inside) >= self.k:
                        low[r] = max(low[r], np.partition(inside, len(inside) - self.k)[len(inside) - self.k] - down[r])
            out |= (partial >= (low - up).astype(kind)[:, None]) & (partial <= (high + down).astype(kind)[:, None])
        return alive & out

    def pairs(self, i: np.ndarray, s: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for low, high, sure_low, sure_high in self._floors(up, down):
            sure = (s >= sure_low[i]) & (s <= sure_high[i])
            low = np.maximum(low, _kth(i[sure], (s - down[i])[sure], self.k, len(up)))
            out |= (s + up[i] >= low[i]) & (s - down[i] <= high[i])
        return out


def _kind(a: np.ndarray, bits: int) -> type:
    """The cheapest type in which all sums of products of anchors and integers of so many bits are exact."""
    bound = int(np.abs(a).astype(object).sum(axis=1).max(initial=0)) << bits
    if bound >= 1 << 63:
        raise OverflowError("scores of these vectors don't fit 63 bits")
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def tighten(a: np.ndarray, bits: int, planes: np.ndarray, alive: np.ndarray, judge: Best | Within) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor and row numbers and exact scores of the pairs of ``alive`` (anchors x rows) that the judge keeps to the end."""
    kind = _kind(a, bits)
    plus, minus = np.maximum(a, 0).sum(axis=1), np.maximum(-a, 0).sum(axis=1)
    a = a.astype(kind)
    rows = np.arange(alive.shape[1])
    partial, pairs = np.zeros(alive.shape, kind), None
    for which, k in enumerate(range(bits - 1, -1, -1)):
        weight, rest = -(1 << k) if k == bits - 1 else 1 << k, (1 << k) - 1
        up, down = rest * plus, rest * minus
        if pairs is None:
            plane = np.unpackbits(planes[which, rows], axis=1, count=a.shape[1]).astype(kind)
            partial += (a * kind(weight)) @ plane.T
            alive = judge.dense(partial, alive, up, down)
            some = alive.any(axis=0)
            if 4 * some.sum() < 3 * len(some):
                partial, alive, rows = partial[:, some], alive[:, some], rows[some]
            if SPARSE * np.count_nonzero(alive) < alive.size or not k:
                i, j = np.nonzero(alive)
                pairs = i, rows[j], partial[i, j].astype(np.int64)
            continue
        i, j, s = pairs
        used, at = np.unique(j, return_inverse=True)
        plane = np.unpackbits(planes[which, used], axis=1, count=a.shape[1]).astype(kind)
        for x in range(0, len(i), AT_ONCE):
            part = slice(x, x + AT_ONCE)
            s[part] += weight * np.einsum("pd,pd->p", a[i[part]], plane[at[part]]).astype(np.int64)
        keep = judge.pairs(i, s, up, down)
        pairs = i[keep], j[keep], s[keep]
    return pairs


def _first(i: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each anchor's k first by score and id."""
    order = np.lexsort((ids, -s, i))
    group = i[order]
    rank = np.arange(len(order)) - np.searchsorted(group, group)
    return order[rank < k]


def _usable(rows: DataFrame) -> DataFrame:
    """vec_id, label and v (integer components), one row a vec_id."""
    usable = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    usable = usable.filter("vec_id is not null and label is not null and x is not null").filter(~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    one = usable.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r"))
    return one.select("vec_id", "r.label", F.transform("r.x", lambda x: F.floor(x * SCALE)).alias("v"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of integers as rows, with zeros behind the shorter ones."""
    offs, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    size = np.diff(offs)
    out = np.zeros((len(size), max(1, int(size.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = values[offs[0] : offs[-1]]
    return out


def _blocks(rows: DataFrame, by: str, n: int, size: int, *columns: str) -> DataFrame:
    """rows in about n / size blocks by the hash of vec_id: by, and arrays of the columns."""
    block = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // size)))).cast("int")
    return rows.groupBy(block.alias(by)).agg(F.collect_list(F.struct(*columns)).alias("own")).select(by, *(F.col(f"own.{c}").alias(c) for c in columns))


def _sliced(rows: DataFrame, n: int) -> DataFrame:
    """block, bits, ids, labels, planes: all rows as bit-planes."""

    @task("op13")
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, labels, v = (c.slice(r, 1).flatten() for c in batch.columns[1:])
                order = np.argsort(labels.to_numpy(), kind="stable")
                bits, planes = slice_bits(_matrix(v)[order])
                lists = [pa.array([x.to_numpy()[order]], pa.list_(pa.int64())) for x in (ids, labels)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array([bits], pa.int32()), *lists, pa.array([planes.tobytes()], pa.binary())], names=["block", "bits", "ids", "labels", "planes"])

    return _blocks(rows, "block", n, BLOCK_ROWS, "vec_id", "label", "v").mapInArrow(run, "block int, bits int, ids array<bigint>, labels array<bigint>, planes binary")


def _met(anchors: DataFrame, sliced: DataFrame, n: int) -> DataFrame:
    """Every block of anchors beside every block of rows; anchors are copied, rows are not."""
    blocks = max(1, -(-n // BLOCK_ROWS))
    copied = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return sliced.join(copied.hint("merge"), "block")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(anchor batch row, ids, labels, vectors of anchors, bits, ids, labels, planes of rows), their vectors as long as each other."""
    for batch in batches:
        x = {name: batch.column(c) for c, name in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            ids, labels, own, own_labels = (x[c].slice(r, 1).flatten().to_numpy() for c in ("ids", "labels", "vec_id", "label"))
            v, bits = _matrix(x["v"].slice(r, 1).flatten()), x["bits"][r].as_py()
            planes = np.frombuffer(x["planes"][r].as_py(), np.uint8).reshape(bits, len(ids), -1)
            width = 8 * planes.shape[2]
            v = v[:, :width] if v.shape[1] >= width else np.pad(v, ((0, 0), (0, width - v.shape[1])))
            yield {c: x[c].slice(r, 1) for c in x}, own, own_labels, v, bits, ids, labels, planes


def nearest_of_label(met: DataFrame, k: int) -> DataFrame:
    """anchor_id, positive_id, positive_score: each anchor's k first other rows of its label."""

    @task("op13")
    def run(batches):
        for _, own, own_labels, v, bits, ids, labels, planes in _pairs(batches):
            for label in np.intersect1d(own_labels, labels):
                mine = np.flatnonzero(own_labels == label)
                low, high = np.searchsorted(labels, [label, label + 1])
                i, j, s = tighten(v[mine], bits, planes[:, low:high], own[mine][:, None] != ids[low:high], Best(k))
                chosen = _first(i, s, ids[low:high][j], k)
                yield pa.RecordBatch.from_arrays([pa.array(own[mine][i[chosen]]), pa.array(ids[low:high][j[chosen]]), pa.array(s[chosen])], names=["anchor_id", "positive_id", "positive_score"])

    found = met.mapInArrow(run, "anchor_id bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def within_ranges(met: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: each positive's k first rows of other labels in its range."""
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    @task("op13")
    def run(batches):
        for x, own, own_labels, v, bits, ids, labels, planes in _pairs(batches):
            positive, score = (_matrix(x[c].flatten()) for c in ("positive_id", "positive_score"))
            size = np.diff(x["positive_id"].flatten().offsets.to_numpy())
            there = np.arange(positive.shape[1]) < size[:, None]
            least, most = -((-low * score) // 100), (high * score) // 100
            there &= least <= most
            least, most = np.where(there, least, np.inf), np.where(there, most, -np.inf)
            i, j, s = tighten(v, bits, planes, own_labels[:, None] != labels, Within(k, least, most))
            for p in range(positive.shape[1]):
                fits = np.flatnonzero((s >= least[i, p]) & (s <= most[i, p]))
                chosen = fits[_first(i[fits], s[fits], ids[j[fits]], k)]
                at = i[chosen]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own[at], positive[at, p], score[at, p], ids[j[chosen]], s[chosen])], names=names)

    found = met.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows with vec_id, label (an integer) and embedding.

    ``anchors`` says by vec_id and label which rows are anchors.  A negative's score is from low to high per cent of its positive's.
    """
    usable = cut(_usable(rows), "op13-rows")
    chosen = usable.filter(anchors)
    n, n_anchors = usable.count(), chosen.count()
    sliced = cut(_sliced(usable, n), "op13-sliced", 4)
    own = _blocks(chosen, "anchors", n_anchors, BLOCK_ANCHORS, "vec_id", "label", "v")
    found = cut(nearest_of_label(_met(own, sliced, n), positives), "op13-positives", 4)
    lists = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("p"))
    ranged = chosen.join(lists, "vec_id").select("vec_id", "label", "v", "p.positive_id", "p.positive_score")
    own = _blocks(ranged, "anchors", n_anchors, BLOCK_ANCHORS, "vec_id", "label", "v", "positive_id", "positive_score")
    out = cut(within_ranges(_met(own, sliced, n), negatives, low, high), "op13-result", 4)
    drop(usable, sliced, found)
    return out
