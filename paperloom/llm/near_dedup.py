"""Near-duplicate groups by SetSketch registers (operator 2).

A document's shingle set is sketched by registers: minima of exponential variates, truncated to a grid of exponentially
spaced values, K = floor(1 - log_b(min)).  Registers of a union are the elementwise maximum of the parts' registers, and
registers of similar sets agree with a probability close to their Jaccard similarity, so bands of five registers
gather candidates.  A candidate pair's similarity is estimated by maximum likelihood from both register lists and
both set sizes; pairs less than five standard deviations below the threshold are confirmed on the full sets.

Hot groups: documents with the same shingle set (128 bits of hash and its size) are one class, represented by its least doc_id, so exact
copies never meet in a bucket.  Buckets are never expanded into all pairs.  In each round every member of a bucket meets only one
hub, by aggregation and join (AQE splits a hot bucket), and confirmed links merge components.  The first hub is the bucket's most central member, the one
whose own buckets are largest: the text that most copies were made from.  Members of buckets that still hold several components then meet by
exact prefix filtering of their full sets: shingles are ordered from the rarest on, and a pair is a candidate only if it shares one so early that the rest of
both can still reach the threshold.  Entries are keyed by shingle and size class, so sizes that can't fit never meet, and in every key the
members of its largest component meet only members of others.  No link between members of one bucket is lost.
Components are found by alternating large-star and small-star steps on tables cut through the shared checkpoint folder.

At J = 0.8, 32 bands of 5 registers miss a pair with probability 3e-6, the estimate's filter with 3e-7.  Shingles are compared as 64-bit hashes.

Null or empty texts have no shingles and are linked with nothing.  Texts with fewer than k words have one shingle, the whole sequence.  Rows
that share a doc_id are one document.  Rows with a null doc_id get a null component and stay.  Very long texts only need memory for
their own words.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V
from ._store import TEXT_ROWS, cut, drop
from ._worker import task
from .components import components

SHINGLE_WORDS = 5
PERCENT = 80
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE = 1.001
RATE = 20.0
LIMIT = 65_534
STAR_ROUNDS = 2
SIGMAS = 5.0
SIZE_STEP = 1.05
BIT_WORDS = -(-REGISTERS // 64)

_RANDOM = np.random.default_rng(20_240_229)
_FACTOR = _RANDOM.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * V.U64(2) + V.U64(1)
_SHIFT = _RANDOM.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_BAND_SALT = V.mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
_SET_SALT = V.mix64(np.arange(101, 103, dtype=np.uint64))
SET_KEY = ["set_key", "set_key2"]


def registers(elements: np.ndarray) -> np.ndarray:
    """The SetSketch registers of a set of 64-bit hashes; all 0 for the empty set."""
    if not len(elements):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(elements), 512):
        np.minimum(least, (elements[i : i + 512, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    u = ((least >> V.U64(11)).astype(np.float64) + 0.5) * 2.0**-53
    value = -np.log1p(-u) / RATE
    return np.clip(np.floor(1.0 - np.log(value) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sketched sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of rows of registers, given both set sizes."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u = n_a / (n_a + n_b)
    v = 1.0 - u

    def differ(x):
        return -np.log1p(-np.maximum(x, 0.0) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        p, q = differ(u - v * j), differ(v - u * j)
        return up * np.log(np.maximum(p, 1e-300)) + down * np.log(np.maximum(q, 1e-300)) + same * np.log(np.maximum(1 - p - q, 1e-300))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        better = likelihood(x) < likelihood(y)
        low, high = np.where(better, x, low), np.where(better, high, y)
    return (low + high) / 2


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct k-word shingle hashes of each document of a block, sorted."""
    words = V.find_words(buf, offs)
    hashes = V.hash_spans(V.LOWER[buf], words.start, words.end)
    grams = V.gram_hashes(hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            out.append(g[np.append(True, g[1:] != g[:-1])])
        elif b > a:
            out.append(V.gram_hashes(hashes[a:b], b - a)[:1])
        else:
            out.append(hashes[:0])
    return out


def sketch_documents(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key and set_key2 (128 bits of hash of the set) and the registers of each row."""
    ident = docs.schema["doc_id"].dataType.simpleString()

    @task("op2")
    def run(batches):
        for batch in batches:
            for i, j, buf, offs in V.chunks(batch.column(1)):
                sets = shingle_sets(buf, offs, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *(pa.array(np.array([V.mix64(s ^ salt).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)) for salt in _SET_SALT),
                        pa.array([registers(s).tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", *SET_KEY, "sketch"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {ident}, n_shingles bigint, set_key bigint, set_key2 bigint, sketch binary")


def _band_keys(reps: DataFrame) -> DataFrame:
    @task("op2")
    def run(batches):
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
            keys = V.mix64(V.gram_hashes_rows(sketch) ^ _BAND_SALT)
            which = pa.array(np.repeat(np.arange(batch.num_rows), BANDS), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), pa.array(keys.reshape(-1).view(np.int64))], names=["rep", "key"])

    ident = reps.schema["rep"].dataType.simpleString()
    return reps.select("rep", "sketch").mapInArrow(run, f"rep {ident}, key bigint")


def _with_bits(reps: DataFrame) -> DataFrame:
    """rep, n_shingles, sketch, and the registers' lowest bits packed into words b0, b1, ..."""
    ident = reps.schema["rep"].dataType.simpleString()

    @task("op2")
    def run(batches):
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            bits = np.zeros((len(sketch), BIT_WORDS * 64), np.uint8)
            bits[:, :REGISTERS] = sketch & 1
            words = np.packbits(bits, axis=1).view(np.int64).reshape(-1, BIT_WORDS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(words[:, i].copy()) for i in range(BIT_WORDS))], names=[*batch.schema.names, *(f"b{i}" for i in range(BIT_WORDS))])

    columns = ", ".join(f"b{i} bigint" for i in range(BIT_WORDS))
    return reps.select("rep", "n_shingles", "sketch").mapInArrow(run, f"rep {ident}, n_shingles bigint, sketch binary, {columns}")


def _may_link(x: str, y: str, percent: int) -> F.Column:
    """Whether two members may reach the threshold, by their sizes and their registers' lowest bits.

    Bits of registers differ with probability (1 - J) / 2; pairs at the threshold pass with all but 1e-6.
    """
    n = F.least(f"{x}.n_shingles", f"{y}.n_shingles"), F.greatest(f"{x}.n_shingles", f"{y}.n_shingles")
    p = (1 - percent / 100) / 2
    most = int(REGISTERS * p + SIGMAS * np.sqrt(REGISTERS * p * (1 - p)) + 1)
    differ = F.bit_count(F.col(f"{x}.b0").bitwiseXOR(F.col(f"{y}.b0")))
    for i in range(1, BIT_WORDS):
        differ = differ + F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}")))
    return (100 * n[0] >= percent * n[1]) & (differ <= most)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    ident = docs.schema["rep"].dataType.simpleString()

    @task("op2")
    def run(batches):
        for batch in batches:
            for i, j, buf, offs in V.chunks(batch.column(1)):
                sets = shingle_sets(buf, offs, k)
                values = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
                bounds = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(bounds, values)], names=["rep", "shingles"])

    return docs.mapInArrow(run, f"rep {ident}, shingles array<bigint>")


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, sketch_a, sketch_b, n_a, n_b) whose estimate is not clearly below the threshold."""
    at = percent / 100
    floor = at - SIGMAS * np.sqrt(at * (1 - at) / REGISTERS)

    @task("op2")
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            a, b = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
            n_a, n_b = (table[c].to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
            keep = pa.array(estimate(a, b, n_a, n_b) >= floor)
            yield pa.RecordBatch.from_arrays([table["a"].filter(keep), table["b"].filter(keep)], names=["a", "b"])

    ident = pairs.schema["a"].dataType.simpleString()
    fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).alias("fits")
    return pairs.filter(fits).select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(run, f"a {ident}, b {ident}")


def prefix_entries(n: int, rare: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where a set of n shingles, the first ``rare`` of which no other set holds, is entered to find partners.

    Returns the places as the smaller set, the places as the larger set, the size class of the smaller for each of the latter, and for each of the
    former.  Two sets of a and b shingles
    reach the threshold with an overlap of at least percent * (a + b) / (100 + percent); at their first common shingle, at places
    i and j, the overlap is at most min(a - i, b - j).
    """
    whole = 100 + percent

    def need(a, b):
        return -(-percent * (a + b) // whole)

    small = np.arange(rare, n - need(n, n) + 1)
    least = -(-percent * n // 100)
    large = np.arange(rare, n - need(n, least) + 1)
    most = np.minimum(n, whole * (n - large) // percent - n)
    low, high = size_class(np.full(len(large), least)), size_class(most)
    count = np.maximum(0, high - low + 1)
    return small, np.repeat(large, count), V.ranges(low, count), size_class(np.full(len(small), n))


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(SIZE_STEP) + 1e-9).astype(np.int64)


def _entries(ordered: DataFrame, percent: int) -> DataFrame:
    """key, place, larger (whether as the larger set), rep, comp, n_shingles for the prefix join."""
    ident = ordered.schema["rep"].dataType.simpleString()

    @task("op2")
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            n, lists = batch.column(names.index("n_shingles")).to_numpy(), batch.column(names.index("common"))
            values, offs = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for at in range(0, batch.num_rows, 256):
                which, keys, places, larger = [], [], [], []
                for r in range(at, min(at + 256, batch.num_rows)):
                    own = values[offs[r] : offs[r + 1]]
                    rare = int(n[r]) - len(own)
                    small, large, sizes, size = prefix_entries(int(n[r]), rare, percent)
                    for place, part, flag in ((small, size, False), (large, sizes, True)):
                        keys.append(V.mix64(own[place - rare] + part.astype(np.uint64)))
                        places.append(place)
                        which.append(np.full(len(place), r))
                        larger.append(np.full(len(place), flag))
                which = pa.array(np.concatenate(which), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places)), pa.array(np.concatenate(larger)), *(batch.column(names.index(c)).take(which) for c in ("rep", "comp", "n_shingles"))],
                    names=["key", "place", "larger", "rep", "comp", "n_shingles"],
                )

    return ordered.mapInArrow(run, f"key bigint, place bigint, larger boolean, rep {ident}, comp {ident}, n_shingles bigint")


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of members (rep, comp, n_shingles) in different components that may reach the threshold, by exact prefix filtering."""
    tokens = members.join(sets, "rep").select("rep", "comp", "n_shingles", F.explode("shingles").alias("t"))
    df = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ordered = tokens.join(df, "t").groupBy("rep", "comp", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("df", "t")))["t"].alias("common"))
    ordered = ordered.filter(100 * F.size("common") >= percent * F.col("n_shingles"))
    entry = cut(_entries(ordered, percent), "op2-entries")
    per = entry.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = cut(per.groupBy("key").agg(F.max_by("comp", "n").alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("key", "main"), "op2-mixed")
    entry_ = cut(entry.join(mixed, "key"), "op2-mixed-entries")
    drop(entry, mixed)
    x, y = entry_.filter("larger").alias("x"), entry_.filter("not larger").alias("y")

    def c(name):
        return F.col(f"x.{name}"), F.col(f"y.{name}")

    (n_x, n_y), (i, j) = c("n_shingles"), c("place")
    fits = (n_y <= n_x) & ((100 + percent) * F.least(n_x - i, n_y - j) >= percent * (n_x + n_y)) & (F.col("x.comp") != F.col("y.comp"))
    met = [
        x.filter("comp <> main").alias("x").join(y, (F.col("x.key") == F.col("y.key")) & fits),
        x.filter("comp = main").alias("x").join(y.filter("comp <> main").alias("y"), (F.col("x.key") == F.col("y.key")) & fits),
    ]
    pairs = [m.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")) for m in met]
    out = cut(pairs[0].union(pairs[1]).distinct(), "op2-met")
    drop(entry_)
    return out


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sketched = cut(sketch_documents(docs, k), "op2-sketches", TEXT_ROWS)
    classes = cut(sketched.filter("n_shingles > 0 and doc_id is not null").groupBy(*SET_KEY, "n_shingles").agg(F.min("doc_id").alias("rep")), "op2-classes")
    reps = sketched.join(classes.withColumnRenamed("rep", "doc_id"), [*SET_KEY, "n_shingles", "doc_id"], "left_semi").select(
        F.col("doc_id").alias("rep"), "n_shingles", "sketch"
    )
    keys = _band_keys(reps)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bucket = cut(keys.join(shared, "key").distinct(), "op2-buckets")
    central = bucket.groupBy("rep").agg(F.sum("n").alias("weight"))
    sketch = cut(_with_bits(reps.join(central.select("rep"), "rep", "left_semi")).dropDuplicates(["rep"]), "op2-candidates")
    bits = [f"b{i}" for i in range(BIT_WORDS)]
    member = cut(bucket.select("rep", "key").join(sketch.select("rep", "n_shingles", *bits).join(central, "rep"), "rep"), "op2-members")
    drop(bucket)
    sets = cut(_sets(docs.withColumnRenamed("doc_id", "rep").join(sketch.select("rep"), "rep", "left_semi").dropDuplicates(["rep"]), k), "op2-sets", TEXT_ROWS)

    def confirm(pairs: DataFrame) -> DataFrame:
        """The pairs with ``linked``, confirmed on full sets."""
        side = [sketch.select(F.col("rep").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n_shingles").alias(f"n_{x}")) for x in "ab"]
        full = [sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"]
        likely = _likely(pairs.join(side[0], "a").join(side[1], "b"), percent)
        both = F.size(F.array_intersect("set_a", "set_b"))
        linked = likely.join(full[0], "a").join(full[1], "b").filter(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b", F.lit(True).alias("linked")).distinct()
        return pairs.join(linked, ["a", "b"], "left").select("a", "b", F.coalesce("linked", F.lit(False)).alias("linked"))

    label, tested = None, []
    for turn in range(STAR_ROUNDS + 1):
        if label is None:
            own = member.withColumn("comp", F.col("rep"))
        else:
            own = member.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        if turn < STAR_ROUNDS:
            rank = F.xxhash64("rep", F.lit(turn)) if turn else -F.col("weight")
            facts = F.struct(rank.alias("r"), F.col("rep").alias("hub"), "comp", "n_shingles", *bits)
            hub = own.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(facts).alias("h")).filter("low < high").select("key", "h.*")
            met = own.alias("x").join(hub.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & _may_link("x", "y", percent))
            met = cut(met.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), "op2-met")
        else:
            mixed = own.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
            left = cut(own.join(mixed, "key", "left_semi").select("rep", "comp", "n_shingles").distinct(), "op2-left")
            met = prefix_pairs(left, sets, percent)
            drop(left)
        fresh = met
        for done in tested:
            fresh = fresh.join(done.select("a", "b"), ["a", "b"], "left_anti")
        result = cut(confirm(fresh), "op2-tested")
        drop(met)
        tested.append(result)
        links = result.filter("linked").select("a", "b")
        if label is not None:
            links = links.union(label.filter("node <> comp").select("node", "comp"))
        before, label = label, components(links)
        if before is not None:
            drop(before)
    drop(sets, member, sketch, *tested)
    out = cut(
        sketched.select("doc_id", "n_shingles", *SET_KEY)
        .join(classes, [*SET_KEY, "n_shingles"], "left")
        .join(label.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))),
        "op2-result",
    )
    drop(sketched, classes, label)
    return out
