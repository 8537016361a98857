"""Line dedup by winnowing over line hashes (operator 8).

A document is its sequence of lines that hold a word, each as its hash.  Of each window of ``WINDOW`` = 3 lines the one with the least hash (the last on a
tie) is selected; neighbouring windows mostly agree, so about half of the lines are fingerprints, and any shared run of 3 lines has one
at the same place in both texts.  Fingerprints that only one place holds, nearly all of ordinary text, go no further.  The first place with a fingerprint may share
no more than its line, so what is left stands with the windows that chose it: each such window is joined with the first place in the corpus
of the same window, by (doc_id, position), and the match is extended both ways line by line.  What is deleted is every run of at least 3 lines that stands at
an earlier place as well.

Only lines' 60-bit hashes and positions are shuffled, and the text once at the end.  The first position of a fingerprint is an
aggregate (pre-aggregated on the map side), not a list, so a line in a third of all documents costs one row per place.  A document's lines are
carried once per source it meets, and of the source only the lines within reach; a match inside a run already found is not extended again, so
a text of n equal lines takes one extension.
Deletions refer to the original texts: a run is deleted even where the first occurrence itself lies in a deleted run of its own document.

Null text stays null.  Empty texts and texts with under three lines stay as they are.  Rows that share a doc_id are one document in positions
and must have one text; rows with a null doc_id stay as they are; of rows that share a doc_id but not the text any one's lines
may stand for all.  Other columns are kept untouched; where one is named as the number of lines removed, that number's name gets underscores behind it.  An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import cut, drop, free_names
from ._worker import task

WINDOW = 3
LEAST_LINES = WINDOW


def _hash(value: Column) -> Column:
    """60 bits of MD5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, and for each line with a word its index in the text and hash, in order."""
    lines = F.split("text", "\n", -1)
    indexed = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    hashed = F.transform(indexed, lambda x: F.struct(x["at"].alias("at"), _hash(x["line"]).alias("h")))
    return (
        docs.filter("doc_id is not null and text is not null")
        .select("doc_id", hashed.alias("s"))
        .filter(F.size("s") >= LEAST_LINES)
        .select("doc_id", F.col("s.at").alias("at"), F.col("s.h").alias("h"))
    )


def fingerprints(lines: DataFrame) -> DataFrame:
    """doc_id, p (a selected line's place among the lines), h (its hash) and starts (of the windows that select it)."""

    def choosers(p: Column) -> Column:
        def line(i: int) -> Column:
            return F.get("h", p + i)

        own, starts = line(0), []
        for behind in range(WINDOW):
            least = F.lit(True)
            for i in range(-behind, WINDOW - behind):
                if i:
                    least = least & (own <= line(i) if i < 0 else own < line(i))
            starts.append(F.when(least, p - behind))
        return F.struct(p.alias("p"), own.alias("h"), F.filter(F.array(*starts), lambda s: s.isNotNull()).alias("starts"))

    places = F.transform(F.sequence(F.lit(0), F.size("h") - 1), choosers)
    return lines.select("doc_id", F.explode(F.filter(places, lambda x: F.size(x["starts"]) > 0)).alias("x")).select("doc_id", "x.p", "x.h", "x.starts")


def seeds_of(lines: DataFrame) -> DataFrame:
    """doc_id, p, g: the windows (where they start, and their line hashes) that chose a fingerprint which stands at several places."""
    chosen = cut(fingerprints(lines), "op8-fingerprints")
    often = chosen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    met = chosen.join(often, "h").groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    windows = F.transform("starts", lambda i: F.struct(i.alias("p"), F.struct(*(F.get("h", i + n).alias(f"h{n}") for n in range(WINDOW))).alias("g")))
    out = cut(lines.join(met, "doc_id").select("doc_id", F.explode(windows).alias("x")).select("doc_id", "x.p", "x.g"), "op8-seeds")
    drop(chosen)
    return out


def runs_of(own: np.ndarray, other: np.ndarray, low: int, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, stop, source start) of the runs around matches (p, q) of three lines; ``other`` begins at the source's line ``low``."""
    out, end = [], 0
    for p, q in sorted(seeds):
        if p + LEAST_LINES <= end:
            continue
        a, b, step = p, p + LEAST_LINES, 64
        while True:
            n = min(step, len(own) - b, len(other) + low - (b + q - p))
            same = own[b : b + n] == other[b + q - p - low : b + q - p - low + n]
            stop = n if same.all() else int(np.argmin(same))
            b += stop
            if stop < n or not n:
                break
            step *= 2
        while a and a + q - p > low and own[a - 1] == other[a - 1 + q - p - low]:
            a -= 1
        out.append((a, b, a + q - p))
        end = max(end, b)
    return out


def _extend(rows: DataFrame) -> DataFrame:
    """doc_id, source_id, first_line, n_lines, source_line, from_line, to_line of the runs around each row's matches."""
    ident = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "source_id", "first_line", "n_lines", "source_line", "from_line", "to_line"]

    @task("op8")
    def run(batches):
        for batch in batches:
            low = batch.column(2).to_numpy()
            lists = [(c.values, c.offsets.to_numpy()) for c in batch.columns[3:]]
            which, first, last = [], [], []
            for r in range(batch.num_rows):
                seeds, own, at, other = (v.slice(o[r], o[r + 1] - o[r]) for v, o in lists)
                places = list(zip(*(x.to_pylist() for x in seeds.flatten()), strict=True))
                at = at.to_numpy()
                for a, b, source in runs_of(own.to_numpy(), other.to_numpy(), int(low[r]), places):
                    which.append(r)
                    first.append((a, b - a, source))
                    last.append((int(at[a]), int(at[b - 1])))
            whole = np.array(first, np.int64).reshape(-1, 3)
            ends = np.array(last, np.int64).reshape(-1, 2)
            ids = pa.array(which, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(ids), batch.column(1).take(ids), *(pa.array(c, pa.int64()).cast(pa.int32()) for c in (*whole.T, *ends.T))], names=names
            )

    rows = rows.select("doc_id", "source_id", "low", "seeds", "h", "at", "other")
    return rows.mapInArrow(run, f"doc_id {ident}, source_id {ident}, first_line int, n_lines int, source_line int, from_line int, to_line int")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """The runs to delete, one row per run and source.

    doc_id, first_line, n_lines, source_id, source_line (indices among the lines with a word), from_line, to_line (the same run as
    first and last index among all lines of the text).
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    lines = cut(hashed_lines(docs).dropDuplicates(["doc_id"]), "op8-lines")
    seeds = seeds_of(lines)
    first = seeds.groupBy("g").agg(F.min(F.struct("doc_id", "p")).alias("o"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("g", F.col("o.doc_id").alias("source_id"), F.col("o.p").alias("q"))
    first = cut(first, "op8-first")
    later = seeds.join(first, "g").filter("doc_id > source_id or p > q")
    pairs = later.groupBy("doc_id", "source_id").agg(F.collect_list(F.struct("p", "q")).alias("seeds"), F.min(F.col("q") - F.col("p")).alias("low"), F.max(F.col("q") - F.col("p")).alias("high"))
    pairs = cut(pairs, "op8-pairs")
    other = lines.select(F.col("doc_id").alias("source_id"), F.col("h").alias("other"))
    low = F.greatest("low", F.lit(0))
    sized = pairs.join(lines.select("doc_id", F.size("h").alias("n")), "doc_id")
    reach = F.slice("other", low + 1, F.greatest(F.col("high") + F.col("n") - low, F.lit(0)))
    met = sized.join(other, "source_id").select("doc_id", "source_id", "seeds", low.alias("low"), reach.alias("other"))
    out = cut(_extend(met.join(lines, "doc_id")), "op8-runs")
    drop(lines, seeds, first, pairs)
    return out


def line_dedup(docs: DataFrame, removed: str = "lines_removed") -> DataFrame:
    """The rows of docs with repeated runs deleted from ``text``, and ``removed``, the number of lines deleted."""
    removed, ident, spans, left = free_names(docs, removed, "run_doc", "runs", "left")
    found = repeated_runs(docs)
    runs = found.groupBy(F.col("doc_id").alias(ident)).agg(F.collect_set(F.struct(F.col("from_line").alias("a"), F.col("to_line").alias("b"))).alias(spans))
    joined = docs.withColumn("text", F.col("text").cast("string")).join(cut(runs, "op8-deleted").hint("merge"), F.col("doc_id") == F.col(ident), "left")
    drop(found)
    lines = F.split("text", "\n", -1)
    inside = F.array_distinct(F.flatten(F.transform(spans, lambda r: F.sequence(r["a"], r["b"]))))
    gone = F.filter(inside, lambda i: F.get(lines, i).rlike(r"[^\x20\x09-\x0D]"))
    out = joined.withColumn(left, F.when(F.col(spans).isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)))
    out = out.withColumn(removed, F.when(F.col(spans).isNotNull(), F.size(lines) - F.size(left)).otherwise(0))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return out.withColumn("text", F.coalesce(kept, "text")).drop(left, spans, ident)
