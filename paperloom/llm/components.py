"""Connected components of a distributed edge table by alternating large-star and small-star steps.

Every step is an aggregation for the least neighbour and a join back, so a hub with many edges is pre-aggregated
on the map side and its join is split by AQE.  Each turn is cut through the shared checkpoint folder and the one before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, drop

MOST_TURNS = 60


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) for every node of the links (their two columns, in any order); drop() deletes the table behind it."""
    a, b = links.columns
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    seen = _print(edges)
    for _ in range(MOST_TURNS):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = cut(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        now = _print(after)
        drop(edges)
        edges = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
    out._paperloom_path = edges._paperloom_path
    return out
