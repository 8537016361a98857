"""License scans by MinHash bands over overlapping windows (operator 10), in DataFrame functions only.

Words are lower-cased, freed of punctuation and split on white space.  Every window of five words (four two-word
shingles), at every word of the text, gets one MinHash value per band.  Templates are windowed in the same way; a window retrieves the templates
that share a value in a band.  Each retrieved template is verified exactly: the share of its shingles found in the text around the window,
its own length to either side, must reach ``least_containment``.

With one row per band, windows of Jaccard similarity J share a band with probability 1 - (1 - J)^4: 0.998 at 0.8, and 1 where five words of a template stand
unbroken.  A template is retrieved by any of its windows, so one is missed only if every window of it misses; a notice that keeps 80 % of its shingles by
replaced words has an unbroken run of five, as a replaced word breaks two shingles; inserted words break one each, and then retrieval is as
probable as said, not certain.

Everything is a row-wise projection: no shuffle, no join, no Python.  Templates and their band values are literals of fixed size.  Null or empty
texts, and texts under five words, have no license.  Repeated rows are scanned each on its own; a null doc_id passes through; other
columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW_SHINGLES = 4
BANDS = 4
LEAST_CONTAINMENT = 0.8
PUNCTUATION = ".,;:()\"'*#%&$!|<>"

#: License notices to look for (fixed texts).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0-header",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction",
    ),
    ("BSD-terms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_MASK = tuple((0x9E3779B97F4A7C15 * (j + 1) * (j + 7)) % (1 << 64) - (1 << 63) for j in range(BANDS))


def _shingles(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.lower(text), PUNCTUATION, ""), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once a row, however often it stands in the result."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _hashed(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))
    return F.when(F.size(words) > WINDOW_SHINGLES, pairs)


def _value(hashes: Column, at: Column, band: int) -> Column:
    """The MinHash value of the window at a place: the least shingle hash after the band's permutation."""
    return F.least(*(F.get(hashes, at + s).bitwiseXOR(F.lit(_MASK[band])) for s in range(WINDOW_SHINGLES)))


def _templates(spark: SparkSession, notices) -> list[dict]:
    frame = spark.createDataFrame(list(notices), "name string, text string").withColumn("w", _shingles(F.col("text"))).withColumn("h", _hashed(F.col("w")))
    windows = F.sequence(F.lit(0), F.size("h") - WINDOW_SHINGLES)

    def values(b: int) -> Column:
        return F.transform(windows, lambda i: _value(F.col("h"), i, b)).alias(f"k{b}")

    keys = [values(b) for b in range(BANDS)]
    return [{"name": r["name"], "h": sorted(set(r["h"])), **{f"k{b}": r[f"k{b}"] for b in range(BANDS)}} for r in frame.select("name", "h", *keys).collect()]


def license_scan(docs: DataFrame, notices=NOTICES, least_containment: float = LEAST_CONTAINMENT) -> DataFrame:
    """doc_id and ``found``, an array of (name, containment), by name, for each row of docs."""
    known = _templates(docs.sparkSession, notices)
    kind = "array<struct<name:string,h:array<bigint>," + ",".join(f"k{b}:array<bigint>" for b in range(BANDS)) + ">>"
    literal = F.from_json(F.lit(json.dumps(known)), kind)
    hit = [sorted({k for t in known for k in t[f"k{b}"]}) for b in range(BANDS)]

    def retrieved(h: Column, i: Column) -> Column:
        out = F.lit(False)
        for b in range(BANDS):
            out = out | _value(h, i, b).isin(hit[b])
        return out

    def verified(h: Column, i: Column) -> Column:
        def shares(k: Column) -> Column:
            return F.filter(literal, lambda t: F.array_contains(t["k0"], k["k0"]) | F.array_contains(t["k1"], k["k1"]) | F.array_contains(t["k2"], k["k2"]) | F.array_contains(t["k3"], k["k3"]))

        def share(t: Column) -> Column:
            low = F.greatest(i - F.size(t["h"]), F.lit(0))
            around = F.slice(h, low + 1, i + F.size(t["h"]) + WINDOW_SHINGLES - low)
            return F.struct(t["name"].alias("name"), (F.size(F.array_intersect(t["h"], around)) / F.size(t["h"])).alias("containment"))

        keys = F.struct(*(_value(h, i, b).alias(f"k{b}") for b in range(BANDS)))
        return F.filter(_let(keys, lambda k: F.transform(shares(k), share)), lambda m: m["containment"] >= least_containment)

    def best(all_: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(all_, lambda m: m["name"])))
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.array_max(F.transform(F.filter(all_, lambda m: m["name"] == n), lambda m: m["containment"])).alias("containment")))

    def scan(h: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(h) - WINDOW_SHINGLES), lambda i: retrieved(h, i))
        return F.when(h.isNotNull(), _let(F.flatten(F.transform(at, lambda i: verified(h, i))), best))

    found = _let(_shingles(F.col("text").cast("string")), lambda w: _let(_hashed(w), scan))
    return docs.select("doc_id", F.coalesce(found, F.array().cast("array<struct<name:string,containment:double>>")).alias("found"))
