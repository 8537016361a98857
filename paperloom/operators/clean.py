"""Cleaning of model texts: repetition filter and de-duplication of lines and table rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, strip

LEAST_LENGTH = 10
LEAST_WORDS = 5
TOP_SHARE = 0.6


def _words(text: Column | str) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _top_count(words: Column) -> Column:
    """How often the most frequent word occurs, by the longest run of equal words in sorted order."""
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(s: Column, w: Column) -> Column:
        return let(F.when(s["w"] == w, s["n"] + 1).otherwise(1), lambda n: F.struct(w.alias("w"), n.alias("n"), F.greatest(s["best"], n).alias("best")))

    return F.aggregate(F.sort_array(words), start, step, lambda s: s["best"])


def top_word_count(text: Column | str) -> Column:
    """How often the most frequent word occurs."""
    return _top_count(_words(text))


def word_count(text: Column | str) -> Column:
    return F.size(_words(text))


def repetition(text: Column | str) -> Column:
    """n_words, top_count (how often the most frequent word occurs) and emptied (whether the filter leaves nothing), from one pass over the words."""
    text = F.col(text) if isinstance(text, str) else text

    def judge(c: Column) -> Column:
        short = (F.length(text) < LEAST_LENGTH) | (c["n"] < LEAST_WORDS)
        bad = F.when(~short, (c["top"] / c["n"] > TOP_SHARE) | strip(text).rlike(r"(?U)^(\d+\s+){5,}"))
        return F.struct(c["n"].alias("n_words"), c["top"].alias("top_count"), F.coalesce(bad, F.lit(False)).alias("emptied"))

    counted = let(_words(text), lambda words: F.struct(F.size(words).alias("n"), _top_count(words).alias("top")))
    return let(counted, judge)


def strip_repetition(text: Column | str) -> Column:
    """The text, or nothing where one word is more than 60 % of it or it begins with five numbers."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(repetition(text)["emptied"], "").otherwise(text)


def dedup_markdown(text: Column | str) -> Column:
    """Lines without repeats: table rows once per table, other lines not right after an equal line.

    A table row equal to the line put out last stays, and so do separators.  Rows are compared without blanks around pipes.  Table rows do not
    change what a line outside tables is compared with.
    """
    lines = F.split(text, "\n", -1)
    start = F.struct(
        F.lit(False).alias("table"), F.array().cast("array<string>").alias("seen"), F.lit(None).cast("string").alias("before"), F.array().cast("array<string>").alias("out")
    )

    def step(s: Column, line: Column) -> Column:
        bare = strip(line)
        pipe, rule = bare.startswith("|"), F.contains(bare, F.lit("---"))
        leaves = s["table"] & ~pipe
        inside = (pipe & ~rule) | (s["table"] & pipe)
        seen = F.when(leaves, F.array().cast("array<string>")).otherwise(s["seen"])
        norm = F.regexp_replace(bare, r"(?U)\s*\|\s*", "|")
        as_is = rule | F.coalesce(bare == strip(F.get(s["out"], F.size(s["out"]) - 1)), F.lit(False))
        fresh = ~F.array_contains(seen, norm)
        keep = F.when(inside, as_is | fresh).otherwise(~F.coalesce(bare == s["before"], F.lit(False)))
        return F.struct(
            inside.alias("table"),
            F.when(inside & ~as_is & fresh, F.concat(seen, F.array(norm))).otherwise(seen).alias("seen"),
            F.when(inside, s["before"]).otherwise(bare).alias("before"),
            F.when(keep, F.concat(s["out"], F.array(line))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(lines, start, step, lambda s: F.array_join(s["out"], "\n"))


def clean_fields(fields: Column | str) -> Column:
    """A map of texts with both cleanings applied to each."""
    return F.transform_values(fields, lambda _, v: dedup_markdown(strip_repetition(v)))
