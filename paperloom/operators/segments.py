"""Splitting images into segments (geometry only) and combining what the segments gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE, TALL = 1.8, 1.5
MIN_SIDE, MAX_SIDE, MAX_ZOOM = 800, 2000, 2.0
SECOND = "\n\n---\n\n### SECOND BILL ###\n\n"
RULE = "\n\n---\n\n"


def _box(x0, y0, x1, y1) -> Column:
    return F.named_struct(*(c for x, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1")) for c in (F.lit(n), x.cast("int"))))


def wide_boxes(w: Column | str, h: Column | str) -> Column:
    """Left and right half of a wide image, or the whole image."""
    w, h = (F.col(x) if isinstance(x, str) else x for x in (w, h))
    zero, mid = F.lit(0), F.floor(w / 2)
    return F.when(w > h * F.lit(WIDE), F.array(_box(zero, zero, mid, h), _box(mid, zero, w, h))).otherwise(F.array(_box(zero, zero, w, h)))


def segment_boxes(w: Column | str, h: Column | str) -> Column:
    """Halves of a wide image, overlapping top and bottom parts of a tall one, or the whole image."""
    w, h = (F.col(x) if isinstance(x, str) else x for x in (w, h))
    zero = F.lit(0)
    tall = F.array(_box(zero, zero, w, F.floor(h * F.lit(0.55))), _box(zero, F.floor(h * F.lit(0.45)), w, h))
    return F.when(w > h * F.lit(WIDE), wide_boxes(w, h)).when(h > w * F.lit(TALL), tall).otherwise(wide_boxes(w, h))


def resized(w: Column | str, h: Column | str) -> Column:
    """Width and height after the size rule: up to 800 on the short side, by twice at most, then down to 2000 on the long side."""
    w, h = ((F.col(x) if isinstance(x, str) else x).cast("double") for x in (w, h))
    zoom = F.when(F.least(w, h) < MIN_SIDE, F.least(F.lit(MAX_ZOOM), F.lit(float(MIN_SIDE)) / F.least(w, h))).otherwise(1.0)
    w1, h1 = F.floor(w * zoom), F.floor(h * zoom)
    shrink = F.when(F.greatest(w1, h1) > MAX_SIDE, F.lit(float(MAX_SIDE)) / F.greatest(w1, h1)).otherwise(1.0)
    return F.named_struct(F.lit("w"), F.floor(w1 * shrink).cast("int"), F.lit("h"), F.floor(h1 * shrink).cast("int"))


def explode_segments(images: DataFrame, boxes: Column) -> DataFrame:
    """One row per segment, numbered from 1."""
    return images.select("*", F.posexplode(boxes).alias("seg_idx", "box")).withColumn("seg_idx", F.col("seg_idx") + 1)


def join_segments(df: DataFrame, keys: list[str], index: str, text: str) -> DataFrame:
    """The texts of a document's segments, marked by number; empty ones are left out but counted."""
    marked = F.when(F.coalesce(F.col(text), F.lit("")) != "", F.concat(F.lit("--- SEGMENT "), F.col(index).cast("string"), F.lit(" ---\n"), F.col(text)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), marked.alias("t")))), lambda x: x["t"])
    return df.groupBy(*keys).agg(F.array_join(F.filter(parts, lambda t: t.isNotNull()), "\n").alias("full_extraction"), F.count(F.lit(1)).alias("segments"))


def combine(df: DataFrame, keys: list[str], index: str, text: str, twin: str, fields: str) -> DataFrame:
    """Texts of all bills of an image, the fields of the last, and how many there were."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(twin), F.lit("")).alias("w"))))
    spoken = F.transform(ordered, lambda x: F.when(x["t"] == "", F.concat(F.lit("Extraction failed for segment "), x["i"].cast("string"))).otherwise(x["t"]))
    return df.groupBy(*keys).agg(
        F.array_join(spoken, SECOND).alias("vlm_output"),
        F.array_join(F.transform(ordered, lambda x: x["w"]), RULE).alias("digital_twin_content"),
        F.max_by(fields, index).alias("vlm_fields"),
        F.count(F.lit(1)).alias("segments_processed"),
    )
