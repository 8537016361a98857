"""Small lookups and summaries of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label and tier of each source (fixed values).
SOURCES = (
    ("kaggle_remote_vlm", "Kaggle Qwen2.5-VL-32B (Remote Tunnel)", "30GB VRAM"),
    ("llava_local_with_ocr_hint", "Local CUDA Qwen-VL (with OCR Hint)", "GPU"),
    ("llava_local_only", "Local CUDA Qwen-VL (Visual Only)", "GPU"),
    ("image_only_fallback", "Local Fallback (Visual Only)", "GPU"),
    ("llava", "LLaVA 1.6 Mistral-7B", "Tier 1"),
    ("blip2", "BLIP-2 Flan-T5-XL", "Tier 2"),
    ("local", "BLIP-base (local)", "Tier 3"),
    ("unavailable", "Model Unavailable", ""),
)


def source_meta(source: Column | str) -> Column:
    """label and tier of a source; an unknown one is unavailable."""
    table = F.create_map(*(x for s, label, tier in SOURCES for x in (F.lit(s), F.struct(F.lit(label).alias("label"), F.lit(tier).alias("tier")))))
    return F.coalesce(F.try_element_at(table, F.coalesce(F.col(source) if isinstance(source, str) else source, F.lit("unavailable"))), F.try_element_at(table, F.lit("unavailable")))


def status_summary(results: DataFrame, status: str = "status") -> DataFrame:
    return results.agg(F.count_if(F.col(status) == "success").alias("succeeded"), F.count(F.lit(1)).alias("total"))


def without_selected(batch: DataFrame, selected: DataFrame, name: str = "name") -> DataFrame:
    """Files of a batch whose names are not selected yet; equal names within the batch all stay."""
    return batch.join(selected.select(name).distinct(), name, "left_anti")


def without_name(files: DataFrame, name: str, column: str = "name") -> DataFrame:
    return files.filter(~F.col(column).eqNullSafe(name))


def document_label(kind: Column | str, default: str = "Document") -> Column:
    return F.coalesce(F.nullif(F.col(kind) if isinstance(kind, str) else kind, F.lit("")), F.lit(default))
