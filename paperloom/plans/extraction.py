"""The whole path from images' replies to results, as one lazy plan that batch and streaming share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import with_once
from ..operators.parse import extraction
from ..operators.segments import combine
from ..operators.template import map_to_template


def extract_segments(replies: DataFrame, url: str = "") -> DataFrame:
    """Rows (keys, seg_idx, reply) with the extraction result of each reply."""
    found = with_once(replies, "__x", extraction("reply", url))
    return found.select(*replies.columns, F.col("__x.fields").alias("fields"), F.col("__x.is_invoice").alias("is_invoice"), F.col("__x._source").alias("_source"))


def results(replies: DataFrame, keys: tuple[str, ...] = ("doc_id",), url: str = "", mode: str = "compatible") -> DataFrame:
    """One result per document: status, texts, fields, template, source, language and number of segments.

    The last segment supplies the structured fields.  A row whose metadata is not an object fails.
    """
    each = with_once(replies, "__x", extraction("reply", url)).withColumns({"__text": F.col("__x.spoken"), "__twin": F.col("__x.twin"), "__pair": F.struct("__x.fields", "__x._source", "__x.meta")})
    whole = combine(each, list(keys), "seg_idx", "__text", "__twin", "__pair")
    whole = whole.withColumns({"record": F.col("vlm_fields.fields"), "vlm_source": F.col("vlm_fields._source"), "__meta": F.col("vlm_fields.meta")})
    bad = F.col("__meta").isNotNull() & ~F.coalesce(F.trim("__meta").startswith("{"), F.lit(False))
    language = F.coalesce(F.get_json_object("__meta", "$.detected_language"), F.lit("unknown"))
    mapped = map_to_template(whole, "record", mode)
    return mapped.select(
        *keys,
        F.when(bad, "failed").otherwise("success").alias("status"),
        F.when(bad, "metadata is not an object").alias("error"),
        "vlm_output",
        F.col("record").alias("vlm_fields"),
        F.col("template").alias("template_fields"),
        "vlm_source",
        "digital_twin_content",
        F.struct(F.col("segments_processed"), language.alias("dominant_language")).alias("metadata"),
    )


def filter_results(df: DataFrame, condition: str) -> DataFrame:
    """Results that meet a SQL condition; a translator from plain language would supply the condition."""
    return df.filter(F.expr(condition))


def flat_records(df: DataFrame, fields: str = "fields", source: str = "_source") -> DataFrame:
    """The dynamic fields (a JSON object as text) as typed columns, after the other columns of df and before the source, whose name no field may take.

    The types are those that all rows agree on, found by one aggregate; what rows disagree on stays a variant.  A field that a row lacks is null.
    """
    others = [c for c in df.columns if c not in (fields, source)]
    seen = df.select(F.try_parse_json(fields).alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    shape = seen.agg(F.schema_of_variant_agg("v").alias("s")).first()["s"] or "OBJECT<>"
    ddl = shape.replace("OBJECT<", "STRUCT<").replace(": VOID", ": STRING")
    if ddl in ("STRUCT<>", "VOID"):
        return df.select(*others, source)
    typed = df.withColumn("flat", F.try_variant_get(F.try_parse_json(fields), "$", ddl))
    names = [n for n in typed.schema["flat"].dataType.names if n not in (*others, source)]
    return typed.select(*others, *(F.col("flat").getField(n).alias(n) for n in names), source)
