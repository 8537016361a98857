"""Model replies to records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.records import let
from ..functions.text import strip

SHOWN_ON_FAILURE = 1000
REMOTE_MARK = "trycloudflare.com"


def envelope(reply: Column | str) -> Column:
    """fields (JSON text), full_extraction, is_comprehensive and _source of a reply; null for an empty one.

    Code fences go, then all before the first opening and after the last closing brace.  A reply that is not JSON then keeps the cut text.
    """
    reply = F.col(reply) if isinstance(reply, str) else reply
    bare = strip(F.replace(F.replace(reply, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))

    def cut(text: Column) -> Column:
        first, last = F.locate("{", text), F.length(text) - F.locate("}", F.reverse(text)) + 1
        both = F.contains(text, F.lit("{")) & F.contains(text, F.lit("}"))
        return F.when(both, F.substring(text, first, F.greatest(last - first + 1, F.lit(0)))).otherwise(text)

    def judge(body: Column) -> Column:
        # parsers pass over what follows a value, but not inside an object; objects with equal keys, at any depth, are JSON as well, though not as a variant
        wrapped = F.concat(F.lit('{"x":'), body, F.lit("}"))
        inside = F.from_json(wrapped, "x string, bad string", {"columnNameOfCorruptRecord": "bad"})
        parsed = F.try_parse_json(wrapped).isNotNull() | (inside["x"].isNotNull() & inside["bad"].isNull())
        return F.struct(body.alias("body"), (F.coalesce(parsed, F.lit(False)) & (body != "")).alias("good"))

    def record(x: Column) -> Column:
        return F.struct(
            F.when(x["good"], x["body"]).alias("fields"),
            F.when(~x["good"], strip(x["body"])).alias("full_extraction"),
            x["good"].alias("is_comprehensive"),
            F.when(x["good"], "master_vlm_json").otherwise("vlm_raw_fallback").alias("_source"),
        )

    whole = let(bare, lambda t: let(cut(t), lambda c: let(judge(c), record)))
    return F.when(F.coalesce(reply, F.lit("")) != "", whole)


def extraction(reply: Column | str, url: str = "") -> Column:
    """The extraction result of one reply: fields (a JSON object as text), is_invoice and _source, and of the fields spoken, twin (both texts) and meta (JSON).

    The object's own keys come first, then full_extraction, english_extraction and metadata, which replace own keys of those names; of equal own keys the last value stands at the first place.  A
    reply that is not JSON gives its first 1000 characters; one whose ``native_json`` is not an object gives the failure record.
    """
    reply = F.col(reply) if isinstance(reply, str) else reply
    kind = "struct<native_json:string,native_layout_text:string,english_layout_text:string,metadata:variant>"

    def parts(env: Column) -> Column:
        return F.struct(F.coalesce(env["is_comprehensive"], F.lit(False)).alias("good"), F.from_json(env["fields"], kind).alias("shape"))

    def own(x: Column) -> Column:
        return F.struct(x["good"].alias("good"), x["shape"].alias("shape"), F.from_json(F.coalesce(x["shape"]["native_json"], F.lit("{}")), "map<string,variant>").alias("own"))

    return let(let(let(envelope(reply), parts), own), lambda x: _extraction(reply, x["good"], x["shape"], x["own"], url))


def _extraction(reply: Column, is_json: Column, shape: Column, own: Column, url: str) -> Column:
    injected = ("full_extraction", "english_extraction", "metadata")
    kept = F.filter(F.map_entries(own), lambda e: ~e["key"].isin(*injected))

    def quoted(text: Column) -> Column:
        return let(F.to_json(F.struct(text.alias("k"))), lambda j: F.substring(j, F.lit(6), F.length(j) - 6))

    def written(entries: Column) -> Column:
        return F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.to_json(e["value"])))

    def last(keys: Column) -> Column:
        several = F.transform(F.array_distinct(keys), lambda k: F.element_at(F.filter(kept, lambda e: e["key"] == k), -1))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), written(kept)).otherwise(written(several))

    items = let(F.transform(kept, lambda e: e["key"]), last)
    added = F.array(
        F.concat(F.lit('"full_extraction":'), quoted(F.coalesce(shape["native_layout_text"], F.lit("")))),
        F.concat(F.lit('"english_extraction":'), quoted(F.coalesce(shape["english_layout_text"], F.lit("")))),
        F.concat(F.lit('"metadata":'), F.coalesce(F.to_json(shape["metadata"]), F.lit("{}"))),
    )
    record = F.concat(F.lit("{"), F.array_join(F.concat(items, added), ","), F.lit("}"))
    source = "kaggle_remote_vlm" if REMOTE_MARK in url else "local_vlm"
    missing = F.coalesce(F.nullif(F.substring(reply, 1, SHOWN_ON_FAILURE), F.lit("")), F.lit("No response"))
    none = F.lit(None).cast("string")

    def result(fields: Column, good: bool, source: str, spoken: Column, twin: Column, meta: Column) -> Column:
        return F.struct(fields.alias("fields"), F.lit(good).alias("is_invoice"), F.lit(source).alias("_source"), spoken.alias("spoken"), twin.alias("twin"), meta.alias("meta"))

    failed = result(F.lit("{}"), False, "failed", none, none, none)
    unread = result(F.to_json(F.struct(missing.alias("full_extraction"))), False, "vlm_parsing_failed", missing, none, none)
    texts = (F.coalesce(shape[c], F.lit("")) for c in ("native_layout_text", "english_layout_text"))
    good = result(record, True, source, *texts, F.coalesce(F.to_json(shape["metadata"]), F.lit("{}")))
    return F.when(is_json, F.when(own.isNotNull(), good).otherwise(failed)).otherwise(unread)
