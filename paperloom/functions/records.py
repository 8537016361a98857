"""JSON objects with free keys as ordered entries.

An entry is (k, nk, v, full): the key, its normal form, the value as text, and whether the value counts as present: null, empty text, zero,
false and empty lists or objects do not, the text "0" does.  Of equal keys the last value stands at the first place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_more_than_blanks, let, normalize_key

ENTRY = "array<struct<k:string,nk:string,v:string,full:boolean>>"


def variants(raw: Column | str) -> Column:
    return F.from_json(raw, "map<string,variant>")


def _entry(key: Column, value: Column) -> Column:
    def of_json(json: Column) -> Column:
        text, zero = json.startswith('"'), json.rlike(r"^-?0+(\.0*)?([eE][+-]?\d+)?$")
        # a text without escapes stands in its JSON as it is
        shown = F.when(text & ~F.contains(json, F.lit("\\")), F.substring(json, F.lit(2), F.length(json) - 2)).otherwise(value.cast("string"))
        full = F.when(text, json != '""').otherwise(~F.coalesce(json.isin("null", "false", "[]", "{}") | zero, F.lit(True)))
        return F.struct(key.alias("k"), normalize_key(key).alias("nk"), shown.alias("v"), full.alias("full"))

    return let(F.to_json(value), of_json)


def entries(raw: Column | str) -> Column:
    """The entries of a JSON object given as text; null if it is none."""
    return F.transform(F.map_entries(variants(raw)), lambda e: _entry(e["key"], e["value"]))


def by_normal_key(items: Column | str) -> Column:
    """Entries with equal normal keys as one: the last value at the first place."""
    def last(keys: Column) -> Column:
        several = F.transform(F.array_distinct(keys), lambda k: F.element_at(F.filter(items, lambda e: e["nk"] == k), -1))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), items).otherwise(several)

    return let(F.transform(items, lambda e: e["nk"]), last)


def usable(entry: Column) -> Column:
    return entry["full"] & has_more_than_blanks(entry["v"])


def hide_private(fields: Column | str) -> Column:
    """A map without the keys that begin with an underscore."""
    return F.map_filter(fields, lambda k, v: ~k.startswith("_"))


__all__ = ["ENTRY", "by_normal_key", "entries", "hide_private", "let", "usable", "variants"]
