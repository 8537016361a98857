"""Filters as data: a JSON tree of conditions, checked against a schema and compiled to a Column.

A node is ``{"and": [...]}``, ``{"or": [...]}``, ``{"not": node}`` or a condition ``{"field": "metadata.dominant_language", "op": "=", "value": "tamil"}``.  Fields are
dotted paths through structs and maps of strings.  Compiled filters are ordinary Columns, so Catalyst prunes columns by them and pushes them into scans.  Comparisons keep SQL's logic of nulls, except that ``not`` of
an unknown is true, as it keeps what doesn't meet its condition.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, MapType, NumericType, StringType, StructType, TimestampType

from ..operators.parse import envelope

COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
TEXT = {"contains": lambda a, b: F.contains(a, b), "starts": lambda a, b: F.startswith(a, b), "ends": lambda a, b: F.endswith(a, b)}
LISTS, UNARY = ("in", "not in"), ("is null", "is not null")
DEEPEST = 32


class InvalidFilter(ValueError):
    """A tree that the schema, or the language of trees, doesn't allow."""


def _field(schema: StructType, path: object) -> tuple[Column, DataType]:
    if not isinstance(path, str) or not path:
        raise InvalidFilter(f"no field: {path!r}")
    column, kind = None, schema
    parts = path.split(".")
    for i, part in enumerate(parts):
        if isinstance(kind, StructType):
            if part not in kind.names:
                raise InvalidFilter(f"no field {'.'.join(parts[: i + 1])}")
            column, kind = (F.col(f"`{part}`") if column is None else column.getField(part)), kind[part].dataType
        elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
            column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
        else:
            raise InvalidFilter(f"{'.'.join(parts[:i])} holds no fields")
    return column, kind


def _operands(column: Column, kind: DataType, value: object, path: str) -> tuple[Column, Column]:
    """Both sides of a comparison in one type; a number against a text field compares what numbers its texts are."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(kind, BooleanType) and isinstance(value, bool) or isinstance(kind, StringType) and isinstance(value, str) or isinstance(kind, NumericType) and number:
        return column, F.lit(value)
    if isinstance(kind, StringType) and number:
        return column.try_cast("double"), F.lit(float(value))
    if isinstance(kind, (DateType, TimestampType)) and isinstance(value, str):
        return column, F.lit(value).try_cast(kind)
    raise InvalidFilter(f"{path} is {kind.simpleString()}, not to be compared with {value!r}")


def _condition(node: dict, schema: StructType) -> Column:
    op, path = node.get("op"), node.get("field")
    column, kind = _field(schema, path)
    if op in UNARY:
        if set(node) != {"field", "op"}:
            raise InvalidFilter(f"{op} takes no value")
        return column.isNull() if op == "is null" else column.isNotNull()
    if set(node) != {"field", "op", "value"}:
        raise InvalidFilter(f"a condition has a field, an op and a value: {node!r}")
    value = node["value"]
    if op in COMPARE:
        return COMPARE[op](*_operands(column, kind, value, path))
    if op in TEXT:
        if not isinstance(kind, StringType) or not isinstance(value, str):
            raise InvalidFilter(f"{op} takes texts")
        return TEXT[op](column, F.lit(value))
    if op in LISTS:
        if not isinstance(value, list) or not value:
            raise InvalidFilter(f"{op} takes a list")
        some = reduce(lambda a, b: a | b, (COMPARE["="](*_operands(column, kind, v, path)) for v in value))
        return some if op == "in" else ~F.coalesce(some, F.lit(False))
    raise InvalidFilter(f"no operator {op!r}")


def compile_filter(tree: object, schema: StructType, depth: int = 0) -> Column:
    """The Column of a tree, or InvalidFilter."""
    if depth > DEEPEST or not isinstance(tree, dict):
        raise InvalidFilter(f"no node: {tree!r}")
    for word, join in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b)):
        if word in tree:
            if len(tree) > 1 or not isinstance(tree[word], list) or not tree[word]:
                raise InvalidFilter(f"{word} takes a list of nodes")
            return reduce(join, (compile_filter(n, schema, depth + 1) for n in tree[word]))
    if "not" in tree:
        if len(tree) > 1:
            raise InvalidFilter("not takes one node")
        return ~F.coalesce(compile_filter(tree["not"], schema, depth + 1), F.lit(False))
    return _condition(tree, schema)


def filter_prompt(request: str, schema: StructType) -> str:
    """What a model is asked to turn a request in words into a tree."""
    ops = ", ".join([*COMPARE, *TEXT, *LISTS, *UNARY])
    return f'Write the condition "{request}" as JSON. Nodes: {{"and": [nodes]}}, {{"or": [nodes]}}, {{"not": node}}, {{"field", "op", "value"}}. Ops: {ops}. Fields: {schema.simpleString()}. Reply with the JSON alone.'


def filter_by_reply(df: DataFrame, reply: str) -> DataFrame:
    """The rows that meet the condition in a model's reply; all rows where it holds no valid one."""
    read = df.sparkSession.range(1).select(envelope(F.lit(reply))["fields"].alias("tree")).first()["tree"]
    try:
        return df.filter(compile_filter(json.loads(read or "null"), df.schema))
    except ValueError:
        return df


def filter_by_request(df: DataFrame, request: str, service) -> DataFrame:
    """The rows that meet a request in words, which ``service`` is asked to put as a tree, in one call."""
    return filter_by_reply(df, service.ask(None, filter_prompt(request, df.schema), service.model))
