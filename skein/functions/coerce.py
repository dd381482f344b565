"""Arguments bent to a JSON schema, nested ones too: the one function here that needs Python."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

#: What a text must look like to become a value of a kind, and how it does.
_SHAPES = {
    "integer": (re.compile(r"[+-]?[0-9]+"), int),
    "number": (re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"), float),
    "boolean": (re.compile(r"(?i)true|false"), lambda text: text.lower() == "true"),
}


def compile_schema(schema) -> Callable:
    """A function that bends a value to the schema where that is certain: numbers in texts, flags, wrapped or comma-separated lists. Built once a schema."""
    kind = schema.get("type") if isinstance(schema, dict) else None
    if kind == "object":
        fields = {k: compile_schema(v) for k, v in (schema.get("properties") or {}).items()}
        return lambda value: {k: fields[k](v) if k in fields else v for k, v in value.items()} if isinstance(value, dict) else value
    if kind == "array":
        item = compile_schema(schema.get("items") or {})
        return lambda value: [item(v) for v in xs] if isinstance(xs := _as_list(value), list) else value
    if kind == "string":
        return lambda value: str(value) if type(value) in (int, float) else value
    if kind not in _SHAPES:
        return lambda value: value
    shape, make = _SHAPES[kind]
    return lambda value: make(value.strip()) if isinstance(value, str) and shape.fullmatch(value.strip()) else value


def _as_list(value):
    """A text cut at commas, or the list that an object wraps as its only value."""
    if isinstance(value, str):
        return [p.strip() for p in value.split(",") if p.strip()]
    wrapped = list(value.values()) if isinstance(value, dict) and len(value) == 1 else []
    return wrapped[0] if wrapped and isinstance(wrapped[0], list) else value


def coerce(value, schema):
    return compile_schema(schema)(value)


def coerce_json(schema: dict):
    """An Arrow-batched function of JSON texts; a text that is no JSON is returned as it is."""

    bend = compile_schema(schema)

    def one(text):
        try:
            return json.dumps(bend(json.loads(text)), ensure_ascii=False, sort_keys=True)
        except (TypeError, ValueError):
            return text

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run
