"""Arguments typed at run time: a table function whose columns come from a JSON schema, given when it is called."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, StringType, StructType

#: Columns that every call has beside its own.
ERROR = "error"


def column_type(schema: dict) -> DataType:
    """The type of a JSON schema: objects with properties are structs, others maps of text; arrays are arrays of their items."""
    kind = schema.get("type")
    if isinstance(kind, list):  # nullable
        kind = next((k for k in kind if k != "null"), None)
    if kind == "object":
        fields = StructType()
        for name, inner in (schema.get("properties") or {}).items():
            fields = fields.add(name, column_type(inner))
        return fields if fields.fields else MapType(StringType(), StringType())
    if kind == "array":
        return ArrayType(column_type(schema.get("items") or {}))
    return {"integer": LongType(), "number": DoubleType(), "boolean": BooleanType()}.get(kind, StringType())


def table_type(schema: dict) -> StructType:
    """Columns of a schema's properties, and the error."""
    top = column_type({**schema, "type": "object"})
    out = StructType()
    for f in top.fields if isinstance(top, StructType) else []:
        if f.name.lower() == ERROR:
            raise ValueError(f"a parameter cannot be named {ERROR}")
        out = out.add(f.name, f.dataType)
    return out.add(ERROR, StringType())


class Mismatch(ValueError):
    pass


def as_type(value, schema: dict, at: str):
    """value as its schema wants it, or Mismatch with the place."""
    kind = schema.get("type")
    if isinstance(kind, list):
        kind = next((k for k in kind if k != "null"), None)
    if value is None:
        return None
    if kind == "object":
        if not isinstance(value, dict):
            raise Mismatch(f"{at or 'arguments'}: no object")
        inner = schema.get("properties") or {}
        missing = [k for k in schema.get("required") or () if value.get(k) is None]
        if missing:
            raise Mismatch(f"{at + '.' if at else ''}{missing[0]}: missing")
        if not inner:
            return {k: v if isinstance(v, str) else json.dumps(v) for k, v in value.items()}
        return tuple(as_type(value.get(k), s, f"{at}.{k}" if at else k) for k, s in inner.items())
    if kind == "array":
        if not isinstance(value, list):
            raise Mismatch(f"{at}: no array")
        return [as_type(v, schema.get("items") or {}, f"{at}[{k}]") for k, v in enumerate(value)]
    if kind == "integer":
        if isinstance(value, bool) or not isinstance(value, int) or not -(1 << 63) <= value < 1 << 63:
            raise Mismatch(f"{at}: no integer")
        return value
    if kind == "number":
        if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
            raise Mismatch(f"{at}: no number")
        return float(value)
    if kind == "boolean":
        if not isinstance(value, bool):
            raise Mismatch(f"{at}: no boolean")
        return value
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if schema.get("enum") and text not in schema["enum"]:
        raise Mismatch(f"{at}: not one of {', '.join(map(str, schema['enum']))}")
    return text


@udtf
class TypedArguments:
    """typed_arguments(arguments, schema): one row of the schema's columns for a call's JSON; nulls and an error where it does not fit."""

    @staticmethod
    def analyze(arguments: AnalyzeArgument, schema: AnalyzeArgument) -> AnalyzeResult:
        if not schema.isConstantExpression or schema.value is None:
            raise ValueError("the schema must be a constant text")
        return AnalyzeResult(table_type(json.loads(schema.value)))

    def __init__(self):
        self.known: tuple[str, dict] | None = None

    def eval(self, arguments: str, schema: str) -> Iterator[tuple]:
        if self.known is None or self.known[0] != schema:
            self.known = (schema, {**json.loads(schema), "type": "object"})
        want = self.known[1]
        width = len(want.get("properties") or {})
        try:
            value = json.loads(arguments) if arguments is not None else None
            if value is None:
                raise Mismatch("arguments: missing")
            row = as_type(value, want, "")
            yield (*(row if width else ()), None)
        except ValueError as wrong:
            yield (*(None,) * width, str(wrong) if isinstance(wrong, Mismatch) else "arguments: no JSON")


def register(spark: SparkSession, name: str = "typed_arguments") -> None:
    """Makes the table function known to SQL: ``SELECT ... FROM calls, LATERAL typed_arguments(calls.arguments, '{...}')``."""
    spark.udtf.register(name, TypedArguments)
