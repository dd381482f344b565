"""Functions by name: columns that take typed arguments from JSON, called directly or by a column that names them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import SQL_TYPES


def ddl(schema: dict) -> str:
    """The column type of a JSON schema: objects with properties are structs, arrays with items arrays of their type."""
    kind = schema.get("type")
    if kind == "object" and schema.get("properties"):
        return "struct<" + ",".join(f"`{k}`:{ddl(v)}" for k, v in schema["properties"].items()) + ">"
    if kind == "array" and schema.get("items"):
        return f"array<{ddl(schema['items'])}>"
    return SQL_TYPES.get(kind, "string")


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: dict
    run: Callable[[Column], Column]

    def call(self, arguments: Column) -> Column:
        """Of arguments as JSON: run gets them as a struct; null where a required one is missing or the text is no JSON."""
        given = F.from_json(arguments, ddl(self.parameters))
        missing = F.lit(False)
        for name in self.parameters.get("required", ()):
            missing = missing | given[name].isNull()
        return F.when(given.isNotNull() & ~missing, self.run(given))


@dataclass
class Registry:
    tools: dict[str, Tool] = field(default_factory=dict)

    def register(self, name: str, description: str, parameters: dict):
        """A decorator of functions from a struct of arguments to a text column."""

        def add(run: Callable[[Column], Column]) -> Callable[[Column], Column]:
            self.tools[name] = Tool(name, description, parameters, run)
            return run

        return add

    def dispatch(self, name: Column, arguments: Column) -> Column:
        """Struct (output, error): the call of the tool that name names; a branch a tool, so a row pays for its own only."""
        output, error = F.lit(None).cast("string"), F.concat(F.lit("unknown tool: "), name)
        for tool in self.tools.values():
            result = tool.call(arguments)
            output = F.when(name == tool.name, result).otherwise(output)
            error = F.when(name == tool.name, F.when(result.isNull(), F.lit(f"bad arguments of {tool.name}"))).otherwise(error)
        return F.struct(output.alias("output"), error.alias("error"))
