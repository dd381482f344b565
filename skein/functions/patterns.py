"""Globs, rules and conditions, compiled to columns once on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = re.compile(r"[A-Za-z0-9_ ]")


def glob_to_regex(glob: str) -> str:
    """An anchored regex for a shell glob: ``*`` also crosses ``/``, ``[!x]`` negates, an unclosed ``[`` is itself.

    Ends in ``\\z``, since ``\\Z`` and ``$`` let a last newline pass.
    """
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            close = glob.find("]", i + 1 + (glob[i : i + 1] == "!"))
            if close < 0:
                out.append(r"\[")
                continue
            body = glob[i:close]
            negated, body = (True, body[1:]) if body.startswith("!") else (False, body)
            body = re.sub(r"([\\\[\]^&~])", r"\\\1", body)
            out.append(f"[{'^' if negated else ''}{body}]")
            i = close + 1
        else:
            out.append(c if _PLAIN.match(c) else f"\\{c}" if ord(c) < 128 else c)
    return rf"(?s)\A{''.join(out)}\z"


def glob_match(value: Column, glob: str) -> Column:
    return value.rlike(glob_to_regex(glob))


def parse_rule(rule: Column) -> Column:
    """Struct (tool, pattern) of ``Tool(pattern)``, null for anything else."""
    shape = r"(?s)\A(\w+)\((.+)\)\z"
    text = F.trim(rule)
    return F.when(text.rlike(shape), F.struct(F.regexp_extract(text, shape, 1).alias("tool"), F.regexp_extract(text, shape, 2).alias("pattern")))


#: Fixed value: the argument by which each tool's calls are judged.
CONTENT_FIELDS = {
    "Bash": "command",
    "ReadFile": "file_path",
    "WriteFile": "file_path",
    "EditFile": "file_path",
    "Glob": "pattern",
    "Grep": "pattern",
}


def call_content(tool: Column, arguments: Column) -> Column:
    """What rules match of a call; empty for tools without such an argument."""
    out = F.lit("")
    for name, field in CONTENT_FIELDS.items():
        out = F.when(tool == name, F.coalesce(F.get_json_object(arguments, f"$.{field}"), F.lit(""))).otherwise(out)
    server, short = (F.coalesce(F.get_json_object(arguments, f"$.{k}"), F.lit("")) for k in ("server", "tool"))
    return F.when(tool == "mcp_call", canonical_tool(server, short)).otherwise(out)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def canonical_tool(server: Column, tool: Column) -> Column:
    """``server__tool`` from a server and either a short or an already canonical name."""
    short = F.regexp_extract(tool, r"(?s)\A(?:mcp__)?(?:.*?__)?(.*)\z", 1)
    owner = F.when(server != "", server).otherwise(F.regexp_extract(tool, r"(?s)\A(?:mcp__)?(.*?)__", 1))
    return F.when(owner == "", safe_name(short)).otherwise(F.concat(safe_name(owner), F.lit("__"), safe_name(short)))


class ConditionError(ValueError):
    pass


#: Fixed value: the order in which operators are looked for; the first found splits the text.
OPERATORS = ("==", "!=", "=~", "~=")


def field_value(name: str, tool: Column, event: Column, arguments: Column) -> Column:
    """A condition's field: ``tool``, ``event`` or ``args.KEY``; what is missing or falsy is empty."""
    if name == "tool":
        return F.coalesce(tool, F.lit(""))
    if name == "event":
        return F.coalesce(event, F.lit(""))
    if not name.startswith("args."):
        return F.lit("")
    value = F.coalesce(F.get_json_object(arguments, f"$['{name[5:]}']"), F.lit(""))
    return F.when(value.isin("0", "0.0", "false", "[]", "{}"), "").otherwise(value)


def compile_condition(text: str | None, tool: Column, event: Column, arguments: Column) -> Column:
    """A boolean column of a condition: parts joined by only ``&&`` or only ``||``; a regex that does not compile never holds."""
    if not text or not text.strip():
        return F.lit(True)
    if "&&" in text and "||" in text:
        raise ConditionError(f"mixed && and ||: {text}")
    out = None
    for part in re.split(r"&&|\|\|", text.strip()):
        test = _compile_part(part.strip(), tool, event, arguments)
        out = test if out is None else out | test if "||" in text else out & test
    return out


def _found(field: Column, pattern: str) -> Column:
    bare = re.fullmatch(r"(?s)/(.*)/", pattern)
    try:
        return field.rlike(re.compile(bare[1] if bare else pattern).pattern)
    except re.error:
        return F.lit(False)


TESTS = {"==": lambda field, value: field == value, "!=": lambda field, value: field != value, "=~": _found, "~=": glob_match}
#: An operator counts only if none of those before it stands further on.
_AN_OPERATOR = "|".join((f"(?!.*(?:{'|'.join(OPERATORS[:k])}))" if k else "") + op for k, op in enumerate(OPERATORS))
_PART = re.compile(rf"(?s)\s*(?P<field>.*?)\s*(?P<operator>{_AN_OPERATOR})\s*(?P<quote>\"(?=.*\"\s*\Z))?(?P<value>.*?)(?(quote)\")\s*")


def _compile_part(text: str, tool: Column, event: Column, arguments: Column) -> Column:
    part = _PART.fullmatch(text)
    if not part:
        raise ConditionError(f"no operator: {text}")
    return TESTS[part["operator"]](field_value(part["field"], tool, event, arguments), part["value"])
