"""YAML headers as JSON and VARIANT, by column expressions.

Lines are first put together where a block text (``|`` or ``>``) or a comment asks for it, then become tokens: an item, an entry of a map or a bare value, each
with its column. One fold over the tokens writes JSON text; its state is the text so far, the stack of open containers with their columns, and whether a value is still due. Values are plain,
quoted, flow lists and maps of any depth, or block texts; numbers, truth values and nulls are told from text as the usual safe loader does.

Not read, and reported as an error: anchors, aliases, tags, several documents, keys that are no text, plain texts over several lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import let

_QUOTED = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'"
#: A key and what is behind it.
_ENTRY = rf"(?s)\A({_QUOTED}|[^\s\"'\[\]{{}},#&*!|>%@`-][^:]*?|-[^\s:][^:]*?)[ \t]*:(?:[ \t]+(.*)|)\z"
_FLOW = rf"{_QUOTED}|[\[\]{{}},]|:(?=[\s,\[\]{{}}]|\z)|(?:[^\[\]{{}},:\"'\s]|:(?![\s,\[\]{{}}]|\z))(?:[^\[\]{{}},:]|:(?![\s,\[\]{{}}]|\z))*"
_INT, _FLOAT = r"\A[-+]?(?:0|[1-9][0-9_]*)\z", r"\A[-+]?(?:[0-9][0-9_]*\.[0-9_]*|\.[0-9][0-9_]*)(?:[eE][-+][0-9]+)?\z"


def json_text(c: Column) -> Column:
    """A string as JSON writes it."""
    whole = F.to_json(F.array(c))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def _plain(v: Column) -> Column:
    number = F.regexp_replace(F.regexp_replace(v, "_", ""), r"\A\+", "")
    return (
        F.when(v.isin("", "~", "null", "Null", "NULL"), "null")
        .when(F.lower(v).isin("true", "yes", "on"), "true")
        .when(F.lower(v).isin("false", "no", "off"), "false")
        .when(v.rlike(_INT), number)
        .when(v.rlike(_FLOAT), F.coalesce(number.try_cast("double").cast("string"), json_text(v)))
        .otherwise(json_text(v))
    )


def _scalar(v: Column, as_text: Column | None = None) -> Column:
    """A quoted or plain value as JSON; a double-quoted one is JSON already."""
    double = v.startswith('"')
    single = json_text(F.replace(F.substr(v, F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'")))
    plain = _plain(v) if as_text is None else F.when(as_text, json_text(v)).otherwise(_plain(v))
    return F.when(double, v).when(v.startswith("'"), single).otherwise(plain)


def _flow(v: Column) -> Column:
    signs = ("[", "]", "{", "}", ",", ":")

    def write(ts: Column) -> Column:
        one = lambda t, i: F.when(t.isin(*signs), t).otherwise(_scalar(t, F.coalesce(F.get(ts, i + 1) == ":", F.lit(False))))
        return F.array_join(F.transform(ts, one), "")

    return let(F.transform(F.regexp_extract_all(v, F.lit(_FLOW), F.lit(0)), lambda t: F.rtrim(t)), write)


def _value(v: Column) -> Column:
    """What stands behind a key or dash, as JSON; null if nothing does, so that lines below may."""
    bare = F.trim(v)
    quoted = F.regexp_extract(bare, rf"(?s)\A({_QUOTED})[ \t]*(?:#.*)?\z", 1)
    plain = F.rtrim(F.regexp_replace(bare, r"(?:\A|[ \t]+)#.*\z", ""))
    return F.when(quoted != "", _scalar(quoted)).when(bare.rlike(r"\A[\[{]"), _flow(F.regexp_replace(bare, r"[ \t]+#[^\"'\]}]*\z", ""))).when(plain != "", _plain(plain))


def _block(text: Column, sign: Column) -> Column:
    """The lines of a block text without their common indent; folded ones joined by spaces; one newline at the end, or none with ``-``."""
    rows = F.slice(F.split(text, "\n", -1), 2, F.size(F.split(text, "\n", -1)))
    first = F.coalesce(F.get(F.filter(rows, lambda x: F.trim(x) != ""), F.lit(0)), F.lit(""))
    indent = F.length(first) - F.length(F.ltrim(first))
    bare = F.rtrim(F.array_join(F.transform(rows, lambda x: F.coalesce(F.substr(x, indent + 1), F.lit(""))), "\n"), F.lit("\n"))
    folded = F.regexp_replace(F.regexp_replace(bare, r"(?<!\n)\n(?!\n)", " "), r"\n(\n+)", "$1")
    body = F.when(sign.startswith(">"), folded).otherwise(bare)
    return json_text(F.when((body == "") | sign.contains("-"), body).otherwise(F.concat(body, F.lit("\n"))))


_LINE = "struct<at:int,text:string,block:string,within:int>"


def _lines(text: Column) -> Column:
    """Lines that say something, each with its column, and the lines of the block text that it opens (null where none)."""
    blank_line = F.lit(None).cast(_LINE)
    start = F.struct(F.array().cast(f"array<{_LINE}>").alias("done"), blank_line.alias("now"))

    def step(acc: Column, raw: Column) -> Column:
        line = F.rtrim(raw, F.lit(" \t\r"))
        bare = F.ltrim(line, F.lit(" "))
        at = F.length(line) - F.length(bare)
        # a block text belongs to the key behind the dashes, or to the last dash, not to the line's first column
        dashes = F.regexp_extract(bare, r"\A((?:-[ ]+)*)", 1)
        owner = F.when(bare.rlike(r"\A(?:-[ ]+)*[|>][+-]?\z"), F.regexp_replace(dashes, r"-[ ]+\z", "")).otherwise(dashes)
        opens = bare.rlike(r"(?:\A|[:-][ \t]+)[|>][+-]?\z")
        now = acc["now"]
        within = F.coalesce(now["block"].isNotNull() & ((bare == "") | (at > now["within"])), F.lit(False))
        longer = F.struct(now["at"].alias("at"), now["text"].alias("text"), F.concat(now["block"], F.lit("\n"), line).alias("block"), now["within"].alias("within"))
        fresh = F.struct(at.alias("at"), bare.alias("text"), F.when(opens, "").alias("block"), (at + F.length(owner)).alias("within"))
        kept = F.when(now.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(now)))
        return (
            F.when(within, F.struct(acc["done"].alias("done"), longer.alias("now")))
            .when((bare == "") | bare.startswith("#"), acc)
            .otherwise(F.struct(kept.alias("done"), fresh.alias("now")))
        )

    return F.aggregate(F.split(text, "\n", -1), start, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


_TOKEN = "struct<at:int,kind:string,key:string,value:string>"


def _tokens(line: Column) -> Column:
    """A line as tokens: each dash an item, then an entry or a value."""
    text = line["text"]
    dashes = F.regexp_extract(text, r"\A((?:-(?:[ ]+|\z))*)", 1)
    parts = F.regexp_extract_all(dashes, F.lit(r"-[ ]*"), F.lit(0))
    token = lambda at, kind, key, value: F.struct(at.cast("int").alias("at"), F.lit(kind).alias("kind"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    items = F.transform(parts, lambda p, i: token(line["at"] + F.length(F.array_join(F.slice(parts, F.lit(1), i), "")), "seq", F.lit(None), F.lit(None)))
    rest, column = F.substr(text, F.length(dashes) + 1), line["at"] + F.length(dashes)
    name = F.regexp_extract(rest, _ENTRY, 1)
    key = F.when(name.rlike(r"\A[\"']"), _scalar(name)).otherwise(json_text(name))
    sign = F.regexp_extract(rest, r"([|>][+-]?)\z", 1)
    block = _block(line["block"], sign)
    entry = token(column, "map", key, F.when(line["block"].isNotNull(), block).otherwise(_value(F.regexp_extract(rest, _ENTRY, 2))))
    alone = token(column, "value", F.lit(None), F.when(line["block"].isNotNull(), block).otherwise(_value(rest)))
    tail = F.when(rest == "", F.array().cast(f"array<{_TOKEN}>")).when(name != "", F.array(entry)).otherwise(F.array(alone))
    return F.concat(items.cast(f"array<{_TOKEN}>"), tail.cast(f"array<{_TOKEN}>"))


_OPEN = "struct<at:int,kind:string>"


def _closers(containers: Column) -> Column:
    return F.array_join(F.transform(F.reverse(containers), lambda s: F.when(s["kind"] == "map", "}").otherwise("]")), "")


def _put(acc: Column, token: Column) -> Column:
    """The fold's step: containers that the token's column ends are closed, one that it begins is opened."""
    at, kind, stack, due = token["at"], token["kind"], acc["stack"], acc["due"]
    fits = lambda s: (s["at"] < at) | ((s["at"] == at) & ((s["kind"] == kind) | ((s["kind"] == "map") & (kind == "seq") & due)))
    height = F.coalesce(F.array_max(F.transform(stack, lambda s, i: F.when(fits(s), i + 1).otherwise(0))), F.lit(0))
    kept, ended = F.slice(stack, F.lit(1), height), F.slice(stack, height + 1, F.size(stack))
    top = F.get(kept, height - 1)
    opens = (height == 0) | (top["at"] < at) | (top["kind"] != kind)
    closing = F.when(F.size(ended) > 0, F.concat(F.when(due, "null").otherwise(""), _closers(ended))).otherwise("")
    still_due = due & (F.size(ended) == 0)
    comma = F.concat(F.when(still_due, "null").otherwise(""), F.lit(","))
    begin = F.when(opens, F.when(kind == "map", "{").otherwise("[")).otherwise(comma)
    written = F.concat(acc["out"], closing, begin, F.when(kind == "map", F.concat(token["key"], F.lit(":"), F.coalesce(token["value"], F.lit("")))).otherwise(""))
    wrong = F.when(opens & ~still_due, F.concat(F.lit("unexpected indent at column "), at.cast("string")))
    state = lambda out, stack, due, error: F.struct(out.alias("out"), stack.alias("stack"), due.alias("due"), F.coalesce(acc["error"], error).alias("error"))
    grown = F.when(opens, F.concat(kept, F.array(F.struct(at.alias("at"), kind.alias("kind"))))).otherwise(kept)
    none = F.lit(None).cast("string")
    value = state(F.concat(acc["out"], F.coalesce(token["value"], F.lit("null"))), stack, F.lit(False), F.when(~due, F.lit("a value without a key")))
    return F.when(acc["error"].isNotNull(), state(acc["out"], stack, due, none)).when(kind == "value", value).otherwise(state(written, grown, (kind == "seq") | token["value"].isNull(), wrong))


def yaml_json(text: Column) -> Column:
    """Struct (json, error) of a YAML text: JSON, or what could not be read. An empty text is null."""
    start = F.struct(F.lit("").alias("out"), F.array().cast(f"array<{_OPEN}>").alias("stack"), F.lit(True).alias("due"), F.lit(None).cast("string").alias("error"))
    finish = lambda acc: F.struct(F.concat(acc["out"], F.when(acc["due"], "null").otherwise(""), _closers(acc["stack"])).alias("json"), acc["error"].alias("error"))

    def read(lines: Column) -> Column:
        odd = F.exists(lines, lambda x: x["text"].rlike(r"\A(?:-[ ]+)*(?:[^\"'#]*:[ \t]+)?[&*!]\S") | x["text"].rlike(r"\A(---|\.\.\.)") | x["text"].startswith("\t"))
        done = F.aggregate(F.flatten(F.transform(lines, _tokens)), start, _put, finish)
        return let(done, lambda d: F.struct(F.when(~odd & d["error"].isNull(), d["json"]).alias("json"), F.when(odd, "anchors, tags, tabs and several documents are not read").otherwise(d["error"]).alias("error")))

    def checked(r: Column) -> Column:
        broken = r["json"].isNotNull() & F.try_parse_json(r["json"]).isNull()
        return F.struct(F.when(~broken, r["json"]).alias("json"), F.when(broken, "no value could be made of it").otherwise(r["error"]).alias("error"))

    return F.when(text.isNotNull(), let(let(_lines(text), read), checked))


def frontmatter_variant(content: Column) -> Column:
    """Struct (meta, body, error) of a text that begins with a ``---`` block: its YAML as a VARIANT, what follows, and why there is none."""
    text = F.ltrim(content, F.lit(" \t\n\x0b\x0c\r"))
    closed = F.regexp_like(text, F.lit(r"(?s)\A---[ \t\r]*\n(?:.*?\n)??---[ \t\r]*(?:\n|\z)"))
    head = F.regexp_extract(text, r"(?s)\A---[ \t\r]*\n((?:.*?\n)??)---[ \t\r]*(?:\n|\z)", 1)
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)\A---[ \t\r]*\n(?:.*?\n)??---[ \t\r]*(?:\n|\z)", ""), r"\A\n+", "")
    made = lambda r: F.struct(F.when(closed, F.try_parse_json(r["json"])).alias("meta"), F.when(closed, body).otherwise(content).alias("body"), F.when(~closed, "no closed header").otherwise(r["error"]).alias("error"))
    return let(yaml_json(F.when(closed, head).otherwise("")), made)
