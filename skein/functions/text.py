"""Scalar functions over message, memory and file texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
CHARS_PER_TOKEN, SCHEMA_CHARS_PER_TOKEN = 3.5, 2.5


def let(value: Column, body) -> Column:
    """body(value) with value computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def approx_tokens(chars: Column, per: float = CHARS_PER_TOKEN) -> Column:
    """Whole tokens of a number of characters. Floor the sum, not the parts, for an estimate of a set."""
    return F.floor(chars / F.lit(per)).cast("long")


def cut_tokens(c: Column, tokens: int) -> Column:
    return F.left(c, F.lit(int(tokens * CHARS_PER_TOKEN)))


def first_line(c: Column) -> Column:
    """The first line that is not blank, stripped; else empty."""
    return F.coalesce(F.get(F.filter(F.transform(lines(c), strip), lambda x: x != ""), F.lit(0)), F.lit(""))


def first_body_line(c: Column) -> Column:
    """The first line that is neither blank nor a heading."""
    return F.coalesce(F.get(F.filter(F.transform(lines(c), strip), lambda x: (x != "") & ~x.startswith("#")), F.lit(0)), F.lit(""))


def frontmatter(c: Column, field: str) -> Column:
    """A field of the leading ``---`` block, unquoted; empty without block or field."""
    block = F.regexp_extract(c, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    value = strip(F.regexp_extract(F.concat(F.lit("\n"), block), rf"\n{field}:([^\n]*)", 1))
    quoted = value.rlike(r"(?s)\A(\".*\"|'.*')\z") & (F.length(value) > 1)
    return F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def json_object(c: Column) -> Column:
    """From the first ``{`` to the last ``}`` of a text; one that begins with ``{`` stays whole."""
    text = strip(c)
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    found = F.when((start > 0) & F.contains(text, F.lit("}")) & (end > start), F.substr(text, start, end - start + 1)).otherwise("")
    return F.when(text.startswith("{"), text).otherwise(found)


def tagged(c: Column, tag: str = "summary") -> Column:
    """What stands between a tag's first opening and the next closing; without them the whole text. Stripped."""
    start = F.instr(c, f"<{tag}>")
    rest = F.substr(c, start + len(tag) + 2)
    stop = F.instr(rest, f"</{tag}>")
    return strip(F.when((start > 0) & (stop > 0), F.substr(rest, F.lit(1), stop - 1)).otherwise(c))


def occurrences(c: Column, part: str) -> Column:
    """How often part stands in a text, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("long")


def replace_once(c: Column, old: str, new: str) -> Column:
    """Struct (text, error): old must stand in the text exactly once."""
    n = occurrences(c, old)
    error = F.when(n == 0, "not found").when(n > 1, "not unique")
    return F.struct(F.when(n == 1, F.replace(c, F.lit(old), F.lit(new))).otherwise(c).alias("text"), error.alias("error"))


def read_slice(c: Column, offset: int, limit: int) -> Column:
    """Lines offset .. offset + limit - 1 (from 0), numbered from 1."""
    part = F.transform(F.slice(lines(c), offset + 1, limit), lambda x, i: F.concat((i + offset + 1).cast("string"), F.lit("\t"), x))
    return F.array_join(part, "\n")


def common_ends(a: Column, b: Column) -> Column:
    """Struct (prefix, suffix): equal lines at both ends of two line arrays; none counts twice."""
    n = F.least(F.size(a), F.size(b))

    def run(x: Column, y: Column, most: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.lit(False))
        return F.least(most, F.when(differs == 0, most).otherwise(differs - 1).cast("int"))

    prefix = run(a, b, n)
    return let(prefix, lambda k: F.struct(k.alias("prefix"), run(F.reverse(a), F.reverse(b), n - k).alias("suffix")))


def line_diff(old: Column, new: Column, context: int = 3, most: int = 200) -> Column:
    """Struct (additions, removals, text): the lines between the common ends, with context and numbers, at most so many."""

    def of(both: Column) -> Column:
        a, b = both["a"], both["b"]

        def shown(ends: Column) -> Column:
            p, s = ends["prefix"], ends["suffix"]
            gone, come = F.size(a) - p - s, F.size(b) - p - s
            at = F.greatest(F.lit(0), p - context)
            line = lambda sign, first: lambda x, i: F.concat(F.lit(f"{sign} "), F.lpad((first + i + 1).cast("string"), 4, " "), F.lit("  "), x)
            every = F.concat(
                F.transform(F.slice(a, at + 1, p - at), line(" ", at)),
                F.transform(F.slice(a, p + 1, gone), line("-", p)),
                F.transform(F.slice(b, p + 1, come), line("+", p)),
                F.transform(F.slice(a, p + gone + 1, F.least(F.lit(context), s)), line(" ", p + gone)),
            )
            cut = F.when(F.size(every) > most, F.concat(F.slice(every, 1, most), F.array(F.lit(f"  … (diff truncated at {most} lines)")))).otherwise(every)
            return F.struct(come.cast("long").alias("additions"), gone.cast("long").alias("removals"), F.array_join(cut, "\n").alias("text"))

        return let(common_ends(a, b), shown)

    return let(F.struct(lines(old).alias("a"), lines(new).alias("b")), of)


def cut_bytes(c: Column, limit: int) -> Column:
    """The longest start of a text of at most so many bytes: a split last character goes."""
    head = F.substring(c.cast("binary"), 1, limit)
    whole = F.make_valid_utf8(head.cast("string"))
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.rtrim(whole, F.lit("�")))


def truncate_index(c: Column, max_lines: int = 200, max_bytes: int = 25_000) -> Column:
    """At most so many lines, then at most so many bytes, cut at the last newline if there is one."""

    def by_bytes(text: Column) -> Column:
        head = F.substring(text.cast("binary"), 1, max_bytes)
        valid = F.rtrim(F.make_valid_utf8(head.cast("string")), F.lit("�"))
        at = F.length(valid) - F.instr(F.reverse(valid), "\n")
        whole = F.contains(valid, F.lit("\n")) & (at > 0)
        return F.when(F.octet_length(text) <= max_bytes, text).when(whole, F.left(valid, at)).otherwise(valid)

    return let(F.array_join(F.slice(lines(strip(c)), 1, max_lines), "\n"), by_bytes)


def coerce_scalar(value: Column, want: Column) -> Column:
    """Struct (kind, text): a string argument as its schema wants it, where its shape allows; else a string still."""
    text = strip(value)
    integer, number = r"\A[+-]?[0-9]+\z", r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
    kept = F.struct(F.lit("string").alias("kind"), value.alias("text"))
    of = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))
    return (
        F.when((want == "integer") & text.rlike(integer) & text.try_cast("long").isNotNull(), of("integer", text.try_cast("long").cast("string")))
        .when((want == "number") & text.rlike(number), of("number", text.try_cast("double").cast("string")))
        .when((want == "boolean") & F.lower(text).isin("true", "false"), of("boolean", F.lower(text)))
        .otherwise(kept)
    )


def age_days(mtime_ms: Column, now_ms: Column) -> Column:
    return F.greatest(F.floor((now_ms - mtime_ms) / 86_400_000), F.lit(0)).cast("long")


def age_label(days: Column) -> Column:
    return F.when(days == 0, "today").when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def parse_command(c: Column) -> Column:
    """Struct (name, args) of ``/name args``, name in lower case; null for other texts."""
    text = strip(c)
    shape = r"(?s)\A/(\S+)\s*(.*)\z"
    return F.when(text.rlike(shape), F.struct(F.lower(F.regexp_extract(text, shape, 1)).alias("name"), strip(F.regexp_extract(text, shape, 2)).alias("args")))


def substitute(template: Column, arguments: Column) -> Column:
    """``$ARGUMENTS`` replaced; where there is none, non-empty arguments are appended."""
    has = F.contains(template, F.lit("$ARGUMENTS"))
    return F.when(has, F.replace(template, F.lit("$ARGUMENTS"), arguments)).when(strip(arguments) != "", F.concat(template, F.lit("\n\n"), arguments)).otherwise(template)


def expand_variables(template: Column, values: dict[str, Column]) -> Column:
    """``$NAME`` replaced in the order given."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"${name}"), F.coalesce(value, F.lit("")))
    return template


def subcommands(c: Column) -> Column:
    """A shell line cut at ``&&``, ``||``, ``;`` and ``|``; blank parts go."""
    return F.filter(F.transform(F.split(c, r"&&|\|\||[;|]"), strip), lambda x: x != "")


def size_label(n: Column) -> Column:
    """Bytes as B, KB or MB with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024.0), F.lit("KB"))).otherwise(F.concat(F.format_string("%.1f", n / 1048576.0), F.lit("MB")))


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals, halves to even."""
    return F.format_string(f"%.{digits}f", F.bround(c.cast("double"), digits))


def relative_time(seconds: Column) -> Column:
    unit = lambda n, name: F.concat(F.floor(seconds / n).cast("string"), F.lit(f" {name} ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, unit(60, "min")).when(seconds < 86_400, unit(3600, "hours")).otherwise(unit(86_400, "days"))


def elapsed(seconds: Column) -> Column:
    return F.when(seconds >= 60, F.concat(fixed(seconds / 60, 1), F.lit("m"))).otherwise(F.concat(fixed(seconds, 0), F.lit("s")))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, cut; 0 of nothing."""
    return F.when(whole > 0, F.floor(100 * part / whole)).otherwise(0).cast("int")


def repository_path(url: Column) -> Column:
    """Struct (owner, repo, ref, subpath, name) of a URL to a folder of a repository, by its host's form; null for other URLs."""
    text = strip(url)
    host = F.lower(F.regexp_extract(text, r"\Ahttps?://([^/:?#]+)", 1))
    parts = F.filter(F.split(F.regexp_extract(text, r"\Ahttps?://[^/?#]+([^?#]*)", 1), "/"), lambda p: p != "")

    def of(ps: Column) -> Column:
        last = F.element_at(ps, -1)
        row = lambda ref, sub: F.struct(ps[0].alias("owner"), ps[1].alias("repo"), ref.alias("ref"), F.array_join(sub, "/").alias("subpath"), F.element_at(sub, -1).alias("name"))
        rest = lambda n: F.slice(ps, n + 1, F.greatest(F.size(ps) - n, F.lit(0)))
        raw = F.when(F.contains(last, F.lit(".")), F.slice(ps, 4, F.greatest(F.size(ps) - 4, F.lit(0)))).otherwise(rest(3))
        return (
            F.when(host.isin("skills.sh", "www.skills.sh") & (F.size(ps) >= 3), row(F.lit("main"), F.concat(F.array(F.lit("skills")), rest(2))))
            .when((host == "github.com") & (F.size(ps) >= 5) & (F.get(ps, F.lit(2)) == "tree"), row(ps[3], rest(4)))
            .when((host == "raw.githubusercontent.com") & (F.size(ps) >= 4) & (F.size(raw) > 0), row(ps[2], raw))
        )

    return let(parts, of)


def is_name(c: Column, most: int = 64) -> Column:
    """Lower-case letters, digits, ``_`` and ``-``, a letter or digit first."""
    return c.rlike(r"\A[a-z0-9][a-z0-9_-]*\z") & (F.length(c) <= most)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def expand_env(template: Column, values: dict[str, str]) -> Column:
    """``${NAME}`` replaced where NAME is known, else left; what is put in is not looked at again."""
    known = F.create_map(*(F.lit(x) for pair in values.items() for x in pair)) if values else F.create_map().cast("map<string,string>")
    name = lambda part: F.regexp_extract(part, r"(?s)\A\$\{([^}]+)\}", 1)
    put = lambda part: F.when(F.map_contains_key(known, name(part)), F.concat(known[name(part)], F.substr(part, F.length(name(part)) + 4))).otherwise(part)
    return F.array_join(F.transform(F.split(template, r"(?=\$\{[^}]+\})", -1), put), "")


def uncached(tokens: Column, cached: Column) -> Column:
    """Input tokens that were not read from a cache, 0 at least; unknown counts are 0."""
    return F.greatest(F.coalesce(tokens, F.lit(0)) - F.coalesce(cached, F.lit(0)), F.lit(0))


def flatten_content(blocks: Column) -> Column:
    """A tool's output, an array of (type, text, mime, uri), as one text."""
    one = lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "image", F.concat(F.lit("[image: "), b["mime"], F.lit("]"))).when(b["type"] == "resource", F.coalesce(b["text"], F.concat(F.lit("[binary resource: "), b["uri"], F.lit("]"))))
    parts = F.filter(F.transform(blocks, one), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise("(no output)")


#: Column types of the types of a JSON schema; any other is text.
SQL_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "object": "map<string,string>", "array": "array<string>"}


def sql_type(json_type: Column) -> Column:
    out = F.lit("string")
    for name, kind in SQL_TYPES.items():
        out = F.when(json_type == name, kind).otherwise(out)
    return out


def run_mode(mode: Column, context: Column) -> Column:
    """Struct (mode, context) of a skill: a context of fork means the mode, which is inline if nothing else is said."""
    fork = context.eqNullSafe("fork")
    given = F.when(mode != "", mode)
    return F.struct(F.coalesce(given, F.when(fork, "fork"), F.lit("inline")).alias("mode"), F.when(fork, "full").otherwise(F.coalesce(context, F.lit("full"))).alias("context"))
