"""Memory, command, skill and instruction files: (path, content, mtime_ms) rows and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.patterns import parse_rule
from skein.functions.yaml import frontmatter_variant
from skein.functions.text import first_body_line, frontmatter, let, lines, run_mode, strip

#: Fixed value: folders that listings leave out.
SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "dist", "build")


def read_files(spark: SparkSession, root: str, glob: str = "*.md", recursive: bool = True) -> DataFrame:
    """(path, content, mtime_ms) of the files under a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    return found.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.unix_millis("modificationTime").alias("mtime_ms"))


def relative(path: Column, root: str) -> Column:
    """A path below root, whatever scheme either is written with."""
    bare = F.regexp_replace(path, r"\A[a-z0-9]+:/+", "/")
    return F.replace(bare, F.lit(root.rstrip("/").split(":", 1)[-1] + "/"), F.lit(""))


def listing(files: DataFrame, root: str) -> DataFrame:
    """Files outside skipped folders, newest first."""
    rel = relative(F.col("path"), root)
    skipped = F.exists(F.split(rel, "/"), lambda p: p.isin(*SKIPPED))
    return files.where(~skipped).orderBy(F.desc("mtime_ms"), "path")


def memory_headers(files: DataFrame, scope: str, index: str = "MEMORY.md", head_lines: int = 30, most: int = 200) -> DataFrame:
    """(path, scope, mtime_ms, name, description, type): only the first lines are looked at; the newest so many stay."""
    head = F.array_join(F.slice(lines(F.col("content")), 1, head_lines), "\n")
    base = F.element_at(F.split("path", "/"), -1)
    rows = files.where(base != index).withColumn("_head", head)
    name = frontmatter(F.col("_head"), "name")
    rows = rows.select("path", F.lit(scope).alias("scope"), "mtime_ms", F.when(name == "", F.regexp_replace(base, r"\.md\z", "")).otherwise(name).alias("name"), frontmatter(F.col("_head"), "description").alias("description"), frontmatter(F.col("_head"), "type").alias("type"))
    return rows.orderBy(F.desc("mtime_ms"), "path").limit(most)


def manifest_line(scope: Column, kind: Column, path: Column, mtime_ms: Column, description: Column) -> Column:
    """A header as a line: scope and type in brackets, path, time to the millisecond, description."""
    tag = lambda c, more="": F.when(c != "", F.concat(F.lit("["), c, F.lit(f"{more}] "))).otherwise("")
    stamp = F.concat(F.date_format(F.timestamp_millis(mtime_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return F.concat(F.lit("- "), tag(scope, "-scope"), tag(kind), path, F.lit(" ("), stamp, F.lit(")"), F.when(description != "", F.concat(F.lit(": "), description)).otherwise(""))


#: Types of memories; any other counts as a reference.
TYPES = ("user", "feedback", "project", "reference")


def memory_blocks(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, name, description, type, body) of blocks between ``---`` that name a memory; bodies are one line."""
    blocks = texts.select(key, F.posexplode(F.split(text, "---", -1)).alias("pos", "block"))
    field = lambda f: strip(F.regexp_extract("block", rf"MEMORY_{f}:([^\n]*)", 1))
    kind = F.lower(field("TYPE"))
    out = blocks.select(key, "pos", field("NAME").alias("name"), field("DESC").alias("description"), F.when(kind.isin(*TYPES), kind).otherwise("reference").alias("type"), field("BODY").alias("body"))
    return out.where((F.col("name") != "") & (F.col("body") != ""))


def index_upsert(index: DataFrame, new: DataFrame, key: str = "file") -> DataFrame:
    """Index lines with those of new files appended, each file once."""
    return index.unionByName(new.dropDuplicates([key]).join(index, key, "left_anti"))


def command_name(path: Column) -> Column:
    """``Sub Dir/My Cmd.md`` is ``sub-dir:my-cmd``."""
    return F.replace(F.replace(F.lower(F.regexp_replace(path, r"\.md\z", "")), F.lit("/"), F.lit(":")), F.lit(" "), F.lit("-"))


def skill_defs(files: DataFrame, root: str) -> DataFrame:
    """(name, description, mode, context, prompt) of skill files with a name; a folder's SKILL.md goes by the folder."""
    rel = relative(F.col("path"), root)
    stem = F.when(rel.endswith("/SKILL.md"), F.element_at(F.split(rel, "/"), -2)).otherwise(F.regexp_replace(F.element_at(F.split(rel, "/"), -1), r"\.md\z", ""))
    get = lambda f: frontmatter(F.col("content"), f)
    name = F.when(get("name") == "", stem).otherwise(get("name"))
    given = run_mode(get("mode"), F.when(get("context") != "", get("context")))
    mode = F.when(given["mode"] == "fork", "fork").otherwise("inline")
    context = F.when(given["context"].isin("full", "recent", "none"), given["context"]).otherwise("none")
    prompt = strip(F.regexp_replace("content", r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(\n|\z)", ""))
    return files.select(name.alias("name"), get("description").alias("description"), mode.alias("mode"), context.alias("context"), prompt.alias("prompt")).where(F.col("name").rlike(r"\A[a-z0-9][a-z0-9_-]*\z"))


def first_of_each_path(parts: DataFrame, path: str, seq: str) -> DataFrame:
    """Ordered union without a path's repeats."""
    return parts.withColumn("_n", F.row_number().over(W.partitionBy(path).orderBy(seq))).where("_n = 1").drop("_n")


#: Blanks that strip() takes off, and a line that includes a file, as patterns.
BLANK = r"[ \t\x0b\f\r]"
INCLUDE = rf"{BLANK}*@(?:\./|\.\./|~/|/)[^ \t\n]*{BLANK}*"


def include_parts(content: Column) -> Column:
    """Array of (line, target) that gives the text when put together: lines that include a file outside fences, and all text between them.

    The text is cut before each fence, and what lies outside of fences before each include: nothing is exploded by line.
    """
    none = F.lit(None).cast("string")
    part = lambda line, target=none: F.struct(line.alias("line"), target.alias("target"))

    def of(piece: Column) -> Column:
        rest = lambda line: F.array(part(line, F.substr(strip(line), F.lit(2))), part(F.substr(piece, F.length(line) + 1)))
        found = lambda line: F.when(line == "", F.array(part(piece))).otherwise(rest(line))
        return let(F.regexp_extract(piece, rf"\A({INCLUDE})(?=\n|\z)", 1), found)

    pieces = lambda chunk: F.flatten(F.transform(F.split(chunk, rf"(?dm)^(?={INCLUDE}$)", -1), of))
    first = F.when(content.rlike(rf"\A{BLANK}*```"), 1).otherwise(0)
    outside = lambda i: (i + first) % 2 == 0
    chunks = F.split(content, rf"(?dm)^(?={BLANK}*```)", -1)
    return F.flatten(F.transform(chunks, lambda c, i: F.when(outside(i), pieces(c)).otherwise(F.array(part(c)))))


def expand_includes(files: DataFrame, depth: int = 5, key: str = "file", content: str = "content") -> DataFrame:
    """(file, content) with lines ``@./other``, ``@../other``, ``@~/other`` or ``@/other`` replaced by a note and that file's lines.

    Files down to a depth are expanded (a root has depth 0), so what the last of them includes is still put in, as it is.

    Lines inside fences stay. An unknown file gives a note; the include of a file that this one came from stays a line.
    Each level is one join on the included name, of include lines only; a line's place is the list of its places on all levels.
    Texts join once, at the end, and files that include nothing stay where they are.
    """
    cut = files.where(F.col(content).isNotNull()).select(F.col(key).alias("name"), F.col(content).alias("text"), include_parts(F.col(content)).alias("parts"))
    numbered = F.transform("parts", lambda p, i: F.struct(i.alias("pos"), p["line"].alias("line"), p["target"].alias("target")))
    cut = cut.withColumn("parts", numbered)
    links = cut.select("name", F.filter("parts", lambda p: p["target"].isNotNull()).alias("links"))
    none = F.lit(None).cast("string")

    def row(at: Column, path: Column, line: Column, target: Column = none, body: Column = none) -> Column:
        return F.struct(at.alias("at"), path.alias("path"), line.alias("line"), target.alias("target"), body.alias("body"))

    def under(at: Column, path: Column) -> Column:
        return F.transform("links", lambda b: row(F.concat(at, F.array(b["pos"])), path, b["line"], b["target"]))

    top, own = F.array().cast("array<int>"), F.array("name")
    rows = links.where(F.size("links") > 0).select(F.col("name").alias("root"), F.explode(F.concat(F.array(row(top, own, F.lit(""), body=F.col("name"))), under(top, own))).alias("r")).select("root", "r.*")
    at, path, target = F.col("at"), F.col("path"), F.col("target")
    nowhere = F.concat(F.lit("\n"), F.col("root"))  # no file's name: spreads what has nothing to join
    for _ in range(depth + 1):
        known = links.select(F.col("name").alias("found"), "links")
        joined = rows.join(known, F.coalesce(target, nowhere) == F.col("found"), "left")
        loop = target.isNotNull() & F.array_contains("path", target)
        longer = F.concat(path, F.array(target))
        note = row(at, longer, F.concat(F.lit("<!-- included from "), target, F.lit(" -->\n")), body=target)
        missing = row(at, path, F.lit("<!-- @ skipped: file not found -->"))
        stays = row(at, path, F.col("line"), body=F.col("body"))
        new = F.when(target.isNull() | loop, F.array(stays)).when(F.col("found").isNull(), F.array(missing)).otherwise(F.concat(F.array(note), under(at, longer)))
        rows = joined.select("root", F.explode(new).alias("r")).select("root", "r.*")
    texts = cut.select(F.col("name").alias("found"), F.filter("parts", lambda p: p["target"].isNull()).alias("texts"))
    whole = rows.join(texts, F.coalesce("body", nowhere) == F.col("found"), "left")
    placed = lambda at, line: F.struct(at.alias("at"), line.alias("line"))
    below = F.coalesce(F.transform("texts", lambda t: placed(F.concat("at", F.array(t["pos"])), t["line"])), F.array().cast("array<struct<at:array<int>,line:string>>"))
    whole = whole.select("root", F.concat(F.array(placed(at, F.col("line"))), below).alias("l"))
    whole = whole.groupBy(F.col("root").alias(key)).agg(F.array_sort(F.flatten(F.collect_list("l"))).alias("l"))
    whole = whole.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "").alias(content))
    same = cut.where(~F.exists("parts", lambda p: p["target"].isNotNull())).select(F.col("name").alias(key), F.col("text").alias(content))
    return same.unionByName(whole)


EFFECTS = ("allow", "deny", "ask")


def yaml_scalar(c: Column) -> Column:
    """A YAML scalar without quotes, comment and blanks around."""
    bare = strip(c)
    double, single = bare.rlike(r'(?s)\A".*"\z'), bare.rlike(r"(?s)\A'.*'\z")
    inner = F.substr(bare, F.lit(2), F.length(bare) - 2)
    plain = strip(F.regexp_replace(bare, r"(\A| )#[^\n]*\z", ""))
    return F.when(double, F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))).when(single, F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(plain)


def rule_rows(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, seq, tool, pattern, effect) of files that are a list of entries ``rule: Tool(pattern)`` and ``effect:``; what is no such entry goes.

    Read is the flow of a flat list, as append_rule writes it: one ``- `` an entry, its fields on lines of their own, in any order.
    """
    entries = F.transform(F.split(F.concat(F.lit("\n"), F.col(content)), r"\n- ", -1), lambda e: F.concat(F.lit("\n"), e))
    rows = files.where(F.concat(F.lit("\n"), F.col(content)).contains("\n- ")).select(key, F.posexplode(entries).alias("seq", "entry")).where("seq > 0")
    field = lambda name: yaml_scalar(F.regexp_extract("entry", rf"\n[ \t]*{name}:[ \t]*([^\n]*)", 1))
    parsed = rows.select(key, (F.col("seq") - 1).alias("seq"), parse_rule(field("rule")).alias("r"), field("effect").alias("effect"))
    return parsed.where(F.col("r").isNotNull() & F.col("effect").isin(*EFFECTS)).select(key, "seq", F.col("r")["tool"].alias("tool"), F.col("r")["pattern"].alias("pattern"), "effect")


def append_rule(rules: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """(key, content): each file with its rules and the new ones (key, tool, pattern, effect) behind, as text that rule_rows reads."""
    every = rules.select(key, "seq", "tool", "pattern", "effect").union(new.select(key, F.lit(1 << 30).alias("seq"), "tool", "pattern", "effect"))
    quoted = F.concat(F.lit("'"), F.replace(F.concat("tool", F.lit("("), "pattern", F.lit(")")), F.lit("'"), F.lit("''")), F.lit("'"))
    line = F.concat(F.lit("- effect: "), "effect", F.lit("\n  rule: "), quoted, F.lit("\n"))
    texts = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return every.groupBy(key).agg(F.array_join(F.transform(texts, lambda s: s["line"]), "").alias("content"))


def strict_frontmatter(content: Column) -> Column:
    """Struct (fields, body) of a text that begins with a ``---`` block of flat YAML: a map of scalars, and of lists as their items joined by newlines.

    Null where the block is missing, not closed, or holds a line that is neither ``key: value``, an item of the key above, a comment nor blank.
    """
    text = F.ltrim(content, F.lit(" \t\n\x0b\x0c\r"))
    inside = F.regexp_extract(text, r"(?s)\A---(.*?)---(.*)\z", 1)
    body = F.regexp_replace(F.regexp_extract(text, r"(?s)\A---(.*?)---(.*)\z", 2), r"\A\n+", "")
    rows = F.filter(F.split(inside, "\n", -1), lambda x: ~x.rlike(r"\A[ \t\r]*(#.*)?\z"))
    is_key, is_item = lambda x: x.rlike(r"\A[A-Za-z_][A-Za-z0-9_-]*:([ \t].*)?\z"), lambda x: x.rlike(r"\A[ \t]*-[ \t]+\S")
    valid = F.forall(rows, lambda x: is_key(x) | is_item(x)) & F.coalesce(is_key(F.get(rows, F.lit(0))), F.lit(False))
    # each key with the items that follow it, as one piece
    pieces = F.split(F.array_join(F.transform(rows, lambda x: F.when(is_key(x), F.concat(F.lit("\x01"), x)).otherwise(x)), "\n"), "\x01", -1)
    items = lambda p: F.transform(F.filter(F.split(p, "\n", -1), is_item), lambda x: yaml_scalar(F.regexp_replace(x, r"\A[ \t]*-[ \t]+", "")))
    own = lambda p: F.regexp_extract(p, r"\A[^:]*:[ \t]*([^\n]*)", 1)
    flow = lambda v: F.array_join(F.transform(F.filter(F.split(F.regexp_extract(v, r"\A\[(.*)\][ \t]*\z", 1), ","), lambda x: strip(x) != ""), yaml_scalar), "\n")
    value = lambda p: F.when(F.size(items(p)) > 0, F.array_join(items(p), "\n")).when(own(p).rlike(r"\A\[.*\][ \t]*\z"), flow(own(p))).otherwise(yaml_scalar(own(p)))
    entries = F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.struct(F.regexp_extract(p, r"\A([^:]*):", 1).alias("k"), value(p).alias("v")))
    # of a repeated key the last value counts
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"]))
    return F.when(text.startswith("---") & text.rlike(r"(?s)\A---.*?---") & valid, F.struct(F.map_from_entries(last).alias("fields"), body.alias("body")))


#: Permission modes and isolations that a definition may name, and its turns where it names none.
PERMISSION_MODES, ISOLATIONS, TURNS = ("default", "acceptEdits", "bypassPermissions", ""), ("", "worktree"), 200


def definitions(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, meta, body, error) of files with a header: any YAML that functions.yaml reads, as a VARIANT; what it does not read has an error."""
    return files.select(path, frontmatter_variant(F.col(content)).alias("f")).select(path, "f.meta", "f.body", "f.error")


def _agents(files: DataFrame, path: str, content: str) -> DataFrame:
    """Definitions with the fields of an agent, and the first reason against it."""
    text = lambda name: strip(F.try_variant_get("meta", f"$.{name}", "string"))
    get = lambda name, default="": F.coalesce(text(name), F.lit(default))
    some = lambda name: F.filter(F.coalesce(F.try_variant_get("meta", f"$.{name}", "array<string>"), F.array(text(name))), lambda x: F.coalesce(x != "", F.lit(False)))
    given = F.try_variant_get("meta", "$.maxTurns", "string")
    turns = F.when(given.isNull(), TURNS).otherwise(given.try_cast("int"))
    model = F.when(F.lower(get("model", "inherit")) == "inherit", "inherit").otherwise(get("model", "inherit"))
    rows = definitions(files, path, content).withColumns({
        "name": text("name"), "description": text("description"), "tools": some("tools"), "disallowed": some("disallowedTools"), "model": model, "max_turns": turns,
        "permission_mode": get("permissionMode", "default"), "background": F.lower(get("background")) == "true", "_isolation": get("isolation"),
    })
    missing = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(missing("name"), "no name")
        .when(missing("description"), "no description")
        .when(~F.coalesce(F.col("max_turns") > 0, F.lit(False)), "maxTurns is no positive number")
        .when(~F.col("permission_mode").isin(*PERMISSION_MODES), "unknown permissionMode")
        .when(~F.col("_isolation").isin(*ISOLATIONS), "unknown isolation")
    )
    return rows.withColumn("error", reason)


def agent_defs(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, name, description, tools, disallowed, model, max_turns, permission_mode, background, prompt) of agent files.

    Those without a name or description, with an unknown mode or isolation, or with turns that are no positive number go; agent_errors says why.
    Includes in the prompt are expand_includes' part, before this.
    """
    fine = _agents(files, path, content).where(F.col("error").isNull())
    return fine.select(path, "name", "description", "tools", "disallowed", "model", "max_turns", "permission_mode", "background", F.col("body").alias("prompt"))


def agent_errors(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, error) of the files that are no agent."""
    return _agents(files, path, content).where(F.col("error").isNotNull()).select(path, "error")


def agent_hooks(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, seq, event, condition, type, command, once) of the hooks inside definitions: a row an entry of their list."""
    hooks = F.try_variant_get("meta", "$.hooks", "array<struct<event:string,condition:string,action:struct<type:string,command:string>,once:boolean>>")
    rows = definitions(files, path, content).select(path, F.posexplode(hooks).alias("seq", "h"))
    return rows.select(path, "seq", "h.event", "h.condition", "h.action.type", "h.action.command", F.coalesce("h.once", F.lit(False)).alias("once"))


def command_defs(files: DataFrame, root: str) -> DataFrame:
    """(name, description, template) of command files; a command is run by text.substitute with its arguments."""
    template = strip(F.regexp_replace("content", r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(\n|\z)", ""))
    described = frontmatter(F.col("content"), "description")
    return files.select(command_name(relative(F.col("path"), root)).alias("name"), F.when(described == "", first_body_line(template)).otherwise(described).alias("description"), template.alias("template"))


def complete_path(listing: DataFrame, typed: str, most: int = 10) -> DataFrame:
    """(shown) of the entries (folder, name, is_folder) of the folder typed whose name begins with what was typed behind the last ``/``, in any case.

    Folders end in ``/``; hidden names and skipped folders are left out; the first so many by name.
    """
    folder, _, prefix = typed.rpartition("/")
    fits = (F.col("folder") == folder) & ~F.col("name").isin(*SKIPPED) & ~F.col("name").startswith(".") & F.lower("name").startswith(prefix.lower())
    shown = F.concat(F.lit(f"{folder}/" if folder else ""), "name", F.when(F.col("is_folder"), "/").otherwise(""))
    return listing.where(fits).orderBy("name").limit(most).select(shown.alias("shown"))
