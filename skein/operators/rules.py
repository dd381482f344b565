"""Permission rules, command checks and hooks.

Rules are small dimensions that come as Python rows and are compiled into the plan: a call's verdict is
worked out where the call stands, with no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.patterns import compile_condition, glob_match
from skein.functions.text import strip, subcommands

SEVERITY = {"allow": 1, "ask": 2, "deny": 3}


def _worst(levels: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, n in SEVERITY.items():
        out = F.when(levels == n, name).otherwise(out)
    return out


def evaluate_rules(tool: Column, content: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The strictest effect of the rules (tool, glob, effect) that fit, in any order; null if none does."""
    level = F.lit(0)
    for name, glob, effect in rules:
        level = F.greatest(level, F.when((tool == name) & glob_match(content, glob), SEVERITY[effect]).otherwise(0))
    return _worst(level)


def evaluate_subcommands(tool: Column, line: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Of all parts of a command line: any deny, else any ask, else allow, also where no rule fits."""
    effects = F.transform(F.when(F.size(subcommands(line)) > 0, subcommands(line)).otherwise(F.array(line)), lambda c: evaluate_rules(tool, c, rules))
    return F.when(F.exists(effects, lambda e: e.eqNullSafe("deny")), "deny").when(F.exists(effects, lambda e: e.eqNullSafe("ask")), "ask").otherwise("allow")


#: Patterns of dangerous commands, in order, with our names for them.
DANGEROUS = [
    (r"rm\s+-[a-z]*r[a-z]*f[a-z]*\s+/\s*$", "recursive delete of the root"),
    (r"mkfs\.", "formats a disk"),
    (r"dd\s+if=.*of=/dev/", "writes to a device"),
    (r"chmod\s+-R\s+777\s+/", "opens the root to all"),
    (r":\(\)\{\s*:\|:&\s*\};:", "fork bomb"),
    (r"curl\s+.*\|\s*(ba)?sh", "runs a remote script"),
    (r"wget\s+.*\|\s*(ba)?sh", "runs a remote script"),
    (r">\s*/dev/sd", "overwrites a disk"),
]

#: Commands that only read, by name.
SAFE = (
    "awk", "basename", "cal", "cargo --version", "cat", "comm", "cut", "date", "df", "diff", "dir", "dirname", "du", "echo", "egrep", "env", "false",
    "fgrep", "file", "find", "free", "git blame", "git branch", "git diff", "git log", "git ls-files", "git remote", "git rev-parse", "git show",
    "git stash list", "git status", "git tag", "go env", "go version", "grep", "head", "hostname", "java --version", "java -version", "ls", "node -v",
    "npm -v", "npx", "pip list", "printenv", "pwd", "python --version", "readlink", "realpath", "rustc --version", "sed", "sort", "stat", "tail",
    "tee", "test", "tr", "true", "uname", "uniq", "uptime", "wc", "whereis", "which", "whoami", "xargs",
)
#: Signs that make any command unsafe.
UNSAFE_SIGNS = ("|", ";", "&&", ">", "$(", "`")


def danger(command: Column, extra: list[tuple[str, str]] = ()) -> Column:
    """The reason of the first pattern found, else null."""
    return F.coalesce(*(F.when(command.rlike(p), reason) for p, reason in [*DANGEROUS, *extra]))


def is_safe(command: Column) -> Column:
    text = strip(command)
    signs = F.lit(False)
    for s in UNSAFE_SIGNS:
        signs = signs | F.contains(text, F.lit(s))
    known = F.exists(F.array(*map(F.lit, SAFE)), lambda s: (text == s) | text.startswith(F.concat(s, F.lit(" "))))
    return (text != "") & ~signs & known


#: What a mode does with each category of tools.
MODES = {
    "default": {"read": "allow", "write": "ask", "command": "ask"},
    "acceptEdits": {"read": "allow", "write": "allow", "command": "ask"},
    "plan": {"read": "allow", "write": "ask", "command": "ask"},
    "bypassPermissions": {"read": "allow", "write": "allow", "command": "allow"},
}


def mode_effect(mode: Column, category: Column) -> Column:
    table = F.create_map(*(x for m, row in MODES.items() for c, e in row.items() for x in (F.lit(f"{m}/{c}"), F.lit(e))))
    return F.element_at(table, F.concat_ws("/", mode, category))


def within(path: Column, roots: list[str]) -> Column:
    """Lexically under one of the roots; links are not followed."""
    out = F.lit(False)
    for r in roots:
        out = out | (path == r.rstrip("/")) | path.startswith(r.rstrip("/") + "/")
    return out & ~path.rlike(r"(\A|/)\.\.(/|\z)")


def permission_chain(tool: Column, category: Column, content: Column, mode: Column, rules, plan_tools=("AskUserQuestion", "ExitPlanMode"), plan_dir: str = "/plans", roots=("/work",), protected=("/work/.config",), sandboxed: Column | None = None) -> Column:
    """The first layer that decides: plan exceptions, safe and dangerous commands, sandboxed commands, paths, rules, mode."""
    command, file = category == "command", category.isin("read", "write") & (content != "")
    sandboxed = F.lit(False) if sandboxed is None else sandboxed
    return (
        F.when((mode == "plan") & (tool.isin(*plan_tools) | (tool.isin("WriteFile", "EditFile") & within(content, [plan_dir]))), "allow")
        .when(command & is_safe(content), "allow")
        .when(command & danger(content).isNotNull(), "deny")
        .when(command & sandboxed, evaluate_subcommands(tool, content, rules))
        .when(file & (category == "write") & within(content, list(protected)), "deny")
        .when(file & ~within(content, list(roots)) & (mode != "bypassPermissions"), "ask")
        .otherwise(F.coalesce(evaluate_rules(tool, content, rules), mode_effect(mode, category)))
    )


def match_hooks(events: DataFrame, hooks: list[dict], event: str, tool: str, arguments: str) -> DataFrame:
    """A row for each event and hook (id, event, condition) that fits: events stay where they are."""
    tests = []
    for k, h in enumerate(hooks):
        fits = (F.col(event) == h["event"]) & compile_condition(h.get("condition"), F.col(tool), F.col(event), F.col(arguments))
        tests.append(F.when(fits, F.struct(F.lit(h["id"]).alias("hook_id"), F.lit(k).alias("nth"), F.lit(bool(h.get("once"))).alias("once"))))
    return events.withColumn("_hook", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull()))).select("*", "_hook.*").drop("_hook")


def once_only(matches: DataFrame, order: list[str]) -> DataFrame:
    """Hooks marked once stay with their first match: the least of all matches, found by partial aggregation."""
    first = matches.where("once").groupBy("hook_id").agg(F.min(F.struct(*order)).alias("_first"))
    joined = matches.join(F.broadcast(first), "hook_id", "left")  # a row for each hook
    return joined.where(~F.col("once") | (F.struct(*order) == F.col("_first"))).drop("_first")


def hook_errors(hooks: DataFrame, events: list[str], actions=("command", "prompt", "http", "agent")) -> DataFrame:
    """Adds error: the first reason against a hook's definition."""
    error = (
        F.when(~F.col("event").isin(*events), "unknown event")
        .when(~F.col("action").isin(*actions), "unknown action")
        .when(F.col("reject") & (F.col("event") != "pre_tool_use"), "reject needs pre_tool_use")
        .when(F.col("async") & (F.col("event") == "pre_tool_use"), "pre_tool_use cannot be async")
    )
    return hooks.withColumn("error", error)


#: Exit codes from which these commands' failure is one; 1 only tells something.
ERROR_FROM = {"grep": 2, "egrep": 2, "fgrep": 2, "rg": 2, "diff": 2, "find": 2, "test": 2, "[": 2}


def last_command(line: Column) -> Column:
    """The base name of the last pipe's command, behind assignments."""
    last = strip(F.element_at(F.split(line, r"\|", -1), -1))
    words = F.filter(F.split(last, r"\s+"), lambda w: (w != "") & ~w.rlike(r"\A[A-Za-z_]\w*="))
    return F.element_at(F.split(F.coalesce(F.get(words, F.lit(0)), F.lit("")), "/", -1), -1)


def is_failure(line: Column, code: Column) -> Column:
    name, least = last_command(line), F.lit(1)
    for command, n in ERROR_FROM.items():
        least = F.when(name == command, n).otherwise(least)
    return F.when(code == 0, False).when(name.isin(*ERROR_FROM), code >= least).otherwise(True)


def safe_batches(calls: DataFrame, key: str, order: list[str], safe: Column) -> DataFrame:
    """Adds batch, from 1: adjacent safe calls share one, others stand alone."""
    by = W.partitionBy(key).orderBy(*order)
    rows = calls.withColumn("_safe", F.coalesce(safe, F.lit(False)))
    joins = F.col("_safe") & F.coalesce(F.lag("_safe").over(by), F.lit(False))
    return rows.withColumn("batch", F.sum(F.when(joins, 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_safe")


def read_before_edit(edits: DataFrame, reads: DataFrame) -> DataFrame:
    """Adds verdict to edits (path, mtime): ok only if the file was read and has not changed since."""
    last = reads.groupBy("path").agg(F.max_by("mtime", "seq").alias("read_mtime"))
    joined = edits.join(last, "path", "left")
    return joined.withColumn("verdict", F.when(F.col("read_mtime").isNull(), "not read").when(F.col("read_mtime") != F.col("mtime"), "changed").otherwise("ok"))


def absolute(path: Column, work_dir: str = "/") -> Column:
    """A path without ``.``, ``..`` and double separators, below work_dir if it is relative; links are not followed."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(work_dir.rstrip("/") + "/"), path))
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/"))


def reads_back_spill(tool: Column, path: Column, folder: str, work_dir: str = "/") -> Column:
    """Whether a call reads a text that was spilled into the folder: such a result is not spilled again."""
    return F.coalesce((tool == "ReadFile") & (path != "") & absolute(path, work_dir).startswith(folder), F.lit(False))


#: What Python calls the kinds of JSON values, by how their text begins.
KINDS = [("{", "dict"), ("[", "list"), ('"', "str"), ("t", "bool"), ("f", "bool"), ("n", "NoneType")]
EXPECTED = {"object": "dict", "array": "list", "string": "str"}


def output_error(output: Column, schema: dict) -> Column:
    """What is wrong with an output (JSON) by the type and the required fields of a schema; null if nothing."""
    text = strip(output)
    kind = F.coalesce(*(F.when(text.startswith(sign), name) for sign, name in KINDS), F.when(text.rlike("[.eE]"), "float").otherwise("int"))
    error = F.lit(None).cast("string")
    if schema.get("required"):
        missing = F.array_except(F.array(*map(F.lit, schema["required"])), F.coalesce(F.json_object_keys(output), F.array().cast("array<string>")))
        error = F.when((kind == "dict") & (F.size(missing) > 0), F.concat(F.lit("Missing required fields: "), F.array_join(missing, ", ")))
    want = schema.get("type")
    if want in EXPECTED:
        error = F.when(kind != EXPECTED[want], F.concat(F.lit(f"Expected {want}, got "), kind)).otherwise(error)
    return error


def matching_files(files: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """Files that fit a pattern; a folder's closing separator does not count."""
    bare = F.regexp_replace(F.col(path), r"/+\z", "")
    fits = F.lit(False)
    for p in patterns:
        fits = fits | glob_match(bare, p)
    return files.where(fits)


def union_rules(*layers: DataFrame) -> DataFrame:
    """(layer, seq, tool, pattern, effect) of all layers (seq, tool, pattern, effect), in order; rules of unknown effect go. The strictest counts, wherever it stands."""
    out = None
    for k, rows in enumerate(layers):
        rows = rows.where(F.col("effect").isin(*SEVERITY)).select(F.lit(k).alias("layer"), "seq", "tool", "pattern", "effect")
        out = rows if out is None else out.union(rows)
    return out
