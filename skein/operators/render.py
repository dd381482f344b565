"""Texts made of rows: reminders, titles, notifications, prompts and what a compacted session starts with.

The wording is the reader's contract, so it stands here as fixed values; every template is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import age_label, approx_tokens, cut_tokens, first_line, fixed, strip

#: Texts around memories that are shown again.
REMINDER_HEAD = "The following relevant memories from prior conversations may help:\n"
STALE = (
    "This memory is %d days old. Memories are point-in-time observations, not live state — claims about code behavior or file:line citations may be outdated. "
    "Verify against current code before asserting as fact."
)

#: Texts of the message that a compacted session starts with.
COMPACT_HEAD = "本次会话延续自之前的对话，因上下文空间不足进行了压缩。以下是早期对话的摘要：\n\n"
COMPACT_TAIL = "\n\n近期消息已原样保留。"
COMPACT_LOG = "\n\n如果你需要压缩前的具体细节（代码片段、报错信息等），请用 ReadFile 读取完整会话记录："

#: Sections of what is attached to it.
FILES_HEAD = "## 最近读过的文件\n以下快照是文件读取工具上次返回的内容。如需当前字节请重新读取。\n"
SKILLS_HEAD = "## 已激活的技能\n下列技能在本会话中被调用过，其触发条件仍然适用。\n"
TOOLS_HEAD = "## 可用工具\n你仍然可以调用以下工具，需要时直接发起调用即可：\n"
HINT = "## 提示\n\n以上恢复的上下文是重建的。若需要原文代码、错误信息或用户原话，请用文件读取工具重新读取，不要根据摘要猜测细节。\n"

#: What a call is titled by its tool, and the argument that follows.
TITLES = {"Glob": ("Glob: ", "pattern"), "Grep": ("Grep: ", "pattern")}
DOING = {"ReadFile": ("Reading ", "file_path"), "EditFile": ("Editing ", "file_path"), "WriteFile": ("Writing ", "file_path"), "Glob": ("Searching ", "pattern"), "Grep": ("Grepping ", "pattern")}

DETAIL_LINES, NOTE_CHARS = 20, 5000


def ordered_join(parts: Column, order: str, text: str, sep: str) -> Column:
    """Of an array of structs, the texts in order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda s: s[text]), sep)


def freshness(days: Column) -> Column:
    """A warning of memories over a day old, else empty."""
    return F.when(days <= 1, "").otherwise(F.format_string(STALE, days))


def memory_section(name: Column, days: Column, content: Column) -> Column:
    note = freshness(days)
    head = F.concat(F.lit("## Memory: "), name, F.lit(" (saved "), age_label(days), F.lit(")\n"))
    return F.concat(head, F.lit("\n"), F.when(note != "", F.concat(note, F.lit("\n\n"))).otherwise(""), content, F.lit("\n\n---\n"))


def reminder(memories: DataFrame, key: str, order: str, name: str = "name", days: str = "days", content: str = "content") -> DataFrame:
    """(key, text): a reminder a key, of its memories in order; what cannot be read (null) is left out."""
    row = F.struct(F.col(order).alias("at"), memory_section(F.col(name), F.col(days), F.col(content)).alias("text"))
    found = memories.where(F.col(content).isNotNull()).groupBy(key).agg(F.collect_list(row).alias("rows"))
    return found.select(key, F.concat(F.lit(REMINDER_HEAD + "\n"), ordered_join(F.col("rows"), "at", "text", "\n")).alias("text"))


def compact_message(summary: Column, attachment: Column | None = None, kept_tail: Column | None = None, log_path: Column | None = None) -> Column:
    """The one user message that a compacted session starts with."""
    out = F.concat(F.lit(COMPACT_HEAD), summary)
    if kept_tail is not None:
        out = F.concat(out, F.when(kept_tail, COMPACT_TAIL).otherwise(""))
    if log_path is not None:
        out = F.concat(out, F.when(log_path != "", F.concat(F.lit(COMPACT_LOG), log_path)).otherwise(""))
    if attachment is not None:
        out = F.concat(out, F.when(attachment != "", F.concat(F.lit("\n\n---\n\n"), attachment)).otherwise(""))
    return out


def file_section(path: Column, content: Column, read_at: Column, tokens: int = 5_000) -> Column:
    """A file as it was read last; read_at is a UTC time."""
    body = cut_tokens(content, tokens)
    stamp = F.date_format(read_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(F.lit("### "), path, F.lit("  (read "), stamp, F.lit(")\n```\n"), body, F.when(body.endswith("\n"), "").otherwise("\n"), F.lit("```\n"))


def skill_section(name: Column, body: Column, tokens: int = 5_000) -> Column:
    return F.concat(F.lit("### "), name, F.lit("\n\n"), cut_tokens(body, tokens), F.lit("\n"))


def skill_tokens(name: Column, body: Column, tokens: int = 5_000) -> Column:
    """What a skill takes of the budget for skills."""
    return approx_tokens(F.length(cut_tokens(body, tokens))) + approx_tokens(F.length(name)) + 8


def tool_section(name: Column, description: Column) -> Column:
    line = first_line(F.coalesce(description, F.lit("")))
    return F.concat(F.lit("- "), name, F.when(line != "", F.concat(F.lit(" — "), line)).otherwise(""), F.lit("\n"))


def recovery_attachment(files: DataFrame, skills: DataFrame, tools: DataFrame, key: str) -> DataFrame:
    """(key, text): sections of files (key, seq, text), skills and tools of the same form, each in order of seq; a section without rows is left out."""
    parts = None
    for k, (rows, head) in enumerate(((files, FILES_HEAD), (skills, SKILLS_HEAD), (tools, TOOLS_HEAD))):
        body = rows.groupBy(key).agg(F.collect_list(F.struct("seq", "text")).alias("rows"))
        part = body.select(key, F.struct(F.lit(k).alias("k"), F.concat(F.lit(head), ordered_join(F.col("rows"), "seq", "text", "")).alias("text")).alias("part"))
        parts = part if parts is None else parts.union(part)
    found = parts.groupBy(key).agg(F.collect_list("part").alias("parts"))
    return found.select(key, F.concat(ordered_join(F.col("parts"), "k", "text", "\n"), F.lit("\n" + HINT)).alias("text"))


def _argument(arguments: Column, name: str) -> Column:
    return F.coalesce(F.get_json_object(arguments, f"$.{name}"), F.lit(""))


def _base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _shortened(c: Column, chars: int) -> Column:
    return F.concat(F.left(c, F.lit(chars)), F.when(F.length(c) > chars, "…").otherwise(""))


def call_title(tool: Column, arguments: Column) -> Column:
    """A line for a call (arguments as JSON)."""
    base = _base(_argument(arguments, "file_path"))
    content, command = _argument(arguments, "content"), _argument(arguments, "command")
    lines = F.when(content == "", 0).otherwise(F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1)
    named = lambda verb, more: F.when(base == "", verb).otherwise(F.concat(F.lit(f"{verb} "), base, more))
    out = F.when(tool == "ReadFile", named("Read", F.lit("")))
    out = out.when(tool == "WriteFile", named("Write", F.concat(F.lit(" ("), lines.cast("string"), F.lit(" lines)"))))
    out = out.when(tool == "EditFile", named("Edit", F.lit("")))
    out = out.when(tool == "Bash", F.when(command == "", "Bash").otherwise(F.concat(F.lit("Bash: "), _shortened(command, 50))))
    for name, (verb, field) in TITLES.items():
        out = out.when(tool == name, F.concat(F.lit(verb), _argument(arguments, field)))
    return out.otherwise(tool)


def call_activity(tool: Column, arguments: Column) -> Column:
    """What a member is doing with a call."""
    out = F.when(tool == "Bash", F.concat(F.lit("Running "), _shortened(_argument(arguments, "command"), 40)))
    for name, (verb, field) in DOING.items():
        out = out.when(tool == name, F.concat(F.lit(verb), _argument(arguments, field)))
    return out.otherwise(tool)


def call_detail(tool: Column, arguments: Column, output: Column, most: int = DETAIL_LINES) -> Column:
    """A call with its output, indented; all lines of a command, else the first so many and how many more there are."""
    lines = F.split(output, "\n", -1)
    total = F.size(lines)
    shown = F.when(output == "", F.array().cast("array<string>")).when(output.endswith("\n"), F.slice(lines, 1, total - 1)).otherwise(lines)
    indented = lambda rows, lead: F.transform(rows, lambda s: F.concat(F.lit(lead), s))
    head = lambda c: F.array(c, F.lit(""))
    cut = F.concat(indented(F.slice(shown, 1, most), "  "), F.when(total > most, F.array(F.format_string("  … (%d more lines)", total - most))).otherwise(F.array().cast("array<string>")))
    command = F.concat(head(F.concat(F.lit("  IN   "), _argument(arguments, "command"))), indented(shown, "  OUT  "))
    file = F.concat(head(F.concat(F.lit("  "), _argument(arguments, "file_path"))), cut)
    return F.array_join(F.when(tool == "Bash", command).when(tool.isin("ReadFile", "WriteFile"), file).otherwise(cut), "\n")


def task_notification(id_: Column, name: Column, status: Column, result: Column, seconds: Column, tokens_in: Column, tokens_out: Column, most: int = NOTE_CHARS) -> Column:
    """A finished task as a message; seconds is null while it runs."""
    cut = F.concat(F.left(result, F.lit(most)), F.when(F.length(result) > most, "\n... (truncated)").otherwise(""))
    took = F.when(seconds.isNull(), "").when(seconds >= 60, F.concat(fixed(seconds / 60, 1), F.lit("m"))).otherwise(F.concat(fixed(seconds, 1), F.lit("s")))
    tokens = F.when((tokens_in > 0) | (tokens_out > 0), F.format_string("\nTokens: input=%d, output=%d", tokens_in, tokens_out)).otherwise("")
    lines = [F.lit("<task-notification>"), F.concat(F.lit("Task ID: "), id_), F.concat(F.lit("Agent: "), name), F.concat(F.lit("Status: "), status), F.concat(F.lit("Elapsed: "), took), tokens, F.lit("Result:"), cut, F.lit("</task-notification>")]
    return F.concat_ws("\n", *lines)


def team_notification(messages: DataFrame, team: str, order: str, sender: str = "sender", text: str = "text") -> DataFrame:
    """(team, text): a drained mailbox as one message."""
    line = F.concat(F.lit("from="), F.col(sender), F.lit(": "), F.col(text))
    drained = messages.groupBy(team).agg(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("text"))).alias("rows"))
    head = F.concat(F.lit('<team-notification team="'), F.col(team).cast("string"), F.lit('">\n'))
    return drained.select(team, F.concat(head, ordered_join(F.col("rows"), "at", "text", "\n"), F.lit("\n</team-notification>")).alias("text"))


def assemble(sections: DataFrame, key: str, priority: str, seq: str, content: str) -> DataFrame:
    """(key, text): sections by priority (ties as added), stripped, blank ones left out, with a blank line between."""
    rows = sections.withColumn("_text", strip(F.col(content))).where(F.col("_text") != "")
    found = rows.groupBy(key).agg(F.collect_list(F.struct(F.col(priority).alias("p"), F.col(seq).alias("q"), F.col("_text").alias("text"))).alias("rows"))
    return found.select(key, ordered_join(F.col("rows"), "p", "text", "\n\n").alias("text"))
