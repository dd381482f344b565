"""Skills as SQL functions, made from their files.

A skill's file has a header (name, description, mode) and a template. Each becomes a temporary SQL function of one argument text, so that a query calls it like any other and the
optimizer inlines it. Template texts enter the session as a literal of their bytes and arguments as values: neither is ever pasted into SQL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import run_mode
from skein.sources.files import definitions

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")


@dataclass(frozen=True)
class Skill:
    name: str
    description: str
    mode: str
    template: str

    @property
    def function(self) -> str:
        """The SQL function's name."""
        return "skill_" + self.name.lower().replace("-", "_")


def skill_rows(files: DataFrame) -> DataFrame:
    """(name, description, mode, template, error) of skill files (path, content): a header that cannot be read is an error, not silence."""
    get = lambda f: F.coalesce(F.try_variant_get("meta", f"$.{f}", "string"), F.lit(""))
    rows = definitions(files)
    error = F.coalesce(F.col("error"), F.when(~get("name").rlike(r"\A[A-Za-z0-9][A-Za-z0-9_-]*\z"), "no valid name"))
    return rows.select("path", get("name").alias("name"), get("description").alias("description"), run_mode(get("mode"), get("context"))["mode"].alias("mode"), F.col("body").alias("template"), error.alias("error"))


def load_skills(files: DataFrame) -> list[Skill]:
    """The skills of a catalogue, which is a dimension of files: the first of each name by path."""
    rows = skill_rows(files).where("error is null").orderBy("path").collect()
    out: dict[str, Skill] = {}
    for r in rows:
        out.setdefault(r["name"].lower(), Skill(r["name"], r["description"], r["mode"], r["template"]))
    return list(out.values())


def register_skills(spark: SparkSession, skills: list[Skill]) -> None:
    """A temporary SQL function for each skill: ``skill_name(arguments)`` is its prompt, the arguments put for ``$ARGUMENTS`` or appended."""
    for s in skills:
        if not _NAME.fullmatch(s.name):
            raise ValueError(f"not a name: {s.name}")
        template = f"decode(unhex('{s.template.encode().hex()}'), 'UTF-8')"
        spark.sql(
            f"""CREATE OR REPLACE TEMPORARY FUNCTION {s.function}(arguments STRING) RETURNS STRING RETURN
            CASE WHEN contains({template}, '$ARGUMENTS') THEN replace({template}, '$ARGUMENTS', coalesce(arguments, ''))
            WHEN trim(BOTH ' \\t\\n\\r' FROM coalesce(arguments, '')) <> '' THEN concat({template}, '\\n\\n', arguments) ELSE {template} END"""
        )


def run_skill(spark: SparkSession, skill: Skill, arguments: str) -> DataFrame:
    """(mode, prompt) of one call, the argument a named parameter."""
    return spark.sql(f"SELECT :mode AS mode, {skill.function}(:arguments) AS prompt", args={"mode": skill.mode, "arguments": arguments})


def run_skills(calls: DataFrame, skills: list[Skill], name: str = "name", arguments: str = "arguments") -> DataFrame:
    """calls with mode and prompt: inline ones are for the conversation at hand, forks for one of their own; null for names that are no skill."""
    prompt: Column = F.lit(None).cast("string")
    mode: Column = F.lit(None).cast("string")
    for s in skills:
        here = F.lower(F.col(name)) == s.name.lower()
        prompt = F.when(here, F.call_function(s.function, F.col(arguments))).otherwise(prompt)
        mode = F.when(here, F.lit(s.mode)).otherwise(mode)
    return calls.withColumns({"mode": mode, "prompt": prompt})
