"""URL filters: host rules by longest match, pattern rules fetched by their rarest literal token.

Only DataFrame functions. A pattern is literal text with these signs: ``||`` at its start stands for
the scheme and any subdomains, ``*`` for anything, ``^`` for a separator or the end; ``@@`` before it
makes it an exception. The tokens of a rule are its runs of letters and digits that any matching URL
must hold as whole tokens. Of these the one rarest in the given URLs is the rule's key: a URL's
tokens fetch the rules filed under them, and no other rule runs its regular expression.

Null URLs and URLs without ``://`` have an empty host and path; no pattern rule sees a null URL; the
method's verdict of a URL that no rule matches is allow. Rules are parameters, so their number
is the caller's; they travel inside the plan as one literal, an array of buckets by the key's checksum, so
that a lookup looks at one bucket however many rules there are.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import let, lower_ascii

#: Host rules as (verdict, host, path).
HOST_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

#: Our own default patterns: advertising, tracking, gambling, adult and spam hosts and paths.
PATTERNS = [
    "||ads-track.", "||ads.", "||adserver.", "||track.", "||tracker.", "||doubleclick.", "||popunder.",
    "||casino-win.", "||casino.", "||free-bets.", "||poker.", "||adult-x.", "||xxx.", "||spam-farm.", "||cheap-pills.",
    "/ads/", "/adserver/", "/banner/*/click", "/track/pixel^", "utm_medium=affiliate^", "/wp-login.php^",
    "@@||ads.*/about^",
]

_SEPARATOR = r"(?:[^a-z0-9_.%-]|\z)"


@dataclass(frozen=True)
class Pattern:
    text: str
    regex: str
    tokens: tuple[str, ...]
    allow: bool


def compile_pattern(text: str) -> Pattern:
    body = text.lower()
    allow = body.startswith("@@")
    body = body[2:] if allow else body
    host = body.startswith("||")
    body = body[2:] if host else body
    regex = r"(?s)" + (r"\A[^:/?#]*://(?:[^/?#]*\.)?" if host else "")
    regex += "".join(".*" if c == "*" else _SEPARATOR if c == "^" else re.sub(r"([^a-z0-9])", r"\\\1", c) for c in body)
    tokens = []
    for m in re.finditer(r"[a-z0-9]+", body):
        starts = body[m.start() - 1] != "*" if m.start() else host
        ends = m.end() < len(body) and body[m.end()] != "*"
        if starts and ends:
            tokens.append(m[0])
    return Pattern(text, regex, tuple(dict.fromkeys(tokens)), allow)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL as the module says."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def _url_tokens(url: Column) -> Column:
    return F.split(lower_ascii(F.coalesce(url, F.lit(""))), "[^a-z0-9]+")


def token_counts(df: DataFrame, url_col: str, patterns: list[Pattern]) -> dict[str, int]:
    """URLs that hold each token of the rules; tokens of no rule are not counted, so the result is as long as the rules."""
    wanted = sorted({t for p in patterns for t in p.tokens})
    if not wanted:
        return {}
    is_wanted = lookup({t: [t] for t in wanted}, "string")
    tokens = F.filter(F.array_distinct(_url_tokens(F.col(url_col))), lambda t: F.size(is_wanted(t)) > 0)
    return {r["token"]: r["n"] for r in df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}


def lookup(entries: dict[str, list], kind: str) -> Callable[[Column], Column]:
    """A function from a key to the array of its entries (of a column type), empty for others: twice as many buckets as keys, all in one literal."""
    buckets: list[list] = [[] for _ in range(1 << max(1, (2 * len(entries) - 1).bit_length()))]
    for key, values in entries.items():
        buckets[zlib.crc32(key.encode()) % len(buckets)].append({"key": key, "values": values})
    table = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<key:string,values:array<{kind}>>>>")

    def fetch(key: Column) -> Column:
        bucket = F.get(table, (F.crc32(key.cast("binary")) % len(buckets)).cast("int"))
        return F.flatten(F.transform(F.filter(bucket, lambda e: e["key"] == key), lambda e: e["values"]))

    return fetch


def rule_index(patterns: list[Pattern], counts: dict[str, int]) -> dict[str, list[Pattern]]:
    """Rules under their rarest token (ties: the longer, then the earlier by code point); under "" those without one."""
    index: dict[str, list[Pattern]] = {}
    for p in patterns:
        key = min(p.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        index.setdefault(key, []).append(p)
    return index


def _host_rule(host: Column, path: Column, host_rules) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null: the host's suffixes look the rules up."""
    by_host: dict[str, list] = {}
    for verdict, at, prefix in host_rules:
        by_host.setdefault(at.lower(), []).append((prefix, f"{at}{prefix}", verdict))
    found = {at: [{"size": len(rule), "rule": rule, "prefix": prefix, "verdict": verdict} for prefix, rule, verdict in rs] for at, rs in by_host.items()}
    fetch = lookup(found, "struct<size:int,rule:string,prefix:string,verdict:string>")
    labels = F.split(host, r"\.", -1)
    suffixes = let(labels, lambda ls: F.transform(F.sequence(F.lit(1), F.size(ls)), lambda i: F.array_join(F.slice(ls, i, F.size(ls)), ".")))
    fetched = F.flatten(F.transform(suffixes, fetch))
    return F.array_max(F.filter(fetched, lambda r: path.startswith(r["prefix"])))


def filter_urls(df: DataFrame, url_col: str = "url", host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """df with host, path, rule (of the host rules, else null), pattern (first that blocks, else null) and verdict.

    Clashing columns of df are replaced. No shuffle but the small count of rule tokens.
    """
    compiled = [compile_pattern(p) for p in patterns]
    index = rule_index(compiled, token_counts(df, url_col, compiled))
    host, path = url_parts(F.col(url_col))
    out = df.drop("host", "path", "rule", "pattern", "verdict").withColumns({"host": host, "path": path})
    if host_rules:
        out = out.withColumn("_fit", _host_rule(F.col("host"), F.col("path"), host_rules))
    else:
        out = out.withColumn("_fit", F.lit(None).cast("struct<size:int,rule:string,prefix:string,verdict:string>"))
    url = lower_ascii(F.coalesce(F.col(url_col), F.lit("")))
    if index:
        found = {t: [{"allow": p.allow, "text": p.text, "regex": p.regex} for p in ps] for t, ps in index.items()}
        keys = F.concat(F.array(F.lit("")), F.filter(F.array_distinct(_url_tokens(F.col(url_col))), lambda t: t != ""))
        fetched = F.flatten(F.transform(keys, lookup(found, "struct<allow:boolean,text:string,regex:string>")))
        out = out.withColumn("_hits", let(url, lambda u: F.array_sort(F.filter(fetched, lambda r: F.rlike(u, r["regex"])))))
        blocks = F.when(~F.exists("_hits", lambda r: r["allow"]), F.get(F.col("_hits"), F.lit(0))["text"])
    else:
        blocks = F.lit(None).cast("string")
    out = out.withColumn("pattern", blocks).withColumn("rule", F.col("_fit")["rule"])
    return out.withColumn("verdict", F.coalesce(F.col("_fit")["verdict"], F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))).drop("_fit", "_hits")
