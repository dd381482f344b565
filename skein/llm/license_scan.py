"""License scans: an exact set-similarity join of text blocks with license templates.

Only DataFrame functions. A block is a line of a text, or a run of 2, 4, ... RUNS[-1] adjacent lines (the whole text, where it
has fewer), as notices are wrapped. Its set and a template's set are their distinct words (A-Z lower-cased, runs of anything but
ASCII signs that are no letter or digit). A block meets a template when |block and template| >= threshold * |template| and,
if it is several lines, it has at most SPAN times as many words as the template's set: chance gathers words in long runs.

All words of templates are ordered by how many texts hold them, rarest first (ties by code point). In that order a
template of n words that needs o of them in common has a prefix of n - o + 1 words, of which a block must hold
at least one (prefix filter): an index of prefix words fetches the templates that a block may meet. The block must have o words of
the templates' (length filter), and from the first common word on, both must have enough words left (positional filter).
Pairs that pass are counted exactly, so every block that meets the threshold is found. Templates are a parameter and stay
small; texts are never shuffled, and only those that hold a prefix word are taken apart into lines.

Null and empty texts have no words, no labels and score 0. Repeated rows are scanned each. Clashing columns of df are replaced.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import let, lower_ascii

#: A word's gap: ASCII characters that are neither digits nor letters nor beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP_CHARACTERS = "".join(c for c in map(chr, range(128)) if not c.isalnum())

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices as licensors put them above a text, short and in full, and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("reserved", "all rights reserved"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies"""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at http://mozilla.org/MPL/2.0/"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"""),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
THRESHOLD = 0.8
#: Lines of a block, and words of a block of several lines for each word of a template.
RUNS, SPAN = (1, 2, 4, 8, 16, 32), 4


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def template_words(text: str) -> list[str]:
    """Distinct words of a template (ASCII), by code point."""
    return sorted(set(re.findall(r"[a-z0-9]+", text.lower())))


def needed(n: int, threshold: float) -> int:
    """Words in common that containment in a template of n words takes."""
    return max(1, math.ceil(round(threshold * n, 9)))


def word_frequencies(df: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """Texts that hold each word of the templates; as long as the templates' vocabulary."""
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), words_of(F.col(text_col)))
    counts = df.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {r["word"]: r["n"] for r in counts.collect()}


BLOCKS = "array<struct<label:string,line:int,lines:int,containment:double>>"


def scan_licenses(df: DataFrame, text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """df with n_words, n_base, first_word, last_word, base_labels, labels, score and blocks.

    blocks: array of (label, line, lines, containment) of each block, from a line (from 0) on, that meets a template. score: the
    highest containment, 1 where a phrase stands, else 0.
    """
    new = [c for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks") if c != text_col]
    sets = [(label, template_words(t)) for label, t in templates if template_words(t)]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    counts = word_frequencies(df, text_col, vocabulary) if vocabulary else {}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))

    out = df.drop(*new).withColumn("_low", F.btrim(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(GAP_CHARACTERS)))
    out = out.withColumn("_words", F.when(F.col("_low") == "", F.array().cast("array<string>")).otherwise(F.split("_low", GAP)))

    # base: only texts that hold the words of a phrase are searched
    held = [F.lit(True) if not p.split() else _all([F.array_contains("_words", w) for w in p.split()]) for p in phrases]
    nothing = F.array().cast("array<struct<at:bigint,label:string>>")
    base = F.concat(*(F.when(has, _starts(F.col("_words"), p.split(), label)).otherwise(nothing) for has, (p, label) in zip(held, phrases.items(), strict=True))) if phrases else nothing
    out = out.withColumn("_base", base)

    # method: lines of texts that hold a prefix word of some template
    none = F.array().cast(BLOCKS)
    if sets:
        index = _index(sets, order, threshold)
        lines = F.split(lower_ascii(F.col(text_col)), "\n", -1)
        out = out.withColumn("blocks", F.when(F.arrays_overlap(F.col("_words"), F.array(*map(F.lit, index))), _blocks(lines, sets, order, index, threshold)).otherwise(none))
    else:
        out = out.withColumn("blocks", none)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base = F.transform("_base", lambda s: s["label"])
    at = F.transform("_base", lambda s: s["at"])
    return out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_base": F.size("_base").cast("long"),
        "first_word": F.array_min(at),
        "last_word": F.array_max(at),
        "base_labels": joined(base),
        "labels": joined(F.concat(base, F.transform("blocks", lambda b: b["label"]))),
        "score": F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))),
    }).drop("_low", "_words", "_base")


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _starts(words: Column, phrase: list[str], label: str) -> Column:
    """Structs (at, label) of the places where the phrase's words stand consecutively."""
    here = lambda ws, i: F.coalesce(_all([F.get(ws, i + k) == p for k, p in enumerate(phrase)]), F.lit(False))
    at = lambda ws: F.filter(F.transform(ws, lambda w, i: F.when(here(ws, i), i.cast("long"))), lambda i: i.isNotNull())
    return F.transform(let(words, at), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def _index(sets, order: list[str], threshold: float) -> dict[str, list[tuple[int, int]]]:
    """Of each prefix word the templates (from 1) that it is in the prefix of, and its place there."""
    rank = {w: k for k, w in enumerate(order)}
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, ws) in enumerate(sets):
        for k, w in enumerate(sorted(ws, key=rank.get)[: len(ws) - needed(len(ws), threshold) + 1]):
            index.setdefault(w, []).append((t + 1, k))
    return index


def _blocks(lines: Column, sets, order: list[str], index: dict[str, list[tuple[int, int]]], threshold: float) -> Column:
    """Array of (label, line, lines, containment) of the blocks that meet a template."""
    ordered = F.array(*map(F.lit, order))  # the intersection with it is in the global order
    entry = lambda t, k: F.struct(F.lit(t).alias("t"), F.lit(k).alias("k"))
    fetch = F.create_map(*(x for w, es in index.items() for x in (F.lit(w), F.array(*(entry(t, k) for t, k in es)))))
    known = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(len(ws)).alias("n"), F.lit(needed(len(ws), threshold)).alias("o"), F.array(*map(F.lit, ws)).alias("words")) for label, ws in sets))
    least = min(needed(len(ws), threshold) for _, ws in sets)

    def of_line(words: Column) -> Column:
        return F.struct(F.array_intersect(ordered, words).alias("words"), F.size(words).alias("size"))

    def run(rows: Column, first: Column, length: int) -> Column:
        part = F.slice(rows, first + 1, length)
        words = F.array_intersect(ordered, F.flatten(F.transform(part, lambda x: x["words"])))
        return F.struct(words.alias("words"), F.aggregate(part, F.lit(0), lambda n, x: n + x["size"]).alias("size"), first.cast("int").alias("line"), F.lit(length).alias("lines"))

    def runs_of(rows: Column, length: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(rows) - length))
        none = F.array().cast("array<struct<words:array<string>,size:int,line:int,lines:int>>")
        return F.when(F.size(rows) * 2 > length, F.transform(starts, lambda i: run(rows, i, length))).otherwise(none)

    def runs(rows: Column) -> Column:
        every = [F.transform(rows, lambda x, i: F.struct(x["words"].alias("words"), x["size"].alias("size"), i.alias("line"), F.lit(1).alias("lines")))]
        every += [runs_of(rows, length) for length in RUNS[1:]]
        return F.filter(F.concat(*every), lambda b: F.size(b["words"]) >= least)

    def met(block: Column) -> Column:
        hits = F.flatten(F.transform(block["words"], lambda w, at: F.transform(F.coalesce(F.try_element_at(fetch, w), F.array().cast("array<struct<t:int,k:int>>")), lambda e: F.struct(e["t"].alias("t"), e["k"].alias("k"), at.alias("at")))))
        # of each template the first word in common
        firsts = lambda hs: F.filter(hs, lambda h, i: (i == 0) | (F.get(hs, i - 1)["t"] != h["t"]))

        def check(h: Column) -> Column:
            def one(t: Column) -> Column:
                able = (F.least(t["n"] - h["k"], F.size(block["words"]) - h["at"]) >= t["o"]) & ((block["lines"] == 1) | (block["size"] <= SPAN * t["n"]))
                common = F.size(F.array_intersect(t["words"], block["words"]))
                found = let(common, lambda c: F.when(c >= t["o"], F.struct(t["label"].alias("label"), block["line"].alias("line"), block["lines"].alias("lines"), (c / t["n"]).cast("double").alias("containment"))))
                return F.when(able, found)

            return let(F.element_at(known, h["t"]), one)

        return F.transform(let(F.array_sort(hits), firsts), check)

    rows = F.transform(lines, lambda x: let(words_of(x), of_line))
    return F.filter(F.flatten(F.transform(let(rows, runs), met)), lambda m: m.isNotNull())
