"""Fill-in-the-middle, Merkle manifests and language identification against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import fill_in_middle, language_id, merkle
from skein.llm.shared import Scratch

from . import brute


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_cut(doc_id, text, seed="1:"):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha(seed + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def marked_documents():
    r = random.Random(5)
    docs = [(d, t) for d, t, *_ in brute.odd_documents()]
    docs += [(None, "one two three"), (None, "one two three"), (7, "another text of the id"), (100, "a<P>b"), (101, "<<S>"), (102, "<S"), (103, "<Px> <PP> P>"), (104, "<"), (105, "z" * 5000), (106, "𝄞€é" * 700), (107, "a" * 511 + "é" + "b" * 600 + "<M" + ">")]
    return docs + [(200 + k, "".join(r.choices("abP<>S é€\n", k=r.choice([1, 3, 510, 511, 512, 513, 1024, 4000])))) for k in range(60)]


@pytest.mark.parametrize("giant", [512, 1024, fill_in_middle.GIANT])
def test_fill_in_middle_cuts_as_plain_python_does(spark, giant):
    docs = marked_documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("cuts", F.lit(1)).withColumn("row", F.lit("x"))
    out = fill_in_middle.transform(df, giant=giant)
    restored = out.withColumn("restored", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in restored), key=str) == sorted(((d, *plain_cut(d, t)) for d, t in docs), key=str)
    assert sorted(r["restored"] for r in restored) == sorted(t or "" for _, t in docs)
    assert {r["form"] for r in restored} == {"plain", "psm", "spm"}


def test_many_short_texts_beside_a_long_one_take_little_memory():
    """What is held at a time goes by bytes and texts, not by their product."""
    import tracemalloc

    import pyarrow as pa

    texts = [b"a b"] * 60_000 + [b"x y " * 20_000]
    tracemalloc.start()
    sizes = [end - first for first, end, data, offsets in fill_in_middle._slices(pa.array(texts)) if fill_in_middle.Chunks(data, offsets)]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    parser = language_id.Parser(language_id.automaton(b"a b x y"), 7)
    bits = language_id.entropies([parser], *language_id.symbols(raw, offsets))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == len(texts) == len(bits) and max(sizes) <= fill_in_middle.TEXTS
    assert peak < 200 << 20


def test_fill_in_middle_of_an_empty_table_and_a_wrong_block(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle.transform(empty).collect() == []
    with pytest.raises(ValueError):
        fill_in_middle.transform(empty, giant=1000)


def test_transition_functions_compose(spark):
    """Two halves composed are the whole, from every state and wherever they meet."""
    text = "ab<P>c é<M x<S>".encode() * 90
    data = np.frombuffer(text, np.uint8)
    after, starts, chars = fill_in_middle.Chunks(data, np.array([0, len(data)])).totals()
    for at in (1, 500, 512, 777, len(data) - 1):
        a, s, c = fill_in_middle.Chunks(data, np.array([0, at, len(data)])).totals()
        assert (a[1][a[0]] == after[0]).all() and (s[0] + s[1][a[0]] == starts[0]).all() and c.sum() == chars[0]


def framed(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_tree(leaves):
    """The levels of a tree, leaves first."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(docs):
    """Rows (doc_id, leaf, subroot, root, proof, folded root) by the definition, recomputing each path."""
    leaf = lambda d, t, g, s, n: sha("".join(framed(x) for x in (d, s, g, n, t)))
    groups = {}
    for d, t, g, s, n in docs:
        groups.setdefault(g, []).append(((d is not None, d or 0), leaf(d, t, g, s, n), (d, t, g, s, n)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:2])
        trees[g] = plain_tree([x[1] for x in groups[g]])
    top = plain_tree([trees[g][-1][0] for g in order])
    out = []
    for j, g in enumerate(order):
        for i, (_, whole, (d, t, _, s, n)) in enumerate(groups[g]):
            tampered = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
            at = leaf(d, t, g, s, n + 1 if tampered and n is not None else n)
            proof = []
            for tree, k in ((trees[g], i), (top, j)):
                for level in tree[:-1]:
                    beside = level[k ^ 1] if k ^ 1 < len(level) else ""
                    at = sha(beside + at) if k % 2 else sha(at + beside)
                    proof.append(beside)
                    k //= 2
            out.append((d, whole, trees[g][-1][0], top[-1][0], sha("".join(proof)), at))
    return out


def spark_manifest(spark, docs, scratch=None):
    df = spark.createDataFrame(docs, brute.SCHEMA).withColumn("leaf", F.lit(1)).withColumn("g", F.lit("x"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", tampered, {"n_chars": F.col("n_chars") + 1}, ("doc_id",), scratch)
    return [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded_root").collect()]


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_merkle_manifest_is_the_tree_of_its_definition(spark, monkeypatch, levels):
    """Blocks of 2 and 4 nodes make as many rounds as a large table would."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    docs = brute.odd_documents() + [(None, "x", "en", None, 1), (None, "x", "en", None, 1), (4, "one", "de", "b", None), (900, "alone", "zu", "b", 5), (901, "", "", "b", 7)]
    docs += [(k, f"text {k}", "en", "a", k % 50) for k in range(1000, 1075)]
    assert sorted(spark_manifest(spark, docs), key=str) == sorted(plain_manifest(docs), key=str)


def test_merkle_manifest_of_one_row_of_copies_and_of_none(spark):
    assert spark_manifest(spark, []) == []
    one = [(1, "a", "en", "s", 1)]
    assert spark_manifest(spark, one) == plain_manifest(one)
    (row,) = spark_manifest(spark, one)
    assert row[1] == row[2] == row[3] == row[5] and row[4] == sha("")
    copies = one * 2100  # one group, one key, three blocks
    assert sorted(spark_manifest(spark, copies)) == sorted(plain_manifest(copies))


def test_merkle_tampering_is_found(spark):
    docs = [(k, f"t{k}", "en" if k % 3 else None, "s", None if k % 5 == 0 else k) for k in range(300)]
    for d, _, _, root, _, folded in spark_manifest(spark, docs):
        assert (folded != root) == (zlib.crc32(str(d).encode()) % 7 == 0 and d % 5 != 0)


def test_ranks_are_dealt_over_tasks(spark):
    """A group that is all rows is ranked without a window over it."""
    rows = spark.range(5000).select(F.lit("1g").alias("g"), (F.col("id") * 7919 % 5000).alias("key"))
    out = merkle.ranked(rows, ["key"], Scratch(spark), "t")
    assert [(r["key"], r["rank"], r["n"]) for r in out.orderBy("rank").collect()] == [(k, k, 5000) for k in range(5000)]


def plain_phrases(train, text):
    at = n = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in train:
            end += 1
        n, at = n + 1, end
    return n


def test_phrases_are_the_longest_matches(spark):
    r = random.Random(4)
    for _ in range(60):
        train = bytes(r.choices(b"abc\0", k=r.randint(1, 80)))
        texts = [bytes(r.choices(b"abcd\0", k=r.choice([0, 1, 7, 60]))) for _ in range(6)]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        start, sizes, text = language_id.cut(offsets)
        parser = language_id.Parser(language_id.automaton(train), len(train))
        assert np.bincount(text, parser.phrases(np.frombuffer(b"".join(texts), np.uint8), start, sizes), minlength=6).astype(int).tolist() == [plain_phrases(train, t) for t in texts]


def test_automaton_accepts_substrings_alone():
    text = b"abcbcabbb"
    edges = {(int(s), int(c)): int(t) for s, c, t in language_id.automaton(text)}
    subs = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}

    def accepts(word):
        state = 0
        for c in word:
            if (state, c) not in edges:
                return False
            state = edges[state, c]
        return True

    alphabet = b"abc"
    words = [b""]
    for _ in range(5):
        assert all(accepts(w) == (w in subs) for w in words)
        words = [w + bytes([c]) for w in words for c in alphabet]
    assert all(accepts(w) for w in subs) and len(edges) <= 3 * len(text)


def test_symbols_join_gaps_and_keep_texts_apart():
    texts = ["Ab, c", "", "  ", "é9é", "..x"]
    raw = [t.encode() for t in texts]
    body, offsets = language_id.symbols(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
    got = [body[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [b"ab\0c", b"", b"\0", "é\0é".encode(), b"\0x"]


SYLLABLES = {"aa": ["ka", "lo", "mi", "ta", "ne"], "bb": ["sch", "ung", "ein", "ler", "ich"], "": ["zó", "ñe", "rua", "ción", "el"]}


def spoken(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(n))


def test_language_of_held_out_documents(spark):
    r = random.Random(9)
    docs = [(k, spoken(r, lang, r.randint(4, 60)), lang) for k in range(400) for lang in [r.choice(list(SYLLABLES))]]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !? \n", "bb"), (None, docs[0][1], "zz"), (1003, spoken(r, "bb", 9000), None), (1004, "é", None)]
    df = spark.createDataFrame(docs + odd + docs[:3], "doc_id long, text string, lang string").withColumn("row", F.lit(1))
    train = df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    out = language_id.identify(df, train).collect()
    assert len(out) == len(docs) + len(odd) + 3
    truth = {d: lang for d, _, lang in docs}
    held = [x for x in out if x["held_out"]]
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in out)
    assert sum(x["lang_pred"] == truth.get(x["doc_id"], x["lang_pred"]) for x in held) >= 0.98 * len(held) and len(held) > 60
    by_id = {x["doc_id"]: x for x in out}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert by_id[1003]["lang_pred"] == "bb" and by_id[1004]["lang_pred"] in ("", "aa", "bb") and all(0 <= x["score"] <= 1 for x in out)
    assert "zz" not in {x["lang_pred"] for x in out}  # a null id teaches nothing


def test_language_scores_are_those_of_the_definition(spark):
    """Scores from the sample as learn() chose it, with phrases counted in plain Python piece by piece."""
    r = random.Random(11)
    docs = [(k, spoken(r, lang, r.choice([1, 5, 300, 1500])), lang) for k in range(40) for lang in [r.choice(list(SYLLABLES))]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    texts = {}
    rows = df.withColumn("h", F.xxhash64("text", "lang")).collect()
    for lang in sorted(SYLLABLES, key=str.encode):
        chosen = sorted({(x["h"], x["text"]) for x in rows if x["lang"] == lang})[:5]
        clean = lambda t: re.sub(rb"[^a-z\x80-\xff]+", b"\0", t)
        texts[lang] = clean(b" ".join(t.lower().encode()[:100] for _, t in chosen))
    out = {x["doc_id"]: x for x in language_id.identify(df, df.select("lang", "text"), sample=5, row_bytes=100).collect()}
    for d, text, _ in docs:
        body = re.sub(rb"[^a-z\x80-\xff]+", b"\0", text.lower().encode())
        pieces = [body[k : k + language_id.PIECE] for k in range(0, len(body), language_id.PIECE)]
        bits = sorted((sum(plain_phrases(t, p) for p in pieces) * math.log2(len(t) + 2) / len(body), k) for k, t in texts.items())
        assert out[d]["lang_pred"] == bits[0][1] and math.isclose(out[d]["score"], 1 - bits[0][0] / bits[1][0], abs_tol=1e-12)


def test_language_without_labels_with_one_and_with_many(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "", "en")], "doc_id long, text string, lang string")
    out = language_id.identify(df, df.select("lang", "text")).collect()
    assert {(x["lang_pred"], x["score"]) for x in out} <= {("und", 0.0), ("en", 1.0)}
    assert language_id.identify(df.limit(0), df.limit(0)).collect() == []
    one = language_id.identify(df, spark.createDataFrame([("en", "words")], "lang string, text string")).collect()
    assert sorted((x["doc_id"], x["lang_pred"], x["score"]) for x in one) == [(1, "en", 1.0), (2, "und", 0.0)]
    many = spark.createDataFrame([(f"l{k}", f"text {k} {j}") for k in range(30) for j in range(3)], "lang string, text string")
    model = language_id.learn(many, total_rows=60)
    assert len(model) == 30 and all(size <= 2 * 10 for _, size in model.values())


def test_a_hot_copy_takes_one_place_of_the_sample(spark):
    train = spark.range(3000).select(F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, "the same words").otherwise(F.concat(F.lit("other words "), F.col("id").cast("string"))).alias("text"))
    model = language_id.learn(train, sample=20)
    assert model["en"][1] > 19 * len("other words ")
