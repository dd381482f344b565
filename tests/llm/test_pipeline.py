"""run() against the same five steps in plain Python."""

import hashlib
import math
import random
import re

import corpus_pipeline
from skein.llm import quality_rules as q

from . import brute


def js(p, r):
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, r, strict=True)) / 2))


def kept(text):
    t, w = text or "", brute.words(text)
    if len(w) < 20 or 100 * brute.repeated_words(t) > 30 * len(w):
        return False
    letters = [c for c in t if c.isalpha()]
    capitals = sum(c.isupper() for c in letters)
    digits, gaps = sum(c.isdigit() for c in t), sum(c in " \t\n\x0b\x0c\r" for c in t)
    signs = len(re.findall(r"[#*$%&|<>]", t))
    counts = [len(letters) - capitals, capitals, digits, gaps, len(t) - len(letters) - digits - gaps - signs, signs]
    far = min(js([c / len(t) for c in counts], [x / sum(ref) for x in ref]) for ref in q.CLASS_REFERENCES.values())
    if len(t) >= q.MIN_CHARS and far > q.MAX_CLASS_DISTANCE:
        return False
    w = [brute.lower(x).strip(q.PUNCTUATION) for x in w]
    hits = {k: [x for x in w if x in ref] for k, ref in sorted(q.WORD_REFERENCES.items())}
    best = max(hits, key=lambda k: len(hits[k]))
    own, ref = hits[best], q.WORD_REFERENCES[best]
    return len(own) < q.MIN_COMMON or js([own.count(x) / len(own) for x in ref], [v / sum(ref.values()) for v in ref.values()]) <= q.MAX_WORD_DISTANCE


def documents():
    r = random.Random(12)
    vocabulary = ["stone", "river", "walked", "morning", "letter", "garden", "the", "of", "and", "to", "window", "silver", "né"] + [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    base, passage = text(120), text(70)
    near = [base.replace(base.split()[k], "changed", 1) for k in range(6)]
    signs = " ".join(w + "***" for w in text(100).split())
    texts = [None, "", "short", signs, base, base, *near, *(text(60) + " " + passage + " " + text(40) for _ in range(3)), *(text(r.randint(25, 200)) for _ in range(25))]
    return [(k, t, "en", [None, "a", "b"][k % 3], len(t or "")) for k, t in enumerate(texts)]


def test_run_is_the_five_steps(spark, tmp_path):
    docs = documents()
    spark.createDataFrame(docs, brute.SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    good = [(d[0], d[1]) for d in docs if kept(d[1])]
    assert 0 < len(good) < len(docs)
    groups = brute.near_duplicates(good)
    stay = [(d, t) for d, t in good if groups[d][1] == d]
    assert len(stay) < len(good)
    removed = brute.remove_repeats(stay)
    assert any(x[1] for x in removed.values())

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = {}
    for r in rows:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        assert r["n_tokens"] <= r["bucket_tokens"]
    assert set(times) <= {d for d, _ in stay} and max(times.values()) <= 2
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == len(rows)

    # the third stage by itself: what is left of each text
    scratch = corpus_pipeline.Scratch(spark)
    third = spark.createDataFrame([d for d in docs if d[0] in dict(stay)], brute.SCHEMA)
    left = {r["doc_id"]: r["text"] for r in scratch.save(corpus_pipeline.repeated_passages(spark, third, str(tmp_path)), "t").collect()}
    for d, t in left.items():
        if "�" not in t:
            assert hashlib.sha256(t.encode()).hexdigest() == removed[d][3]
    sizes = {d: len(brute.words(t)) for d, t in left.items()}
    assert all(r["n_tokens"] == sizes[r["doc_id"]] for r in rows)

    # the fourth: each source near its target
    from .test_models import plain_targets

    source = {d[0]: d[3] for d in docs}
    per = {}
    for d, n in sizes.items():
        per[source[d]] = per.get(source[d], 0) + n
    targets = plain_targets(per)
    for s, target in targets.items():
        taken = sum(n * sizes[d] for d, n in times.items() if source[d] == s)
        assert abs(taken - target) <= max(n for d, n in sizes.items() if source[d] == s)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], brute.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    df = spark.createDataFrame(documents()[4:9], brute.SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns, name


def test_stages_keep_rows_without_ids_and_clashing_columns(spark, tmp_path):
    docs = documents()
    rows = [(None if k in (7, 9, 20, 21) else 30 if k == 31 else d[0], d[1], d[2], d[3], d[4], "mine", k, [k], k) for k, d in enumerate(docs)]
    rows += [rows[25], rows[21]]
    schema = brute.SCHEMA + ", kept string, spans int, n_words array<int>, k1 long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    (_, first), (_, second), (_, third), (_, fourth), _ = corpus_pipeline.STAGES
    scratch = corpus_pipeline.Scratch(spark)

    good = [r for r in rows if kept(r[1])]
    one = scratch.save(first(spark, df, str(tmp_path)), "one")
    assert one.columns == df.columns and sorted(map(str, map(tuple, one.collect()))) == sorted(map(str, good))

    groups = brute.near_duplicates(enumerate(r[1] for r in good))
    members = {}
    for k, (_, c) in groups.items():
        members.setdefault(c, []).append(good[k])
    two = scratch.save(second(spark, one, str(tmp_path)), "two")
    left = two.collect()
    assert two.columns == df.columns and len(left) == len(members)
    for group in members.values():
        stays = [r for r in left if tuple(r) in group]
        assert len(stays) == 1 and stays[0]["doc_id"] == min((r[0] for r in group if r[0] is not None), default=None)

    removed = brute.remove_repeats(enumerate(r["text"] for r in left))
    three = scratch.save(third(spark, two, str(tmp_path)), "three")
    after = {r["spans"]: r for r in three.collect()}
    assert three.columns == df.columns and len(after) == len(left)
    for k, r in enumerate(left):
        got = after[r["spans"]]
        assert tuple(got)[5:] == tuple(r)[5:] and got["doc_id"] == r["doc_id"] and got["n_chars"] == len(got["text"])
        assert "\ufffd" in got["text"] or hashlib.sha256(got["text"].encode()).hexdigest() == removed[k][3]

    four = fourth(spark, three, str(tmp_path))
    chosen = sum(r["copies"] for r in corpus_pipeline.mixing.copies(three).collect())
    assert four.columns == df.columns and four.count() == chosen
