"""Classifier, neighbours, packing, mixing and archives."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from skein.llm import ann, mixing, packing, quality_classifier, warc
from skein.llm.shared import Scratch

from . import brute


def labelled(n=300):
    r = random.Random(2)
    docs = []
    for k in range(n):
        ws = r.choices(["the", "house", "of", "stone", "and", "water", "which", "stands"], k=r.randint(20, 80))
        docs.append((k, " ".join(w + "***" if k % 3 == 0 else w for w in ws)))
    return docs, [(k, 0 if k % 3 == 0 else 1) for k, _ in docs]


def test_classifier_held_out_accuracy(spark):
    docs, labels = labelled()
    docs += [(1000, None), (1001, ""), (1002, " \n "), (1003, "x" * 50_000), (0, docs[0][1])]
    out = quality_classifier.classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 300]
    truth = dict(labels)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def plain_features(text):
    """The statistics by their definitions, one text at a time."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = [x for k, x in enumerate(raw.split(b"\n")) if len(x) + (k < raw.count(b"\n")) > 1]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    again = lambda xs: len(xs) - len(set(xs))
    share = lambda n, of: math.sqrt(n / max(of, 1))
    count = lambda signs: sum(raw.count(c.encode()) for c in signs)
    spaces = count(" \t\n\x0b\x0c\r")
    return [
        math.log1p(len(words)), math.log1p((len(raw) - spaces) / max(len(words), 1)), share(count("#*$%&|<>@^~_=+\\/{}[]"), len(raw)), share(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), len(raw)),
        share(count("0123456789"), len(raw)), share(count(".,;:'\"()-?"), len(raw)), share(count("!"), len(raw)), share(count("|"), len(raw)), math.log1p(len(raw) / max(len(lines), 1)),
        share(again(lines), len(lines)), share(again(windows), len(words)), share(len(words) - again(words), len(words)),
        share(sum(w[-1:] in (b".", b",", b";", b":", b"!", b"?") for w in words), len(words)), share(sum(len(w) <= 3 for w in words), len(words)),
    ]


def test_classifier_is_the_discriminant_of_its_definition(spark):
    q = quality_classifier
    docs, labels = labelled(200)
    r = random.Random(9)
    docs = [(k, t + r.choice(["", "\nSame line\nSame line\n", " A, B! | 12", "\n\n"]) + (" " + t if k % 7 == 0 else "")) for k, t in docs] + [(900, None), (901, ""), (902, " a"), (903, "é" * 2000)]
    out = {x["doc_id"]: x["score"] for x in q.classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = {d: np.array(plain_features(t)) for d, t in docs}
    truth = {d: y for d, y in labels if zlib.crc32(str(d).encode()) % 5}
    sets = [np.array([x[d] for d, y in truth.items() if y == c]) for c in (0, 1)]
    covs = [np.cov(s.T, bias=True) for s in sets]
    pooled = sum(len(s) * c for s, c in zip(sets, covs, strict=True)) / len(truth)
    log = []
    for s, c in zip(sets, covs, strict=True):
        c = (1 - q.POOLED - q.DIAGONAL) * c + q.POOLED * pooled + q.DIAGONAL * np.diag(np.diag(pooled)) + q.RIDGE * np.eye(len(c))
        far = lambda v, s=s, c=c: (v - s.mean(0)) @ np.linalg.inv(c) @ (v - s.mean(0))
        log.append({d: math.log(len(s) / len(truth)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * far(v) for d, v in x.items()})
    for d in x:
        assert abs(out[d] - 1 / (1 + np.exp(-np.clip(log[1][d] - log[0][d], -500, 500)))) < 1e-5, d


def test_classifier_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_classifier.classify(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).collect()
    assert rows[0]["score"] == 0.5
    one = spark.createDataFrame([(1, 1), (2, None), (3, 7)], "doc_id long, quality int")
    assert quality_classifier.classify(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), one).first()["score"] in (0.5, 1.0)
    assert quality_classifier.classify(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


def test_statistics_do_not_depend_on_neighbours():
    texts = [b"a b c\nA B!!", b"", b"one | two | three\none | two | three\n", b"x y z w v u t s x y z w v u t s"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    together = quality_classifier.statistics(data, offsets)
    for k, t in enumerate(texts):
        alone = quality_classifier.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(alone[0], together[k])


def test_neighbours_recall_ties_and_bad_vectors(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(1500, 16)).astype(np.float32)
    x[200:260] = x[7]  # a hot vector: ties go to smaller ids
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] + [1.0] * 15), (5080, [float("inf")] + [1.0] * 15), (5100, [1.0] * 8), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(5)
    out = ann.search(df, queries=lambda c: c % 20 == 0, top=20).collect()
    d = x.astype(np.float64)
    found = {}
    for r in out:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 1500, 20))
    hits = 0
    for q, got in found.items():
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 21)) and len({v for _, v, _ in got}) == 20 and q not in {v for _, v, _ in got}
        assert all(abs(s - d[q] @ d[v]) < 1e-9 for _, v, s in got)
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        score = np.round(d @ d[q], 9)
        score[q] = -np.inf
        best = np.lexsort((np.arange(1500), -score))[:20]
        hits += len(set(best) & {v for _, v, _ in got})
    assert hits / (20 * len(found)) >= 0.9
    assert [v for _, v, _ in found[200]][:20] == [7, *range(201, 220)]


def test_neighbours_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (20, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(few, queries=lambda c: c % 20 == 0, share=1.0).collect()}
    assert got == {(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)}
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_of_single_numbers_and_double_vectors(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [-3.0]), (20, [2.0]), (3, [0.0])], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(few, queries=lambda c: c % 20 == 0).collect()}
    assert got == {(0, 1, 20, 2.0), (0, 2, 1, -3.0), (20, 1, 0, 2.0), (20, 2, 1, -6.0)}
    fine = [1.0, 1e-12, 0.3]
    two = spark.createDataFrame([(0, fine), (1, [1.0, 0.0, 0.1])], "vec_id long, embedding array<double>")
    assert ann.search(two, queries=lambda c: c == 0).first()["score"] == 1.0 + 0.3 * 0.1


def plain_neighbours(rows, top):
    """By brute force: rows of the query's own id are no candidates, repeated rows are candidates each."""
    x = np.array([v for _, v in rows])
    out = []
    for q, v in rows:
        if q % 20 == 0:
            near = sorted((-float(s), c) for s, (c, _) in zip(x @ np.array(v), rows, strict=True) if c != q)[:top]
            out += [(q, k, c, -s) for k, (s, c) in enumerate(near, 1)]
    return sorted(out)


def test_neighbours_of_ids_that_are_repeated_more_than_top_times(spark):
    g = np.random.default_rng(8)
    whole = lambda n: g.integers(-4, 5, (n, 6)).astype(float) + 0.0  # small whole numbers: exact scores and many ties
    hot = [1.0, 2.0, 0.0, 0.0, 1.0, 3.0]
    rows = [(20, hot)] * 30 + [(1000 + k, hot) for k in range(30)] + [(2000 + k, v.tolist()) for k, v in enumerate(whole(30))]
    rows += [(40, v.tolist()) for v in whole(40)] + [(41, v.tolist()) for v in whole(40)] + [(60, hot), (60, [-1.0] + hot[1:])]
    rows = [r for r in rows if any(r[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    for top in (3, 20):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, queries=lambda c: c % 20 == 0, top=top, share=1.0).collect())
        assert got == plain_neighbours(rows, top)


def test_neighbours_multiply_only_the_cells_read():
    """Kept rows against a plain walk, with and without repeated groups."""
    g = np.random.default_rng(15)
    for groups in (1000, 6):
        ask, place = np.divmod(g.permutation(8 * 40)[:200], 40)
        score, tie = g.integers(0, 9, 200).astype(float), place
        grp = g.integers(0, groups, 40)[place] if groups < 1000 else place
        got = set(ann.first_groups(ask, place, score, tie, grp, 4).tolist())
        want = set()
        for q in range(8):
            seen = {}
            for k in sorted(np.flatnonzero(ask == q), key=lambda k: (-score[k], tie[k])):
                if grp[k] in seen or len(seen) < 5:
                    seen[grp[k]] = seen.get(grp[k], 0) + 1
                    if seen[grp[k]] <= 4:
                        want.add(int(k))
        assert got == want


def test_heap_and_sort_give_one_order():
    g = np.random.default_rng(3)
    first, second, counts = g.normal(size=30), g.normal(size=20), g.integers(0, 3, (30, 20))
    for want in (1, 100, 400, 10_000):
        assert ann.traverse(first, second, counts, want, 10) == ann.traverse(first, second, counts, want, 10**6)


def test_calibrated_share_falls_with_the_index(spark):
    g = np.random.default_rng(12)
    centres = g.normal(size=(40, 12))
    x = centres[g.integers(0, 40, 8000)] + 0.2 * g.normal(size=(8000, 12))
    read = []
    for n in (500, 8000):
        c1, c2 = ann.train(x[:n, :6], int(n**0.5)), ann.train(x[:n, 6:], int(n**0.5))
        read.append(ann.calibrate(x[:n], c1, c2, 20))
    assert read[1] < read[0] < 1 and read[1] < 0.2


def test_heap_pops_cells_in_order():
    first, second = np.array([3.0, 1.0, 2.0]), np.array([0.5, 0.1])
    cells = ann.traverse(first, second, np.ones((3, 2), int), 6)
    sums = [first[i] + second[j] for i, j in cells]
    assert sums == sorted(sums) and len(set(cells)) == 6


def test_boundaries_are_optimal():
    r = random.Random(6)
    for _ in range(200):
        sizes = sorted(r.sample(range(40), r.randint(1, 9)))
        cells = [(s, n, n * s) for s in sizes for n in [r.randint(1, 5)]]
        most = r.randint(1, 5)
        padding = lambda ends, cells=cells: sum(n * (min(e for e in ends if e >= s) - s) for s, n, _ in cells)
        best = min(padding(e) for k in range(1, most + 1) for e in itertools.combinations(sizes, k) if e[-1] == sizes[-1])
        ends = packing.best_boundaries(cells, most)
        assert len(ends) <= most and padding(ends) == best


def test_packing_batches(spark):
    docs = brute.odd_documents()
    docs += [docs[3], docs[3]]
    rows = packing.pack(spark.createDataFrame(docs, brute.SCHEMA), buckets=4, budget=500).collect()
    assert len(rows) == len(docs)
    batches = {}
    for r in rows:
        assert r["n_tokens"] <= r["bucket_tokens"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), members in batches.items():
        assert len({m["slot"] for m in members}) == len(members)
        assert len(members) == 1 or len(members) * members[0]["bucket_tokens"] <= 500
        room = max(1, 500 // max(1, members[0]["bucket_tokens"]))
        assert len(members) == room or (bucket, batch + 1) not in batches  # only a bucket's last batch is not full
    lengths = sorted({r["n_tokens"] for r in rows})
    pad = sum(r["bucket_tokens"] - r["n_tokens"] for r in rows)
    best = min(sum(min(e for e in ends if e >= r["n_tokens"]) - r["n_tokens"] for r in rows) for ends in itertools.combinations(lengths, 4) if ends[-1] == lengths[-1])
    assert pad == best
    assert packing.pack(spark.createDataFrame([], brute.SCHEMA)).count() == 0


def test_packing_is_the_same_in_any_order_with_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECE", 16)
    r = random.Random(6)
    rows = [(None, n) for n in r.choices(range(300), k=200)] + [(7, n) for n in r.choices(range(9), k=90)] + [(None, 5)] * 100 + [(k, r.randrange(300)) for k in range(100)]
    seen = []
    for order in range(3):
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, n long").repartition(1 + 4 * order)
        seen.append(sorted((tuple(x) for x in packing.pack(df, text_col="n", length=F.col("n"), budget=900).collect()), key=str))
    assert seen[0] == seen[1] == seen[2]
    assert sorted((d, n) for d, n, *_ in seen[0] if d is not None) == sorted(x for x in rows if x[0] is not None) and len(seen[0]) == len(rows)
    assert len({x[2:3] + x[4:] for x in seen[0]}) == len(rows)  # one place each


def test_packing_with_every_length_a_cell_is_optimal(spark):
    r = random.Random(16)
    lengths = [r.randint(1, 30_000) for _ in range(12)]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, n long")
    padding = lambda **fine: sum(x["bucket_tokens"] - x["n_tokens"] for x in packing.pack(df, text_col="n", buckets=3, length=F.col("n"), **fine).collect())
    ends = sorted(set(lengths))
    best = min(sum(min(e for e in some if e >= n) - n for n in lengths) for some in itertools.combinations(ends, 3) if some[-1] == ends[-1])
    assert padding(fine=None) == best <= padding(fine=4)


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in free}
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]


def test_mixing_meets_its_targets(spark):
    r = random.Random(8)
    docs = [(k, " ".join(["w"] * r.randint(1, 60)), r.choice(["a", "a", "a", "b", "c", None])) for k in range(900)]
    docs += [(5000, None, "b"), (5001, "", None), (5002, "w w", "empty"), (5003, None, "void"), (5004, "w w w", "b"), (5004, "w w w", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    rows = mixing.copies(df).collect()
    assert len(rows) == len(docs)
    sizes, taken = {}, {}
    for x in rows:
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
        assert x["taken"] == x["copies"] * x["size"] and x["taken"] <= 2 * x["size"]
    targets = plain_targets(sizes)
    for x in rows:
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - targets[x["source"]]) < 1e-6
    for s, n in taken.items():
        assert abs(n - targets[s]) <= 61
    again = mixing.copies(df.repartition(7)).collect()
    assert sorted(map(tuple, ((x["doc_id"], x["taken"]) for x in rows))) == sorted((x["doc_id"], x["taken"]) for x in again)


def test_mixing_rates_by_bisection(spark):
    r = random.Random(18)
    docs = [(k, " ".join(["w"] * r.randint(1, 90)), r.choice(["a"] * 6 + ["b", "c", None])) for k in range(400)]
    rows = mixing.copies(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    of = {}
    for x in rows:
        of.setdefault(x["source"], []).append(x)
    targets = plain_targets({s: sum(x["size"] for x in xs) for s, xs in of.items()})
    for s, xs in of.items():
        mean = sum(x["size"] for x in xs) / len(xs)
        rate = lambda low, n, mean=mean: min(2.0, math.exp(low * n / mean))
        low, high = -60.0, 60.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(x["size"] * rate(middle, x["size"]) for x in xs) < targets[s] else (low, middle)
        full = targets[s] >= 2 * sum(x["size"] for x in xs)
        for x in xs:
            want = 2.0 if full else rate(high, x["size"])
            assert abs(x["rate"] - want) < 1e-4 and x["copies"] in (math.floor(want + 1e-6), math.floor(want - 1e-6), math.floor(want - 1e-6) + 1)
        for n in {x["size"] for x in xs}:  # the copies of all up to one size are what their rates give, rounded
            upto = [x for x in xs if x["size"] <= n]
            assert abs(sum(x["copies"] for x in upto) - sum(x["rate"] for x in upto)) < 0.51


def test_mixing_sizes_and_targets_as_sql(spark):
    import duckdb
    import pandas as pd

    docs = pd.DataFrame([(d[0], d[1], d[3]) for d in brute.odd_documents()], columns=["doc_id", "text", "source"])
    con = duckdb.connect()
    con.register("documents", docs)
    # no source but the smallest reaches its limit twice over: one round of sharing out the excess a source
    want = con.execute(r"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
      p AS (SELECT source, sum(size) AS source_size FROM s GROUP BY source), o AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM p),
      l AS (SELECT *, sum(2 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone, sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w, 1.5 * sum(source_size) OVER () AS every FROM o),
      v AS (SELECT min(CASE WHEN (every - coalesce(gone, 0)) / left_w * w <= 2 * source_size THEN {'k': source_size / w, 'level': (every - coalesce(gone, 0)) / left_w} END).level AS level FROM l)
      SELECT doc_id, size, source_size, least(2 * source_size, w * level) AS target FROM s JOIN o ON s.source IS NOT DISTINCT FROM o.source, v""").fetchall()
    got = mixing.copies(spark.createDataFrame([tuple(None if isinstance(v, float) else v for v in x) for x in docs.astype(object).where(docs.notna(), None).itertuples(index=False)], "doc_id long, text string, source string")).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == sorted((d, n, int(m), round(float(t), 6)) for d, n, m, t in want)


def test_mix_takes_rows_without_or_with_equal_ids(spark):
    docs = [(None, "w " * n, "a", n) for n in range(1, 30)] + [(None, "w " * 7, "a", 100 + k) for k in range(9)] + [(5, "x y", "b", 1), (5, "x y z", "b", 2), (5, "x y", "b", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, hash int").repartition(3)
    chosen = sum(r["copies"] for r in mixing.copies(df).collect())
    out = mixing.mix(df).collect()
    assert len(out) == chosen and set(map(tuple, out)) <= set(docs)
    assert all(out.count(x) <= 2 * docs.count(tuple(x)) for x in out)


def test_mix_repeats_rows_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([(k, "w " * 5, "a", k) for k in range(40)], "doc_id long, text string, source string, size int")
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == 60
    assert mixing.copies(spark.createDataFrame([], brute.SCHEMA)).count() == 0


PAGES = [(1, "http://a/", "<p>" + "x" * 200), (2, "http://b/\r\nX: y", "<p>" + "x" * 200), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "é" * 50), (9, "u", "é" * 50), (8, "u", "WARC/1.1\r\n\r\n" * 30), (10, "u", "z" * 300_000)]


def test_archives_round_trip(spark, tmp_path):
    scratch = Scratch(spark)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(df, f"{tmp_path}/warc", frame_bytes=300, bundle_bytes=900, scratch=scratch)
    rows = {r["page_id"]: r for r in warc.read_archives(spark, index).collect()}
    assert len(rows) == len(PAGES)
    for page_id, _, html in PAGES:
        raw, r = (html or "").encode(), rows[page_id]
        first = min(p for p, _, h in PAGES if (h or "") == (html or ""))
        revisit = len(raw) >= 100 and first < page_id
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]) == raw
    found = warc.look_up(index, [7, 10]).collect()
    assert {r["page_id"] for r in found} == {7, 10}


def test_bundles_are_plain_zstandard(tmp_path):
    import zstandard

    w = warc.BundleWriter(frame_bytes=50)
    places = [w.add(warc.record(k, "u", b"payload %d" % k, None)) for k in range(5)]
    (tmp_path / "b.zst").write_bytes(w.close())
    plain = zstandard.ZstdDecompressor().stream_reader(open(tmp_path / "b.zst", "rb"), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1") == 5
    reader = warc.BundleReader(str(tmp_path / "b.zst"))
    assert [reader.record(*p)["payload"] for p in places] == [b"payload %d" % k for k in range(5)]


def test_archives_of_nothing(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/none")
    assert index.count() == 0 and warc.read_archives(spark, index).count() == 0


def test_archives_keep_other_payloads_of_an_id(spark, tmp_path):
    p, q = "p" * 150, "q" * 150
    pages = [(3, "u", p), (7, "u", p), (7, "u", q), (7, "u", p), (None, "u", p), (None, "u", q), (9, "u", q), (3, "u", "r" * 99)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    for few in (200_000, 0):
        warc.BROADCAST_REVISITS, kept = few, warc.BROADCAST_REVISITS
        rows = warc.read_archives(spark, warc.write_archives(df, f"{tmp_path}/warc{few}")).collect()
        warc.BROADCAST_REVISITS = kept
        want = []
        for page_id, _, html in pages:
            first = min(i for i, _, h in pages if h == html and i is not None)
            again = len(html) >= 100 and page_id is not None and first < page_id
            want.append((page_id, hashlib.sha256(html.encode()).hexdigest(), "revisit" if again else "response", first if again else None, None if again else html.encode()))
        got = [(r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"])) for r in rows]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_mix_deals_a_hot_text_under_null_ids(spark, monkeypatch):
    """One text as a third of all rows, without ids: the same copies in any order, and no task with more than a tenth of the rows."""
    monkeypatch.setattr(mixing, "RUN", 512)
    r = random.Random(31)
    docs = [(None, "the same text again", "a", k % 3) for k in range(30_000)] + [(k if k % 7 else None, " ".join(["w"] * r.randint(1, 40)) + f" {k}", r.choice("aab"), 0) for k in range(60_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars int")
    seen = []
    for parts in (3, 16):
        out = mixing.copies(df.repartition(parts))
        per = out.groupBy("doc_id", "hash", "source", "copies").count().collect()
        seen.append(sorted((tuple(x) for x in per), key=str))
    assert seen[0] == seen[1] and sum(x[-1] for x in seen[0]) == len(docs)
    chosen = {(x[1], x[3]): x[4] for x in seen[0] if x[0] is None}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        mixed = mixing.mix(df.repartition(16))
        sizes = [x["count"] for x in mixed.groupBy(F.spark_partition_id()).count().collect()]
        hot = mixed.where("text = 'the same text again'").groupBy("n_chars").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    taken = sum(k * n for (h, k), n in chosen.items() if n > 1000)
    assert abs(sum(x["count"] for x in hot) - taken) <= 60_000 and sum(sizes) == sum(x[3] * x[4] for x in seen[0])
    assert max(sizes) <= 0.1 * sum(sizes)
    assert len({x["n_chars"] for x in hot}) == 3
