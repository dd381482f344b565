"""Near duplicates and repeated passages against all pairs and all windows."""

import random

import numpy as np
import pyarrow as pa

from skein.llm import components, ngram_join, suffix_dedup
from skein.llm.queries import op2_ngram_join, op4_suffix_dedup
from skein.llm.shared import Scratch

from . import brute


def write(spark, tmp_path, docs):
    spark.createDataFrame(docs, brute.SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_ngram_join_odd_cases(spark, tmp_path):
    docs = brute.odd_documents()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op2_ngram_join(spark, write(spark, tmp_path, docs)).collect()}
    assert got == brute.near_duplicates([(d[0], d[1]) for d in docs])


def test_ngram_join_chains_and_repeated_rows(spark, tmp_path):
    r = random.Random(1)
    ws = [f"v{k}" for k in range(120)]
    docs = []
    for k in range(30):  # a drifting chain: neighbours link, its ends do not
        docs.append((100 - k, " ".join(ws), "en", "s", 1))
        ws = ws[2:] + [f"n{k}a", f"n{k}b"]
    docs += [docs[0], (7, " ".join(r.sample(ws, 100)), "en", "s", 1)]
    rows = op2_ngram_join(spark, write(spark, tmp_path, docs)).collect()
    want = brute.near_duplicates({d[0]: d[1] for d in docs}.items())
    assert len(rows) == len(docs)
    assert all((x["n_shingles"], x["component_id"]) == want[x["doc_id"]] for x in rows)


def test_ngram_join_empty_table(spark, tmp_path):
    assert op2_ngram_join(spark, write(spark, tmp_path, [])).count() == 0


def test_ngram_join_rows_without_or_with_equal_ids(spark, tmp_path):
    r = random.Random(11)
    words = lambda n: [r.choice(["ab", "cd", "ef", "gh"]) + str(r.randrange(400)) for _ in range(n)]
    ws = words(100)
    rows = []
    for k, d in enumerate((9, None, 4, None, 9)):  # a chain through rows without an id; one id with two texts
        rows.append((d, " ".join(ws[2 * k :] + [f"n{j}" for j in range(2 * k)])))
    rows += [(None, " ".join(words(50))), (4, "x y"), (None, "X Y"), (None, None), (None, ""), (3, " "), (3, " ".join(words(40)))]
    numbered = brute.near_duplicates(enumerate(t for _, t in rows))
    groups = {}
    for k, (_, c) in numbered.items():
        groups.setdefault(c, []).append(rows[k][0])
    least = lambda c: min((d for d in groups[c] if d is not None), default=None)
    got = op2_ngram_join(spark, write(spark, tmp_path, [(d, t, None, None, None) for d, t in rows])).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((rows[k][0], n, least(c))) for k, (n, c) in numbered.items())


def test_ngram_join_long_words_that_a_polynomial_confuses(spark, tmp_path):
    a = "a"
    while len(a) < 1024:  # equal modulo 2 ** 64 under every odd base
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = [(1, a), (2, b), (3, a), (4, f"x {a} y z u v"), (5, f"x {b} y z u v")]
    got = {x["doc_id"]: x["component_id"] for x in op2_ngram_join(spark, write(spark, tmp_path, [(d, t, None, None, None) for d, t in docs])).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_ngram_join_deals_common_keys(spark, tmp_path, monkeypatch):
    from skein.llm import shared

    for module in (shared, ngram_join, components):
        monkeypatch.setattr(module, "hot_limit", lambda rows: 3)
        monkeypatch.setattr(module, "FEW", 0)
    docs = brute.odd_documents()
    docs += [(1000 + k, docs[7][1], None, None, None) for k in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op2_ngram_join(spark, write(spark, tmp_path, docs)).collect()}
    assert got == brute.near_duplicates([(d[0], d[1]) for d in docs])


def test_ngram_join_shuffles_only_segments_that_pairs_name(spark, monkeypatch):
    tokens = {row: np.arange(row % 5, row % 5 + 20, dtype=np.uint64) for row in range(200)}
    rows = [(row, f, 10, t[10 * f : 10 * f + 10].tobytes()) for row, t in tokens.items() for f in (0, 1)]
    segments = spark.createDataFrame(rows, "row long, fragment int, low int, tokens binary")
    pairs = spark.createDataFrame([(5, 0, 20, 20), (6, 0, 20, 20), (9, 0, 20, 20), (7, 2, 20, 20)], "d long, p long, n int, pn int")
    shuffled, candidates = [], ngram_join._candidates
    monkeypatch.setattr(ngram_join, "_candidates", lambda some, wanted: shuffled.append(candidates(some, wanted).count()) or candidates(some, wanted))
    linked = ngram_join.verify(Scratch(spark), pairs, segments, "links")
    assert sorted(map(tuple, linked.collect())) == [(5, 0), (6, 0), (7, 2)]
    assert len(shuffled) == 4 and max(shuffled) < 20  # of 200 segments, the four of one side and those that fall on their bits


def test_ngram_join_has_one_python_worker_for_a_task(spark, monkeypatch):
    tokens = {row: np.arange(row % 5, row % 5 + 20, dtype=np.uint64) for row in range(40)}
    rows = [(row, f, 10, t[10 * f : 10 * f + 10].tobytes()) for row, t in tokens.items() for f in (0, 1)]
    scratch = Scratch(spark)
    segments = scratch.save(spark.createDataFrame(rows, "row long, fragment int, low int, tokens binary"), "segments")
    pairs = scratch.save(spark.createDataFrame([(row, 0, 20, 20) for row in range(5, 40)], "d long, p long, n int, pn int"), "pairs")
    plans, overlaps = [], ngram_join._overlaps

    def planned(joined):
        df = overlaps(joined)
        df.collect()  # the plan as it is after what Spark changes while it runs
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return df

    monkeypatch.setattr(ngram_join, "_overlaps", planned)
    for most in (1024, 3):  # few partners of the pivot, and some that are dealt
        monkeypatch.setattr(ngram_join, "hot_limit", lambda rows, most=most: most)
        linked = ngram_join.verify(scratch, pairs, segments, f"links_{most}")
        assert sorted(map(tuple, linked.collect())) == [(row, 0) for row in range(5, 40) if row % 5 < 2]
    assert len(plans) == 4
    for plan in plans:
        above: list[tuple[int, bool]] = []  # of the nodes above: depth, and whether Python runs in their stage
        for line in plan.splitlines():
            name = line.lstrip(" :+-*(0123456789)")
            depth = len(line) - len(line.lstrip(" :+-"))
            while above and above[-1][0] >= depth:
                above.pop()
            python = bool(above) and above[-1][1] and not name.startswith(("Exchange", "BroadcastExchange"))
            assert not (python and name.startswith("MapInArrow")), plan
            above.append((depth, python or name.startswith("MapInArrow")))
        assert plan.count("MapInArrow") >= 3, plan


def test_ngram_join_shingles_little_at_a_time(monkeypatch):
    sizes, shingles = [], ngram_join._shingles
    monkeypatch.setattr(ngram_join, "_shingles", lambda data, offsets: sizes.append(len(data)) or shingles(data, offsets))
    texts = [f"{k} " * 5000 for k in range(200)]
    frame = type("Frame", (), {"mapInArrow": lambda self, run, schema: run})()
    run = ngram_join._sets(frame, 4)
    ids = pa.array(range(200), pa.int64())
    out = list(run([pa.RecordBatch.from_arrays([ids, ids, ids, ids, pa.array(texts)], names=["row", "doc", "k1", "k2", "text"])]))
    assert sum(b.num_rows for b in out) >= 200 and sum(sizes) == sum(map(len, texts))
    assert max(sizes) <= 1 << 18


def test_shingle_sets_need_no_neighbours():
    texts = ["a b c d e f", "", "A  b\tc", "x", "a b c d e f a b c d e f"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    hashes, counts = ngram_join.shingle_sets(data, offsets)
    assert counts.tolist() == [len(brute.shingles(t)) for t in texts]
    alone, _ = ngram_join.shingle_sets(np.frombuffer(raw[0], np.uint8), np.array([0, len(raw[0])]))
    assert hashes[: counts[0]].tolist() == alone.tolist()


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (3, 1), (8, 20), (30, 30)]
    got = components.components(Scratch(spark), spark.createDataFrame(edges, "u long, v long"), "t").collect()
    assert {(r["node"], r["component"]) for r in got} == {(5, 1), (4, 1), (3, 1), (9, 8), (20, 8)}


def test_suffix_dedup_odd_cases(spark, tmp_path):
    docs = brute.odd_documents()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op4_suffix_dedup(spark, write(spark, tmp_path, docs)).collect()}
    assert got == brute.remove_repeats([(d[0], d[1]) for d in docs])


def test_suffix_dedup_overlaps_periods_and_pieces(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    letters = lambda n: "".join(r.choices("abcdef ", k=n))
    p = letters(450)
    docs = [(1, letters(300) + p[:260] + letters(50)), (2, p[50:450] + letters(10)), (3, p[200:] + p[:199]), (4, "ab" * 400), (5, letters(40) + "ab" * 120), (6, letters(3000) + p[100:310]), (7, p), (8, "ü" * 150)]
    docs = [(k, t, None, None, None) for k, t in docs]
    want = brute.remove_repeats([(d[0], d[1]) for d in docs])
    as_dict = lambda df: {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in df.collect()}
    assert as_dict(op4_suffix_dedup(spark, write(spark, tmp_path / "a", docs))) == want
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)  # texts over two pieces are cut, and nothing changes
    assert as_dict(op4_suffix_dedup(spark, write(spark, tmp_path / "b", docs))) == want


def test_suffix_dedup_empty_table_and_carried_columns(spark, tmp_path):
    assert op4_suffix_dedup(spark, write(spark, tmp_path, [])).count() == 0
    df = spark.createDataFrame([(1, "x" * 10, "mine", 4)], "doc_id long, text string, spans string, kept int")
    row = suffix_dedup.remove_repeats(df.withColumnsRenamed({"spans": "s", "kept": "k"}), carry=("s", "k")).first()
    assert (row["n_bytes"], row["s"], row["k"]) == (10, "mine", 4)


def test_suffix_dedup_rows_without_or_with_equal_ids(spark, tmp_path):
    r = random.Random(7)
    letters = lambda n: "".join(r.choices("abcdef ", k=n))
    t, u, v = letters(400), letters(500), letters(300)
    rows = [(None, t), (1, t), (None, u), (None, v), (2, u[100:350] + letters(60)), (2, letters(700)), (3, v), (3, v), (None, None), (4, letters(250)), (4, None)]
    want = brute.remove_repeats(enumerate(x for _, x in rows))
    got = op4_suffix_dedup(spark, write(spark, tmp_path, [(d, x, None, None, None) for d, x in rows])).collect()
    digest = lambda x: tuple(x)[1:]
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got) == sorted((str(rows[k][0]), *digest((k, *w))) for k, w in want.items())


def test_suffix_dedup_one_core_in_many_contexts(spark, tmp_path, monkeypatch):
    refined, plain = [], suffix_dedup._refined
    monkeypatch.setattr(suffix_dedup, "_refined", lambda *x: refined.append(1) or plain(*x))
    r = random.Random(8)
    letters = lambda n: "".join(r.choices("abcdefghij ", k=n))
    core, shared = letters(190), letters(150)
    docs = [(k, letters(r.randint(90, 160)) + core + letters(r.randint(90, 160))) for k in range(3000)]
    docs += [(5000 + k, letters(60) + shared[k:] + core + shared[: 20 * k] + letters(150)) for k in range(6)]
    want = brute.remove_repeats(docs)
    assert sum(x[1] > 0 for x in want.values()) >= 3
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in op4_suffix_dedup(spark, write(spark, tmp_path, [(k, t, None, None, None) for k, t in docs])).collect()}
    assert got == want and refined


def test_suffix_dedup_carries_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x" * 10, "mine", 4, 5)], "doc_id long, text string, spans string, kept int, `odd name` int")
    row = suffix_dedup.remove_repeats(df, carry=("spans", "kept", "odd name"), within="row").first()
    assert (row["n_bytes"], row["row"]["spans"], row["row"]["kept"], row["row"]["odd name"], bytes(row["kept"])) == (10, "mine", 4, 5, b"x" * 10)


def test_suffix_ranks_order_windows():
    data = np.frombuffer(b"banana bandana banana", np.uint8)
    starts = np.arange(len(data) - 5)
    rank = suffix_dedup.suffix_ranks(data, starts, 6)
    texts = [data[s : s + 6].tobytes() for s in starts]
    assert [sorted(set(texts)).index(t) for t in texts] == rank.tolist()
