"""Every query with SQL against DuckDB on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from skein import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(plans.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_diff_lines_as_a_walk(spark):
    def diff(a, b):
        p = s = 0
        while p < min(len(a), len(b)) and a[p] == b[p]:
            p += 1
        while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
            s += 1
        rows = [f"  {k + 1:4}  {x}" for k, x in enumerate(a) if max(0, p - 3) <= k < p]
        rows += [f"- {k + 1:4}  {x}" for k, x in enumerate(a) if p <= k < len(a) - s]
        rows += [f"+ {k + 1:4}  {x}" for k, x in enumerate(b) if p <= k < len(b) - s]
        rows += [f"  {k + 1:4}  {x}" for k, x in enumerate(a) if len(a) - s <= k < len(a) - s + 3]
        return len(b) - p - s, len(a) - p - s, "\n".join(rows[:200] + ["  … (diff truncated at 200 lines)"] * (len(rows) > 200))

    texts = {r["doc_id"]: r["text"].split("\n") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["additions"], r["removals"], r["text"]) for r in plans.QUERIES["diff_lines"](spark, SF).collect()}
    assert got == {k: diff(a, [x + " changed" if i == 1 else x for i, x in enumerate(a)]) for k, a in texts.items()}


def test_extracts_reads_whole_texts(spark, tmp_path):
    texts = [" long " * 50, "a\n<summary>b</summary> c", "", "x" * 61 + "</summary>", "\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["summary"] for r in plans.QUERIES["extracts"](spark, str(tmp_path)).collect()}
    assert got == {k: f"{t}</summary>".split("</summary>", 1)[0].strip() for k, t in enumerate(texts)}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
