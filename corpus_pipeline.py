"""A training corpus from `documents` in five stages; run() applies them, each to what the one before wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup
from skein.llm.shared import Scratch

def whole_row(docs: DataFrame) -> Column:
    """All columns as one, so that none meets an operator's own of the same name."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    judged = quality_rules.judge_quality(docs.select("text", whole_row(docs)))
    return judged.where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: the smallest id, null ones last, and of equal rows any one."""
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; a character that loses some of its bytes becomes U+FFFD. A text may become empty, its document stays."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = suffix_dedup.remove_repeats(docs, carry=others, within="row")
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; a copy is a row."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_tokens, batch, slot) of each row."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: Components, suffix arrays and a convex dual are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage_{k}")
            scratch.drop(f"stage_{k - 1}")
            scratch.free_shuffles()
    return docs
