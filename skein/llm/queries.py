"""Thin queries over the synthetic tables, one or two for each operator, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import (
    ann, fill_in_middle, language_id, license_scan, merkle, mixing, ngram_join, packing, quality_classifier, quality_rules, suffix_dedup, url_filter, warc,
)
from skein.llm.shared import Scratch, table
from skein.llm.sql import SQL  # noqa: F401


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_classifier.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size(F.filter("blocks", lambda b: b["lines"] == 1)).cast("long").alias("n_blocks"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), queries=lambda vec_id: vec_id % 20 == 0, top=20)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("hash")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    index = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{scratch.root}/warc", scratch=scratch)
    return warc.read_archives(spark, index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = F.sha2(fill_in_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), restored)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    proven = merkle.manifest(
        docs, ["doc_id", "source", "lang", "n_chars", "text"], group="lang", key="doc_id", tampered=chosen, changed={"n_chars": F.col("n_chars") + 1}, carry=("doc_id",)
    )
    proof = merkle.proof_digest(F.col("path")).alias("proof_sha256")
    return proven.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).select("lang", "text")
    return language_id.identify(docs.select("doc_id", "text"), train)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_ngram_join, op3_url_filter, op4_suffix_dedup, op5_license_scan, op6_nearest_neighbours, op7_packing, op8_quality_rules, op9_mixing, op10_warc,
        op11_fill_in_middle, op12_merkle_manifest, op13_language_id,
    )
}
