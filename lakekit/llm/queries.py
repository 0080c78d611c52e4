"""The operators applied to their whole tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lakekit.llm import (
    alignment,
    maintext,
    minhash,
    mixing,
    negatives,
    packing,
    permutation,
    quality,
    substring,
    tokens,
    toxicity,
    urls,
    warc,
)
from lakekit.llm.scratch import Scratch
from lakekit.session import stored

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
URL_RULES = [
    urls.UrlRule("allow", "org/"),
    urls.UrlRule("block", "example.org/es/"),
    urls.UrlRule("block", "example.org/en/1"),
    urls.UrlRule("allow", "com/fr/"),
    urls.UrlRule("block", "com/de/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stored(quality.ledger(_table(spark, sf_dir, "documents")), "quality-ledger")
    base, strict = quality.fails(quality.BASE), quality.fails(quality.STRICT)
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & ~strict).alias("kept"),
        "failed_bits",
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "token-planes") as work:
        target = f"{work.path}/files"
        tokens.write_ids(_table(spark, sf_dir, "documents"), target, TOKENIZER, end_id=2)
        read = tokens.read_ids(spark, target)
        return stored(read.select("doc_id", "start", "n_tokens", "ids_crc32"), "token-planes")


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER, end_id=1, capacity=4096)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.without_repeats(_table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), target_entropy=0.97, max_repeats=4.0)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.archive(_table(spark, sf_dir, "pages"), min_bytes=0)
    return merged.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "file", "offset"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.severity_model(docs, _table(spark, sf_dir, "labels"))
    return toxicity.severities(docs, model)


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def alignment_digests(aligned: DataFrame) -> DataFrame:
    """Aligned documents with the hash of their groups in place of the groups; no tokens have an empty one."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.withColumn("groups_sha256", digest).drop("groups")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(
        _table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        derive=alignment_digests,
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    values = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")))
    rows = negatives.finite(vectors, "embedding").select("vec_id", moved.alias("label"), values.alias("vector"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_token_planes": op3_token_planes,
    "op4_permutation_index": op4_permutation_index,
    "op5_url_filters": op5_url_filters,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_temperature_mixing": op8_temperature_mixing,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op11_main_text": op11_main_text,
    "op12_token_alignment": op12_token_alignment,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op1_quality_rules": rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)),
                    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), windows AS (
            SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
            FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)
        ), twins AS (
            SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1
        ), places AS (
            SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twins) GROUP BY r
        ), m AS (
            SELECT doc_id, len(w) AS n_words,
                coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                coalesce(places.n, 0) AS n_repeat_words
            FROM docs LEFT JOIN places USING (r)
        ), bits AS (
            SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
                + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 4 ELSE 0 END
                + CASE WHEN 100 * n_symbols > 50 * n_words THEN 8 ELSE 0 END
                + CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END
                + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed_bits
            FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            failed_bits & 3 <> 0 AS base_failed, failed_bits & 63 = 0 AS kept, failed_bits
        FROM bits""",
}
