"""Registered queries of the corpus operators: each operator on its whole table.

The functions are thin: they apply an operator with production parameters and
derive the digest columns from its real outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from sparkcover.llm import oracle
from sparkcover.llm.ann import nearest_neighbours
from sparkcover.llm.common import read_table, written
from sparkcover.llm.decontaminate import mark_benchmark
from sparkcover.llm.langid import fit_dictionaries, identify
from sparkcover.llm.licenses import scan_licenses
from sparkcover.llm.packing import pack
from sparkcover.llm.prefix_trie import prefix_trie
from sparkcover.llm.ranked_search import ranked_search
from sparkcover.llm.sharding import shuffle_into_shards
from sparkcover.llm.simhash import near_duplicate_groups
from sparkcover.llm.substring import remove_repeated_passages
from sparkcover.llm.token_counts import count_tokens
from sparkcover.llm.toxicity import SAMPLE_ROWS, calibrate, learn_lexicon, match_lexicon, score_of
from sparkcover.llm.urls import judge_urls

SHARDS = 40
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]

LICENSE_PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of sizes at most one row apart, uniformly shuffled."""
    out = shuffle_into_shards(read_table(spark, sf_dir, "documents"), SHARDS)
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    out = judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    labels = read_table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    lexicon = learn_lexicon(docs, labels, doc_id="doc_id", text="text", label="toxic", sample_rows=SAMPLE_ROWS)
    matched = written(match_lexicon(docs, lexicon, carry=["doc_id"]), "lexicon-matches")
    exponent, shares = calibrate(matched, labels, doc_id="doc_id", label="toxic")
    score = score_of(F.col("raw"), F.col("n_words"), exponent, shares)
    return matched.select(
        "doc_id",
        held_out.alias("held_out"),
        score.alias("score"),
        (score >= 0.7).cast("int").alias("predicted"),
        "n_hits",
        "raw",
        "n_words",
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when 13-word passages of earlier documents go."""
    out = remove_repeated_passages(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every embedding whose id is divisible by 20."""
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), 20, query_every=20)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    out = near_duplicate_groups(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "fingerprint", "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document lies inside a window of the benchmark."""
    out = mark_benchmark(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), carry=["doc_id"]
    )
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2048."""
    out = pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
    return out.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of the whole text."""
    return count_tokens(
        read_table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        carry=["doc_id"],
    )


def language_held_out() -> Column:
    """True for the rows whose labels language identification doesn't learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = language_held_out()
    out = identify(docs, fit_dictionaries(docs, ~held_out), carry=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return scan_licenses(read_table(spark, sf_dir, "documents"), LICENSE_PHRASES, carry=["doc_id"]).drop("detections")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that score highest for each benchmark item."""
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=20)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt behind the head of its group's first."""
    return prefix_trie(
        read_table(spark, sf_dir, "conversations"),
        base=lambda c: c - c % 20,
        head_turns=lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)),
        max_head=3,
    ).drop("turn_conv_id", "turn_no")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_url_filters": op2_url_filters,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_license_scan": op11_license_scan,
    "op12_ranked_search": op12_ranked_search,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op7_decontamination": oracle.DECONTAMINATION,
    "op12_ranked_search": oracle.RANKED_SEARCH,
    "op13_prefix_trie": oracle.PREFIX_TRIE,
}
