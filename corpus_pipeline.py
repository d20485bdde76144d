"""The training-data pipeline over ``documents``: five stages, each one operator.

Language identification, near-duplicate removal, removal of repeated passages, benchmark
decontamination, packing. Every stage takes what the one before it kept and judges all
of it; all but the last return the columns of ``documents``. Between stages the rows are
written as Parquet, so a lost executor never costs more than a stage's own tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcover.llm.common import read_table, written
from sparkcover.llm.decontaminate import mark_benchmark
from sparkcover.llm.langid import fit_dictionaries, identify
from sparkcover.llm.packing import pack
from sparkcover.llm.queries import language_held_out
from sparkcover.llm.simhash import near_duplicate_groups
from sparkcover.llm.substring import remove_repeated_passages


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: those with text whose margin isn't narrow."""
    found = identify(docs, fit_dictionaries(docs, ~language_held_out()))
    return found.where("accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return near_duplicate_groups(docs).where("representative").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; those that lose every word go."""
    out = remove_repeated_passages(docs).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    marked = mark_benchmark(docs, read_table(spark, sf_dir, "benchmark"))
    return marked.where(~F.col("contaminated")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("packed", packed),
]

#: Compression sizes, fingerprints and tokens are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
