"""Word and character counts.

The whole chain is one lazy DataFrame:
``lines -> explode(words) -> groupBy(word).count -> where n >= t -> explode(chars)
-> groupBy(ch).count``. Both aggregations are hash aggregates with a map-side
partial step, so a word that holds a third of all tokens is pre-summed in every
task before the shuffle and never concentrates raw rows in one reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcover.functions.text import split_chars, split_words


def tokenize(lines: DataFrame, line_col: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per word: ``(*keep, word string)``."""
    return lines.select(*keep, F.explode(split_words(F.col(line_col))).alias("word"))


def doc_word_count(lines: DataFrame, doc_col: str = "doc_id", line_col: str = "line") -> DataFrame:
    """Occurrences of each word per document: ``(doc_id, word, n bigint)``."""
    return (
        tokenize(lines, line_col, keep=(doc_col,))
        .groupBy(doc_col, "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def word_count(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Occurrences of each word: ``(word string, n bigint)``."""
    return tokenize(lines, line_col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def popular_words(counts: DataFrame, threshold: int) -> DataFrame:
    """Words whose count is at least ``threshold``."""
    return counts.where(F.col("n") >= F.lit(int(threshold)))


def explode_chars(words: DataFrame, word_col: str = "word") -> DataFrame:
    """One row per character of each word: ``(word, pos int, ch string)``, pos from 1."""
    return words.select(
        F.col(word_col).alias("word"), F.posexplode(split_chars(F.col(word_col))).alias("p", "ch")
    ).select("word", (F.col("p") + 1).cast("int").alias("pos"), "ch")


def char_count(words: DataFrame, word_col: str = "word") -> DataFrame:
    """Occurrences of each character over the given words: ``(ch string, n bigint)``.

    Every row of ``words`` contributes its characters once, whatever its count.
    """
    return (
        words.select(F.explode(split_chars(F.col(word_col))).alias("ch"))
        .groupBy("ch")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def popular_char_count(lines: DataFrame, threshold: int, line_col: str = "line") -> DataFrame:
    """Characters of the words seen at least ``threshold`` times: ``(ch, n bigint)``.

    Each distinct popular word contributes its characters once (not weighted by
    the word's count).
    """
    return char_count(popular_words(word_count(lines, line_col), threshold))
