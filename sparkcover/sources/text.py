"""Text sources: line scans of files and of a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcover.functions.text import split_lines


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of the text files at ``path``: ``(line string)``; blank lines kept."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of a text column: ``(doc_id, line_no int, line string)``, line_no from 1.

    Each document is treated like a small text file. The explode is a narrow,
    per-row generator: a 20,000-word document stays inside one task only as one
    row, which is what a file split would do too.
    """
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"),
    ).select("doc_id", (F.col("pos") + 1).cast("int").alias("line_no"), "line")
