"""Popular-character count over a stream of text files (Structured Streaming).

The reference only reads text in batch. This is the same query (tokenize, count
words, keep the popular ones, count their characters) on a ``readStream`` text
source, for corpora that keep arriving. Word counts are the only state: a
streaming aggregation (``complete`` mode, state store checkpointed to the
query's checkpoint location); the character count over the popular words is
recomputed from that state in each micro-batch with ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcover.operators.wordcount import char_count, popular_words, word_count


def stream_word_counts(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``(word, n)`` over the text files arriving in ``path``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    lines = reader.load(path).select(F.col("value").alias("line"))
    return word_count(lines)


def start_popular_char_count(
    spark: SparkSession,
    path: str,
    threshold: int,
    checkpoint_location: str,
    sink: Callable[[DataFrame, int], None],
    trigger_once: bool = False,
):
    """Start the streaming query; ``sink(char_counts_df, batch_id)`` gets each update.

    ``checkpoint_location`` must be shared storage on a cluster: the word-count
    state and the source offsets live there, so a restarted driver resumes.
    """
    counts = stream_word_counts(spark, path)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        sink(char_count(popular_words(batch, threshold)), batch_id)

    writer = (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint_location)
        .foreachBatch(on_batch)
    )
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
