"""Edge partitioning (T1-T4): place edges by a 1D or 2D strategy before a graph job.

The partition id is a column expression (``functions.graph``); placing rows is
``repartitionById``, which sends each row straight to partition ``pid`` (the
hash of a small int id modulo n is the id itself in the graph library, so this is
the same placement). Partitioning never changes a result, only where work runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcover.functions.graph import partition_1d, partition_2d

STRATEGIES = ("none", "1d", "2d")


def with_partition_id(edges: DataFrame, strategy: str, n: int) -> DataFrame:
    """Add ``pid int`` to the edges for the given strategy (``"1d"`` or ``"2d"``)."""
    if strategy == "1d":
        return edges.withColumn("pid", partition_1d(F.col("src"), n))
    if strategy == "2d":
        return edges.withColumn("pid", partition_2d(F.col("src"), F.col("dst"), n))
    raise ValueError(f"unknown partition strategy {strategy!r}; use one of {STRATEGIES}")


def partition_edges(edges: DataFrame, strategy: str, n: int) -> DataFrame:
    """Edges placed into ``n`` partitions by the strategy; ``"none"`` keeps the input layout."""
    if strategy in ("none", None, 0):
        return edges
    placed = with_partition_id(edges, strategy, n)
    return placed.repartitionById(int(n), F.col("pid")).drop("pid")


def partition_sizes(edges: DataFrame, strategy: str, n: int) -> DataFrame:
    """Edges per partition after placement: ``(pid int, n_edges bigint)``.

    Rows are tagged with the partition they actually landed in
    (``spark_partition_id()``), so this measures the placement, not the formula.
    """
    placed = with_partition_id(edges, strategy, n).repartitionById(int(n), F.col("pid"))
    return placed.groupBy(F.spark_partition_id().alias("pid")).agg(
        F.count(F.lit(1)).alias("n_edges")
    )
