"""Edge sources and graph derivation.

A graph is a DataFrame of directed edges ``(src bigint, dst bigint)``; its vertices
are the distinct endpoints. Undirected graphs list both directions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcover.session import shuffle_partitions


def parse_edge_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Parse edge-list text rows into ``(src, dst)``.

    Rules of an edge-list file: empty lines and lines starting with ``#`` are
    skipped, the rest is split on runs of whitespace, the first two tokens are
    the endpoints and further tokens are ignored. A line with fewer than two
    tokens or a token that is not an integer is an error. Duplicates and
    self-loops are kept.
    """
    value = F.col(col)
    body = lines.where((value != F.lit("")) & ~value.startswith("#"))
    tokens = F.split(value, r"\s+")
    parsed = body.select(
        value.alias("_line"),
        F.when(F.size(tokens) < 2, F.raise_error(F.concat(F.lit("Invalid line: "), value)))
        .otherwise(tokens)
        .alias("_t"),
    )
    src = F.col("_t")[0].try_cast("bigint")
    dst = F.col("_t")[1].try_cast("bigint")
    bad = F.raise_error(F.concat(F.lit("Invalid vertex id in line: "), F.col("_line")))
    return parsed.select(
        F.when(src.isNull(), bad).otherwise(src).cast("bigint").alias("src"),
        F.when(dst.isNull(), bad).otherwise(dst).cast("bigint").alias("dst"),
    )


def read_edge_list(spark: SparkSession, path: str, num_partitions: int | None = None) -> DataFrame:
    """Read an edge-list text file (or folder) into ``(src, dst)``.

    The scan is split by Spark's own settings (``spark.sql.files.maxPartitionBytes``,
    ``spark.sql.files.minPartitionNum``); text is never shuffled. ``num_partitions``
    deals the parsed pairs of numbers to that many partitions.
    """
    edges = parse_edge_lines(spark.read.text(path))
    return edges.repartition(int(num_partitions)) if num_partitions else edges


def vertices_from_edges(edges: DataFrame) -> DataFrame:
    """Distinct endpoints of the edges: ``(id bigint)``."""
    return (
        edges.select(F.col("src").alias("id"))
        .union(edges.select(F.col("dst").alias("id")))
        .distinct()
    )


def graph_size(edges: DataFrame) -> DataFrame:
    """One row ``(n_vertices bigint, n_edges bigint)``.

    One shuffle: endpoints are grouped by id with their out-degree, then summed.
    """
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("e")).union(
        edges.select(F.col("dst").alias("id"), F.lit(0).alias("e"))
    )
    per_vertex = ends.groupBy("id").agg(F.sum("e").alias("out"))
    return per_vertex.agg(
        F.count(F.lit(1)).alias("n_vertices"),
        F.coalesce(F.sum("out"), F.lit(0)).cast("bigint").alias("n_edges"),
    )


def symmetrize(edges: DataFrame, drop_loops: bool = True) -> DataFrame:
    """Both directions of every edge, duplicates removed (one shuffle)."""
    both = edges.select("src", "dst").union(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    if drop_loops:
        both = both.where(F.col("src") != F.col("dst"))
    return both.distinct()


def bipartite_edges(table: DataFrame, left: str, right: str) -> DataFrame:
    """Symmetric simple graph linking ``left`` and ``right`` values of a table.

    Ids are made disjoint as ``2*left`` and ``2*right + 1``. Because forward edges
    have even sources and reverse edges odd ones, de-duplicating the forward
    pairs once is enough: one shuffle for the whole graph. The pairs are dealt before they are
    made distinct, in ``spark.sql.shuffle.partitions`` parts that stay: a hash table then holds a
    part's pairs, not those of a whole file split or of many merged parts.
    """
    n_parts = shuffle_partitions(table.sparkSession)
    fwd = (
        table.where(F.col(left).isNotNull() & F.col(right).isNotNull())
        .select(
            (F.col(left).cast("bigint") * F.lit(2)).alias("src"),
            (F.col(right).cast("bigint") * F.lit(2) + F.lit(1)).alias("dst"),
        )
        .repartition(n_parts, "src", "dst")
        .distinct()
    )
    # one pass for both directions: a union would read the pairs and make them distinct twice
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return fwd.select(F.inline(both))


def edge_lines(edges: DataFrame) -> DataFrame:
    """Edge-list text rows ``"<src> <dst>"`` (``value string``), the inverse of the scan."""
    return edges.select(F.format_string("%d %d", "src", "dst").alias("value"))
