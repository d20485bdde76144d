"""Edge store (T1, K1): a graph kept on shared storage in the layout that message steps need.

``save_edges`` pays for the placement once: edges bucketed and sorted by source, so that a
bucket is a shuffle partition of the vertex state; those of sources with more edges than a
fair bucket's share apart and evenly spread (their few states are broadcast); and the graph's
statistics. ``open_edges`` gives an ``EdgeSet`` that reads them as they lie: a message step on
it exchanges messages only, in every job and session that opens the store.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcover.operators.neighbors import EdgeSet, GraphStats, graph_stats
from sparkcover.session import drop_path, shuffle_partitions


def _table(spark: SparkSession, path: str, buckets: int) -> str:
    """The bucketed files at ``path`` as a table of this session's catalog."""
    name = "edges_" + re.sub(r"\W", "_", uuid.uuid4().hex)
    spark.sql(
        f"CREATE TABLE {name} (src BIGINT, dst BIGINT) USING parquet "
        f"CLUSTERED BY (src) SORTED BY (src) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return name


def store_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stats/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_edges(edges: DataFrame, path: str, buckets: int | None = None) -> None:
    """Write ``edges (src, dst)`` to the folder ``path`` on shared storage, which must not exist.

    ``buckets`` should be the ``spark.sql.shuffle.partitions`` of the jobs that will read it
    (the default: this session's). The statistics are written last: without them there is no
    store, and what an unfinished try left is replaced.
    """
    spark = edges.sparkSession
    if store_exists(spark, path):
        raise ValueError(f"there is an edge store at {path} already")
    drop_path(spark, path)
    buckets = buckets or shuffle_partitions(spark)
    edges = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
    edges.write.parquet(f"{path}/raw")  # read once, however often it is gone through below
    raw = spark.read.parquet(f"{path}/raw")
    stats = graph_stats(raw)
    share = max(1, -(-stats.n_edges // buckets))
    hot = raw.groupBy("src").agg(F.count(F.lit(1)).alias("deg")).where(F.col("deg") > share).select("src")
    hot.write.parquet(f"{path}/hot_ids")
    hot = F.broadcast(spark.read.schema("src bigint").parquet(f"{path}/hot_ids"))  # fewer than buckets
    raw.join(hot, "src", "left_semi").select("src", "dst").write.parquet(f"{path}/hot")
    name = _table(spark, f"{path}/cold", buckets)
    cold = raw.join(hot, "src", "left_anti").select("src", "dst").repartition(buckets, "src").sortWithinPartitions("src")
    cold.write.insertInto(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: the files stay
    row = [(buckets, *[getattr(stats, c) for c in GraphStats.__dataclass_fields__])]
    fields = ", ".join(f"{c} bigint" for c in ("buckets", *GraphStats.__dataclass_fields__))
    drop_path(spark, f"{path}/raw")
    spark.createDataFrame(row, fields).coalesce(1).write.parquet(f"{path}/stats")


def open_edges(spark: SparkSession, path: str, *, broadcast_bytes: int | None = None) -> EdgeSet:
    """The graph of a store as an ``EdgeSet``; ``release`` lets go of it and leaves the store."""
    row = spark.read.parquet(f"{path}/stats").first()
    stats = GraphStats(**{c: row[c] for c in GraphStats.__dataclass_fields__})
    name = _table(spark, f"{path}/cold", row["buckets"])
    hot, cold = spark.read.parquet(f"{path}/hot"), spark.table(name)
    ids = spark.read.schema("src bigint").parquet(f"{path}/hot_ids")
    return EdgeSet(
        hot.unionByName(cold), stats, split=(ids, hot, cold), n_parts=int(row["buckets"]), broadcast_bytes=broadcast_bytes,
        on_release=lambda: spark.sql(f"DROP TABLE IF EXISTS {name}"),
    )
