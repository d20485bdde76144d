"""Connected components of an edge list, direction ignored (for per-component reports).

Alternating large-star and small-star steps: a large-star step hangs every larger neighbour of
a vertex onto the smallest of its neighbourhood, a small-star step does so with the smaller
ones. The edge set ends as one star per component, around its smallest id, after about the
logarithm of the longest component's size in steps. Each step is a pre-aggregated minimum per
vertex and one join back to the edges; vertices with more edges than a fair task's share are
joined by broadcast, as there are fewer of them than shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcover.plans.loop import checkpointed
from sparkcover.session import drop_path, shuffle_partitions


def join_to_many(many: DataFrame, one: DataFrame, key: str, n_rows: int, how: str = "inner") -> DataFrame:
    """``many`` with the row of ``one`` of the same ``key``; ``one.n`` counts a key's rows in ``many``.

    Keys of more than a fair share of the ``n_rows`` of ``many`` are joined by broadcast where
    their rows lie. The counts sum to ``n_rows``, so these are fewer than shuffle partitions.
    """
    share = -(-n_rows // shuffle_partitions(many.sparkSession))
    hot = F.broadcast(one.where(F.col("n") > share).drop("n"))
    rest = one.where(F.col("n") <= share).drop("n")
    return many.join(hot, key).unionByName(many.join(hot, key, "left_anti").join(rest, key, how), allowMissingColumns=True)


def _stars(links: DataFrame, n_links: int, larger: bool) -> DataFrame:
    """One large-star (``larger``) or small-star step on links ``(u, v)``, ``u > v``."""
    if larger:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        hung = join_to_many(both, least, "u", 2 * n_links).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), "m")
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        # (v, m) for each smaller neighbour, and the vertex itself in place of the pair that is m's own
        hung = join_to_many(links, least, "u", n_links).select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), "m"
        )
    return hung.select("u", F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every endpoint of ``edges (src, dst)``: the smallest id it can reach."""
    spark = edges.sparkSession
    vertices = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    links, folder = checkpointed(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )

    def state_of(frame: DataFrame) -> tuple:
        mark = F.xxhash64("u", "v").cast("decimal(38,0)")
        return tuple(frame.agg(F.count(F.lit(1)), F.sum(mark)).first())

    before, now = None, state_of(links)
    while now != before:  # a round of both steps that changes nothing is the last
        before = now
        for larger in (True, False):
            step, new_folder = checkpointed(_stars(links, now[0], larger))
            drop_path(spark, folder)
            links, folder = step, new_folder
            now = state_of(links)
    out = vertices.join(links.select(F.col("u").alias("id"), "v"), "id", "left").select(
        "id", F.coalesce("v", "id").alias("component")
    )
    out = out.checkpoint(eager=True)
    drop_path(spark, folder)
    return out
