"""Graph job runner (D1): read an edge list, place the edges, run a cover, write the result.

``run_task`` chains the sources, partitioning and cover plans with keyword
arguments in place of a command line. Unknown tasks and missing required
arguments raise ``ValueError``.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from sparkcover.operators.grid import GridEdgeSet
from sparkcover.operators.neighbors import EdgeSet
from sparkcover.operators.partition import partition_edges
from sparkcover.plans.greedy import (
    check_symmetric_simple,
    greedy_dominating_set,
    greedy_dominating_set_directed,
)
from sparkcover.plans.lp import fractional_dominating_set, lp_rounded_dominating_set_any, round_fractional_ds
from sparkcover.sources.edges import read_edge_list
from sparkcover.sources.sinks import write_result_text
from sparkcover.sources.store import open_edges, save_edges, store_exists

TASKS = ("greedy_cover", "lp_cover")
# Partition strategy codes of the LP task (0 none, 1 = 1D, 2 = 2D).
PART_STRATEGIES = {0: "none", 1: "1d", 2: "2d"}


def run_task(
    spark: SparkSession,
    task: str,
    path: str,
    *,
    num_partitions: int | None = None,
    output: str | None = None,
    k: int | None = None,
    delta: int | None = None,
    part_strat: int | None = None,
    seed: int = 42,
    report: dict | None = None,
    resume_dir: str | None = None,
    edge_store: str | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Run one graph task on the edge list at ``path``; returns the result DataFrame.

    * ``greedy_cover``: edges placed with the 2D strategy, greedy cover; any edge list.
      A symmetric simple one is run to convergence by rounds, result ``(id, color,
      halt_step)``; a one-way, repeated or looped one by the superstep-exact program,
      result ``(id, color, value, halt_step, converged)``.
    * ``lp_cover``: needs ``k``, ``delta`` and ``part_strat`` (0 none, 1 1D, 2 2D); any edge
      list, by passes or supersteps likewise; fractional cover then rounding; result
      ``(id, color, x)``.

    ``resume_dir``: a folder on shared storage, kept for this job; a job whose driver died goes
    on from its last commit there when it is started again.

    ``edge_store``: a folder on shared storage that keeps the graph placed by source in
    ``num_partitions`` buckets (``sources.store``). The first job with it reads ``path`` and
    fills it, later ones read it as it lies; the strategy then places nothing.

    With the 2D strategy the edges stay in the cells they are placed in and vertex states go
    to them (``operators.grid``). ``broadcast_bytes`` is the size up to which a state is
    broadcast instead (default: ``spark.sql.autoBroadcastJoinThreshold``).

    ``num_partitions`` is required for both, as the edge partition count.
    With ``output`` the result is also written as text rows ``id<TAB>(color,second)``;
    an existing folder there is an error. ``report`` (a dict) receives the graph size,
    the path taken (``rounds``, ``passes`` or ``supersteps``), ``converged`` and the algorithm's wall time.
    """
    if task not in TASKS:
        raise ValueError(f"Invalid task type: {task!r} (expected one of {TASKS})")
    if num_partitions is None:
        raise ValueError("num_partitions is required (number of edge partitions)")
    if task == "lp_cover":
        missing = [n for n, v in (("delta", delta), ("k", k), ("part_strat", part_strat)) if v is None]
        if missing:
            raise ValueError(f"lp_cover needs {', '.join(missing)}")
        if part_strat not in PART_STRATEGIES:
            raise ValueError("part_strat must be 0 (none), 1 (1D) or 2 (2D)")
        strategy = PART_STRATEGIES[part_strat]
    else:
        strategy = "2d"
    facts: dict = {}
    if edge_store:
        if not store_exists(spark, edge_store):
            save_edges(read_edge_list(spark, path), edge_store, int(num_partitions))
        es = open_edges(spark, edge_store, broadcast_bytes=broadcast_bytes)
    else:
        read = read_edge_list(spark, path)
        if strategy == "2d":  # the steps send on the placed edges
            es = GridEdgeSet(read, int(num_partitions), broadcast_bytes=broadcast_bytes)
        else:
            placed = partition_edges(read, strategy, int(num_partitions))
            es = EdgeSet(placed, materialize=True, broadcast_bytes=broadcast_bytes)
    try:
        facts |= {"n_vertices": es.stats.n_vertices, "n_edges": es.stats.n_edges}
        t0 = time.time()
        second = "halt_step"
        stats: dict = {}
        check = check_symmetric_simple(es.edges)
        simple = not (check["bad_pairs"] or check["loops"])
        if task == "lp_cover":
            if simple:
                frac = fractional_dominating_set(es, int(k), int(delta), validate=False, resume_dir=resume_dir)
                result = round_fractional_ds(es, frac, seed, validate=False)
            else:
                result = lp_rounded_dominating_set_any(es, int(k), int(delta), seed, resume_dir=resume_dir)
            facts |= {"path": "passes" if simple else "supersteps", "converged": True}
            second = "x"
        elif simple:
            result = greedy_dominating_set(es, validate=False, stats_out=stats, resume_dir=resume_dir)
            facts |= {"path": "rounds", "converged": True, "rounds": stats["rounds"]}
        else:
            result = greedy_dominating_set_directed(es, stats_out=stats, resume_dir=resume_dir)
            facts |= {"path": "supersteps", "converged": stats["converged"], "iterations": stats["iterations"]}
            second = "value"
        facts["seconds"] = round(time.time() - t0, 3)
    finally:
        es.release()
    if report is not None:
        report.update(facts)
    if output:
        write_result_text(result, output, second)
    return result
