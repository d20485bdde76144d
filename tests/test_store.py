"""Edge stores: the same graph back, and message steps that leave its edges where they lie."""

import random

import pytest
from pyspark.sql import functions as F

from sparkcover.operators import neighbors as nb
from sparkcover.plans.greedy import greedy_dominating_set
from sparkcover.plans.job import run_task
from sparkcover.sources.store import open_edges, save_edges, store_exists

from .simulate import both_ways, simulate_greedy
from .test_round2 import run_nodes

EDGE = "src bigint, dst bigint"


def hub_graph():
    rng = random.Random(3)
    pairs = {(0, i) for i in range(1, 80)} | {(rng.randrange(1, 80), rng.randrange(80, 120)) for _ in range(90)}
    return both_ways(sorted(pairs))


def test_same_graph_and_no_exchange_of_edges(spark, tmp_path):
    edges, path = hub_graph(), f"file:{tmp_path}/store"
    g = spark.createDataFrame(edges + edges[:3], EDGE)  # repeated edges are kept
    save_edges(g, path, buckets=6)
    assert store_exists(spark, path)
    with pytest.raises(ValueError, match="already"):
        save_edges(g, path)
    es = open_edges(spark, path, broadcast_bytes=0)
    assert sorted(map(tuple, es.edges.collect())) == sorted(edges + edges[:3])
    assert es.stats == nb.graph_stats(g) and es.n_parts == 6
    hot, hot_edges, cold_edges = es._hot_cold()
    assert 0 in {r.src for r in hot.collect()} and hot_edges.count() + cold_edges.count() == len(edges) + 3
    with es.loop_plans():
        state = es.partitioned(es.edges.select(F.col("src").alias("id")).distinct())
        state = state.select("id", (F.col("id") * 2).alias("v")).persist()
        state.count()
        got = es.aggregate(state, ["v"], [F.max("v").alias("m")])
        step = es.join_back(state, got).select("id", "m")
        rows = {r.id: r.m for r in step.collect()}
        names = run_nodes(step._jdf.queryExecution().executedPlan())
    assert names.count("Exchange") == 1 and "Sort" not in names, names
    want = {}
    for s, d in edges:
        want[d] = max(want.get(d, -1), 2 * s)
    assert rows == want
    state.unpersist()
    es.release()


def test_jobs_fill_a_store_once(spark, tmp_path):
    edges, path = both_ways([(1, 2), (2, 3), (3, 4), (1, 5)]), f"file:{tmp_path}/store"
    (tmp_path / "e.txt").write_text("\n".join(f"{a} {b}" for a, b in edges))
    expected, _, _ = simulate_greedy(edges)
    first = run_task(spark, "greedy_cover", str(tmp_path / "e.txt"), num_partitions=3, edge_store=path)
    (tmp_path / "e.txt").write_text("not read again")
    report = {}
    again = run_task(spark, "greedy_cover", str(tmp_path / "e.txt"), num_partitions=3, edge_store=path, report=report)
    for out in (first, again):
        assert {r.id: (r.color, r.halt_step) for r in out.collect()} == expected
    assert report["n_edges"] == 8 and spark.catalog.listTables() == []


def test_empty_graph(spark, tmp_path):
    save_edges(spark.createDataFrame([], EDGE), f"file:{tmp_path}/store")
    es = open_edges(spark, f"file:{tmp_path}/store")
    assert greedy_dominating_set(es).count() == 0
    es.release()
