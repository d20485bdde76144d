"""Greedy rounds on adjacency blocks: the results of the joins, few jobs, no block with a hub's edges."""

import random

import pytest

from sparkcover.operators.blocks import BlockGraph
from sparkcover.operators.neighbors import EdgeSet
from sparkcover.plans.greedy import greedy_dominating_set
from sparkcover.plans.lp import fractional_dominating_set, lp_rounded_dominating_set, round_fractional_ds
from sparkcover.sources.edges import bipartite_edges


def _edges(spark, pairs):
    both = sorted({(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b})
    return spark.createDataFrame(both, "src bigint, dst bigint")


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_same_as_the_joins(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(120)]
    if seed:  # a hub, and vertices of its own
        pairs += [(1000, i) for i in range(50)] + [(1000, 2000 + i) for i in range(80)]
    g = _edges(spark, pairs)
    es = EdgeSet(g, materialize=True, broadcast_bytes=0)
    stats = {}
    got = _rows(greedy_dominating_set(es, stats_out=stats))
    es.release()
    known = {}
    assert got == _rows(greedy_dominating_set(g, delta_state=False, stats_out=known))
    assert stats["rounds"] == known["rounds"]


def test_few_jobs_a_round(spark):
    g = _edges(spark, [(i, i + 1) for i in range(60)])
    es = EdgeSet(g, materialize=True, broadcast_bytes=0)
    stats = {}
    sc = spark.sparkContext
    sc.setJobGroup("few-jobs", "greedy on a path")
    greedy_dominating_set(es, stats_out=stats)
    sc.setLocalProperty("spark.jobGroup.id", None)
    es.release()
    assert stats["rounds"] > 20
    assert len(sc.statusTracker().getJobIdsForGroup("few-jobs")) < 2 * stats["rounds"]


def test_a_hub_is_spread(spark):
    g = _edges(spark, [(0, i) for i in range(1, 2001)])
    graph = BlockGraph(g, 4000)
    held = graph.blocks.map(lambda r: len(r[1][2]["hot_at"]) + len(r[1][2]["cold_src"])).collect()
    graph.release()
    assert sum(held) == 4000
    assert max(held) < 3 * 4000 / graph.n


@pytest.mark.parametrize("k", [1, 3])
def test_lp_same_as_the_joins(spark, k):
    rnd = random.Random(k)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(120)] + [(1000, i) for i in range(50)]
    g = _edges(spark, pairs)
    es = EdgeSet(g, materialize=True, broadcast_bytes=0)
    sc = spark.sparkContext
    group = f"few-jobs-lp-{k}"
    sc.setJobGroup(group, "lp passes")
    frac = fractional_dominating_set(es, k, validate=False)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup(group)) <= 8
    assert _rows(frac) == _rows(fractional_dominating_set(g, k))
    assert _rows(lp_rounded_dominating_set(es, k)) == _rows(lp_rounded_dominating_set(g, k))
    es.release()


def test_rounding_of_some_vertices(spark):
    """Values for other ids than the graph's: the same rows as by joins."""
    g = _edges(spark, [(i, i + 1) for i in range(20)])
    xs = spark.createDataFrame([(i, 0.3) for i in range(3, 30)], "id bigint, x double")
    es = EdgeSet(g, materialize=True, broadcast_bytes=0)
    assert _rows(round_fractional_ds(es, xs, validate=False)) == _rows(round_fractional_ds(g, xs))
    es.release()


def test_pairs_are_dealt_before_they_are_distinct(spark):
    """A task's hash table of pairs is one of a fixed number of parts, not a whole file split's."""
    t = spark.createDataFrame([(1, 2), (1, 2), (None, 3), (4, 2)], "a bigint, b bigint")
    g = bipartite_edges(t, "a", "b")
    plan = g._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Exchange" in x]
    assert lines and all("REPARTITION_BY_NUM" in x for x in lines)
    assert _rows(g) == [(2, 5), (5, 2), (5, 8), (8, 5)]
