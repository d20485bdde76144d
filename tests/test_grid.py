"""Message steps on the 2D cells: the same messages, no exchange of edges, no hot list."""

import random

import pytest
from pyspark.sql import functions as F

from sparkcover.operators.grid import GridEdgeSet
from sparkcover.plans.job import run_task

from .simulate import simulate_greedy
from .test_changes_and_resume import graphs
from .test_round2 import folders, held, run_nodes
from .test_store import hub_graph

EDGE = "src bigint, dst bigint"


@pytest.mark.parametrize("n", [1, 7, 9])
def test_messages(spark, n):
    rng = random.Random(n)
    edges = [(rng.randrange(12), rng.randrange(20) - 5) for _ in range(150)] + [(3, 3), (3, 4), (3, 4)]
    g = spark.createDataFrame(edges + [(None, 1), (2, None)], EDGE)
    es = GridEdgeSet(g, n, broadcast_bytes=0)
    assert sorted((r.src, r.dst) for r in es.edges.collect()) == sorted(edges)
    ids = sorted({v for e in edges for v in e})
    state = spark.createDataFrame([(i, i * 11) for i in ids], "id bigint, v bigint")
    with es.loop_plans():
        sent = sorted(map(tuple, es.send(state, ["v"], F.col("id") % 2 == 0).collect()))
        assert sent == sorted((d, s * 11) for s, d in edges if s % 2 == 0)
        got = es.pull(state, F.col("id") % 3 == 0, ["v"], [F.max("v").alias("m")], F.col("id") > 2)
        want = {}
        for s, d in edges:
            if d % 3 == 0 and s > 2:
                want[d] = max(want.get(d, -1), s * 11)
        assert {r.id: r.m for r in got.collect()} == want
        cut = es.restrict(state.where("id > 4").select("id"), sum(i > 4 for i in ids))
        assert sorted((r.src, r.dst) for r in cut.edges.collect()) == sorted((s, d) for s, d in edges if s > 4 and d > 4)
    cut.release()
    es.release()


def test_edges_stay_where_they_are(spark):
    """One exchange takes states to the cells, one the partial results to their vertices."""
    edges = hub_graph()
    before = folders(spark), held(spark)
    es = GridEdgeSet(spark.createDataFrame(edges, EDGE), 9, broadcast_bytes=0)
    with es.loop_plans():
        state = es.partitioned(es.edges.select(F.col("src").alias("id")).distinct())
        state = state.select("id", (F.col("id") * 2).alias("v")).persist()
        state.count()
        got = es.aggregate(state, ["v"], [F.max("v").alias("m")])
        got.count()
        step = es.aggregate(state, ["v"], [F.max("v").alias("m")])
        rows = {r.id: r.m for r in step.collect()}
        names = run_nodes(step._jdf.queryExecution().executedPlan())
        text = step._jdf.queryExecution().executedPlan().toString()
    assert names.count("Exchange") == 2 and "Sort" not in names, (names, text)
    want = {}
    for s, d in edges:
        want[d] = max(want.get(d, -1), 2 * s)
    assert rows == want
    # the hub's edges, a quarter of all, lie in a column of cells
    spread = es.cells.where("src = 0").groupBy("cell").count().collect()
    assert len(spread) == 3 and max(r["count"] for r in spread) < 0.5 * sum(r["count"] for r in spread)
    state.unpersist()
    es.release()
    assert held(spark) <= before[1] and folders(spark) <= before[0]


@pytest.mark.parametrize("task", ["greedy_cover", "lp_cover"])
def test_jobs_on_the_grid(spark, tmp_path, task):
    edges = graphs(random.Random(51), 2, 6)
    (tmp_path / "e.txt").write_text("\n".join(f"{a} {b}" for a, b in edges))
    path, extra = str(tmp_path / "e.txt"), {} if task == "greedy_cover" else {"k": 2, "delta": 6}
    strategy = {} if task == "greedy_cover" else {"part_strat": 2}
    grid = run_task(spark, task, path, num_partitions=7, broadcast_bytes=0, **extra, **strategy)
    if task == "greedy_cover":
        expected, _, _ = simulate_greedy(edges)
        assert {r.id: (r.color, r.halt_step) for r in grid.collect()} == expected
    else:
        plain = run_task(spark, task, path, num_partitions=7, part_strat=0, **extra)
        assert sorted(map(tuple, grid.collect())) == sorted(map(tuple, plain.collect()))


def test_one_way_job_on_the_grid(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n2 3\n")
    out = run_task(spark, "greedy_cover", str(tmp_path / "e.txt"), num_partitions=4, broadcast_bytes=0)
    assert {r.id: r.color for r in out.collect()} == {1: -3, 2: -3, 3: -3}


def test_empty_grid(spark):
    es = GridEdgeSet(spark.createDataFrame([], EDGE), 4, broadcast_bytes=0)
    state = spark.createDataFrame([(1, 2)], "id bigint, v bigint")
    assert es.send(state, ["v"]).count() == 0
    assert es.stats.n_edges == 0
    es.release()
