"""Runtime filters: edges of inactive vertices are dropped before joins that shuffle or sort."""

import random

import pytest
from pyspark.sql import functions as F

from sparkcover.operators import neighbors as nb
from sparkcover.plans.greedy import greedy_dominating_set

from .simulate import simulate_greedy
from .test_changes_and_resume import graphs
from .test_round2 import run_nodes

EDGE = "src bigint, dst bigint"


@pytest.mark.parametrize("ids,filter_bytes", [
    (lambda i: i, None),
    (lambda i: i - 500, None),
    (lambda i: i * 10**15 - 2**62, None),  # a wide range: hashed
    (lambda i: [-(2**63), 2**63 - 1][i] if i < 2 else i, None),
    (lambda i: i, 48),  # one word: full of false positives, never a lost edge
])
def test_only_keeps_every_active_edge(spark, ids, filter_bytes):
    rng = random.Random(6)
    pairs = [(rng.randrange(1000), rng.randrange(1000)) for _ in range(3000)]
    edges = [(ids(a), ids(b)) for a, b in pairs]
    more = {} if filter_bytes is None else {"filter_bytes": filter_bytes}
    es = nb.EdgeSet(spark.createDataFrame(edges, EDGE), **more)
    active = {ids(i) for i in range(0, 1000, 100)}
    sent = spark.createDataFrame([(i,) for i in sorted(active)] + [(2**63 - 2,), (None,)], "id bigint")
    for end, at in (("src", 0), ("dst", 1)):
        got = sorted(map(tuple, es.only(es.edges, end, sent).collect()))
        want = sorted(e for e in edges if e[at] in active)
        rest = list(got)
        for e in want:
            rest.remove(e)
        if filter_bytes is None:
            assert len(rest) <= 5  # edges reaching the join fall with the active share
    es.release()


def test_edges_reaching_a_sorted_join_fall(spark, monkeypatch):
    monkeypatch.setattr(nb, "_HASHED_BYTES", 0)
    edges = [(a, (a * 7 + k) % 400) for a in range(400) for k in range(10)]
    es = nb.EdgeSet(spark.createDataFrame(edges, EDGE), materialize=True, broadcast_bytes=0)
    state = spark.range(400).select("id", (F.col("id") + 1).alias("v"))
    sent = es.send(state, ["v"], F.col("id") < 4)
    assert sorted(map(tuple, sent.collect())) == sorted((d, s + 1) for s, d in edges if s < 4)
    plan = sent._jdf.queryExecution().executedPlan()
    assert "BroadcastHashJoin" in run_nodes(plan)  # with the filter's words, before the sort
    assert es.only(es.edges, "src", state.where("id < 4").select("id")).count() == 40
    es.release()


def test_covers_with_sorted_joins(spark, monkeypatch):
    monkeypatch.setattr(nb, "_HASHED_BYTES", 0)
    edges = graphs(random.Random(61), 2, 6)
    expected, _, _ = simulate_greedy(edges)
    es = nb.EdgeSet(spark.createDataFrame(edges, EDGE), materialize=True, broadcast_bytes=0)
    got = greedy_dominating_set(es, delta_share=1)
    assert {r.id: (r.color, r.halt_step) for r in got.collect()} == expected
    es.release()
