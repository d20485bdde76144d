"""State as base and deltas: the same covers, rounds that write what they changed, nothing left over."""

import random

import pytest
from pyspark.sql import functions as F

from sparkcover.operators import neighbors as nb
from sparkcover.plans.greedy import greedy_dominating_set
from sparkcover.plans.loop import DeltaKeeper

from .simulate import both_ways, simulate_greedy
from .test_changes_and_resume import graphs
from .test_round2 import folders, held

EDGE = "src bigint, dst bigint"


@pytest.mark.parametrize("share,limit", [(0, None), (1, 0)])
def test_same_cover(spark, share, limit):
    edges = graphs(random.Random(41), 2, 7)
    expected, _, _ = simulate_greedy(edges)
    before = folders(spark), held(spark)
    es = nb.EdgeSet(spark.createDataFrame(edges, EDGE), materialize=True, broadcast_bytes=limit)
    got = greedy_dominating_set(es, delta_share=share, delta_state=True)
    assert {r.id: (r.color, r.halt_step) for r in got.collect()} == expected
    es.release()
    # the result's own checkpoint stays
    assert len(folders(spark) - before[0]) == 1 and held(spark) <= before[1]


def test_rows_written_follow_the_changes(spark):
    path = both_ways([(a, a + 1) for a in range(30)])
    expected, _, _ = simulate_greedy(path)
    stats = {}
    got = greedy_dominating_set(
        spark.createDataFrame(path, EDGE), delta_state=True, shrink_ratio=0.0, stats_out=stats
    )
    assert {r.id: (r.color, r.halt_step) for r in got.collect()} == expected
    # a long path settles from its ends: of 31 vertices a late round changes a few
    written = stats["written"]
    assert written[0] == 31 and stats["rounds"] > 6
    assert sum(written) < 0.7 * 31 * stats["rounds"] and min(written) < 10, written


@pytest.mark.parametrize("share,rows", [
    (0.5, [100, 5, 5, 20, 5, 25, 5, 25, 5]),  # every third delta: all of them merged into one
    (0.18, [100, 5, 5, 20, 100, 5, 5, 20, 100]),  # a new base once they hold more than 18 rows
])
def test_deltas_are_laid_over_and_compacted(spark, share, rows):
    es = nb.EdgeSet(spark.createDataFrame(both_ways([(a, a + 1) for a in range(99)]), EDGE), broadcast_bytes=0)
    keeper = DeltaKeeper(spark, es, tick="t", transient=("hit",), compact_share=share)
    with es.loop_plans():
        state = es.partitioned(spark.range(100).select("id")).select(
            "id", F.lit(None).cast("bigint").alias("v"), F.lit(0).alias("t")
        )
        state = keeper.settle(state, force=True)
        want = {i: None for i in range(100)}
        for r in range(1, 9):
            hit = F.col("id") % 20 == r % 4
            new = F.when(hit, F.lit(None) if r == 5 else F.col("id") * r).otherwise(F.col("v")).alias("v")
            state = keeper.settle(state.select("id", new, (F.col("t") + 1).alias("t"), hit.alias("hit")))
            want.update({i: None if r == 5 else i * r for i in want if i % 20 == r % 4})
            got = state.collect()
            assert {x.id: x.v for x in got} == want and {x.t for x in got} == {r}
            assert {x.id for x in got if x.hit} == {i for i in want if i % 20 == r % 4}
        assert keeper.written == rows
    keeper.release()
    es.release()
