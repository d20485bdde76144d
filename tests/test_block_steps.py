"""What a step on adjacency blocks costs besides its work: passes of Python, garbage collections, checks."""

import gc
import re

import numpy as np
import pytest

from sparkcover.operators import neighbors
from sparkcover.operators.blocks import _VERTEX, BlockGraph, _block
from sparkcover.operators.neighbors import EdgeSet
from sparkcover.plans import greedy, lp
from sparkcover.plans.lp import fractional_dominating_set


def _path(spark, n):
    pairs = [(i, i + 1) for i in range(n)]
    return spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src bigint, dst bigint")


def _passes(rdd):
    return set(re.findall(r" PythonRDD\[\d+\]", rdd.toDebugString().decode()))


def _step(block, state, got):
    return {"frozen": gc.get_freeze_count() > 0}, np.maximum(got, 0)


def test_a_step_is_one_pass_of_python(spark):
    graph = BlockGraph(_path(spark, 40), 80)
    first = graph.start(lambda block: ({}, block["deg"].astype(np.int64)), "max")
    second = graph.advance(first, "max", _step, "max")
    assert len(_passes(second) - _passes(first)) == 1
    assert all(s["frozen"] for s in graph.states(second).collect())
    graph.release()


def test_rounds_are_put_together_ahead(spark, monkeypatch):
    """The steps of the second job are there before the first one's count is known."""
    seen = []
    advance, total = BlockGraph.advance, BlockGraph.states
    monkeypatch.setattr(BlockGraph, "advance", lambda *a: seen.append("step") or advance(*a))

    def states(self, state):
        out = total(self, state)
        count = out.map

        def counted(f):
            mapped = count(f)
            add = mapped.sum
            mapped.sum = lambda: (add(), seen.append("counted"))[0]
            return mapped

        out.map = counted
        return out

    monkeypatch.setattr(BlockGraph, "states", states)
    monkeypatch.setattr(greedy, "_ROUNDS_A_JOB", 2)
    es = EdgeSet(_path(spark, 60), materialize=True, broadcast_bytes=0)
    greedy.greedy_dominating_set(es)
    es.release()
    assert seen[: seen.index("counted")].count("step") == 4 * 2 * greedy._ROUNDS_A_JOB - 3


def test_the_guard_on_rounds(spark):
    es = EdgeSet(_path(spark, 20), materialize=True, broadcast_bytes=0)
    known = {}
    wanted = sorted(map(tuple, greedy.greedy_dominating_set(es, stats_out=known).collect()))
    got = greedy.greedy_dominating_set(es, max_rounds=known["rounds"])
    assert sorted(map(tuple, got.collect())) == wanted
    with pytest.raises(RuntimeError):
        greedy.greedy_dominating_set(es, max_rounds=known["rounds"] - 1)
    es.release()


def test_two_covers_check_their_edges_once(spark, monkeypatch):
    asked = []
    check = greedy.check_symmetric_simple
    for module in (greedy, lp):  # wherever it may be called from
        monkeypatch.setattr(module, "check_symmetric_simple", lambda edges: asked.append(1) or check(edges), raising=False)
    es = EdgeSet(_path(spark, 10), materialize=True)
    greedy.greedy_dominating_set(es)
    fractional_dominating_set(es, 1)
    es.release()
    assert len(asked) == 1
    loop = EdgeSet(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "src bigint, dst bigint"), materialize=True)
    for cover in (greedy.greedy_dominating_set, lambda e: fractional_dominating_set(e, 1)):
        with pytest.raises(ValueError):
            cover(loop)
    loop.release()


def test_blocks_are_read_by_count(spark, monkeypatch):
    """Rows of a few numbers go to Python in batches of a row count, whose bytes aren't added up for each row."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    edges, seen, before = _path(spark, 40), [], spark.conf.get(key)
    frame = type(edges)
    call = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: seen.append(spark.conf.get(key)) or call(self, *a, **b))
    graph = BlockGraph(edges, 80)
    graph.load(spark.range(41).selectExpr("id", "id as value"))
    assert seen == [str((1 << 31) - 1)] * 2
    assert spark.conf.get(key) == before
    widths = graph.blocks.map(lambda r: [r[1][2][a].itemsize for a in ("deg", "cold_src", "cold_starts", "hot_starts")]).collect()
    assert widths and all(w == [4, 4, 4, 4] for w in widths)
    graph.release()


def test_edges_of_a_block_lie_by_where_they_lead():
    """Also with more partitions than 8 or 16 bits number, and ids beyond 32 bits."""
    rnd = np.random.default_rng(5)
    for n in (3, 300, 100_000):
        ids = np.unique(rnd.integers(0, 1 << 40, 50))
        src, dst = rnd.choice(ids, 400), rnd.integers(0, 60, 400) << 33
        to = dst % 7919 * 31 % n
        none = np.zeros(len(ids), np.int64)
        kind = np.repeat([0, _VERTEX], [400, len(ids)])
        columns = kind, np.concatenate([src, ids]), np.concatenate([dst, none + 9]), np.concatenate([to, none])
        block = _block(none, *(c[p] for p in [rnd.permutation(len(kind))] for c in columns))
        starts, reached = block["cold_starts"].tolist(), block["reached"]
        got = []
        for q, lo, hi in block["routes"]:
            for i in range(lo, hi):
                stop = starts[i + 1] if i + 1 < len(starts) else 400
                got += [(q, int(reached[i]), int(ids[s])) for s in block["cold_src"][starts[i] : stop]]
        assert sorted(got) == sorted(zip(to.tolist(), dst.tolist(), src.tolist(), strict=True))
        assert [g[:2] for g in got] == sorted(g[:2] for g in got)
        assert len(reached) == len(set(zip(to.tolist(), dst.tolist(), strict=True)))


def test_edges_are_written_for_joins_only(spark, monkeypatch):
    """Blocks are made from held edges once; rounds of joins read edges from the checkpoint folder."""
    written, checkpointed = [], neighbors.checkpointed
    monkeypatch.setattr(neighbors, "checkpointed", lambda df: written.append(df.columns) or checkpointed(df))
    edges = _path(spark, 30)
    by_joins = sorted(map(tuple, greedy.greedy_dominating_set(edges).collect()))
    assert written[0] == ["src", "dst"]
    written.clear()
    monkeypatch.setattr(neighbors, "broadcast_limit_bytes", lambda spark: 0)
    assert sorted(map(tuple, greedy.greedy_dominating_set(edges).collect())) == by_joins
    assert not written
