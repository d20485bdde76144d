"""The fractional cover and its rounding on any edge list, against a plain superstep run."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkcover.plans.job import run_task
from sparkcover.plans.lp import lp_rounded_dominating_set, lp_rounded_dominating_set_any

EDGE = "src bigint, dst bigint"


def simulate_lp(edges, k, delta, draw):
    """One dict per vertex; messages are lists of one value or none; exact sums."""
    last = 2 * k * k
    vertices = {i: {"step": 1, "color": -1, "x": 0.0, "deg": 0, "out": [-1.0]} for e in edges for i in e}
    schedule = [(l, m) for l in range(k - 1, -1, -1) for m in range(k - 1, -1, -1)]

    def run(i, v, got):
        s, values = v["step"], [m for box in got for m in box]
        v["step"] += 1
        if s <= last and s % 2:
            l, m = schedule[(s - 1) // 2]
            if sum(x == -1 for x in values) >= math.pow(delta + 1, l / k):
                v["x"] = max(v["x"], 1.0 / math.pow(delta + 1, m / k))
            v["out"] = [v["x"]]
        elif s <= last:
            if math.fsum(values) >= 1:
                v["color"] = -2
            v["out"] = [float(v["color"])]
        elif s == last + 1:
            v["color"], v["deg"], v["out"] = 0, 0, [1.0]
        elif s == last + 2:
            v["deg"], v["out"] = len(values), [float(len(values))]
        elif s == last + 3:
            v["deg"] = max([0, *map(int, values)])
            v["out"] = [float(v["deg"])]
        elif s == last + 4:
            v["deg"] = max([v["deg"], *map(int, values)])
            v["color"] = 2 if draw(i) <= min(1.0, v["x"] * math.log1p(v["deg"])) else 0
            v["out"] = [float(v["color"])]
        else:
            if s == last + 5 and 2.0 not in values:
                v["color"] = 2
            v["out"] = []

    active = set(vertices)
    for _ in range(last + 6):
        box = {}
        for s, d in edges:
            if s in active:
                box.setdefault(d, []).append(vertices[s]["out"])
        for i, got in box.items():
            run(i, vertices[i], got)
        active = set(box)
    return {i: (v["color"], v["x"]) for i, v in vertices.items()}


def half(i):
    return (i * 37 % 101) / 101


def spark_half(vid):
    return (vid * 37 % 101) / F.lit(101.0)


@pytest.mark.parametrize("edges,want", [
    ([(1, 2)], {1: (-1, 0.0), 2: (-1, 1.0)}),
    ([(1, 2), (2, 3)], {1: (-1, 0.0), 2: (-1, 1.0), 3: (-2, 1.0)}),
    ([(1, 2), (2, 3), (3, 1)], {i: (2, 1.0) for i in (1, 2, 3)}),
    ([(1, 1)], {1: (2, 1.0)}),
])
def test_small_directed_graphs(spark, edges, want):
    out = lp_rounded_dominating_set_any(spark.createDataFrame(edges, EDGE), 1, 2, draw=lambda vid: F.lit(1.0))
    assert {r.id: (r.color, r.x) for r in out.collect()} == want


@pytest.mark.parametrize("k,limit", [(1, None), (2, None), (2, 0)])
def test_random_multigraphs(spark, k, limit):
    from sparkcover.operators.neighbors import EdgeSet

    rng = random.Random(100 + k)
    edges = []
    for part in range(25):  # many small graphs in one run: they don't touch each other
        n = rng.randint(2, 7)
        edges += [(50 * part + rng.randrange(n), 50 * part + rng.randrange(n)) for _ in range(rng.randint(1, 3 * n))]
    es = EdgeSet(spark.createDataFrame(edges, EDGE), materialize=True, broadcast_bytes=limit)
    got = lp_rounded_dominating_set_any(es, k, 4, draw=spark_half)
    assert {r.id: (r.color, r.x) for r in got.collect()} == simulate_lp(edges, k, 4, half)
    es.release()


def test_same_as_the_passes_on_symmetric_simple_graphs(spark):
    rng = random.Random(8)
    pairs = {(a, b) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.12}
    g = spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs]], EDGE)
    for k in (1, 2):
        a, b = lp_rounded_dominating_set(g, k), lp_rounded_dominating_set_any(g, k)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_jobs_take_any_edge_list(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n2 3\n# a comment\n\n4 4\n")
    report = {}
    run_task(spark, "lp_cover", str(tmp_path / "e.txt"), num_partitions=3, k=1, delta=2, part_strat=2, output=str(tmp_path / "o"), report=report)
    lines = dict(r.value.split("\t") for r in spark.read.text(str(tmp_path / "o")).collect())
    assert lines == {"1": "(-1,0.0)", "2": "(-1,1.0)", "3": "(-2,1.0)", "4": "(2,1.0)"}
    assert report["path"] == "supersteps" and report["n_edges"] == 3


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        lp_rounded_dominating_set_any(spark.createDataFrame([(1, 2)], EDGE), 0, 1)
    assert lp_rounded_dominating_set_any(spark.createDataFrame([], EDGE), 2).count() == 0
