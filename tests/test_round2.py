"""Exact keys, resource hygiene, any-edge-list jobs, validity checks, plan shapes of the loops."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sparkcover.functions.graph import (
    BLACK,
    CHOSEN,
    GRAY,
    NOT_CHOSEN,
    partition_2d,
    rank_key,
    rank_key_id,
    rank_key_wt,
    rank_mode,
)
from sparkcover.operators import neighbors as nb
from sparkcover.operators.checks import bad_colors, cover_report, undominated_vertices
from sparkcover.plans.greedy import greedy_dominating_set, greedy_dominating_set_directed
from sparkcover.plans.job import run_task
from sparkcover.plans.loop import kept_layout
from sparkcover.plans.lp import lp_rounded_dominating_set, round_fractional_ds
from sparkcover.session import parse_bytes
from sparkcover.sources.sinks import write_result_parquet, write_result_text

from .simulate import both_ways, simulate_greedy

EDGE = "src bigint, dst bigint"


@pytest.mark.parametrize("mode", ["long", "decimal"])
def test_rank_keys_are_exact(spark, mode):
    wts = [0, 1, (1 << 21) - 1, 1 << 21, 6_000_000, 1 << 30, (1 << 31) - 1]
    ids = [0, 1, 200, (1 << 32) - 1]
    if mode == "decimal":
        ids += [-(1 << 63), -(1 << 63) + 1, -1, (1 << 63) - 1]
        wts += [1 << 40]
    rows = [(w, i) for w in wts for i in ids]
    df = spark.createDataFrame(rows, "wt bigint, id bigint")
    key = rank_key(F.col("wt"), F.col("id"), mode)
    got = df.select("wt", "id", rank_key_wt(key, mode).alias("w"), rank_key_id(key, mode).alias("i"), key.alias("k")).collect()
    assert all((r.wt, r.id) == (r.w, r.i) for r in got)
    by_key = sorted(got, key=lambda r: r.k)
    assert [(r.wt, -r.id) for r in by_key] == sorted((w, -i) for w, i in rows)


def test_rank_mode_looks_at_in_degree(spark):
    assert rank_mode(0, 5, 1 << 31) == "decimal" and rank_mode(0, 5, 3) == "long"
    assert rank_mode(-1, 5, 3) == "decimal"
    s = nb.graph_stats(spark.createDataFrame([(1, 9), (2, 9), (2, 9), (3, 9)], EDGE))
    assert (s.max_in_degree, s.max_out_degree) == (4, 2)


def test_sizes_are_parsed():
    assert [parse_bytes(x) for x in ("10485760", "64MB", "100m", "1g", "1 GiB", "7b", "-1")] == [
        10485760, 64 << 20, 100 << 20, 1 << 30, 1 << 30, 7, -1
    ]
    with pytest.raises(ValueError):
        parse_bytes("lots")


def test_round_guard_raises(spark):
    path = spark.createDataFrame(both_ways([(1, 2), (2, 3), (3, 4)]), EDGE)
    with pytest.raises(RuntimeError, match="still live"):
        greedy_dominating_set(path, max_rounds=1)
    assert greedy_dominating_set(path, max_rounds=50).where("halt_step is null").count() == 0


def folders(spark):
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {d for d in os.listdir(top) if os.listdir(f"{top}/{d}")}


def held(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_covers_leave_only_their_results(spark):
    rng = random.Random(5)
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.1]
    g = spark.createDataFrame(both_ways(pairs), EDGE)
    before, frames = folders(spark), held(spark)
    out = greedy_dominating_set(g)
    assert len(folders(spark) - before) == 1 and held(spark) == frames
    lp = lp_rounded_dominating_set(g, 2)
    # the fractional phase's result, which the caller of both phases never sees, and the final one
    assert len(folders(spark) - before) <= 3 and held(spark) == frames
    directed = greedy_dominating_set_directed(g)
    assert held(spark) == frames and len(folders(spark) - before) <= 4
    assert {r.id for r in out.collect()} == {r.id for r in lp.collect()} == {r.id for r in directed.collect()}
    with pytest.raises(ValueError):
        greedy_dominating_set(spark.createDataFrame([(1, 2)], EDGE))
    assert held(spark) == frames and len(folders(spark) - before) <= 4


@pytest.mark.parametrize("text,want", [
    ("1 2\n2 3\n", {1: "(-3,0)", 2: "(-3,1)", 3: "(-3,1)"}),
    ("1 1\n", {1: "(-5,7)"}),
    ("1 2\n2 1\n1 2\n2 1\n", {1: "(-5,7)", 2: "(-4,7)"}),
    ("1 2\n2 3\n3 1\n", {1: "(-5,1)", 2: "(-4,7)", 3: "(-3,7)"}),
])
def test_jobs_take_any_edge_list(spark, tmp_path, text, want):
    (tmp_path / "e.txt").write_text(text)
    report = {}
    run_task(spark, "greedy_cover", str(tmp_path / "e.txt"), num_partitions=3, output=str(tmp_path / "o"), report=report)
    lines = dict(r.value.split("\t") for r in spark.read.text(str(tmp_path / "o")).collect())
    assert {int(k): v for k, v in lines.items()} == want
    assert report["path"] == "supersteps" and report["converged"] is True
    with pytest.raises(Exception, match="already exists"):
        run_task(spark, "greedy_cover", str(tmp_path / "e.txt"), num_partitions=3, output=str(tmp_path / "o"))


def test_job_reports_a_run_that_never_stops(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n1 3\n2 3\n3 1\n3 2\n11 12\n11 13\n12 13\n13 11\n13 12\n21 22\n22 21\n")
    report = {}
    out = run_task(spark, "greedy_cover", str(tmp_path / "e.txt"), num_partitions=3, report=report).collect()
    assert report["converged"] is False
    assert {r.id: r.converged for r in out} == {r.id: r.id > 20 for r in out}  # each component by itself
    assert {r.id % 10: r.color for r in out if r.id < 20} == {1: -3, 2: -5, 3: -4}
    assert {r.id: r.halt_step for r in out if r.id > 20} == {21: 7, 22: 7}


def test_writers_keep_existing_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, -5, 7)], "id bigint, color int, halt_step int")
    write_result_text(df, str(tmp_path / "t"))
    write_result_parquet(df, str(tmp_path / "p"))
    with pytest.raises(Exception):
        write_result_text(df, str(tmp_path / "t"))
    write_result_parquet(df, str(tmp_path / "p"), mode="overwrite")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_rounding_checks_its_input(spark):
    g = spark.createDataFrame([(1, 2), (2, 3)], EDGE)
    x = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "id bigint, x double")
    with pytest.raises(ValueError):
        round_fractional_ds(g, x)


def test_restrict_splits_hubs(spark):
    pairs = both_ways([(0, i) for i in range(1, 150)] + [(i, i + 1) for i in range(1, 100)])
    g = spark.createDataFrame(pairs, EDGE)
    live = spark.createDataFrame([(i,) for i in range(0, 150, 1) if i % 3], "id bigint").union(
        spark.createDataFrame([(0,)], "id bigint")
    )
    want = sorted((a, b) for a, b in pairs if (a % 3 or a == 0) and (b % 3 or b == 0))
    for limit in (None, 0):
        es = nb.EdgeSet(g, materialize=True, broadcast_bytes=limit)
        out = es.restrict(live, 101)
        assert sorted(map(tuple, out.edges.collect())) == want
        out.release()
        es.release()


def run_nodes(plan):
    """Node names of a plan as it was run; what made the cached frames isn't part of it."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return run_nodes(plan.executedPlan())
    if name.endswith("QueryStage"):
        return run_nodes(plan.plan())
    children = plan.children()
    return [name, *[n for k in range(children.length()) for n in run_nodes(children.apply(k))]]


def test_message_step_moves_only_messages(spark):
    """Without broadcasts: one exchange a step, and the cached edges aren't sorted again."""
    pairs = both_ways([(a, a + 1) for a in range(200)])
    with kept_layout(spark):
        es = nb.EdgeSet(spark.createDataFrame(pairs, EDGE), materialize=True, broadcast_bytes=0)
        es._hot_cold()
        ids = es.edges.select(F.col("src").alias("id")).distinct()
        state = es.partitioned(ids).select("id", (F.col("id") * 2).alias("v")).persist()
        state.count()
        got = es.aggregate(state, ["v"], [F.max("v").alias("m")])
        step = es.join_back(state, got).select("id", "m")
        assert len(step.collect()) == 201
        names = run_nodes(step._jdf.queryExecution().executedPlan())
        assert names.count("Exchange") == 1, names
        assert "Sort" not in names and "ShuffledHashJoin" in names
        state.unpersist()
        es.release()


def test_compact_on_the_shuffle_path(spark):
    rng = random.Random(21)
    edges = []
    for i in range(15):
        n = rng.randint(3, 9)
        edges += both_ways([(100 * i + a, 100 * i + b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5])
    expected, _, _ = simulate_greedy(edges)
    es = nb.EdgeSet(spark.createDataFrame(edges, EDGE), materialize=True, broadcast_bytes=0)
    got = {r.id: (r.color, r.halt_step) for r in greedy_dominating_set(es).collect()}
    es.release()
    assert got == expected


def test_checks_find_planted_faults(spark):
    g = spark.createDataFrame(both_ways([(1, 2), (2, 3), (3, 4), (4, 5)]), EDGE)
    cover = spark.createDataFrame([(1, -4), (2, -5), (3, -4), (4, -4), (5, -9)], "id bigint, color int")
    assert sorted(r.id for r in undominated_vertices(g, cover, BLACK).collect()) == [4, 5]
    assert [r.id for r in bad_colors(cover, [GRAY, BLACK]).collect()] == [5]
    assert tuple(cover_report(g, cover, BLACK, [GRAY, BLACK]).first()) == (5, 1, 2, 1)
    for out, chosen, other in ((greedy_dominating_set(g), BLACK, GRAY), (lp_rounded_dominating_set(g, 2), CHOSEN, NOT_CHOSEN)):
        assert undominated_vertices(g, out, chosen).count() == 0 and bad_colors(out, [chosen, other]).count() == 0


def test_partition_2d_nonsquare_values(spark):
    """n = 20, worked out with Python integers: 5 columns of 4 rows."""
    p = 1125899906842597

    def mixed(v):
        w = v * p % 2**64
        return abs(w - 2**64 if w >= 2**63 else w)

    rows = [(a, b) for a in range(0, 4000, 97) for b in (1, 5000, 2**40 + 3)]
    df = spark.createDataFrame(rows, EDGE)
    got = {(r[0], r[1]): r[2] for r in df.select("src", "dst", partition_2d(F.col("src"), F.col("dst"), 20)).collect()}
    want = {}
    for a, b in rows:
        col = mixed(a) % 20 // 4
        want[a, b] = col * 4 + (mixed(b) % 4)
    assert got == want
