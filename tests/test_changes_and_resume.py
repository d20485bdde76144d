"""Greedy rounds that follow changes, and runs that go on after their driver died."""

import os
import random

import pytest

from sparkcover.operators import neighbors as nb
from sparkcover.plans import loop
from sparkcover.plans.greedy import greedy_dominating_set
from sparkcover.plans.job import run_task

from .simulate import both_ways, simulate_greedy

EDGE = "src bigint, dst bigint"


def graphs(rng, parts=6, path=14):
    edges = []
    for i in range(parts):
        n = rng.randint(3, 10)
        edges += both_ways([(100 * i + a, 100 * i + b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.45])
    return edges + both_ways([(9000 + a, 9001 + a) for a in range(path)])


@pytest.mark.parametrize("share,limit", [(0, None), (1, None), (1, 0)])
def test_following_changes_changes_nothing(spark, share, limit):
    edges = graphs(random.Random(31))
    expected, _, _ = simulate_greedy(edges)
    es = nb.EdgeSet(spark.createDataFrame(edges, EDGE), materialize=True, broadcast_bytes=limit)
    stats = {}
    got = greedy_dominating_set(es, stats_out=stats, delta_share=share)
    assert {r.id: (r.color, r.halt_step) for r in got.collect()} == expected
    es.release()
    if share == 1:
        assert all(f for _, f in stats["followed"][1:])
        # a long path settles from its ends: late rounds touch a few edges of many
        assert stats["followed"][-1][0] < 0.5 * len(edges)


def test_decimal_keys(spark):
    edges = [(a - (1 << 40), b - (1 << 40)) for a, b in graphs(random.Random(32), 3, 4)]
    expected, _, _ = simulate_greedy(edges)
    got = greedy_dominating_set(spark.createDataFrame(edges, EDGE), delta_share=1)
    assert {r.id: (r.color, r.halt_step) for r in got.collect()} == expected


def test_pull_reads_the_edges_of_those_who_ask(spark):
    edges = graphs(random.Random(33))
    want = {}
    for s, d in edges:
        if d % 3 == 0 and s % 2 == 0:
            want[d] = max(want.get(d, -1), s * 7)
    from pyspark.sql import functions as F

    for limit in (None, 0):
        es = nb.EdgeSet(spark.createDataFrame(edges, EDGE), materialize=True, broadcast_bytes=limit)
        state = es.edges.select(F.col("src").alias("id")).distinct().withColumn("v", F.col("id") * 7)
        got = es.pull(state, F.col("id") % 3 == 0, ["v"], [F.max("v").alias("m")], F.col("id") % 2 == 0)
        assert {r.id: r.m for r in got.collect()} == want
        es.release()


class Killed(Exception):
    pass


@pytest.mark.parametrize("dies_at", [3])
def test_a_killed_run_goes_on(spark, tmp_path, monkeypatch, dies_at):
    edges = graphs(random.Random(34), 2, 12)
    expected, _, _ = simulate_greedy(edges)
    g = spark.createDataFrame(edges, EDGE)
    folder = f"file:{tmp_path}/run"
    commit = loop.RoundLog.commit

    def until(self, round_no, *rest):
        if round_no > dies_at:
            # dies with the state written and the manifest not
            rest[0].write.mode("overwrite").parquet(f"{self.folder}/state-{round_no:08d}")
            raise Killed
        commit(self, round_no, *rest)

    monkeypatch.setattr(loop.RoundLog, "commit", until)
    with pytest.raises(Killed):
        greedy_dominating_set(g, resume_dir=folder, resume_every=1)
    assert f"round-{dies_at:08d}.json" in os.listdir(tmp_path / "run")
    monkeypatch.setattr(loop.RoundLog, "commit", commit)
    stats = {}
    rounds = []
    monkeypatch.setattr(loop.RoundLog, "due", lambda self, r: rounds.append(r) or True)
    got = greedy_dominating_set(g, resume_dir=folder, resume_every=1, stats_out=stats)
    assert rounds[0] == dies_at + 1  # the earlier rounds weren't run again
    assert {r.id: (r.color, r.halt_step) for r in got.collect()} == expected
    assert stats["rounds"] == len(stats["live_counts"]) and not os.path.exists(tmp_path / "run")


@pytest.mark.parametrize("task,text,dies_at", [
    ("lp_cover", "1 2\n2 1\n2 3\n3 2\n", 2),  # symmetric: by passes
    ("lp_cover", "1 2\n2 3\n3 1\n3 3\n", 8),
    ("greedy_cover", "1 2\n1 3\n2 3\n3 1\n1 1\n", 4),
])
def test_a_killed_job_goes_on(spark, tmp_path, monkeypatch, task, text, dies_at):
    (tmp_path / "e.txt").write_text(text)
    more = {"k": 2, "delta": 2, "part_strat": 0} if task == "lp_cover" else {}

    def job(**resume):
        out = run_task(spark, task, str(tmp_path / "e.txt"), num_partitions=2, **more, **resume)
        return sorted(map(tuple, out.collect()))

    folder = f"file:{tmp_path}/run"
    commit, commits = loop.RoundLog.commit, []

    def until(self, round_no, *rest):
        commits.append(round_no)
        commit(self, round_no, *rest)
        if round_no >= dies_at:
            raise Killed

    monkeypatch.setattr(loop.RoundLog, "due", lambda self, r: True)
    monkeypatch.setattr(loop.RoundLog, "commit", until)
    with pytest.raises(Killed):
        job(resume_dir=folder)
    monkeypatch.setattr(loop.RoundLog, "commit", lambda self, r, *rest: commits.append(-r) or commit(self, r, *rest))
    assert job(resume_dir=folder) == job()
    assert all(-c > dies_at for c in commits if c < 0) and not os.path.exists(tmp_path / "run")


def test_a_folder_of_another_run_is_refused(spark, tmp_path):
    g = spark.createDataFrame(both_ways([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]), EDGE)
    log = loop.RoundLog(spark, f"file:{tmp_path}/run")
    log.commit(2, g, [], {"n_vertices": 1, "n_edges": 1})
    with pytest.raises(ValueError, match="another input"):
        greedy_dominating_set(g, resume_dir=f"file:{tmp_path}/run")
