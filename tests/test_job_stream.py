import pytest

from sparkcover.plans.job import run_task
from sparkcover.streaming.wordcount import start_popular_char_count

from .test_text import INPUT_LINES

TOY = "1 2\n2 1\n1 3\n3 1\n2 3\n3 2\n2 4\n4 2\n2 6\n6 2\n3 5\n5 3\n3 7\n7 3\n4 5\n5 4\n5 6\n6 5"


def test_run_task_greedy_cover(spark, tmp_path):
    p = tmp_path / "edges.txt"
    p.write_text(TOY)
    out = tmp_path / "out"
    report = {}
    res = run_task(spark, "greedy_cover", str(p), num_partitions=4, output=str(out), report=report)
    assert report["n_vertices"] == 7 and report["n_edges"] == 18 and report["rounds"] == 3
    lines = sorted(spark.read.text(str(out)).collect(), key=lambda r: r[0])
    assert [r[0] for r in lines][:3] == ["1\t(-4,11)", "2\t(-5,11)", "3\t(-5,11)"]
    assert res.count() == 7


def test_run_task_lp_cover(spark, tmp_path):
    p = tmp_path / "edges.txt"
    p.write_text(TOY)
    for strat in (0, 1, 2):
        res = run_task(spark, "lp_cover", str(p), num_partitions=4, k=2, delta=5, part_strat=strat)
        got = {r["id"]: r["color"] for r in res.collect()}
        assert got == {1: 0, 2: 2, 3: 2, 4: 0, 5: 2, 6: 0, 7: 0}


def test_run_task_arguments(spark, tmp_path):
    p = tmp_path / "g.txt"
    p.write_text("1 2\n2 1")
    with pytest.raises(ValueError):
        run_task(spark, "pagerank", str(p), num_partitions=2)
    with pytest.raises(ValueError):
        run_task(spark, "greedy_cover", str(p))
    with pytest.raises(ValueError):
        run_task(spark, "lp_cover", str(p), num_partitions=2, k=2)


def test_streaming_popular_chars(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "part1.txt").write_text("\n".join(INPUT_LINES[:5]) + "\n")
    (src / "part2.txt").write_text("\n".join(INPUT_LINES[5:]) + "\n")
    seen = []

    def sink(df, batch_id):
        seen.append({r["ch"]: r["n"] for r in df.collect()})

    q = start_popular_char_count(
        spark, str(src), 2, str(tmp_path / "ckpt"), sink, trigger_once=True
    )
    q.awaitTermination(120)
    assert seen[-1] == dict(
        a=4, b=1, c=1, e=6, f=1, h=1, i=1, l=1, n=4, o=2, p=2, r=2, t=2, u=1, v=1
    )
