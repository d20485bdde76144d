import pytest
from pyspark.sql import functions as F

from sparkcover.functions.graph import partition_1d, partition_2d
from sparkcover.operators import neighbors as nb
from sparkcover.operators.partition import partition_edges, partition_sizes
from sparkcover.sources.edges import (
    bipartite_edges,
    edge_lines,
    graph_size,
    parse_edge_lines,
    read_edge_list,
    symmetrize,
    vertices_from_edges,
)


def test_graph_size_toy(toy):
    row = graph_size(toy).first()
    assert (row["n_vertices"], row["n_edges"]) == (7, 18)


def test_in_degree_toy(toy):
    got = {r["id"]: r["deg"] for r in nb.in_degree(toy).collect()}
    assert got == {1: 2, 2: 4, 3: 4, 4: 2, 5: 3, 6: 2, 7: 1}


def test_twohop_max_degree_toy(toy):
    got = {r["id"]: r["deg2"] for r in nb.twohop_max_degree(toy).collect()}
    assert got == {v: 4 for v in range(1, 8)}


def test_partition_1d_golden(toy):
    got = {r["src"]: r["pid"] for r in toy.select("src", partition_1d(F.col("src"), 4).alias("pid")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 0, 5: 1, 6: 2, 7: 3}


def test_partition_2d_golden(toy):
    got = {
        (r["src"], r["dst"]): r["pid"]
        for r in toy.select("src", "dst", partition_2d(F.col("src"), F.col("dst"), 4).alias("pid")).collect()
    }
    assert got == {
        (1, 2): 2, (2, 1): 1, (1, 3): 3, (3, 1): 3, (2, 3): 1, (3, 2): 2, (2, 4): 0, (4, 2): 0,
        (2, 6): 0, (6, 2): 0, (3, 5): 3, (5, 3): 3, (3, 7): 3, (7, 3): 3, (4, 5): 1, (5, 4): 2,
        (5, 6): 2, (6, 5): 1,
    }


def test_partition_wraps_large_ids(spark):
    # src * prime overflows 64 bits: the id must still be a valid partition
    df = spark.createDataFrame([(9000, 1), (2**40 + 7, 3), (2**62, 5)], "src bigint, dst bigint")
    for n in (4, 9, 20):
        pids = [r[0] for r in df.select(partition_2d(F.col("src"), F.col("dst"), n)).collect()]
        assert all(0 <= p < n for p in pids)
    # known value: abs(wrap(9000 * P)) % 8, computed with Python integers
    p = 1125899906842597
    w = (9000 * p) % 2**64
    w = w - 2**64 if w >= 2**63 else w
    assert df.select(partition_1d(F.col("src"), 8)).first()[0] == abs(w) % 8


def test_partition_edges_places_rows(toy):
    placed = partition_edges(toy, "2d", 4)
    tagged = placed.select("src", "dst", F.spark_partition_id().alias("p"),
                           partition_2d(F.col("src"), F.col("dst"), 4).alias("pid"))
    assert tagged.where("p <> pid").count() == 0
    sizes = {r["pid"]: r["n_edges"] for r in partition_sizes(toy, "2d", 4).collect()}
    assert sum(sizes.values()) == 18


def test_edge_list_parse(spark):
    rows = ["# comment", "", "1 2", "2\t3 0.5", "3   4", "5 5"]
    df = spark.createDataFrame([(x,) for x in rows], "value string")
    got = sorted(tuple(r) for r in parse_edge_lines(df).collect())
    assert got == [(1, 2), (2, 3), (3, 4), (5, 5)]


def test_edge_list_bad_line_raises(spark):
    df = spark.createDataFrame([("1 2",), ("7",)], "value string")
    with pytest.raises(Exception, match="Invalid line"):
        parse_edge_lines(df).collect()
    df = spark.createDataFrame([("1 x",)], "value string")
    with pytest.raises(Exception):
        parse_edge_lines(df).collect()


def test_read_edge_list_roundtrip(spark, toy, tmp_path):
    path = str(tmp_path / "edges")
    edge_lines(toy).write.text(path)
    back = read_edge_list(spark, path, num_partitions=4)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, toy.collect()))


def test_symmetrize_and_vertices(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3)], "src bigint, dst bigint")
    sym = sorted(map(tuple, symmetrize(df).collect()))
    assert sym == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert sorted(r[0] for r in vertices_from_edges(df).collect()) == [1, 2, 3]


def test_bipartite_edges(spark):
    t = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (None, 3)], "a bigint, b bigint")
    got = sorted(map(tuple, bipartite_edges(t, "a", "b").collect()))
    assert got == [(2, 21), (4, 21), (21, 2), (21, 4)]


def test_hot_cold_split_matches_broadcast(spark):
    # a hub holding most edges: force the shuffle path and compare with broadcast
    edges = [(0, i) for i in range(1, 200)] + [(i, 0) for i in range(1, 200)] + [(1, 2), (2, 1)]
    g = spark.createDataFrame(edges, "src bigint, dst bigint")
    state = vertices_from_edges(g).select("id", (F.col("id") % 3).alias("v"))
    small = nb.EdgeSet(g)
    forced = nb.EdgeSet(g, broadcast_bytes=0)
    assert forced.state_fits_broadcast(1) is False
    a = small.aggregate(state, ["v"], [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")])
    b = forced.aggregate(state, ["v"], [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    hot = [r[0] for r in forced._hot_cold()[0].collect()]
    assert hot == [0]


def test_neighbor_x_sum(toy):
    xs = vertices_from_edges(toy).select("id", F.lit(0.5).alias("x"))
    got = {r["id"]: r["sum_x"] for r in nb.neighbor_x_sum(toy, xs).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 2.0, 4: 1.0, 5: 1.5, 6: 1.0, 7: 0.5}


def test_an_edge_set_knows_its_vertices_and_degrees(spark):
    """The table behind the statistics serves vertices and hot sources: no pass over the edges is added."""
    g = spark.createDataFrame([(1, 9), (2, 9), (2, 9), (9, 3), (3, 3)], "src bigint, dst bigint")
    es = nb.EdgeSet(g, materialize=True, checkpoint=False)
    assert es._folder is None
    assert sorted(r.id for r in es.vertices().collect()) == [1, 2, 3, 9]
    plan = es.vertices()._jdf.queryExecution().optimizedPlan()
    assert plan.toString().startswith("Project [id") and "src" not in plan.toString().splitlines()[0]
    assert {(r.id, r.out, r.inn) for r in es._degrees.collect()} == {(1, 1, 0), (2, 2, 0), (3, 1, 2), (9, 1, 3)}
    assert es.stats == nb.graph_stats(g)
    hot, hot_edges, cold_edges = nb.EdgeSet(g, materialize=True, n_parts=5)._hot_cold()
    assert sorted(r.src for r in hot.collect()) == [2]
    assert (hot_edges.count(), cold_edges.count()) == (2, 3)
    es.release()
    assert sorted(r.id for r in es.vertices().collect()) == [1, 2, 3, 9]


def test_both_directions_come_from_one_pass(spark):
    rows = [(1, 5), (1, 5), (2, 5), (2, None), (None, 1)]
    g = bipartite_edges(spark.createDataFrame(rows, "a bigint, b bigint"), "a", "b")
    assert sorted(map(tuple, g.collect())) == [(2, 11), (4, 11), (11, 2), (11, 4)]
    assert "Union" not in g._jdf.queryExecution().optimizedPlan().toString()
