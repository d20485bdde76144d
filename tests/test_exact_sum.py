"""Exact, order-free sums of doubles against math.fsum."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from sparkcover.functions.exact import ExactSum
from sparkcover.operators import neighbors as nb


def sums(df, exact=None):
    exact = exact or ExactSum.of_column(df, "x")
    grouped = df.groupBy("g").agg(*exact.partials(F.col("x"), "s"))
    return {r.g: r.t for r in grouped.select("g", exact.total("s").alias("t")).collect()}


def groups(rng):
    yield [0.1] * 10
    yield [1 / 3] * 3
    yield [1e16, 1.0, -1e16]
    yield [1.0, 2**-53, 2**-106]  # just over a tie
    yield [1.0, 2**-53]  # a tie to even
    yield [-1.0, -(2**-53), -(2**-106)]
    yield [0.0, -0.0, 0.0]
    yield [5.0]
    yield [-0.1, 0.1, -0.1]
    for _ in range(15):
        yield [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9) for _ in range(rng.randrange(1, 60))]


def test_sums_are_exact_and_rounded_once(spark):
    rng = random.Random(1)
    rows = [(g, x) for g, values in enumerate(groups(rng)) for x in values]
    want = {}
    for g, x in rows:
        want.setdefault(g, []).append(x)
    for _ in range(2):
        rng.shuffle(rows)
        got = sums(spark.createDataFrame(rows, "g int, x double").repartition(rng.randrange(1, 9)))
        assert got == {g: math.fsum(v) for g, v in want.items()}


def test_the_whole_range_of_doubles(spark):
    rng = random.Random(2)
    bits = lambda: struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64) & ~(1 << 62)))[0]
    rows = [(g, v) for g in range(12) for v in [bits() for _ in range(rng.randrange(1, 20))]]
    rows += [(20, 5e-324), (20, 5e-324), (21, 2.0**1000), (21, -5e-324), (22, 2.0**-1022), (22, 2.0**-1000)]
    rows = [(g, x) for g, x in rows if math.isfinite(x)]
    want = {}
    for g, x in rows:
        want.setdefault(g, []).append(x)
    assert sums(spark.createDataFrame(rows, "g int, x double")) == {g: math.fsum(v) for g, v in want.items()}


def test_nulls_and_values_that_are_not_finite(spark):
    rows = [(1, None), (2, None), (2, 1.5), (3, math.inf), (3, 1.0), (4, math.inf), (4, -math.inf), (5, math.nan), (6, 0.0)]
    got = sums(spark.createDataFrame(rows, "g int, x double"))
    assert got[1] is None and got[2] == 1.5 and got[3] == math.inf and got[6] == 0.0
    assert math.isnan(got[4]) and math.isnan(got[5])


@pytest.mark.parametrize("limit", [None, 0])
def test_neighbour_sums_do_not_depend_on_partitions(spark, limit):
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(900)]
    xs = {i: rng.uniform(0, 1) for i in range(60)}
    state = spark.createDataFrame(list(xs.items()), "id bigint, x double")
    seen = []
    for parts in (1, 3, 8):
        rng.shuffle(edges)
        g = spark.createDataFrame(edges, "src bigint, dst bigint").repartition(parts)
        es = nb.EdgeSet(g, materialize=True, broadcast_bytes=limit)
        seen.append({r.id: r.sum_x for r in nb.neighbor_x_sum(es, state).collect()})
        es.release()
    want = {}
    for s, d in edges:
        want.setdefault(d, []).append(xs[s])
    assert seen[0] == seen[1] == seen[2] == {d: math.fsum(v) for d, v in want.items()}
